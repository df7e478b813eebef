"""Chat formatting with typed content parts, by DataFrame functions only.

A turn's content is an ordered array of parts ``struct<kind, text, ref, units>``. Text parts are written with control
characters escaped; an image, audio or document part becomes one placeholder, its reference is recorded in order and it
counts for a number of expanded tokens given by its units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,units:bigint>"
BEGIN, OPEN, SHUT, END = "<s>", "<|", "|>\n", "<|end|>\n"

#: Tokens that one unit of an attachment expands to (an image tile, a second of audio, a document page).
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 640}

#: Escaped one after the other; undone in reverse. No text can then hold the "<" or "[" that control strings begin with.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """One text part; null is an empty text."""
    return F.array(
        F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units"))
    )


def _visit(part: Column) -> Column:
    """A part's text in the output. An unknown kind is flattened as a document; a null part is empty."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    known = F.when(kind.isin(*UNIT_TOKENS), kind).otherwise("document")
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), known, F.lit("|>")))


def _units(part: Column) -> Column:
    per = F.lit(UNIT_TOKENS["document"])
    for kind, tokens in UNIT_TOKENS.items():
        per = F.when(part["kind"] == kind, F.lit(tokens)).otherwise(per)
    return F.when(F.coalesce(part["kind"], F.lit("text")) == "text", F.lit(0)).otherwise(per * F.coalesce(part["units"], F.lit(1))).cast("long")


def _text_tokens(part: Column) -> Column:
    return F.when(F.coalesce(part["kind"], F.lit("text")) == "text", F.regexp_count(F.coalesce(part["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _before(values: Column) -> Column:
    """The sum of the values before each, as an array built by appending."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("sums"))
    return F.aggregate(values, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["sums"], F.array(a["sum"])).alias("sums")))["sums"]


#: Turns that are added up together. Appending copies an array each time, so arrays stay short.
_RUN = 256


def _begins(lengths: Column, first: int) -> Column:
    """Where each piece begins, for a conversation of any number of turns: within runs of turns, then from run to run."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _RUN).cast("int")), lambda k: F.slice(lengths, k * _RUN + 1, F.lit(_RUN)))
    return F.flatten(F.zip_with(F.transform(runs, _before), _before(F.transform(runs, _sum)), lambda inside, at: F.transform(inside, lambda x: x + at + first)))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", train_on: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans, attachments, attachment_tokens, text_tokens.

    ``formatted`` is ``<s>`` and, for each turn by number, ``<|role|>``, a line break, the parts and ``<|end|>`` with a
    line break. ``loss_spans`` are the 1-based start and length, in code points, of the contents of turns of the role
    ``train_on``, without markers. ``attachments`` are (place, kind, ref) in order of appearance. Turns with equal
    numbers follow their role, then their parts (kind, then text as given); a null number comes first, a null role is
    empty, a null text is empty, a null id is a conversation of its own, an empty table gives no rows. Columns other than
    the four named are not read. A conversation is one output row, so its turns meet in one task.
    """
    p = F.coalesce(F.col(f"`{parts}`"), F.array().cast(f"array<{PART}>"))
    who = F.coalesce(F.col(f"`{role}`"), F.lit(""))
    one = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), who.alias("role"), p.alias("parts")).alias("t"))
    chats = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("sorted"))
    refs = lambda parts: F.transform(
        F.filter(parts, lambda x: F.coalesce(x["kind"], F.lit("text")) != "text"),
        lambda x: F.struct(F.when(x["kind"].isin(*UNIT_TOKENS), x["kind"]).otherwise("document").alias("kind"), x["ref"].alias("ref")),
    )
    visited = lambda t: F.struct(
        t["role"].alias("role"), F.array_join(F.transform(t["parts"], _visit), "").alias("body"), refs(t["parts"]).alias("refs"),
        _sum(F.transform(t["parts"], _units)).alias("units"), _sum(F.transform(t["parts"], _text_tokens)).alias("words"),
    )
    chats = chats.withColumn("ts", F.transform("sorted", visited)).drop("sorted")
    piece = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SHUT), t["body"], F.lit(END))
    chats = chats.withColumn("pieces", F.transform("ts", piece))
    begins = _begins(F.transform("pieces", lambda x: F.length(x).cast("long")), len(BEGIN))
    spans = F.filter(
        F.transform(
            F.arrays_zip("ts", F.col("begins")),
            lambda z: F.when(
                z["ts"]["role"] == train_on,
                F.struct(
                    (z["begins"] + len(OPEN) + F.length(escape(z["ts"]["role"])) + len(SHUT) + 1).cast("long").alias("start"),
                    F.length(z["ts"]["body"]).cast("long").alias("length"),
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    attached = F.flatten(F.transform("ts", lambda t: t["refs"]))
    return chats.withColumn("begins", begins).select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.concat(F.lit(BEGIN), F.array_join("pieces", "")).alias("formatted"),
        spans.alias("loss_spans"),
        F.transform(attached, lambda a, k: F.struct((k + 1).alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"))).alias("attachments"),
        _sum(F.transform("ts", lambda t: t["units"])).alias("attachment_tokens"),
        _sum(F.transform("ts", lambda t: t["words"])).alias("text_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>, unescaped; placeholders stay as they are."""
    rest = 2147483647
    pieces = F.filter(F.split(F.substring(formatted, len(BEGIN) + 1, rest), r"<\|end\|>\n", -1), lambda x: x != "")
    head = lambda x: F.substring_index(x, SHUT, 1)
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring(head(x), len(OPEN) + 1, rest)).alias("role"),
            unescape(F.substring(x, F.length(head(x)) + len(SHUT) + 1, F.lit(rest))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")
