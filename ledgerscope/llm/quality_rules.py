"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.text import SPACE_CLASS

SYMBOLS = "#*$%&|<>"

#: Frequent function words of four languages, used by the stop-word ratio.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "it", "that", "for", "on", "with", "as", "was", "are", "be", "by", "this", "at", "from", "or", "an"],
    "de": ["der", "die", "das", "und", "ist", "in", "den", "von", "zu", "mit", "sich", "auf", "für", "im", "dem", "ein", "eine", "als", "auch", "nicht"],
    "fr": ["le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "que", "qui", "dans", "pour", "sur", "pas", "par", "est", "avec", "au"],
    "es": ["el", "la", "los", "las", "de", "y", "en", "que", "un", "una", "por", "con", "para", "se", "del", "no", "es", "su", "al", "lo"],
}


@dataclass(frozen=True)
class Rule:
    """A document fails when ``measure`` is below ``least`` or above ``most``; a bound of None is open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The default table. Ratios are by words, by word characters or by lines.
RULES = (
    Rule("too_short", "n_words", least=50),
    Rule("repeated_words", "repeat_ratio", most=0.5),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("word_length", "mean_word_chars", least=1.5, most=30.0),
    Rule("stop_words", "stop_ratio", least=0.02),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
    Rule("shouting", "upper_ratio", most=0.6),
)


#: Texts of up to so many words sort their windows as single longs, the place in the low bits and 48 bits of hash or more;
#: longer ones as pairs of hash and place. Both confirm equal hashes on the words, so the results are the same.
SHORT = 1 << 16


def _measures(text: Column, stop_words: list[str]) -> list[tuple[str, Column]]:
    """Columns in the order in which they are made; each may use those before it."""
    w, n = F.col("__w"), F.size("__w")
    none = F.array().cast("array<bigint>")
    # a window begins at every word but the last two
    hashes = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    h, any_twice = F.col("__h"), F.col("__twice")
    high = F.col("__high")
    packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long"))))
    s = F.col("__s")
    equal = lambda i, j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))
    place = lambda x: x.bitwiseAND(F.bitwise_not(high)).cast("int")
    near = lambda x, y: F.coalesce((x.bitwiseAND(high) == y.bitwiseAND(high)) & equal(place(x), place(y)), F.lit(False))
    short = F.transform(
        F.filter(s, lambda x, k: near(x, F.get(s, k + 1)) | near(x, F.get(s, k - 1))), lambda x: x.bitwiseAND(F.bitwise_not(high))
    )
    pairs = F.col("__p")
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & equal(x["i"].cast("int"), y["i"].cast("int")), F.lit(False))
    long_ = F.transform(F.filter(pairs, lambda x, k: same(x, F.get(pairs, k + 1)) | same(x, F.get(pairs, k - 1))), lambda x: x["i"])
    r = F.col("__r")
    # a window at i covers i, i + 1 and i + 2; what the next window covers is left to it
    covered = F.aggregate(
        F.transform(r, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(r, k + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = sorted({v for x in stop_words for v in (x, x.capitalize(), x.upper())})
    return [
        ("__w", F.filter(F.split(text, SPACE_CLASS + "+", -1), lambda x: x != "")),
        ("n_words", n.cast("long")),
        ("__h", hashes),
        ("__twice", F.size(F.array_distinct("__h")) < F.size("__h")),
        ("__high", F.call_function("shiftleft", F.lit(-1).cast("long"), F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double"))).cast("int"))),
        ("__s", F.when(any_twice & (n <= SHORT), packed).otherwise(none)),
        (
            "__p",
            F.when(any_twice & (n > SHORT), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))).otherwise(
                F.array().cast("array<struct<h:bigint,i:bigint>>")
            ),
        ),
        ("__r", F.sort_array(F.when(n <= SHORT, short).otherwise(long_))),
        ("n_repeat_words", F.when(any_twice, covered).otherwise(F.lit(0).cast("long"))),
        ("word_chars", F.length(F.array_join(w, "")).cast("long")),
        ("n_symbols", F.regexp_count(text, F.lit("[" + SYMBOLS + "]")).cast("long")),
        ("__l", lines),
        ("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")),
        ("__stop", F.size(F.filter(w, lambda x: x.isin(stops)))),
        ("__upper", F.regexp_count(text, F.lit("[A-Z]"))),
        ("repeat_ratio", F.try_divide(F.col("n_repeat_words"), F.col("n_words"))),
        ("symbol_ratio", F.try_divide(F.col("n_symbols"), F.col("word_chars"))),
        ("mean_word_chars", F.try_divide(F.col("word_chars"), F.col("n_words"))),
        ("stop_ratio", F.try_divide(F.col("__stop"), F.col("n_words"))),
        ("dup_line_ratio", F.try_divide(F.col("n_dup_lines"), F.size("__l"))),
        ("upper_ratio", F.try_divide(F.col("__upper"), F.col("word_chars"))),
    ]


#: What a rule may measure, and what is returned for every row.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("repeat_ratio", "symbol_ratio", "mean_word_chars", "stop_ratio", "dup_line_ratio", "upper_ratio")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row fails. An undefined ratio (no words) fails no bound."""
    bounds = []
    for r in rules:
        m = F.col(r.measure)
        low = m < r.least if r.least is not None else F.lit(False)
        high = m > r.most if r.most is not None else F.lit(False)
        bounds.append(F.when(F.coalesce(low | high, F.lit(False)), F.lit(r.name)))
    return F.array_compact(F.array(*bounds)) if bounds else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, stop_words: dict[str, list[str]] = STOP_WORDS) -> DataFrame:
    """Adds the counts, the ratios, ``failed`` (names of failed rules) and ``passed`` to every row.

    A null or empty text has zero of everything and null ratios. Columns of the input whose names clash with an added
    one are dropped in favour of it. Rows are independent, so repeated rows and empty tables need no special case.
    """
    measures = _measures(F.col("__t"), sorted({w for ws in stop_words.values() for w in ws}))
    inner = {"__t", *[name for name, _ in measures if name.startswith("__")]}
    added = {*COUNTS, *RATIOS, "failed", "passed", *inner}
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    for name, column in measures:
        out = out.withColumn(name, column)
    out = out.withColumn("failed", compile_rules(rules)).withColumn("passed", F.size("failed") == 0)
    return out.drop(*inner)
