"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.text import held_out, one_text, stored

#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "һ": "h", "к": "k", "м": "m", "т": "t",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
#: Insults that count before anything is learned.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "disgusting", "worthless", "imbecile", "bastard", "bitch", "asshole", "retard", "whore")
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish", "sore loser", "pathetic fallacy", "idiot proof", "circus clown", "class clown", "rodeo clown")


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(k): v for k, v in (DIGITS | HOMOGLYPHS).items()}
    for code in (*range(0xC0, 0x250), *range(0xFF01, 0xFF5F), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if base.isascii() and base.isprintable():
            table.setdefault(code, DIGITS.get(base, base))
    for code in (*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0xAD, *range(0x300, 0x370)):
        table[code] = None
    for code in range(33, 127):
        c = chr(code)
        if not c.isalnum() and c not in DIGITS and c != "$":
            table[code] = " "
    for c in "\t\n\x0b\x0c\r":
        table[ord(c)] = " "
    for c in range(65, 91):
        table[c] = chr(c + 32)
    return table


_FOLD = _fold_table()
_DOLLAR = re.compile(r"\$(?=[a-z])")


def fold(text: str | None) -> str:
    """Lower case without accents, look-alikes and digits read as letters, punctuation as spaces; a space at either end."""
    if not text:
        return "  "
    out = text.translate(_FOLD)
    if "$" in out:
        out = _DOLLAR.sub("s", out).replace("$", " ")
    return f" {out} "


@dataclass
class Lexicon:
    """Weights by folded entry: `` word `` is a whole word, `` word`` a beginning. ``exceptions`` are folded phrases; a text of
    up to 400 words with hits of weight ``half`` scores one half."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    half: float = 12.0
    _auto: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "half": self.half, "_auto": None}

    def automaton(self):
        if self._auto is None:
            a = ahocorasick.Automaton()
            for w, x in self.weights.items():
                a.add_word(w, (len(w), x))
            for e in self.exceptions:
                e = fold(e)
                a.add_word(e, (len(e), None))
            a.make_automaton()
            self._auto = a
        return self._auto

    def hits(self, text: str | None) -> tuple[float, int, int]:
        """Sum of weights, matched words and all words. Of entries that begin a word together the heaviest counts once."""
        folded = fold(text)
        found: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (n, x) in self.automaton().iter(folded):
            at = end - n + 1
            if x is None:
                free.append((at, end))
            elif x > found.get(at, 0.0):
                found[at] = x
        if free:
            found = {at: x for at, x in found.items() if not any(a <= at < b for a, b in free)}
        return sum(found.values()), len(found), len(folded.split())

    def score(self, total: float, words: int) -> float:
        return score(total, words, self.half)


def strength(total: float, words: int) -> float:
    """Weight of the hits by length: texts of more than 400 words need more, by the square root of their length."""
    return total / max(1.0, math.sqrt(words / 400))


def score(total: float, words: int, half: float) -> float:
    """0 to 1; one half at a strength of ``half``."""
    return 1 - 2.0 ** -(strength(total, words) / half)


#: Letters of the word beginnings that are tried as entries.
BEGINNINGS = range(4, 9)


def _entries(text: str | None) -> set[str]:
    words = set(fold(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}


def _weigh(counts: dict[str, tuple[int, int]], bad: int, good: int, least: int, ratio: float) -> dict[str, float]:
    """Entries of toxic documents beyond chance, from their toxic and other document counts.

    A weight is the log ratio of the two shares, smoothed by one. Kept are entries of at least ``least`` toxic documents
    and a ratio above ``ratio`` that chance would not give any of those tried (Chernoff's bound), less the beginnings that
    say no more than a longer entry.
    """
    found = {f" {w} ": (6.0, 0) for w in SEED_WORDS}
    if bad and good:
        share = bad / (bad + good)
        tried = {e: (b, g) for e, (b, g) in counts.items() if b >= least}
        for e, (b, g) in tried.items():
            w = math.log((b + 1) / bad) - math.log((g + 1) / good)
            sure = b * math.log(b / (b + g) / share) + (g * math.log(g / (b + g) / (1 - share)) if g else 0.0)
            if w > math.log(ratio) and sure > math.log(len(tried)) + 4.6:
                found[e] = (max(w, found.get(e, (0.0, 0))[0]), b)
    longest: dict[str, int] = {}  # of each beginning, the most toxic documents that a longer entry has
    for e, (_, b) in found.items():
        for n in range(1 + BEGINNINGS.start, len(e)):
            longest[e[:n]] = max(longest.get(e[:n], 0), b)
    return {e: w for e, (w, b) in sorted(found.items()) if e.endswith(" ") or b * 0.9 > longest.get(e, 0)}


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_rows: int = 40_000, least: int = 4, ratios: tuple[float, ...] = (4.0, 10.0, 25.0), threshold: float = 0.3, folds: int = 3,
) -> Lexicon:
    """Weights from the words, and the word beginnings of four to eight letters, of labelled documents, and the scale of scores.

    At most ``max_rows`` labelled rows are used, in the order of a hash of their id; rows without an id or a label are not. An id
    counts once: with the largest of its labels, and of its texts the one with the least hash.
    The counts are summed by Spark, by fold. The least ratio of entries and the scale are fitted to the same rows: those of
    a fold are scored with the entries of the others, and the pair that gives the best F1 at the threshold is taken (the
    largest ratio and 12 where the rows do not have both labels).
    """
    key, mark = F.col(f"`{id}`"), F.col(f"`{label}`")
    known = labels.filter(mark.isNotNull() & key.isNotNull()).groupBy(key.alias("i")).agg(F.max(mark).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("i"), "i").limit(max_rows).withColumn("fold", F.pmod(F.xxhash64(F.lit(3), F.col("i")), F.lit(folds)).cast("int"))
    rows = stored(one_text(docs, known, id, text).select("t", "y", "fold"), "labelled")

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], Counter] = {}
        for part in parts:
            for t, y, k in zip(part["t"], part["y"], part["fold"], strict=True):
                c = sums.setdefault((int(y), int(k)), Counter())
                c.update(_entries(t))
                c[""] += 1
        for (y, k), c in sums.items():
            yield pd.DataFrame({"entry": list(c), "y": y, "fold": k, "n": list(c.values())})

    def count(y: int, k: int):
        return F.sum(F.when((F.col("y") == y) & (F.col("fold") == k), F.col("n")).otherwise(0))

    counts = rows.mapInPandas(features, "entry string, y int, fold int, n long").groupBy("entry").agg(F.array(*[count(y, k) for y in (1, 0) for k in range(folds)]).alias("n"))
    # an entry of too few toxic documents in all has too few in any folds
    got = {r["entry"]: r["n"] for r in counts.filter((F.aggregate(F.slice("n", 1, folds), F.lit(0).cast("long"), lambda a, x: a + x) >= least) | (F.col("entry") == "")).collect()}
    totals = got.pop("", [0] * (2 * folds))

    def lexicon(ratio: float, without: int | None) -> Lexicon:
        use = [k for k in range(folds) if k != without]
        two = lambda n: (sum(n[k] for k in use), sum(n[folds + k] for k in use))
        return Lexicon(_weigh({e: two(n) for e, n in got.items()}, *two(totals), least, ratio))

    if not (sum(totals[:folds]) and sum(totals[folds:])):
        return lexicon(ratios[-1], None)
    by_fold = [[lexicon(r, k) for k in range(folds)] for r in ratios]

    def strengths(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [[strength(x, n) for x, _, n in (lex[k].hits(t) for lex in by_fold)] for t, k in zip(part["t"], part["fold"], strict=True)]
            yield pd.DataFrame({"y": part["y"], "x": found})

    seen = rows.mapInPandas(strengths, "y int, x array<double>").toPandas()  # of max_rows rows at most
    x, y = np.stack(seen["x"].to_list()), seen["y"].to_numpy()
    best, cut, ratio = max((*_best_cut(x[:, i], y), r) for i, r in enumerate(ratios))
    out = lexicon(ratio, None)
    out.half = cut / -math.log2(1 - threshold)
    return out


def _best_cut(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The best F1 of "toxic from here on", and the strength between the rows where it is."""
    values = np.unique(x[x > 0])
    if not len(values):
        return 0.0, 6.0
    order = np.argsort(-x, kind="stable")
    at = np.searchsorted(-x[order], -values, "right")  # rows with at least that strength
    hit = np.cumsum(y[order] == 1)[at - 1]
    f1 = 2 * hit / (at + (y == 1).sum())
    best = int(np.argmax(f1))
    return float(f1[best]), float((values[best] + (values[best - 1] if best else 0.0)) / 2)


def toxicity(docs: DataFrame, lexicon: Lexicon, id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, score, predicted, n_hits, n_words. A null or empty text scores 0; rows are independent; an empty table gives no rows."""
    kind = docs.schema[id].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [lexicon.hits(t) for t in part["t"]]
            scores = [lexicon.score(x, n) for x, _, n in found]
            yield pd.DataFrame(
                {"doc_id": part["doc_id"], "score": scores, "predicted": [int(s >= threshold) for s in scores], "n_hits": [h for _, h, _ in found], "n_words": [n for _, _, n in found]}
            )

    return docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInPandas(
        run, f"doc_id {kind}, score double, predicted int, n_hits long, n_words long"
    )


def learn_and_score(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Learns from labelled rows that are not held out, scores all rows, and adds ``held_out``."""
    seen = labels.filter(~held_out(F.col(f"`{id}`"), modulus, remainder))
    lexicon = learn_lexicon(docs, seen, id, text)
    out = toxicity(docs, lexicon, id, text)
    return out.withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder))


def keep_clean(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns; null and empty texts stay, and so does each of repeated rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [lexicon.score(x, n) < threshold for x, _, n in (lexicon.hits(t) for t in b.column(text).to_pylist())]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
