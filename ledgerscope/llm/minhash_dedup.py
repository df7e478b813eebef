"""Near duplicates: b-bit MinHash signatures, band candidates, a collision-corrected estimate, and confirmation on full shingle sets."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.graph import components
from ledgerscope.llm.text import mix, pieces, stored, words_of

#: Low bits kept of each minimum: 16 to a long.
BITS = 4
#: Candidates whose estimate is this far below the threshold are dropped unconfirmed: more than five standard errors.
MARGIN = 0.2
#: A pair at the threshold meets in no band in fewer cases than this.
MISSED = 2e-5


def band_plan(percent: int) -> tuple[int, int]:
    """Bands and minima in each, for a threshold: 24 of 6 at 85, 32 of 5 at 80. All minima together fill whole longs."""
    s = min(max(percent, 1), 99) / 100
    rows = max(1, round(math.log(0.35) / math.log(s)))
    bands = math.ceil(math.log(MISSED) / math.log(1 - s**rows) - 0.5)
    while bands * rows % (64 // BITS):
        bands += 1
    return bands, rows


@functools.cache
def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, np.uint64) | np.uint64(1)


_WINDOW = _odd(64, 14)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct sorted 64-bit hashes of the k-word windows; of fewer words, one hash of them all; of none, none."""
    n = len(words)
    if n == 0:
        return words
    m = min(n, k)
    h = np.full(n - m + 1, np.uint64(m), np.uint64)
    for j in range(m):
        h += words[j : n - m + 1 + j] * _WINDOW[j % 64]
    return np.unique(mix(h))


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """The minima of k permutations (multiply and add modulo 2^64), piece by piece for long sets."""
    least = np.full(k, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[a : a + 2048, None] * _odd(k, 11) + _odd(k, 12)).min(axis=0), out=least)
    return mix(least)


def _pack(least: np.ndarray) -> np.ndarray:
    low = (least & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _bands(least: np.ndarray, bands: int) -> np.ndarray:
    keys = (least * _odd(len(least), 13)).reshape(bands, -1).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
    return mix(keys).view(np.int64)


def _key(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set, in two halves."""
    both = (shingles + np.uint64(1), shingles ^ np.uint64(0x5851F42D4C957F2D))
    return tuple(int(mix(x).sum(dtype=np.uint64).view(np.int64)) for x in both)


def signatures(docs: DataFrame, shingle: int, percent: int, id: str, text: str) -> DataFrame:
    """Per row: doc_id, n (set size), k1 and k2 (a 128-bit key of the set), sig (packed low bits), bands (band keys)."""
    n_bands, n_rows = band_plan(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            w = words_of(b.column("t"))
            n, k1, k2, sig, bands = [], [], [], [], []
            for a, z in zip(w.first[:-1], w.first[1:], strict=True):
                s = shingle_hashes(w.hashes[a:z], shingle)
                n.append(len(s))
                for to, key in zip((k1, k2), _key(s), strict=True):
                    to.append(key)
                least = signature(s, n_bands * n_rows) if len(s) else None
                sig.append(_pack(least) if len(s) else None)
                bands.append(_bands(least, n_bands) if len(s) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, longs), pa.array(bands, longs)],
                ["doc_id", "n", "k1", "k2", "sig", "bands"],
            )

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(
        run, f"doc_id {kind}, n long, k1 long, k2 long, sig array<long>, bands array<long>"
    )


def estimate(a: Column, b: Column, k: int) -> Column:
    """Similarity from the packed low bits of k minima: the share of equal ones, less what chance makes equal, 2^-b."""
    ones = int("1" * (64 // BITS), 16)  # the lowest bit of every field
    unequal = None
    for j in range(k * BITS // 64):
        x = F.get(a, F.lit(j)).bitwiseXOR(F.get(b, F.lit(j)))
        folded = x
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        count = F.bit_count(folded.bitwiseAND(F.lit(ones)))
        unequal = count if unequal is None else unequal + count
    chance = 2.0**-BITS
    return ((1 - unequal / k) - chance) / (1 - chance)


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and estimate allow the threshold."""
    x = pairs.join(reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    x = x.join(reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    x = x.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return x.filter(estimate(F.col("sa"), F.col("sb"), math.prod(band_plan(percent))) >= percent / 100 - MARGIN).select("a", "b")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, id: str, text: str) -> DataFrame:
    """The full shingle sets (rep, k, s) of the wanted ids, k a key of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            w = words_of(b.column("t"))
            s = [shingle_hashes(w.hashes[a:z], shingle) for a, z in zip(w.first[:-1], w.first[1:], strict=True)]
            k = pa.array([_key(x)[0] for x in s], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("rep"), k, pa.array([x.tobytes() for x in s], pa.binary())], ["rep", "k", "s"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(f"`{id}`").alias("rep"), F.col(f"`{text}`").alias("t")).join(wanted, "rep", "left_semi")
    return rows.mapInArrow(run, f"rep {kind}, k long, s binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on the full sets; where the sets come with signatures, those too far apart by estimate go first. Where they come with components, these are named instead of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("sa"), b.column("sb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                both = int((y[at] == x).sum()) if len(x) else 0
                keep[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            kept = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    named = "comp" if "comp" in sets.columns else "rep"
    kind = sets.schema[named].dataType.simpleString()
    signed = ["sig"] if "sig" in sets.columns else []
    x = pairs.join(sets.select(F.col("rep").alias("a"), F.col(named).alias("ca"), F.col("s").alias("sa"), *(F.col(c).alias("ga") for c in signed)), "a")
    x = x.join(sets.select(F.col("rep").alias("b"), F.col(named).alias("cb"), F.col("s").alias("sb"), *(F.col(c).alias("gb") for c in signed)), "b")
    if signed:
        near = estimate(F.col("ga"), F.col("gb"), math.prod(band_plan(percent))) >= percent / 100 - MARGIN
        x = x.filter(F.coalesce(near, F.lit(True)))
    return x.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


#: Set sizes are classed by this ratio when prefixes are joined.
_CLASS = 1.03


def _prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can reach the threshold, from (rep, k, s, comp).

    With every set in one order, rare shingles first, a pair that is linked has its first common shingle early in both:
    at most as far in as leaves the overlap that the threshold asks for. So each set is entered under that many shingles
    and no more, by its own size class and by those of the smaller sets it can be linked with. Members of a large group
    that are too far apart to be linked differ in rare shingles first, and so never meet.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("s")]
            n = [len(x) for x in s]
            row = pa.array(np.repeat(np.arange(len(n)), n), pa.int64())
            flat = pa.array(np.concatenate(s) if s else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in ("rep", "k", "comp")), pa.array(np.repeat(n, n), pa.int64()), flat], ["rep", "k", "comp", "n", "h"])

    kind = sets.schema["rep"].dataType.simpleString()
    rows = stored(sets.select("rep", "k", "comp", "s").mapInArrow(shingles, f"rep {kind}, k long, comp {kind}, n long, h long"), "shingles")
    df = rows.groupBy("h").agg(F.count("*").alias("df"))
    ordered = rows.join(df, "h").groupBy("rep", "k", "comp", "n").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("s"))
    need = lambda n, m: F.ceil((n + m) * percent / (100 + percent))
    step = float(np.log(_CLASS))
    size_class = lambda n: F.floor(F.log(n.cast("double")) / step)
    n = F.col("n")
    least = F.ceil(n * percent / 100)
    own = F.struct(size_class(n).alias("c"), F.lit(True).alias("own"), (n - need(n, n)).alias("last"))
    smaller = F.transform(
        F.sequence(size_class(least), size_class(n)),
        lambda c: F.struct(c.alias("c"), F.lit(False).alias("own"), (n - need(n, F.greatest(least, F.floor(F.exp(c * step))))).alias("last")),
    )
    entries = ordered.select("rep", "comp", "n", "s", F.explode(F.concat(F.array(own), smaller)).alias("e")).filter("e.last >= 0")
    entries = entries.select("rep", "comp", "n", "e.c", "e.own", F.posexplode(F.slice("s", F.lit(1), (F.col("e.last") + 1).cast("int"))).alias("at", "x"))
    entries = stored(entries.filter("x.df > 1").select("rep", "comp", "n", "c", "own", "at", F.col("x.h").alias("h")), "entries")
    # the component with most entries under a key need not be joined with itself
    most = entries.groupBy("h", "c", "comp").agg(F.count("*").alias("k")).groupBy("h", "c")
    most = most.agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
    entries = entries.join(most, ["h", "c"]).withColumn("is_main", F.col("comp") == F.col("main"))
    x = entries.filter("own").select("h", "c", F.col("rep").alias("r1"), F.col("comp").alias("c1"), F.col("n").alias("n1"), F.col("at").alias("p1"), F.col("is_main").alias("m1"))
    y = entries.filter("NOT own").select("h", "c", F.col("rep").alias("r2"), F.col("comp").alias("c2"), F.col("n").alias("n2"), F.col("at").alias("p2"), F.col("is_main").alias("m2"))
    fits = (
        (F.col("c1") != F.col("c2"))
        & ((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("r1") < F.col("r2"))))
        & (F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) >= need(F.col("n1"), F.col("n2")))
    )
    met = x.filter("NOT m1").join(y, ["h", "c"]).filter(fits).unionByName(x.filter("m1").join(y.filter("NOT m2"), ["h", "c"]).filter(fits))
    return met.select(F.greatest("r1", "r2").alias("a"), F.least("r1", "r2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id reachable by links), kept (doc_id = component_id).

    Documents are linked when the sets of their lower-cased (A-Z) word shingles have a Jaccard similarity of at least
    ``percent`` hundredths. Equal sets are one class and travel as its least doc_id. In every band bucket two leaders
    are compared with all members, the same ones in buckets of the same members, which joins large
    groups with work in proportion to their size; the second round
    then tests the remaining pairs among the members of buckets that are not yet in one component, so nothing is
    left untested; there, rare-first prefixes of the sets choose the pairs, so that a group's members that are too far apart
    are never paired. A text with fewer words than a shingle is one shingle; null and empty texts have none and stay
    alone. A null id has no component and is kept. Rows that repeat an id and a set are one document; an id with several
    sets has the links of each, and a component per row.
    """
    sigs = stored(signatures(docs, shingle, percent, id, text), "signatures")
    classes = sigs.filter("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"))
    # by the id too, so that a large class of copies is spread; an id with several texts stands for each of their sets
    owner = ["doc_id", "k1", "k2", "n"]
    reps = sigs.filter("n > 0").dropDuplicates(owner).join(classes.withColumn("doc_id", F.col("rep")), owner)
    reps = stored(reps.select("rep", "n", "k1", "k2", "sig", "bands"), "classes")
    buckets = reps.select("rep", F.explode("bands").alias("band"))
    leaders = buckets.groupBy("band").agg(F.count("*").alias("c"), F.min("rep").alias("l1"), F.min_by("rep", F.xxhash64("rep")).alias("l2")).filter("c > 1")
    buckets = stored(buckets.join(leaders, "band").select("band", "rep", "l1", "l2"), "buckets")
    star = buckets.select("rep", F.explode(F.array("l1", "l2")).alias("lead")).filter("rep <> lead")
    star = star.select(F.greatest("rep", "lead").alias("a"), F.least("rep", "lead").alias("b")).distinct()
    tried = stored(_likely(star, reps, percent), "pairs")
    sets = stored(_sets(docs, buckets.select("rep").distinct(), shingle, id, text), "sets")
    links = stored(_confirmed(tried, sets, percent), "links")
    labels = components(links)
    placed = buckets.select("band", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("band", "rep", F.coalesce("component", "rep").alias("comp"))
    open_ = placed.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("band")
    open_ = stored(placed.join(open_, "band", "left_semi").select("rep", "comp").distinct(), "open")
    sets = sets.join(open_, "rep")
    pairs = _prefix_pairs(sets, percent)
    # the prefixes have checked the sizes, so the signatures ride with the sets: one join of the pairs, not two
    signed = sets.join(reps.select("rep", F.col("k1").alias("k"), "sig"), ["rep", "k"], "left")
    # between components only, so that the second pass is over these and not over all their members
    more = stored(_confirmed(pairs.join(tried, ["a", "b"], "left_anti"), signed, percent).distinct(), "links")
    merged = components(more).select(F.col("node").alias("comp"), F.col("component").alias("into"))
    by_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    by_class = by_class.join(merged, "comp", "left").select("k1", "k2", F.col("n").alias("m"), F.coalesce("into", "comp").alias("comp"))
    s = sigs.select("doc_id", "n", "k1", "k2").alias("s")
    c = by_class.alias("c")
    out = s.join(c, (F.col("s.k1") == F.col("c.k1")) & (F.col("s.k2") == F.col("c.k2")) & (F.col("s.n") == F.col("c.m")), "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("comp"), F.col("doc_id")))
    return out.select("doc_id", F.col("s.n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def drop_near(docs: DataFrame, found: DataFrame, id: str = "doc_id") -> DataFrame:
    """The rows whose id is kept, with their columns; rows with a null id stay, and so does an id of which any row is kept. With a number of the row as the id, rows are judged one by one."""
    gone = found.groupBy(F.col("doc_id").alias(id)).agg(F.bool_or("kept").alias("__kept")).filter("NOT __kept").select(id)
    return docs.join(gone, id, "left_anti")
