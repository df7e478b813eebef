"""Near-duplicate embeddings: binary codes from learned rotations, tables of their pieces, and a second look at the vectors.

Iterative quantisation learns rotations on a bounded sample, so that the signs of a rotated vector are balanced bits that lose
little. The bits are cut into pieces, a table for each; vectors that agree in a whole piece meet, and their cosine is taken from the
vectors themselves. Groups of close vectors are no pairs: all within half the angle of a common centre are linked to each other,
which is counted and not listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.graph import components
from ledgerscope.llm.text import discard, stored

#: Vectors that the rotations are learned on, at most.
SAMPLE = 8192
#: A piece is so long that about this many unrelated vectors share one; as many pieces as miss a pair at the threshold this rarely.
SHARED, MISSED = 8, 0.005
#: A bucket above it is compared block by block, after its centre has taken in what is close to it.
BLOCK = 512


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 5, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and a projection to ``bits`` columns: principal axes, turned until signs and values agree best; as many such turns as the bits need, each from another start."""
    mean = sample.mean(0)
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    width = min(sample.shape[1], bits)
    axes, rng, out = axes[:, ::-1][:, :width], np.random.default_rng(seed), []
    v = x @ axes
    while sum(p.shape[1] for p in out) < bits:
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(steps):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        out.append(axes @ turn)
    return mean, np.concatenate(out, 1)[:, :bits]


def pieces_for(n: int, cosine: float) -> tuple[int, int]:
    """Bits of a piece and number of pieces for n vectors: a bit of a pair at the threshold differs in angle / pi of cases."""
    width = min(max(math.ceil(math.log2(max(n, 2) / SHARED)), 6), 31)
    alike = (1 - math.acos(cosine) / math.pi) ** width
    return width, math.ceil(math.log(MISSED) / math.log(1 - alike))


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length, each divided by its own."""
    v = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    v = v / np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _coder(mean: np.ndarray, turn: np.ndarray, width: int, tables: int):
    """A function of batches (cid, size, v, ...): adds ``keys``, the pieces of each vector's bits. Vectors of another length than the sample's take seeded planes instead."""
    weights = 1 << np.arange(width)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                b = batch.slice(k, 4096)
                lengths = np.asarray(pc.list_value_length(b.column("v")))
                keys = np.zeros((b.num_rows, tables), np.int64)
                for d in np.unique(lengths):
                    at = np.flatnonzero(lengths == d)
                    x = _unit(b.column("v").take(pa.array(at)))
                    m, p = (mean, turn) if d == len(mean) else (0.0, np.random.default_rng(int(d)).standard_normal((d, width * tables)))
                    keys[at] = (((x - m) @ p) >= 0).reshape(len(at), tables, width) @ weights
                flat = pa.array(keys.reshape(-1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables), flat)], [*b.schema.names, "keys"])

    return code


def _compare(g: dict[str, np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket or of two blocks of one: (cid, vectors linked to it that no earlier table brings, least cid linked).

    A pair counts at the first table in which it meets; pairs of one ball are counted elsewhere; where two blocks meet, pairs within either are left to the block itself.
    """
    x = g["x"]
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    if g["i"][0] != g["j"][0]:
        linked &= g["own"][:, None] != g["own"][None, :]
    a, b = np.nonzero(linked)
    cid, labels = g["cid"], g["cid"].copy()
    while len(a):
        least = labels.copy()
        np.minimum.at(least, a, labels[b])
        if (least == labels).all():
            break
        labels = least
    first = (g["keys"][a] == g["keys"][b]).argmax(1) == g["t"][0] if len(a) else np.zeros(0, bool)
    ball = g["ball"]
    first &= (ball[a] != ball[b]) | (ball[a] < 0)
    return cid, np.bincount(a[first], weights=g["size"][b[first]].astype(np.float64), minlength=len(cid)).astype(np.int64), labels


def _matcher(cosine: float):
    """Over rows sorted by (t, d, key, i, j): compares each run of equal ones. At most two blocks are held."""
    names = ["t", "d", "key", "i", "j", "own", "cid", "size", "ball"]

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        cols = {c: table[c].to_numpy() for c in names}
        new = np.zeros(len(table), bool)
        new[0] = True
        for c in ("t", "d", "key", "i", "j"):
            new[1:] |= cols[c][1:] != cols[c][:-1]
        starts, out = np.append(np.flatnonzero(new), len(table)), []
        keys = np.asarray(table["keys"].combine_chunks().flatten()).reshape(len(table), -1)
        vectors, length = table["v"].combine_chunks(), cols["d"]
        turns = np.append(np.flatnonzero(np.append(True, length[1:] != length[:-1])), len(table))
        units = {int(s): _unit(vectors.slice(s, e - s)) for s, e in zip(turns[:-1], turns[1:], strict=True)}
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if e - s < 2:
                continue
            base = int(turns[np.searchsorted(turns, s, "right") - 1])
            x = units[base][s - base : e - base]
            cid, n, label = _compare({**{c: v[s:e] for c, v in cols.items()}, "x": x, "keys": keys[s:e]}, cosine)
            told = (n > 0) | (label < cid)
            out.append((cid[told], n[told], label[told]))
        arrays = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in arrays], ["cid", "n", "label"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            # what ends with the last row may go on in the next batch
            same = np.ones(b.num_rows, bool)
            for c in ("t", "d", "key", "i", "j"):
                v = b.column(c).to_numpy()
                same &= v == v[-1]
            cut = int(b.num_rows - np.argmin(same[::-1])) if not same.all() else 0
            if held and cut == 0:
                first = held[-1]
                if any(first.column(c)[-1].as_py() != b.column(c)[0].as_py() for c in ("t", "d", "key", "i", "j")):
                    yield flush(held)
                    held = []
                held.append(b)
                continue
            if cut:
                yield flush([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        if held:
            yield flush(held)

    return match


def _centred(v: str, centre: str) -> F.Column:
    """Cosine of two columns of equal length, in doubles."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(v, centre) / F.sqrt(dot(v, v) * dot(centre, centre))


def _balls(rows: DataFrame, hot: DataFrame, cosine: float, dimensions: int) -> DataFrame:
    """Close vectors of large buckets: (cid, ball). A bucket's centre is the mean of its vectors; the vectors within half the angle of it are linked to each other, and each joins one such ball."""
    half = math.cos(math.acos(cosine) / 2) + 1e-9
    member = rows.filter(F.col("d") == dimensions).join(hot, ["t", "d", "key"])
    sums = member.groupBy("t", "d", "key").agg(F.array(*[F.sum(F.col("v")[k].cast("double")) for k in range(dimensions)]).alias("centre"))
    close = member.join(stored(sums, "centres"), ["t", "d", "key"]).filter(_centred("v", "centre") >= half)
    best = close.groupBy("cid").agg(F.max(F.struct("n", F.col("t").cast("long").alias("t"), "key")).alias("b"))
    return best.select("cid", (F.col("b.t") * (1 << 32) + F.col("b.key")).alias("ball"))


def _dealt(rows: DataFrame, counts: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Rows (t, key, d, cid, size, v, keys, ball) to the bucket or the pairs (i, j) of blocks in which they are compared, sorted by these; ``own`` is a row's block.

    A large bucket has blocks of about ``BLOCK`` rows, those of a large ball apart from the rest; blocks of one ball do not meet.
    """
    bucket = ["t", "d", "key"]
    zero = F.lit(0)
    small = rows.join(counts.filter(F.col("n") <= BLOCK).select(bucket), bucket).select("*", zero.alias("i"), zero.alias("j"), zero.alias("own"))
    if hot is not None:
        large = rows.join(hot.select(bucket), bucket)
        parts = large.groupBy(*bucket, "ball").agg(F.count("*").alias("n"))
        parts = parts.withColumn("sub", F.when(F.col("n") >= BLOCK // 2, F.col("ball")).otherwise(-1)).groupBy(*bucket, "sub").agg(F.sum("n").alias("n"))
        per = parts.withColumn("blocks", F.transform(F.sequence(F.lit(1), F.ceil(F.col("n") / BLOCK).cast("int")), lambda k: F.struct("sub", (k - 1).alias("k"))))
        lists = stored(per.groupBy(*bucket).agg(F.array_sort(F.flatten(F.collect_list("blocks"))).alias("blocks")), "blocks")
        large = large.join(lists, bucket)
        sub = F.when(F.exists("blocks", lambda b: b["sub"] == F.col("ball")), F.col("ball")).otherwise(-1)
        large = large.withColumn("sub", sub)
        many = F.size(F.filter("blocks", lambda b: b["sub"] == F.col("sub")))
        place = F.struct("sub", F.pmod(F.xxhash64("cid"), many).cast("int").alias("k"))
        large = large.withColumn("own", (F.array_position("blocks", place) - 1).cast("int"))
        meets = F.filter(F.transform("blocks", lambda b, k: F.when((b["sub"] != F.col("sub")) | (b["sub"] == -1), k)), lambda k: k.isNotNull())
        large = large.withColumn("__o", F.explode(meets)).withColumn("i", F.least("own", "__o")).withColumn("j", F.greatest("own", "__o"))
        small = small.unionByName(large.select(small.columns))
    return small.repartition("t", "d", "key", "i", "j").sortWithinPartitions("t", "d", "key", "i", "j")


def near_duplicates(vectors: DataFrame, vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with a cosine of at least ``cosine`` that the tables bring together), component_id (least vec_id reachable), kept.

    Equal vectors are one class, whose rows are linked to each other. The sample for the rotations has at most ``SAMPLE`` rows,
    chosen by a hash of the vectors; every row is in every table. Pairs of groups within half the angle of a bucket's centre are counted, the
    others compared in blocks, and none is listed.

    Null, empty and zero vectors and those with null, NaN or infinite components are linked with nothing and stay; vectors of
    different lengths are not linked. Ids may repeat or be null: rows are told apart, and a component without any id has none.
    Further columns are ignored. An empty table gives an empty result.
    """
    rows = stored(vectors.select("vec_id", F.col(vector).alias("v")).withColumn("row", F.monotonically_increasing_id()), "rows")
    good = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # equal vectors: a class has the least row's number
    classes = stored(rows.filter(good).groupBy("v").agg(F.min("row").alias("cid"), F.count("*").alias("size")), "classes")
    n = classes.count()
    by_length = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if by_length is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    d = by_length.d
    rate = min(1.0, 0.8 * SAMPLE / by_length["count"])
    drawn = classes.filter((F.size("v") == d) & (F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(rate * (1 << 30)))).limit(SAMPLE).select("v").collect()
    width, tables = pieces_for(n, cosine)
    sample = np.array([r.v for r in drawn] or [[0.0] * d], np.float64)
    sample /= np.maximum(np.abs(sample).max(1, keepdims=True), 1e-300)
    mean, turn = learn_rotations(sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300), width * tables)

    kind = classes.schema["v"].dataType.simpleString()
    coded = stored(classes.mapInArrow(_coder(mean, turn, width, tables), f"v {kind}, cid long, size long, keys array<int>"), "coded")
    spread = coded.select(F.posexplode("keys").alias("t", "key"), F.size("v").alias("d"), "cid", "size", "v", "keys")
    counts = stored(spread.groupBy("t", "d", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    hot = stored(counts.filter(F.col("n") > BLOCK), "hot")
    if hot.isEmpty():
        balls = None
        placed = spread.withColumn("ball", F.lit(-1).cast("long"))
    else:
        balls = stored(_balls(spread, hot, cosine, d), "balls")
        placed = coded.join(balls, "cid", "left").select(F.posexplode("keys").alias("t", "key"), F.size("v").alias("d"), "cid", "size", "v", "keys", F.coalesce("ball", F.lit(-1).cast("long")).alias("ball"))
    found = stored(_dealt(placed, counts, hot if balls is not None else None).mapInArrow(_matcher(cosine), "cid long, n long, label long"), "links")

    links = found.groupBy("cid").agg(F.sum("n").alias("n"))
    edges = found.filter("label < cid").select(F.col("cid").alias("a"), F.col("label").alias("b")).distinct()
    own = classes.select("v", "cid", "size")
    if balls is not None:
        whole = stored(balls.join(classes.select("cid", "size"), "cid").groupBy("ball").agg(F.sum("size").alias("inside"), F.min("cid").alias("head")), "whole")
        placed_in = stored(balls.join(whole, "ball"), "members")
        edges = edges.union(placed_in.filter("cid <> head").select("cid", "head"))
        own = own.join(placed_in.select("cid", "inside"), "cid", "left")
    else:
        own = own.withColumn("inside", F.lit(None).cast("long"))
    parts = stored(components(edges).withColumnRenamed("node", "cid"), "parts")
    known = own.join(links, "cid", "left").join(parts, "cid", "left").select("v", F.col("cid"), (F.coalesce("n", F.lit(0)) + F.coalesce("inside", "size") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    # the class of each row, and of each component its least id
    whole_rows = rows.join(known.withColumn("__of", F.lit(True)), "v", "left")
    told = stored(whole_rows.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "row").alias("component")), "told")
    least = stored(told.groupBy("component").agg(F.min("vec_id").alias("component_id")), "least")
    out = told.join(least, "component").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    discard(rows, classes, coded, counts, hot, found, parts)
    return out
