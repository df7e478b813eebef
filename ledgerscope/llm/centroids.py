"""Centroid clustering on integers, exact, with an n-simplex projection that leaves few centroids to compare.

Distances to several pivots are kept once for each vector. With them a vector is the apex of a simplex over the pivots: its
coordinates in the pivots' span, and its height above it. Two apexes give a lower and an upper bound of the distance of
their vectors, and only centroids whose lower bound is not above the least upper bound are compared component by component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.text import discard, stored

#: Components beyond it take Python's integers instead of numpy's, and no bounds: 64 squares of differences stay below 2^63.
PLAIN = 1 << 27
#: Components beyond it count as it; distances and sums beyond a long as the largest long.
LARGEST = 1 << 62
_LONG = (1 << 63) - 1


class Simplex:
    """The base of a simplex over pivots (rows of integers). Pivots next to the span of those before add nothing to the bounds and are left out."""

    def __init__(self, pivots: np.ndarray, least: float = 1e-3):
        kept: list[np.ndarray] = []
        lower = np.zeros((0, 0))
        for p in pivots:
            if not kept:
                kept.append(p)
                continue
            own, base = (p - kept[0]).astype(np.float64), np.array(kept[1:], np.float64).reshape(len(kept) - 1, len(p)) - kept[0]
            x = np.linalg.solve(lower, base @ own) if len(base) else np.zeros(0)
            height = own @ own - x @ x
            if height > least * (own @ own) and height > 0:
                lower = np.block([[lower, np.zeros((len(base), 1))], [x[None, :], np.array([[np.sqrt(height)]])]])
                kept.append(p)
        self.pivots = np.array(kept, np.int64).reshape(len(kept), pivots.shape[1])
        self.inverse = np.linalg.inv(lower)  # a solver for many right sides at once may hang in a process that has forked, as a driver does to start its JVM
        self.sizes = ((self.pivots[1:] - self.pivots[:1]) ** 2).sum(1).astype(np.float64)

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots."""
        return squared(vectors, self.pivots)

    def apexes(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From squared distances to the pivots: coordinates in their span, the height squared, and the error that rounding may make in squared bounds."""
        d = d.astype(np.float64)
        inner = (d[:, :1] + self.sizes - d[:, 1:]) / 2
        x = inner @ self.inverse.T
        return x, np.maximum(d[:, 0] - (x * x).sum(1), 0), 1e-4 * d[:, 0]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances of two tables of integers, exact; a column of ``b`` at a time, so memory follows ``a``."""
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1) if len(b) else np.zeros((len(a), 0), a.dtype)


def nearest(vectors: np.ndarray, centroids: np.ndarray, simplex: Simplex, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (ties: the smaller number), the squared distance, and how many pairs were compared component by component.

    ``kept`` are the vectors' squared distances to the pivots. The candidates are compared exactly, so bounds decide no tie.
    """
    x, hx, ex = simplex.apexes(kept)
    y, hy, ey = simplex.apexes(simplex.distances(centroids))
    flat = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    heights, cross = hx[:, None] + hy[None, :], 2 * np.sqrt(hx[:, None] * hy[None, :])
    slack = ex[:, None] + ey[None, :] + 1.0
    least = (flat + heights + cross + slack).min(1, keepdims=True)
    open_ = flat + heights - cross - slack <= least
    best, at = np.full(len(vectors), _LONG, np.int64), np.zeros(len(vectors), np.int32)
    for c in range(len(centroids)):
        i = np.flatnonzero(open_[:, c])
        d = ((vectors[i] - centroids[c]) ** 2).sum(1)
        closer = d < best[i]
        best[i[closer]], at[i[closer]] = d[closer], c
    return at, best, int(open_.sum())


def _nearest_large(vectors: list[list[int]], centroids: list[list[int]]) -> tuple[list[int], list[int]]:
    at, best = [], []
    for v in vectors:
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
        best.append(min(d))
        at.append(d.index(best[-1]))
    return at, best


def integer_vectors(vectors: DataFrame, vector: str, dimensions: int, scale: int) -> DataFrame:
    """Vectors of exactly ``dimensions`` components, none null or not finite, as (vec_id, ints, large)."""
    x = F.col(vector)
    fits = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    bound = lambda v: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), v))
    rows = vectors.select("vec_id", x.alias(vector)).filter(F.coalesce(fits, F.lit(False)))
    ints = F.transform(vector, lambda v: F.floor(bound(v.cast("double") * scale)).cast("long"))
    rows = rows.select("vec_id", ints.alias("ints"))
    return rows.withColumn("large", F.exists("ints", lambda v: (v > PLAIN) | (v < -PLAIN)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _assigner(centroids: list[list[int]], simplex: Simplex, width: int):
    """A function of a batch: cluster, distance (Python's integers where large) and the components."""
    plain_centroids = all(abs(c) <= PLAIN for row in centroids for c in row)
    c = np.array(centroids, np.int64) if plain_centroids else None

    def assign(b: pa.RecordBatch):
        v, large = _matrix(b.column("ints"), width), np.asarray(b.column("large").to_numpy(zero_copy_only=False), bool)
        if c is not None and not large.any():
            at, d, _ = nearest(v, c, simplex, _matrix(b.column("kept"), len(simplex.pivots)))
            return at, d, v
        at, d = _nearest_large(v.tolist(), centroids)
        return np.array(at, np.int32), d, v

    return assign


def cluster(vectors: DataFrame, vector: str = "embedding", dimensions: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, pivots: int = 64, salt: str = "1:") -> DataFrame:
    """Lloyd's rounds in whole numbers: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components become floor(``scale`` * x). The first centroids are the ``k`` vectors with the smallest sha256 of ``salt``
    and their id (fewer vectors: as many as there are; repeated ids: by their components; null ids last). Ties of distance
    go to the smaller number, and an empty centroid stays as it was. The pivots are the first ``pivots`` of these vectors.

    Rows that are no vectors of this kind are left out: null, of another length, with a null, NaN or infinite component.
    Repeated rows count as often as they occur, and other columns are ignored. An empty table gives an empty result. A
    component beyond 2^62 counts as 2^62, and a distance beyond a long as the largest long; vectors beyond 2^27 are compared
    with all centroids in Python's integers.

    A task sends a sum and a count for each centroid; centroids and pivots, k rows, are all that the driver holds.
    """
    spark = vectors.sparkSession
    ints = integer_vectors(vectors, vector, dimensions, scale)
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = [list(r.ints) for r in ints.withColumn("__h", order).orderBy(F.asc_nulls_last("__h"), "ints").limit(max(k, pivots)).collect()]
    simplex = Simplex(np.array([p for p in first[:pivots] if all(abs(c) <= PLAIN for c in p)], np.int64).reshape(-1, dimensions)[:pivots])
    if not len(simplex.pivots):
        simplex = Simplex(np.zeros((1, dimensions), np.int64))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            v = np.clip(_matrix(b.column("ints"), dimensions), -PLAIN, PLAIN)
            d = simplex.distances(v)
            kept = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, kept], [*b.schema.names, "kept"])

    table = stored(ints.mapInArrow(measure, "vec_id long, ints array<long>, large boolean, kept array<long>"), "vectors")
    centroids = first[:k]
    number = pa.decimal128(38, 0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign, total, n = _assigner(centroids, simplex, dimensions), {}, np.zeros(len(centroids), np.int64)
        for b in _slices(batches):
            at, _, v = assign(b)
            n += np.bincount(at, minlength=len(centroids))
            for c in np.unique(at):
                mine = v[at == c]
                part = mine.sum(0).tolist() if np.abs(mine).max() < 1 << 50 else mine.astype(object).sum(0).tolist()
                total[c] = [x + y for x, y in zip(total[c], part, strict=True)] if c in total else part
        own = sorted(total)
        if own:
            cells = [(int(c), j, int(n[c]), total[c][j]) for c in own for j in range(dimensions)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells, strict=True), (pa.int32(), pa.int32(), pa.int64(), number), strict=True)], ["cluster", "place", "n", "total"])

    for _ in range(rounds if centroids else 0):
        cells = table.mapInArrow(sums, "cluster int, place int, n long, total decimal(38,0)")
        found = cells.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).collect()  # k rows of components
        centroids = [list(c) for c in centroids]
        for r in found:
            centroids[r.cluster][r.place] = int(r.total) // r.n

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _assigner(centroids, simplex, dimensions)
        for b in _slices(batches):
            at, d, _ = assign(b)
            whole = pa.array(d, pa.int64()) if isinstance(d, np.ndarray) else pa.array([min(x, _LONG) for x in d], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(at, pa.int32()), whole], ["vec_id", "cluster", "distance"])

    out = stored(table.mapInArrow(last, "vec_id long, cluster int, distance long"), "clusters")
    discard(table)
    per = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # a row for each centroid
    whole, texts = sum(int(r.total) for r in per), {r.cluster: ",".join(map(str, centroids[r.cluster])) for r in per}
    facts = [(r.cluster, min(int(r.total), _LONG), min(whole, _LONG), texts[r.cluster]) for r in per]
    of = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, __c string")
    return out.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("__c", 256).alias("centroid_sha256"))
