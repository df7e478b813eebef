"""Packing: length buckets that minimise padding over the global histogram, and token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.text import in_lots, stored, word_count

#: Lengths up to here are histogram cells of their own; above, cells grow by 1/512, so a histogram has a bounded number of cells.
EXACT_LENGTHS = 2048
CELLS_PER_OCTAVE = 355
#: Documents of one lot of a bucket, about; lots are ranked apart and placed by the counts of the lots before them.
LOT_ROWS = 50_000


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int, sums: np.ndarray | None = None) -> np.ndarray:
    """The upper bounds of at most ``buckets`` length buckets with the least total padding, by dynamic programming.

    With the distinct lengths ascending, ``cost(i, j)`` is the padding if lengths i to j - 1 are padded to the last of
    them. A cell of several lengths has its largest in ``lengths`` and its tokens in ``sums``. The best split point does not move back as j grows, so each layer is filled by divide and conquer.
    """
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.float64), counts[order].astype(np.float64)
    n = len(x)
    if n <= buckets:
        return lengths[order].astype(np.int64)
    docs, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x if sums is None else sums[order].astype(np.float64))])
    best = np.full(n + 1, np.inf)
    best[0] = 0
    splits = []
    for _ in range(buckets):
        now, split = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            value = best[i] + x[j - 1] * (docs[j] - docs[i]) - (tokens[j] - tokens[i])
            k = int(np.argmin(value))
            now[j], split[j] = value[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best = now
        splits.append(split)
    bounds, j = [], n
    for split in reversed(splits):
        if j == 0:
            break
        bounds.append(int(x[j - 1]))
        j = int(split[j])
    return np.array(bounds[::-1], np.int64)


def _cell(n: F.Column) -> F.Column:
    """The upper end of a length's histogram cell."""
    octave = F.log2(n.cast("double") / EXACT_LENGTHS) * CELLS_PER_OCTAVE
    return F.when(n <= EXACT_LENGTHS, n).otherwise(F.greatest(n, F.ceil(F.pow(F.lit(2.0), F.ceil(octave) / CELLS_PER_OCTAVE) * EXACT_LENGTHS)))


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", buckets: int = 16, budget: int = 65_536, seed: int = 29) -> DataFrame:
    """Per row: doc_id, n_tokens (words), bucket, bucket_length (what its rows are padded to), batch, place, batch_tokens and padding.

    Every row is in one batch. A batch holds rows of one bucket, ``max(1, budget // bucket_length)`` of them but for the
    bucket's last, in a seeded order, so that ``batch_tokens``, its rows times the padded length, keeps to the budget
    unless one row alone exceeds it. A null or empty text has 0 tokens and goes to the lowest bucket. Repeated rows are
    packed each; an empty table gives no rows. Only the histogram, of a bounded number of cells, reaches the driver.
    """
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), word_count(F.col(f"`{text}`")).alias("n_tokens"))
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("cell", _cell(F.col("n_tokens"))), "lengths")
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("n_tokens").alias("longest"), F.sum("n_tokens").alias("tokens")).orderBy("cell").toPandas()
    bounds = best_bounds(cells["longest"].to_numpy(), cells["n"].to_numpy(), buckets, cells["tokens"].to_numpy()) if len(cells) else np.array([0])
    lots = 1 + int(cells["n"].sum()) // LOT_ROWS if len(cells) else 1
    lots = max(lots, 64)
    of = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b < F.col("n_tokens"))).cast("int")
    length = F.element_at(F.array(*[F.lit(int(b)) for b in bounds]), F.col("bucket") + 1).cast("long")
    rows = rows.withColumn("bucket", of).withColumn("bucket_length", length)
    rows = in_lots(rows, lots)
    counted = rows.groupBy("bucket", "lot").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1))
    places = counted.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("bucket"))).drop("n")
    within = F.row_number().over(Window.partitionBy("bucket", "lot").orderBy("draw", "doc_id", "n_tokens", "row"))
    joined = rows.withColumn("within", within).join(places, ["bucket", "lot"])
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    at = F.col("before") + F.col("within") - 1
    number = F.floor(at / per).cast("long")
    full = F.least(per, F.col("all") - number * per)
    return joined.select(
        "doc_id", "n_tokens", "bucket", "bucket_length",
        F.concat_ws("-", "bucket", number).alias("batch"), F.pmod(at, per).cast("int").alias("place"),
        (full * F.col("bucket_length")).alias("batch_tokens"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )
