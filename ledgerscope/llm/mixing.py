"""Mixing sources to target weights by subset sums over exact document lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.text import free_name, in_lots, stored, word_count

#: Documents of one source and length are dealt by a seeded hash of their id to so many lots, each ranked by itself.
LOTS = 256


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, to (source, source_size, target).

    Sources in order of code points, null last, weigh ``weights``, repeating. They share ``share`` of all sizes; a target
    stops at ``most`` times its source's size and the excess is shared again. That limit is the water level: with the
    sources sorted by cap over weight, those whose cap lies below the level of the rest are full. The windows here run
    over one row per source.
    """
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    base = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    base = base.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    mine = left * F.col("weight") / F.sum("weight").over(after)
    # the first source that is not full sets the level for itself and all after it
    marked = base.withColumn("rate", F.when(mine < F.col("cap"), left / F.sum("weight").over(after)))
    rate = F.first("rate", ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("target", F.when(rate.isNull(), F.col("cap")).otherwise(F.least("cap", rate * F.col("weight")))).select(
        "source", "source_size", "target"
    )


def _reach(n: np.ndarray, free: np.ndarray, rest: int) -> list[tuple[int, int]]:
    """How many of which length to take so that their sum is as near below ``rest`` as can be, by bounded-knapsack dynamic programming.

    Bit r of a set says that r is reachable. Of the sets only every sixty-fourth is kept for the way back, and those
    between are made again.
    """
    moves, kept = [], []
    mask, reach = (1 << (rest + 1)) - 1, 1
    for i in range(len(n)):
        left, power = (min(int(free[i]), rest // int(n[i])) if n[i] else 0), 1
        while left > 0 and not reach >> rest & 1:
            if len(moves) % 64 == 0:
                kept.append(reach)
            k = min(power, left)
            moves.append((i, k))
            reach |= reach << (k * int(n[i])) & mask
            left -= k
            power *= 2
        if reach >> rest & 1:
            break
    at, out = reach.bit_length() - 1, []
    for lot in range(len(kept) - 1, -1, -1):
        part, sets = moves[64 * lot : 64 * lot + 64], [kept[lot]]
        for i, k in part[:-1]:
            sets.append(sets[-1] | sets[-1] << (k * int(n[i])) & mask)
        for (i, k), before in zip(reversed(part), reversed(sets), strict=True):
            if not before >> at & 1:
                out.append((i, k))
                at -= k * int(n[i])
    return out


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to ``budget``, or as near below as can be.

    First the same share of every length is taken, rounded down; the rest, less than the sum of the distinct lengths, is
    lowered by whole documents, longest first, while it exceeds twice the longest length, and is then met by a
    bounded-knapsack dynamic program over the documents left: bit r of a set says that r is reachable.
    """
    order = np.argsort(-lengths, kind="stable")
    n, c = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((n * c).sum())
    take = np.zeros(len(n), np.int64)
    if budget >= total:
        take[:] = c
    elif budget > 0 and total > 0:
        take = np.array([int(x) * budget // total for x in c], np.int64)
        rest = budget - int((n * take).sum())
        bound = 2 * int(n[0])
        for i in range(len(n)):
            if rest <= bound:
                break
            if n[i]:
                k = min(int(c[i] - take[i]), max(0, rest - bound) // int(n[i]) + 1, rest // int(n[i]))
                take[i] += k
                rest -= k * int(n[i])
        for i, k in _reach(n, c - take, rest):
            take[i] += k
    out = np.zeros(len(n), np.int64)
    out[order] = take
    return out


def mix_sources(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, row: str | None = None,
) -> DataFrame:
    """Per row: doc_id, row (the column named so, else a number), size, source, source_size, target, copies (0, 1, ... up to ``most``) and taken (size times copies).

    A source gets as many whole passes as fit its target; what is left is a subset sum over its documents' exact
    lengths, and the documents of a length are chosen by a seeded hash of the id, so reruns agree. Null is a source of
    its own; a null or empty text has size 0 and is never taken beyond the whole passes. Repeated rows of one id are
    documents of their own, told apart by their row. An empty table gives no rows.
    """
    rows = stored(
        docs.select(
            F.col(f"`{id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`")).alias("size"),
            F.xxhash64(F.lit(seed), F.col(f"`{id}`").cast("string")).alias("draw"), (F.col(f"`{row}`") if row else F.monotonically_increasing_id()).alias("row"),
        ),
        "sizes",
    )
    rows = in_lots(rows, LOTS)
    lots = rows.groupBy("source", "size", "lot").agg(F.count("*").alias("n"))
    lots = stored(lots, "lots")
    by_length = lots.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes, weights, share, most)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        size, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        passes = min(int(most), int(target // size)) if size else 0
        budget = int(round(target)) - passes * size
        more = fit_counts(part["size"].to_numpy(), part["n"].to_numpy(), budget) if passes < most else np.zeros(len(part), np.int64)
        return part.assign(passes=passes, more=more)[["source", "size", "source_size", "target", "passes", "more"]]

    # one group holds one source's lengths and their counts, not its documents
    joined = by_length.alias("l").join(targets.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).select("l.*", "source_size", "target")
    plan = joined.groupBy("source").applyInPandas(
        fit, "source string, size long, source_size long, target double, passes int, more long"
    )
    earlier = F.sum("n").over(Window.partitionBy("source", "size").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1))
    dealt = lots.withColumn("earlier", F.coalesce(earlier, F.lit(0)))
    dealt = dealt.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")))
    dealt = dealt.select("d.source", "d.size", "d.lot", "source_size", "target", "passes", (F.col("more") - F.col("earlier")).alias("here"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "lot").orderBy("draw", "doc_id", "row"))
    ranked = rows.withColumn("rank", rank)
    out = ranked.alias("r").join(
        dealt.alias("d"),
        F.col("r.source").eqNullSafe(F.col("d.source")) & (F.col("r.size") == F.col("d.size")) & (F.col("r.lot") == F.col("d.lot")),
    )
    copies = F.col("passes") + F.when(F.col("rank") <= F.col("here"), 1).otherwise(0)
    return out.select("doc_id", "row", "r.size", "r.source", "source_size", "target", copies.alias("copies"), (F.col("r.size") * copies).alias("taken"))


def repeat(docs: DataFrame, mixed: DataFrame, row: str) -> DataFrame:
    """The rows of ``docs`` with their columns, each as often as the mix takes it, where ``row`` is the column that told rows apart there.

    Rows with a null id or an id of other rows too are taken by their own copies. An empty table gives no rows.
    """
    taken, copies, copy = (free_name(docs, n) for n in ("__taken", "__copies", "__copy"))
    mix = mixed.filter("copies > 0").select(F.col("row").alias(taken), F.col("copies").alias(copies))
    rows = docs.join(mix, F.col(f"`{row}`") == F.col(taken))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(taken, copies, copy)
