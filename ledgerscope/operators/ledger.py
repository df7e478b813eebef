"""The ledger: decoding logs, dropping implausible transfers, balances and supply at instants, reconciliation, issuance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerscope.functions import wide
from ledgerscope.functions.classify import is_burn
from ledgerscope.functions.keys import hex_to_decimal, hex_to_long, negated, topic_address
from ledgerscope.operators import steps
from ledgerscope.shared import settled

#: Fixed value: the topic of a Transfer event.
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"


def scan_logs(raw: DataFrame, head: int | None = None, step: int = 10_000) -> DataFrame:
    """Transfer logs up to a pinned head, or all to the newest block without one, with the aligned block window each belongs to (``block_window``). A block number that is none, or has over 15 digits, is left out."""
    block = hex_to_long(F.col("blockNumber"))
    return raw.filter((F.get("topics", F.lit(0)) == TRANSFER_TOPIC) & (block.isNotNull() if head is None else block <= head)).withColumn("block_window", block - F.pmod(block, F.lit(step)))


def decode_logs(raw: DataFrame, blocks: DataFrame | None = None, skipped: Observation | None = None, unresolved: Observation | None = None, whole_words: bool = False) -> DataFrame:
    """Logs of three topics as transfers (asset_uid, block, log_index, tx_hash, from_address, to_address, raw, overflow, block_time).

    ``raw`` is exact up to 2^126, else null with ``overflow`` set (``drop_implausible`` takes a null amount as above any supply). A missing or zero timestamp is looked up in ``blocks``.
    With ``whole_words`` it is a number of 256 bits (see ``wide``) instead, which balances, supplies and ``reconcile_ledger`` add up exactly; ``overflow`` is then a word that is none.
    Logs without three topics, a block or a log index are skipped. ``skipped`` observes their number (``skipped_logs``), ``unresolved`` that of transfers whose time is
    not found (``unresolved_times``), in the pass that reads the logs; both are known once an action on the result has ended.
    """
    whole = (F.size("topics") == 3) & hex_to_long(F.col("blockNumber")).isNotNull() & hex_to_long(F.col("logIndex")).isNotNull()
    read = raw.withColumn("__whole", F.coalesce(whole, F.lit(False)))
    if skipped is not None:
        read = read.observe(skipped, F.count_if(~F.col("__whole")).alias("skipped_logs"))
    out = read.filter("__whole").select(
        "asset_uid", hex_to_long(F.col("blockNumber")).alias("block"), hex_to_long(F.col("logIndex")).alias("log_index"), F.col("transactionHash").alias("tx_hash"),
        topic_address(F.get("topics", F.lit(1))).alias("from_address"), topic_address(F.get("topics", F.lit(2))).alias("to_address"),
        (wide.from_hex if whole_words else hex_to_decimal)(F.col("data")).alias("raw"), hex_to_long(F.col("blockTimestamp")).alias("__s"),
    )
    out = out.withColumn("overflow", F.col("raw").isNull()).withColumn("block_time", F.when(F.col("__s") > 0, F.timestamp_seconds("__s"))).drop("__s")
    out = block_times(out, blocks) if blocks is not None else out
    return out if unresolved is None else out.observe(unresolved, F.count_if(F.col("block_time").isNull()).alias("unresolved_times"))


def block_times(transfers: DataFrame, blocks: DataFrame) -> DataFrame:
    b = blocks.select(F.col("number").alias("block"), F.col("timestamp").alias("__at"))
    return transfers.join(b, "block", "left").withColumn("block_time", F.coalesce("block_time", "__at")).drop("__at")


def human(raw: str, decimals: str, whole_words: bool = False) -> F.Column:
    """A raw amount, or one of 256 bits, in the token's units, as a double, after all exact steps."""
    return (wide.to_double(F.col(raw)) if whole_words else F.col(raw).cast("double")) / F.pow(F.lit(10.0), F.col(decimals))


def running_sum(rows: DataFrame, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """The sum of ``value`` over an asset's rows before each row. Buckets of the order are summed first, so no window holds a whole asset."""
    totals = rows.groupBy("asset_uid", bucket).agg(F.sum(value).alias("__total"))
    before = F.sum("__total").over(Window.partitionBy("asset_uid").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("asset_uid", bucket, F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy("asset_uid", bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(out, F.coalesce(inside, F.lit(0))).join(offsets, ["asset_uid", bucket]).withColumn(out, F.col(out) + F.col("__before")).drop("__before")


#: Mints and burns of an asset that one task replays, about.
LOT_ROWS = 100_000

#: Lots that one task puts together to the next level.
FAN = 64

#: Pieces of a lot's effect that are kept; a lot with more is replayed from its start once that is known.
PIECES = 1024


def drop_implausible(transfers: DataFrame, bucket: str = "bucket", seq: str = "seq", lot_rows: int = LOT_ROWS, fan: int = FAN, pieces: int = PIECES) -> DataFrame:
    """Adds ``dropped``: a transfer out of no burn address that moves more than the supply so far. A dropped burn leaves the supply as it was.

    A null amount is one too large to be a number (see ``decode_logs``): above any supply, so it is dropped, and a mint of
    one is kept but never added. ``seq`` orders an asset's rows, ``bucket`` (no null) its stretches, and neither contradicts the other.

    Only mints and burns change a supply, so only they are replayed; their narrow rows are written once. Where an asset's
    mints less burns never go below zero, the supply after a move is their running sum. Other assets, where a dropped
    burn makes a true recurrence, are replayed by ``supply_after``. All rows then meet the supply after the last move before
    them in one window over their bucket.
    """
    mint, burn = is_burn(F.col("from_address")), is_burn(F.col("to_address"))
    known = F.when(mint, F.col("amount")).when(burn, negated(F.col("amount")))
    moves = settled(transfers.select("asset_uid", F.col(bucket).alias("bucket"), F.col(seq).alias("seq"), known.alias("delta")).filter("delta IS NOT NULL"))
    summed = running_sum(moves, "bucket", ["seq"], "delta", "before").withColumn("after", F.col("before") + F.col("delta"))
    negative = settled(summed.groupBy("asset_uid").agg(F.min("after").alias("least")).filter("least < 0").select("asset_uid"))
    after = settled(
        summed.join(negative, "asset_uid", "left_anti").select("asset_uid", "bucket", "seq", "after")
        .unionByName(supply_after(moves.join(negative, "asset_uid", "left_semi"), lot_rows, fan, pieces))
    )
    # a bucket starts with what the last move of an earlier one left
    ends = after.groupBy("asset_uid", "bucket").agg(F.max_by("after", "seq").alias("end"))
    earlier = Window.partitionBy("asset_uid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = transfers.select("asset_uid", F.col(bucket).alias("bucket")).distinct().join(ends, ["asset_uid", "bucket"], "left")
    begun = begun.select("asset_uid", "bucket", F.lit(None).cast(moves.schema["seq"].dataType).alias("seq"), F.coalesce(F.last("end", ignorenulls=True).over(earlier), F.lit(0)).alias("after"))
    marks = begun.unionByName(after).select("asset_uid", F.col("bucket").alias(bucket), F.col("seq").alias(seq), F.col("after").alias("__after"), F.lit(True).alias("__mark"))
    rows = transfers.withColumn("__mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy("asset_uid", bucket).orderBy(F.col(seq).asc_nulls_first(), "__mark").rowsBetween(Window.unboundedPreceding, -1)
    supply = F.coalesce(F.last("__after", ignorenulls=True).over(before), F.lit(0))
    out = rows.withColumn("__supply", supply).filter("NOT __mark")
    return out.withColumn("dropped", ~mint & (F.col("amount").isNull() | (F.col("amount") > F.col("__supply")))).select(*transfers.columns, "dropped")


def supply_after(moves: DataFrame, lot_rows: int = LOT_ROWS, fan: int = FAN, pieces: int = PIECES) -> DataFrame:
    """The supply after each mint or burn (asset_uid, bucket, seq, delta), as ``after``; a burn above the supply changes nothing.

    Buckets, or stretches of at most ``lot_rows`` moves of a longer one, are put together to lots of less than twice ``lot_rows``, a task each. What a lot does to the supply it starts
    from is a step function: on each stretch of starts the same burns are refused, so the same number is added.
    Such functions are found for all lots at once, on the starts that mints and burns before them allow, put together ``fan`` at a time up
    to one for each asset, and applied on the way down, so the rounds grow with the logarithm of the lots. An asset with a function of over ``pieces``
    steps, which takes burns that refuse one another over and over, is replayed lot after lot instead (``_starts_in_turn``). An asset of one lot needs none of it.
    """
    placed, per = _lots(moves, lot_rows)
    starts = _lot_starts(placed, per, fan, pieces)
    kind = starts.schema["start"].dataType.simpleString()

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        return part[["asset_uid", "bucket", "seq"]].assign(after=steps.replay(part["start"].iloc[0], part["delta"]))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moves.select("asset_uid", "bucket", "seq").schema) + f", after {kind}"
    return placed.join(starts, ["asset_uid", "lot"]).groupBy("asset_uid", "lot").applyInPandas(replay, schema)


def _lots(moves: DataFrame, lot_rows: int) -> tuple[DataFrame, DataFrame]:
    """The moves with their ``lot``, and what each stretch of a lot comes to (n, net, minted)."""
    place = F.row_number().over(Window.partitionBy("asset_uid", "bucket").orderBy("seq"))
    cut = moves.withColumn("stretch", F.floor((place - 1) / lot_rows))
    before = Window.partitionBy("asset_uid").orderBy("bucket", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    per = cut.groupBy("asset_uid", "bucket", "stretch").agg(F.count("*").alias("n"), F.sum("delta").alias("net"), F.sum(F.greatest("delta", F.lit(0).cast(moves.schema["delta"].dataType))).alias("minted"))
    per = settled(per.withColumn("lot", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / lot_rows)))
    return cut.join(per.select("asset_uid", "bucket", "stretch", "lot"), ["asset_uid", "bucket", "stretch"]).drop("stretch"), per


def _lot_starts(placed: DataFrame, per: DataFrame, fan: int, pieces: int) -> DataFrame:
    """The supply at which each lot starts: asset_uid, lot, start."""
    kind = per.schema["net"].dataType.simpleString()
    earlier = Window.partitionBy("asset_uid").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(kind)
    # a start is at least all mints less all burns before it, and at most all mints
    sums = per.groupBy("asset_uid", "lot").agg(F.sum("net").cast(kind).alias("net"), F.sum("minted").cast(kind).alias("minted"))
    low, high = (F.coalesce(F.sum(c).over(earlier), zero).cast(kind) for c in ("net", "minted"))
    last = F.max("lot").over(Window.partitionBy("asset_uid"))
    lots = settled(sums.withColumn("low", F.greatest(low, zero)).withColumn("high", high).withColumn("last", last).select("asset_uid", "lot", "net", "low", "high", "last"))
    depth = lots.agg(F.max("last")).first()[0] or 0
    alone = lots.filter("last = 0").select("asset_uid", "lot", zero.alias("start"))
    if depth == 0:
        return alone
    shape = f"asset_uid string, lot long, high {kind}, at array<{kind}>, add array<{kind}>"

    def found(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        at, add = steps.of_moves(part["delta"], part["low"].iloc[0], part["high"].iloc[0], pieces)
        return pd.DataFrame({"asset_uid": part["asset_uid"].iloc[:1], "lot": part["lot"].iloc[:1], "high": part["high"].iloc[:1], "at": [at], "add": [add]})

    def put_together(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("lot")
        at, add = steps.chain(zip(part["high"], part["at"], part["add"], strict=True), pieces)
        return pd.DataFrame({"asset_uid": part["asset_uid"].iloc[:1], "lot": part["lot"].iloc[:1] // fan, "high": part["high"].iloc[:1], "at": [at], "add": [add]})

    def handed_down(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("lot")
        return part[["asset_uid", "lot"]].assign(start=steps.starts(part["start"].iloc[0], zip(part["at"], part["add"], strict=True)))

    # nothing follows the last lot of an asset, so what it does is not asked
    asked = placed.join(lots.filter("lot < last").select("asset_uid", "lot", "low", "high"), ["asset_uid", "lot"])
    ends = lots.filter("lot = last AND last > 0").select("asset_uid", "lot", "high", F.array("low").alias("at"), F.array(zero).alias("add"))
    levels = [settled(asked.groupBy("asset_uid", "lot").applyInPandas(found, shape).unionByName(ends))]
    while depth >= fan:
        depth //= fan
        levels.append(settled(levels[-1].groupBy("asset_uid", F.floor(F.col("lot") / fan)).applyInPandas(put_together, shape)))
    vague = levels[0].filter("size(at) = 0").select("asset_uid")
    for level in levels[1:]:
        vague = vague.union(level.filter("size(at) = 0").select("asset_uid"))
    vague = settled(vague.distinct())
    known = levels[-1].join(vague, "asset_uid", "left_anti").withColumn("start", zero)
    down = known.groupBy("asset_uid").applyInPandas(handed_down, f"asset_uid string, lot long, start {kind}")
    for level in reversed(levels[:-1]):
        above = down.withColumnRenamed("lot", "__above")
        below = level.withColumn("__above", F.floor(F.col("lot") / fan)).join(above, ["asset_uid", "__above"])
        down = below.groupBy("asset_uid", "__above").applyInPandas(handed_down, f"asset_uid string, lot long, start {kind}")
    starts = alone.unionByName(down)
    if vague.isEmpty():
        return starts
    return starts.unionByName(_starts_in_turn(placed.join(vague, "asset_uid", "left_semi"), lots.join(vague, "asset_uid", "left_semi")))


def _starts_in_turn(placed: DataFrame, lots: DataFrame) -> DataFrame:
    """The starts of lots by rounds: first as if no burn were refused, then lots whose start has changed are replayed again until none has."""
    kind = lots.schema["net"].dataType.simpleString()
    nets = lots.select("asset_uid", "lot", "net").withColumn("start", F.lit(None).cast(kind))
    earlier = Window.partitionBy("asset_uid").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        return pd.DataFrame({"asset_uid": part["asset_uid"].iloc[:1], "lot": part["lot"].iloc[:1], "net": [steps.net(part["due"].iloc[0], part["delta"])], "start": part["due"].iloc[:1]})

    while True:
        due = nets.withColumn("due", F.coalesce(F.sum("net").over(earlier), F.lit(0)).cast(kind))
        changed = settled(due.filter(~F.col("start").eqNullSafe(F.col("due"))))
        if changed.isEmpty():
            return nets.select("asset_uid", "lot", "start")
        again = placed.join(changed.select("asset_uid", "lot", "due"), ["asset_uid", "lot"])
        played = again.groupBy("asset_uid", "lot").applyInPandas(run, f"asset_uid string, lot long, net {kind}, start {kind}")
        nets = settled(due.join(changed, ["asset_uid", "lot"], "left_anti").drop("due").unionByName(played))


def dropped_counts(flagged: DataFrame, assets: DataFrame) -> DataFrame:
    """Dropped transfers of every asset of the list, zero included."""
    n = flagged.groupBy("asset_uid").agg(F.count_if("dropped").alias("dropped"))
    return assets.select("asset_uid").join(n, "asset_uid", "left").fillna(0, ["dropped"])


def legs(transfers: DataFrame) -> DataFrame:
    """Two rows a transfer: the sender loses and the recipient gains the amount (asset_uid, address, delta, block_time). The amount is a number, or one of 256 bits."""
    two = F.explode(F.array(F.struct(F.lower("from_address").alias("address"), wide.minus(transfers, "amount").alias("delta")), F.struct(F.lower("to_address").alias("address"), F.col("amount").alias("delta"))))
    return transfers.select("asset_uid", "block_time", two.alias("leg")).select("asset_uid", "leg.address", "leg.delta", "block_time")


def _next_instant(rows: DataFrame, instants: DataFrame) -> DataFrame:
    """Each row with the first instant after it as ``as_of``; rows after the last are left out.

    Instants with a ``month``, the ends of consecutive months, are found by the row's month. Others, a declared list, are
    one broadcast array.
    """
    if "month" in instants.columns:
        own = F.add_months(F.trunc("block_time", "month"), 1).cast("timestamp")
        out = rows.crossJoin(F.broadcast(_span(instants))).withColumn("as_of", F.greatest(own, F.col("__first"))).filter(F.col("as_of") <= F.col("__last"))
        return out.drop("__first", "__last")
    out = rows.crossJoin(F.broadcast(_listed(instants))).withColumn("as_of", F.get(F.filter("__all", lambda x: x > F.col("block_time")), F.lit(0)))
    return out.drop("__all").filter("as_of IS NOT NULL")


def _span(instants: DataFrame) -> DataFrame:
    return instants.agg(F.min("as_of").alias("__first"), F.max("as_of").alias("__last"))


def _listed(instants: DataFrame) -> DataFrame:
    return instants.select("as_of").distinct().agg(F.sort_array(F.collect_list("as_of")).alias("__all"))


def _intervals(moved: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Sums of ``delta`` up to each ``as_of`` as ``out``, which hold from it up to ``until``, the next one with a change (null: for good)."""
    w = Window.partitionBy(*keys).orderBy("as_of")
    summed = moved.groupBy(*keys, "as_of").agg(wide.total(moved, "delta").alias("delta"))
    return summed.select(*keys, "as_of", wide.total(summed, "delta", w.rowsBetween(Window.unboundedPreceding, 0)).alias(out), F.lead("as_of").over(w).alias("until"))


def _expanded(held: DataFrame, instants: DataFrame) -> DataFrame:
    """A row for each instant of an interval: from ``as_of`` on, before ``until``."""
    if "month" in instants.columns:
        end = F.coalesce(F.add_months("until", -1).cast("timestamp"), F.col("__last"))
        at = held.crossJoin(F.broadcast(_span(instants))).withColumn("as_of", F.explode(F.sequence("as_of", end, F.expr("interval 1 month"))))
        return at.drop("until", "__first", "__last")
    inside = F.filter("__all", lambda x: (x >= F.col("as_of")) & (F.col("until").isNull() | (x < F.col("until"))))
    return held.crossJoin(F.broadcast(_listed(instants))).withColumn("as_of", F.explode(inside)).drop("until", "__all")


def balance_intervals(transfers: DataFrame, instants: DataFrame) -> DataFrame:
    """Positive balances, burn addresses left out, as intervals: asset_uid, address, balance, as_of, until.

    A balance holds at ``as_of``, just before which it was reached, and at every later instant before ``until`` (null: to
    the last). An address has a row for each instant by which it has changed, so a holder who never moves is one row,
    whatever the number of instants. Changes are added up by instant before they meet, so no window holds more rows than there are instants.
    """
    held = _intervals(_next_instant(legs(transfers), instants), ["asset_uid", "address"], "balance")
    return _positive(held)


def _positive(held: DataFrame) -> DataFrame:
    return held.filter((F.col("balance") > wide.nothing(held, "balance")) & ~is_burn(F.col("address")))


def balances_at(transfers: DataFrame, instants: DataFrame) -> DataFrame:
    """Positive balances just before each instant, burn addresses left out: asset_uid, as_of, address, balance. Intervals are expanded where a balance exists, and only there."""
    return _expanded(balance_intervals(transfers, instants), instants).select("asset_uid", "as_of", "address", "balance")


def balances_at_head(transfers: DataFrame, head: int | None = None, block: str = "block") -> DataFrame:
    """Positive balances after all transfers up to and including block ``head`` (None: the newest), without instants.

    asset_uid, as_of, address, balance; burn addresses are left out. ``as_of`` is the time of the newest block read, of any asset: the moment the balances describe.
    """
    read = transfers if head is None else transfers.filter(F.col(block) <= head)
    moved = legs(read)
    held = _positive(moved.groupBy("asset_uid", "address").agg(wide.total(moved, "delta").alias("balance")))
    return held.crossJoin(F.broadcast(read.agg(F.max_by("block_time", block).alias("as_of")))).select("asset_uid", "as_of", "address", "balance")


def supply_at(transfers: DataFrame, instants: DataFrame) -> DataFrame:
    """Mints less burns before each instant: asset_uid, as_of, total_supply. A transfer from zero to a burn address counts as a mint."""
    mint, burn = is_burn(F.col("from_address")), is_burn(F.col("to_address"))
    none = wide.nothing(transfers, "amount")
    delta = F.when(mint, F.col("amount")).when(burn, wide.minus(transfers, "amount")).otherwise(none)
    begun = transfers.select("asset_uid").distinct().crossJoin(F.broadcast(instants.agg(F.min("as_of").alias("as_of")))).withColumn("delta", none).filter("as_of IS NOT NULL")
    moved = _next_instant(transfers.select("asset_uid", "block_time", delta.alias("delta")), instants).select("asset_uid", "as_of", "delta")
    out = _expanded(_intervals(moved.unionByName(begun), ["asset_uid"], "total_supply"), instants)
    return out.select("asset_uid", "as_of", F.coalesce("total_supply", none).alias("total_supply"))


def reconcile_ledger(transfers: DataFrame, reported: DataFrame) -> DataFrame:
    """Per asset: true if positive balances sum to the reported supply and none is negative, false if not, null if no supply is reported and none is negative. Amounts and supplies are numbers, or both of 256 bits and carried."""
    moved, none = legs(transfers), wide.nothing(transfers, "amount")
    held = moved.filter(~is_burn(F.col("address"))).groupBy("asset_uid", "address").agg(wide.total(moved, "delta").alias("b"))
    sums = held.groupBy("asset_uid").agg(
        F.coalesce(wide.total(held, "b", where=F.col("b") > none), none).alias("held"), F.count_if(F.col("b") < none).alias("negative")
    )
    out = sums.join(reported.select("asset_uid", "total_supply"), "asset_uid", "left")
    return out.select(
        "asset_uid", "held", "negative", "total_supply",
        F.when(F.col("negative") > 0, False).when(F.col("total_supply").isNull(), None).otherwise(F.col("held") == F.col("total_supply")).alias("reconciled"),
    )


def issuance_profile(transfers: DataFrame) -> DataFrame:
    """Per asset: transfers, mints, burns, minted, first mint, and the largest recipient of mints (of all receipts if nothing was minted) with its share; ties go to the least address."""
    mint, burn = is_burn(F.col("from_address")), is_burn(F.col("to_address")) & ~is_burn(F.col("from_address"))
    base = transfers.withColumn("__mint", mint)
    facts = base.groupBy("asset_uid").agg(
        F.count("*").alias("transfers"), F.count_if("__mint").alias("mints"), F.count_if(burn).alias("burns"),
        F.coalesce(F.sum(F.when(mint, F.col("amount"))), F.lit(0)).alias("minted"), F.min(F.when(mint, F.col("block_time"))).alias("first_mint"),
    )
    to = base.groupBy("asset_uid", F.lower("to_address").alias("recipient")).agg(
        F.sum(F.when(F.col("__mint"), F.col("amount"))).alias("m"), F.sum("amount").alias("r")
    )
    got = to.join(facts.select("asset_uid", "minted"), "asset_uid").withColumn("got", F.when(F.col("minted") > 0, F.coalesce("m", F.lit(0))).otherwise(F.col("r")))
    top = got.groupBy("asset_uid").agg(F.min(F.struct(negated(F.col("got")).alias("x"), "recipient")).alias("t"), F.sum("got").alias("all_got"))
    return facts.join(top, "asset_uid").select(
        *facts.columns, F.col("t.recipient").alias("top_recipient"), F.when(F.col("all_got") > 0, negated(F.col("t.x")) / F.col("all_got")).alias("top_share")
    )


def issuance_caveat(profile: DataFrame) -> DataFrame:
    """Adds ``caveat``: null where mints are seen, else what their absence means for the secondary figures, and who received most."""
    most = F.format_string(
        " Most was received by %s, %.1f%% of all receipts: if that is the issuer, list it as one, and what it hands out counts as primary.", F.col("top_recipient"), F.col("top_share") * 100
    )
    text = F.concat(
        F.lit("No issuance is seen: nothing ever leaves the zero address, so secondary figures may hold an issuer's own distribution and are upper bounds."),
        F.when(F.col("top_recipient").isNotNull() & F.col("top_share").isNotNull(), most).otherwise(""),
    )
    return profile.withColumn("caveat", F.when(F.col("mints") == 0, text))
