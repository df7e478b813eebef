"""Exact duplicates: binary-fuse filters over an immutable snapshot, exact buckets with byte checks behind them.

Two texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted; null counts as
empty. A snapshot is a table of distinct digests that never changes, with one static filter per digest bucket. An
incoming batch is first grouped by digest by itself, so a hot text is one row before anything is moved; the filters then
screen these groups, positives join the snapshot's rows on the digest, and the texts of such pairs are compared.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.text import SPACE, free_name, mix, stored

#: Digests in one filter bucket, about: a filter of so many keys has some 60 kB.
KEYS_PER_FILTER = 50_000


class BinaryFuse:
    """An 8-bit, three-way binary-fuse filter over distinct 64-bit keys: no false negatives, 1/256 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + np.uint64(seed))
        low = np.uint64(segment - 1)
        at = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
        b = (at + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low)
        c = (at + np.uint64(2 * segment)) ^ (h & low)
        return np.stack([at, b, c]).astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(np.asarray(keys, np.uint64))
        n = max(len(keys), 2)
        segment = min(1 << 18, 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)))
        slots = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
        segments = max(1, -(-slots // segment) - 2)
        seed = 0
        while True:
            seed += 0x9E3779B9
            places, prints = cls._places(keys, seed, segment, segments)
            order = cls._peel(places, (segments + 2) * segment)
            if order is not None:
                break
            if seed > 40 * 0x9E3779B9:
                segments += 1 + segments // 8
        table = np.zeros((segments + 2) * segment, np.uint8)
        for ks, slots_ in reversed(order):
            # the keys of a round share no slot of their own, so a round is assigned at once
            p = places[:, ks]
            table[slots_] = 0
            table[slots_] = prints[ks] ^ table[p[0]] ^ table[p[1]] ^ table[p[2]]
        return cls(seed, segment, segments, table)

    @staticmethod
    def _peel(places: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the slot that only they use), or None if some keys are left."""
        n = places.shape[1]
        count = np.bincount(places.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in places:
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds, left, front = [], n, np.flatnonzero(count == 1)
        while len(front):
            keys, pick = np.unique(owner[front], return_index=True)
            rounds.append((keys, front[pick]))
            left -= len(keys)
            touched = places[:, keys]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, keys)
            front = np.unique(touched)
            front = front[count[front] == 1]
        return rounds if left == 0 else None

    def __contains__(self, key: int) -> bool:
        return bool(self.screen(np.array([key], np.uint64))[0])

    def screen(self, keys: np.ndarray) -> np.ndarray:
        p, f = self._places(np.asarray(keys, np.uint64), self.seed, self.segment, self.segments)
        t = self.prints
        return f == (t[p[0]] ^ t[p[1]] ^ t[p[2]])


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


@dataclass(frozen=True)
class Snapshot:
    """``rows``: one row per distinct digest (digest, n, best); ``filters``: one static filter per bucket; both are written tables."""

    rows: DataFrame
    filters: DataFrame
    buckets: int


def fingerprints(docs: DataFrame, side: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars (code points), digest (SHA-256 of the normalised text), row (a number of the row) and side."""
    return docs.select(
        F.col(f"`{id}`").alias("doc_id"),
        F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long").alias("n_chars"),
        F.unhex(F.sha2(normalised(F.col(f"`{text}`")), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
        side.alias("side"),
    )


def grouped(prints: DataFrame) -> DataFrame:
    """One row per digest: n rows, and best, the row that stays (most code points, then smallest doc_id, then row)."""
    return prints.groupBy("digest").agg(
        F.count("*").alias("n"), F.min(F.struct((-F.col("n_chars")).alias("less"), "doc_id", "row")).alias("best")
    )


def _bucket(buckets: int) -> Column:
    # 15 hex digits of the digest, so that the number is not negative
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _key(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x)[8:16] for x in digests), np.uint64)


def build_snapshot(prints: DataFrame) -> Snapshot:
    """Groups the rows by digest and builds a static filter for every bucket of digests."""
    rows = stored(grouped(prints), "snapshot")
    buckets = 1 + rows.count() // KEYS_PER_FILTER

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse.build(_key(part["digest"]))
        return pd.DataFrame({"bucket": [key[0]], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "prints": [f.prints.tobytes()]})

    filters = (
        rows.select("digest", _bucket(buckets).alias("bucket"))
        .groupBy("bucket")
        .applyInPandas(build, "bucket int, seed long, segment int, segments int, prints binary")
    )
    return Snapshot(rows, stored(filters, "filters"), buckets)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Adds ``maybe``: false if the digest is certainly not in the snapshot. One row per digest goes in and out."""

    def look(held: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(new), bool)
        if len(held) and len(new):
            f = held.iloc[0]
            hit = BinaryFuse(int(f["seed"]), int(f["segment"]), int(f["segments"]), np.frombuffer(f["prints"], np.uint8)).screen(_key(new["digest"]))
        return pd.DataFrame({"digest": new["digest"], "maybe": hit})

    marked = groups.select("digest", _bucket(snapshot.buckets).alias("bucket"))
    return snapshot.filters.groupBy("bucket").cogroup(marked.groupBy("bucket")).applyInPandas(look, "digest binary, maybe boolean")


#: Bits of the screen for each wanted digest, and at most: 64 MB go to every task, whatever the input.
SCREEN_SHARE, SCREEN_MOST = 16, 1 << 29


def _screened(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Rows whose digest may be one of the n wanted. These set bits of a bitmap that is sized by their count up to a bound and broadcast in pages
    of 4 kB; beyond the bound more other rows pass and move, but none that is wanted is lost."""
    bits = min(SCREEN_MOST, max(1 << 16, 1 << math.ceil(math.log2(max(n, 1) * SCREEN_SHARE))))
    bit = lambda digest: F.pmod(F.xxhash64(digest), F.lit(bits)) + 1
    marks = wanted.select(bit(F.col("digest")).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("__page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("__bits"))
    x = rows.withColumn("__x", bit(F.col("digest")))
    at = F.bitmap_bit_position("__x")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0
    return x.join(F.broadcast(marks), F.bitmap_bucket_number("__x") == F.col("__page")).filter(hit).drop("__x", "__page", "__bits")


def _texts(docs: DataFrame, wanted: DataFrame, n: int, id: str, text: str) -> DataFrame:
    """The normalised text of each wanted (digest, side, doc_id): of repeated rows one."""
    body = docs.select(F.col(f"`{id}`").alias("doc_id"), normalised(F.col(f"`{text}`")).alias("body")).withColumn(
        "digest", F.unhex(F.sha2("body", 256))
    )
    body = _screened(body, wanted, n)
    w = wanted.select(F.col("digest").alias("w_digest"), F.col("doc_id").alias("w_id"), "side")
    found = body.join(w, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("digest") == F.col("w_digest"))).select("digest", "side", "body")
    return found.groupBy("digest", "side").agg(F.min("body").alias("body"))


def dedup(docs: DataFrame, snapshot_if: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Exact duplicates of a whole table, of which the rows where ``snapshot_if`` holds are the snapshot and the rest arrives.

    Returns per row: doc_id, keep_id, group_size, kept, text_sha256, n_chars (of the original text). Of equal texts stays the row with the most code
    points in the original text, then the smallest doc_id (null first), then any one of identical rows. Null and empty
    texts, and texts of white space only, are one group. Other columns are not read; an empty table gives no rows.
    """
    side = F.when(F.coalesce(snapshot_if, F.lit(False)), "held").otherwise("new")
    prints = stored(fingerprints(docs, side, id, text), "digests")
    held = build_snapshot(prints.filter("side = 'held'"))
    new = stored(grouped(prints.filter("side = 'new'")), "incoming")
    maybe = screen(new, held).filter("maybe").select("digest")
    pairs = stored(
        maybe.join(held.rows.select("digest", F.col("best").alias("old")), "digest").join(new.select("digest", F.col("best").alias("new")), "digest"), "pairs"
    )
    wanted = pairs.select("digest", F.lit("held").alias("side"), F.col("old.doc_id").alias("doc_id")).unionByName(
        pairs.select("digest", F.lit("new").alias("side"), F.col("new.doc_id").alias("doc_id"))
    )
    bodies = _texts(docs, wanted, pairs.count(), id, text)
    # equal digests of unequal bytes: such a group stays by itself
    unequal = bodies.groupBy("digest").agg((F.min("body") != F.max("body")).alias("unequal")).filter("unequal")
    sides = (
        held.rows.withColumn("side", F.lit("held")).unionByName(new.withColumn("side", F.lit("new"))).join(unequal, "digest", "left")
        .select("digest", "side", "n", "best", F.when(F.col("unequal"), F.col("side")).otherwise("").alias("part"))
    )
    classes = sides.groupBy("digest", "part").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"), F.collect_set("side").alias("sides"))
    by_side = classes.select("digest", F.explode("sides").alias("side"), "group_size", "best")
    return prints.join(by_side, ["digest", "side"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_chars",
    )


def _row_key(id: Column, digest: Column, n_chars: Column) -> Column:
    return F.concat_ws(":", F.coalesce(id.cast("string"), F.lit("null")), digest, n_chars.cast("string"))


def drop_copies(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns, where ``found`` is what ``dedup`` returned for them.

    A row stays by its id, its normalised text and its length, so one id with several texts is judged text by text; of
    rows that repeat all three, one stays. Such repeats are dropped before the texts move, and texts move once.
    """
    name = free_name(docs, "__key")
    ids = found.filter("kept").select(_row_key(F.col("doc_id"), F.col("text_sha256"), F.col("n_chars")).alias(name)).distinct()
    body = F.col(f"`{text}`")
    key = _row_key(F.col(f"`{id}`"), F.sha2(normalised(body), 256), F.length(F.coalesce(body, F.lit(""))))
    # an inner join, as a semi-join would be pushed below the dropping of repeats
    return docs.withColumn(name, key).dropDuplicates([name]).join(ids, name).drop(name)
