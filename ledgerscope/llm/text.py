"""Word splitting and hashing on Arrow batches, and the shared work folder.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. All kernels work on the UTF-8 buffer of an
Arrow column with numpy, so no Python object is made per word.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The white space between words, as characters and as a Java regular expression.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_PIECE = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(length: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < length:
        n = max(length, _PIECE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("p", _BASE), ("i", inverse)):
            x = np.full(n, np.uint64(base), dtype=np.uint64)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            _powers[name] = x
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch of texts: ``hashes``, ``starts`` and ``lens`` in bytes, ``first`` (n + 1 word offsets of the texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data, self.offsets = data, offsets
        hashes, starts, lens = [], [], []
        cuts = np.unique(offsets)
        at = 0
        while at < len(data):
            to = self._cut(cuts, at)
            h, s, n = self._piece(data[at:to], cuts[(cuts >= at) & (cuts < to)] - at, lower)
            hashes.append(h)
            starts.append(s + at)
            lens.append(n)
            at = to
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.lens = np.concatenate(lens) if lens else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, offsets)

    def _cut(self, cuts: np.ndarray, at: int) -> int:
        """The end of a piece: a text's end, or else white space, about _PIECE bytes on."""
        end = at + _PIECE
        if end >= len(self.data):
            return len(self.data)
        k = np.searchsorted(cuts, end, "right") - 1
        if cuts[k] > at:
            return int(cuts[k])
        while end < len(self.data):
            part = self.data[end : end + _PIECE]
            gap = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
            stop = int(cuts[np.searchsorted(cuts, end, "right")])
            if len(gap):
                return min(end + int(gap[0]), stop)
            if stop <= end + _PIECE:
                return stop
            end += _PIECE
        return len(self.data)

    @staticmethod
    def _piece(d: np.ndarray, begins: np.ndarray, lower: bool):
        inside = ~((d == 32) | ((d >= 9) & (d <= 13)))
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        start[begins] = inside[begins]
        stop = np.zeros(len(d) + 1, bool)
        stop[1:] = inside
        stop[1:-1] &= ~inside[1:] | start[1:]
        s, e = np.flatnonzero(start), np.flatnonzero(stop)
        if lower:
            d = np.where((d >= 65) & (d <= 90), d + np.uint8(32), d)
        p, inv = _power(len(d) + 1)
        total = np.zeros(len(d) + 1, np.uint64)
        np.cumsum((d.astype(np.uint64) + np.uint64(1)) * p[: len(d)], out=total[1:])
        h = (total[e] - total[s]) * inv[s]
        return mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), s, e - s


def words_of(column: pa.Array, lower: bool = True) -> Words:
    return Words(*buffers(column), lower)


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole rows with about ``size`` bytes of text each, so that a task's memory does not follow the row count of a batch."""
    for b in batches:
        _, offsets = buffers(b.column(column))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as empty. Counts the word starts, so no array is built."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def free_name(df, name: str) -> str:
    """The name, with underscores before it while a column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def one_text(docs, known, id: str, text: str):
    """``known`` (i, ...; one row an id) with ``t``, the id's text in ``docs``; of several rows the text with the least hash, so the result has at most the rows of ``known``.

    An id with many rows sends one text a task.
    """
    rows = docs.select(F.col(f"`{id}`").alias("i"), F.col(f"`{text}`").alias("t")).join(F.broadcast(known), "i")
    return rows.groupBy(*known.columns).agg(F.min_by("t", F.xxhash64("t")).alias("t"))


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Where none is named, on one machine only, a temporary one is set here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and held.isDefined():
        return held.get()
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df, name: str, compression: str = "zstd"):
    """Writes a DataFrame to the shared folder and reads it again: one computation, many uses, no lineage."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables) -> None:
    """Deletes tables that ``stored`` has written and nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def in_lots(rows, lots: int):
    """Adds ``lot``, from (doc_id, draw, row): by the draw, so that reruns agree, but by the row where one id has over a thousandth of the rows.

    There are at most a thousand such ids, a null one among them; they are broadcast. Rows of such an id may change places.
    """
    least = max(rows.count() // 1000, 100)
    many = rows.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n")).filter(F.col("__n") > least)
    out = rows.join(F.broadcast(many), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    key = F.when(F.col("__n").isNotNull(), F.xxhash64("draw", "row")).otherwise(F.col("draw"))
    return out.withColumn("lot", F.pmod(key, F.lit(lots)).cast("int")).drop("__id", "__n")
