"""Language-model scoring with a two-level hierarchical Pitman-Yor model, seated by Gibbs steps.

Every training word, and the start, is a context restaurant of the words that follow it; all of them share the unigram
restaurant as parent, whose own parent is a fixed base distribution. A Gibbs sweep seats all customers of every dish again,
given the tables of all other dishes: those of most dishes at once, as their number of tables is drawn from its exact
distribution, those of very large dishes customer by customer. The totals of other ranges are those of the sweep before.

How it is dealt out. Texts become blocks of word numbers, a written table bucketed by block, so that replies are joined with
it without moving it. A word has a range by its hash, a pair of context and word one by the hash of both, so that no word
and no context makes a hot key: a range gets a pair once from a block, however often it occurs there. From so many blocks
(or ranges) on that a group would grow with them, they are first added up in lots. Pairs with one customer have one table
for certain; only their numbers by word and context go on. The others are seated by their range, sweep by sweep, each
sweep a written table. Back to a block goes what it cannot know itself: of pairs that others have too the customers and
tables, of words the totals.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.text import Words, buffers, discard, held_out, mix, stored, work_dir

#: The hashes of the end token and of the start as a context, which no word can be tokenised to on purpose.
END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0x93B1F0E5A2C4D687)
_BLOCK = 12 << 20
#: Customers to a range of pairs and types to a range of words, about; how many rows of one range are added up at once.
RANGE_TOKENS, RANGE_WORDS, FAN_IN = 3 << 19, 1 << 19, 1024
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers as zstandard-compressed byte planes: those of high bytes are nearly empty. The first byte is the size of a number."""
    x = np.ascontiguousarray(x)
    if x.dtype.kind == "i":
        x = x.astype(np.uint64)
    most = int(x.max()) if len(x) else 0
    size = next(n for n in (1, 2, 4, 8) if most < 1 << 8 * n)
    x = x.astype(f"u{size}")
    planes = x.view(np.uint8).reshape(len(x), size).T.tobytes() if len(x) else b""
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(planes)


def _expand(b: bytes) -> np.ndarray:
    """Numbers that are not negative, as int64."""
    size = b[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(b)[1:], max_output_size=1 << 31), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(f"u{size}").astype(np.int64)


def _distinct(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers from 0 to ``most``, ascending, and where each of ``x`` is among them. Numbers and their places are sorted as one number where both fit."""
    bits = len(x).bit_length()
    if most.bit_length() + bits > 63 or not len(x):
        return np.unique(x, return_inverse=True)
    y = np.sort(x << bits | np.arange(len(x)))
    place = y & (1 << bits) - 1
    y >>= bits
    new = np.append(True, y[1:] != y[:-1])
    inverse = np.empty(len(x), np.int64)
    inverse[place] = np.cumsum(new) - 1
    return y[new], inverse


def _met(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value is met first, in that order, and which of them each of ``x`` is: by hashing, without sorting."""
    inverse = pd.factorize(x)[0].astype(np.int64)
    return np.flatnonzero(np.diff(np.maximum.accumulate(inverse), prepend=-1)) if len(x) else inverse, inverse


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal values."""
    if len(x):
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        yield from zip(x[at].tolist(), at.tolist(), [*at[1:].tolist(), len(x)], strict=True)


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _bits(n: float) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1.0)))))


def _pair_hash(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(ctx.astype(np.uint64) * _A) + word.astype(np.uint64) * _B)


def encode(docs: DataFrame, id: str, text: str, held: F.Column) -> DataFrame:
    """Blocks of whole texts: ids, held_out flags, token counts, distinct token hashes (frequent first) and tokens as numbers of them."""
    kind = docs.schema[id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for b in batches:
            data, offsets = buffers(b.column("t"))
            held_all = np.array(b.column("held").to_pylist(), bool)
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _BLOCK, "right")) - 1)
                w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n = np.diff(w.first)
                tokens = np.insert(w.hashes, w.first[1:], END)
                at, seq = _met(tokens)
                words = tokens[at]
                order = np.lexsort((words, -np.bincount(seq)))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()), pa.array([b.column("doc_id").slice(lo, hi - lo).to_pylist()], pa.list_(b.schema.field("doc_id").type)),
                        pa.array([held_all[lo:hi].tobytes()], pa.binary()), pa.array([_squeeze(n + 1)], pa.binary()),
                        pa.array([words[order].tobytes()], pa.binary()), pa.array([_squeeze(rank[seq])], pa.binary()),
                    ],
                    ["block", "ids", "held", "lens", "words", "seq"],
                )
                number += 1
                lo = hi

    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("t"), held.alias("held"))
    return rows.mapInArrow(run, f"block long, ids array<{kind.simpleString()}>, held binary, lens binary, words binary, seq binary")


def bucketed(blocks: DataFrame) -> DataFrame:
    """The blocks as a written table in buckets, which a join by block need not shuffle."""
    spark = blocks.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{work_dir(spark).rstrip('/')}/{name}"
    blocks.repartition(n, "block").write.option("path", path).option("compression", "zstd").bucketBy(n, "block").saveAsTable(name)
    return spark.table(name)


class _Block:
    """A block; its words are in the order of their hashes here, and the start is one of them."""

    def __init__(self, row):
        self.held = np.frombuffer(row["held"], bool)
        self.lens = _expand(row["lens"])
        words = np.append(np.frombuffer(row["words"], np.uint64), START)
        order = np.argsort(words)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.words, self.start = words[order], int(rank[-1])
        self.seq = rank[_expand(row["seq"])]
        self.begin = np.concatenate([[0], np.cumsum(self.lens)])
        self.train = np.repeat(~self.held, self.lens)

    def counts(self) -> np.ndarray:
        n = np.bincount(self.seq[self.train], minlength=len(self.words))
        n[self.start] = (~self.held).sum()
        return n

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs as contexts and words, each token's pair, and the pairs' training counts."""
        before = np.empty(len(self.seq), np.int64)
        before[1:] = self.seq[:-1]
        before[self.begin[:-1]] = self.start
        width = len(self.words)
        pairs, inverse = _distinct(before * width + self.seq, width * width)
        return pairs // width, pairs % width, inverse, np.bincount(inverse[self.train], minlength=len(pairs))

    def asked(self, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The numbers of the pairs of known words by range, those ranges, and the pairs."""
        ctx, word, inverse, cnt = self.pairs()
        known = np.flatnonzero((ids[ctx] >= 0) & (ids[word] >= 0))
        part = _top(_pair_hash(ids[ctx[known]], ids[word[known]]), bits)
        order = np.argsort(part.astype(np.uint16) if bits <= 16 else part, kind="stable")
        return known[order], part[order], (ctx, word, inverse, cnt)


def _lot(number: int, lots: int) -> int:
    return int(mix(np.array([number], np.uint64))[0] % np.uint64(lots)) if lots > 1 else 0


def _table(rows: list[tuple], columns: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])


def _each(blocks: DataFrame, f: Callable, columns: str) -> DataFrame:
    """``f(row)`` gives the rows for one row; rows are done one at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                yield _table(list(f(row)), columns)

    return blocks.mapInPandas(run, columns)


def _grouped(rows: DataFrame, keys: list[str], f: Callable, columns: str) -> DataFrame:
    return rows.groupBy(*keys).applyInPandas(lambda key, part: _table(list(f(key, part.to_dict("records"))), columns), columns)


def _cogrouped(a: DataFrame, b: DataFrame, keys: list[str], f: Callable, columns: str) -> DataFrame:
    run = lambda key, x, y: _table(list(f(key, x.to_dict("records"), y.to_dict("records"))), columns)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, columns)


def _to_lots(rows: DataFrame, lots: int) -> DataFrame:
    """A range's row for each of its lots."""
    return rows.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))) if lots > 1 else rows.withColumn("lot", F.lit(0))


@dataclass
class Model:
    """What all tasks need: a few numbers, whatever the corpus."""

    seed: int
    word_bits: int
    pair_bits: int = 0
    tokens: int = 0
    types: int = 0
    d: tuple[float, float] = (0.75, 0.75)  # discounts: contexts, unigram
    theta: tuple[float, float] = (1.0, 1.0)
    unknown: float = 0.5  # share of the base distribution for words outside the training texts
    root: list[tuple[float, float]] = field(default_factory=list)  # by sweep: customers and tables of the unigram restaurant

    def base(self, sweep: int) -> float:
        """Unigram mass for the base distribution."""
        c, t = self.root[sweep]
        return (self.theta[1] + self.d[1] * t) / (self.theta[1] + c)

    def unigram(self, sweep: int, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        known = self.base(sweep) * (1 - self.unknown) / max(self.types, 1)
        return np.maximum(c - self.d[1] * t, 0) / (self.theta[1] + self.root[sweep][0]) + known

    def random(self, *key: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(key=[self.seed, sum(int(k) << 40 * i for i, k in enumerate(key)) & (1 << 64) - 1]))


#: Dishes of up to so many customers have their number of tables drawn at once; beyond that their customers step one by one. Weights of few customers are products, those of more sums of logarithms.
DRAWN, FEW = 2048, 16
_CELLS = 1 << 19


@functools.lru_cache(maxsize=2)
def _seatings(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: at c * (c - 1) / 2 + t - 1 the weight of all ways to seat c customers at t tables, whose customers weigh n - d."""
    rows = [np.zeros(1)]
    for n in range(1, DRAWN):
        more = rows[-1] + np.log(n - d * np.arange(1, n + 1))
        rows.append(np.logaddexp(np.append(more, -np.inf), np.append(-np.inf, rows[-1])))
    return np.concatenate(rows)


def drawn_tables(c: np.ndarray, others: np.ndarray, parent: np.ndarray, theta: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """The number of tables of each dish of c customers (at most ``DRAWN``), drawn given the tables of the restaurant's other dishes.

    t tables weigh as all ways to seat c customers at them, times (theta + d * (others + k)) * parent for k below t: what steps
    of ``gibbs``, without end, would come to.
    """
    out, ways = np.minimum(c, 1), _seatings(d)
    some = np.flatnonzero((c > 1) & (c <= FEW))
    some = some[np.argsort(c[some].astype(np.uint16), kind="stable")]
    for n, x, y in _runs(c[some]):
        m = some[x:y]
        own, more = parent[m], d * parent[m]
        term, sums = own * (theta + d * others[m]), np.empty((n, len(m)))
        weight = np.ones(len(m))  # the first table's own factor is common to all
        begin = n * (n - 1) // 2
        sums[0] = np.exp(ways[begin])
        for k in range(1, n):
            term = term + more
            weight = weight * term
            sums[k] = sums[k - 1] + np.exp(ways[begin + k]) * weight
        drawn = rng.random(len(m)) * sums[-1]
        out[m] += (sums[:-1] <= drawn).sum(0)
    some = np.flatnonzero(c > FEW)
    end = np.cumsum(c[some])
    lo = 0
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(end, end[lo] - c[some[lo]] + _CELLS, "right")))
        m = some[lo:hi]
        n = c[m]
        begin = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(begin, n)
        x = np.cumsum(np.log((theta + d * (np.repeat(others[m], n) + k)) * np.repeat(parent[m], n)))
        x += ways[np.repeat(n * (n - 1) // 2, n) + k] - np.repeat(np.append(0.0, x)[begin], n)
        x = np.cumsum(np.exp(x - np.repeat(np.maximum.reduceat(x, begin), n)))
        least, most = np.append(0.0, x)[begin], x[begin + n - 1]
        out[m] = np.clip(np.searchsorted(x, least + rng.random(len(m)) * (most - least), "right") - begin, 0, n - 1) + 1
        lo = hi
    return out


def seated(
    c: np.ndarray, t: np.ndarray, sizes: np.ndarray, others: np.ndarray, parent: np.ndarray, theta: float, d: float, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """One sweep over all dishes: the new t, and the sizes of tables of dishes beyond ``DRAWN``, whose sizes are given."""
    large, t = c > DRAWN, t.copy()
    t[~large] = drawn_tables(c[~large], others[~large], parent[~large], theta, d, rng)
    t[large], sizes = gibbs(c[large], t[large], sizes, others[large], parent[large], theta, d, rng)
    return t, sizes


def first_tables(c: np.ndarray, new: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """A first number of tables for c customers of each dish, where a new table has mass ``new`` and the old ones k - d * t.

    The first opens a table. From 32 customers on, groups of a sixteenth of those seated sit down at once, so a dish takes
    a number of steps like the logarithm of its count. The Gibbs steps start from here.
    """
    order = np.argsort(-c, kind="stable")
    n, a = c[order], new[order]
    t = np.minimum(n, 1).astype(np.float64)
    k, live = 1, int(np.searchsorted(-n, -1, "left"))
    while live:
        p = a[:live] / (a[:live] + k - d * t[:live])
        step = 1 if k < 32 else k // 16
        if step == 1:
            t[:live] += rng.random(live) < p
        else:
            t[:live] += rng.binomial(np.minimum(step, n[:live] - k), np.clip(p, 0, 1))
        k += step
        live = int(np.searchsorted(-n, -k, "left"))
    out = np.empty(len(c), np.int64)
    out[order] = t
    return out


def first_sizes(c: np.ndarray, t: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Customers of each table, dish by dish: one each, and the rest by random shares."""
    of, begin = np.repeat(np.arange(len(t)), t), np.cumsum(t) - t
    share = rng.gamma(1 - d, size=len(of)) + 1e-12
    share /= np.bincount(of, share, minlength=len(t))[of] if len(of) else 1
    sizes = 1 + ((c - t)[of] * share).astype(np.int64)
    got = np.bincount(of, sizes, minlength=len(t)).astype(np.int64)
    some = t > 0
    sizes[begin[some]] += (c - got)[some]
    return sizes


def gibbs(
    c: np.ndarray, t: np.ndarray, sizes: np.ndarray, others: np.ndarray, parent: np.ndarray, theta: float, d: float, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """One sweep over dishes of c customers at t tables of the given sizes (dish by dish): the new t and sizes.

    A step takes out a customer and seats it again: at a table of n others by n - d, at a new one by
    (theta + d * tables of the restaurant) * parent, where the restaurant's tables are ``others``, those of its other
    dishes, and the dish's own as they now are. Every customer of every dish steps once. A table is drawn as that of
    another customer, by n, and taken by (n - d) / n, so a step costs the same whatever the dish. Dishes step side by
    side while there are many, and each alone beyond that.
    """
    kept: list[tuple[np.ndarray, np.ndarray]] = []  # dish and size of every table
    order = np.argsort(-c, kind="stable")
    many, alone, idle = (order[x:y] for x, y in _cuts(c[order]))
    t, begin = t.copy(), np.cumsum(t) - t
    of = np.repeat(np.arange(len(t)), t)
    still = np.zeros(len(t), bool)
    still[idle] = True
    kept.append((of[still[of]], sizes[still[of]]))
    for m in alone:
        s = _reseat(sizes[begin[m] : begin[m] + t[m]], float(others[m]), float(parent[m]), theta, d, rng)
        t[m] = len(s)
        kept.append((np.full(len(s), m), s))
    if len(many):
        n, tables, left = c[many], t[many], others[many]
        first = np.cumsum(n) - n  # a dish has as many places for tables as customers
        row = np.repeat(np.arange(len(many)), tables)
        col = np.arange(len(row)) - np.repeat(np.cumsum(tables) - tables, tables)
        size = np.zeros(int(n.sum()), np.int32)
        size[first[row] + col] = sizes[begin[many][row] + col]
        at = np.repeat((first[row] + col).astype(np.int32), size[first[row] + col])  # each customer's table; who is who is drawn, as the order of steps must not follow the tables
        at = at[np.argsort(np.repeat(np.arange(len(many)), n) + rng.random(len(at)))]
        free = np.arange(len(size), dtype=np.int32)  # a dish's places from its tables-th on are free
        for step in range(int(n[0])):
            k = int(np.searchsorted(-n, -step, "left"))
            x, own, f = n[:k], first[:k] + step, first[:k]
            out = at[own]
            size[out] -= 1
            gone = np.flatnonzero(size[out] == 0)
            tables[gone] -= 1
            free[f[gone] + tables[gone]] = out[gone]
            new = (theta + d * (left[:k] + tables[:k])) * parent[many[:k]]
            opens = rng.random(k) * (x - 1 - d * tables[:k] + new) < new
            opened = np.flatnonzero(opens)
            to = free[f[opened] + tables[opened]]
            tables[opened] += 1
            size[to] = 1
            at[own[opened]] = to
            wait = np.flatnonzero(~opens)
            while len(wait):
                other = (rng.random(len(wait)) * (x[wait] - 1)).astype(np.int64)
                to = at[f[wait] + other + (other >= step)]
                taken = rng.random(len(wait)) * size[to] < size[to] - d
                seated = wait[taken]
                size[to[taken]] += 1
                at[own[seated]] = to[taken]
                wait = wait[~taken]
        t[many] = tables
        used = np.flatnonzero(size)
        kept.append((many[np.searchsorted(first, used, "right") - 1], size[used]))
    of = np.concatenate([x for x, _ in kept])
    order = np.argsort(of, kind="stable")
    return t, np.concatenate([x for _, x in kept])[order].astype(np.int64)


#: A step of dishes side by side costs as much as this many customers of a dish that steps alone, about.
SIDE_BY_SIDE = 32


def _cuts(c: np.ndarray) -> tuple[tuple[int, int], ...]:
    """Of dishes by customers, descending: those that step side by side, those that step alone (the cheapest number of them), and those of one customer."""
    idle = int(np.searchsorted(-c, -1, "left"))
    alone = int(np.argmin(np.cumsum(np.append(0, c[:idle])) + SIDE_BY_SIDE * np.append(c[:idle], 0)))
    return (alone, idle), (0, alone), (idle, len(c))


def _reseat(sizes: np.ndarray, others: float, parent: float, theta: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """A sweep over one dish, customer by customer."""
    at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    rng.shuffle(at)  # who is who: the order of steps must not follow the tables
    c, size, free, seat = len(at), sizes.tolist(), [], memoryview(at)
    tables = len(size)
    for lo in range(0, c, 1 << 16):
        hi = min(c, lo + (1 << 16))
        draws = rng.random((3, hi - lo)).tolist()
        for j, u, v, w in zip(range(lo, hi), *draws, strict=True):
            k = seat[j]
            size[k] -= 1
            if not size[k]:
                tables -= 1
                free.append(k)
            new = (theta + d * (others + tables)) * parent
            if u * (c - 1 - d * tables + new) < new:
                tables += 1
                if free:
                    k = free.pop()
                    size[k] = 1
                else:
                    k = len(size)
                    size.append(1)
            else:
                while True:
                    other = int(v * (c - 1))
                    k = seat[other + (other >= j)]
                    if w * size[k] < size[k] - d:
                        break
                    v, w = rng.random(2).tolist()
                size[k] += 1
            seat[j] = k
    out = np.array(size, np.int64)
    return out[out > 0]


def _vocabulary(blocks: DataFrame, m: Model, lots: int) -> tuple[DataFrame, DataFrame, int]:
    """Words (range, words, ids, counts), ids by block (block, range, ids, counts) with -1 for unknown words, and how many types occur once.

    A word's id is its rank by frequency in its range, times the number of ranges, plus the range: dense, and small for
    frequent words. The totals of tokens and types are set in the model; the start counts as neither.
    """

    def send(row) -> Iterator[tuple]:
        b = _Block(row)
        c, lot = b.counts(), _lot(int(row["block"]), lots)
        for r, x, y in _runs(_top(b.words, m.word_bits)):
            yield r, lot, int(row["block"]), b.words[x:y].tobytes(), _squeeze(c[x:y])

    def add(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        words, inverse = np.unique(np.concatenate([np.frombuffer(x["words"], np.uint64) for x in rows]), return_inverse=True)
        c = np.zeros(len(words), np.int64)
        np.add.at(c, inverse, np.concatenate([_expand(x["counts"]) for x in rows]))
        return words[c > 0], c[c > 0]

    def part(key: tuple, rows: list[dict]) -> Iterator[tuple]:
        words, c = add(rows)
        yield key[0], words.tobytes(), _squeeze(c)

    def number(key: tuple, rows: list[dict]) -> Iterator[tuple]:
        words, c = add(rows)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -c))] = np.arange(len(words))
        token = words != START
        yield key[0], words.tobytes(), _squeeze((rank << m.word_bits) + key[0]), _squeeze(c), [int(c[token].sum()), int(token.sum()), int((c[token] == 1).sum())]

    def reply(key: tuple, rows: list[dict], held: list[dict]) -> Iterator[tuple]:
        words, ids, c = (np.frombuffer(held[0]["words"], np.uint64), _expand(held[0]["ids"]), _expand(held[0]["counts"])) if held else [np.zeros(0, np.int64)] * 3
        for x in rows:
            asked = np.frombuffer(x["words"], np.uint64)
            at = np.minimum(np.searchsorted(words, asked), max(len(words) - 1, 0))
            known = words[at] == asked if len(words) else np.zeros(len(asked), bool)
            out, n = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
            out[known], n[known] = ids[at[known]] + 1, c[at[known]]
            yield x["block"], key[0], _squeeze(out), _squeeze(n)

    asks = _each(blocks, send, "range long, lot int, block long, words binary, counts binary")
    parts = _grouped(asks, ["range", "lot"], part, "range long, words binary, counts binary") if lots > 1 else asks
    words = stored(_grouped(parts, ["range"], number, "range long, words binary, ids binary, counts binary, stats array<long>"), "words")
    sums = words.agg(*[F.coalesce(F.sum(F.get("stats", F.lit(k))), F.lit(0)) for k in range(3)]).collect()[0]
    m.tokens, m.types = int(sums[0]), int(sums[1])
    ids = _cogrouped(asks, _to_lots(words, lots), ["range", "lot"], reply, "block long, range long, ids binary, counts binary")
    return words, stored(ids, "ids"), int(sums[2])


def _ids(rows: list[dict]) -> np.ndarray:
    rows = sorted((r for r in rows if r["ids"] is not None), key=lambda r: r["range"])
    return np.concatenate([_expand(r["ids"]) for r in rows]) - 1


#: kind 0: pairs of a range with two customers or more; 1: which of a unit's pairs are which of these (their number: one customer elsewhere); 2: numbers of single pairs by word.
_PAIRS = "kind int, range long, unit long, ctx binary, word binary, cnt binary, stats array<long>"
#: With them, of kind 0: the distinct words of its pairs, by range, and which of them each pair's word and context are. Every sweep asks for these.
_PLACED = f"{_PAIRS}, ids binary, of_word binary, of_ctx binary"


def _pairs(blocks: DataFrame, ids: DataFrame, m: Model, lots: int) -> tuple[DataFrame, DataFrame | None]:
    """The pairs of all blocks together, and with lots which pairs of a block are which of its lot."""
    columns = "range long, lot int, unit long, ctx binary, word binary, cnt binary"

    def send(key: tuple, rows: list[dict], got: list[dict]) -> Iterator[tuple]:
        if not rows:
            return
        b, known, lot = _Block(rows[0]), _ids(got), _lot(key[0], lots)
        asked, part, (ctx, word, _, cnt) = b.asked(known, m.pair_bits)
        ctx, word, cnt = known[ctx[asked]], known[word[asked]], cnt[asked]
        for r, x, y in _runs(part):
            yield r, lot, key[0], _squeeze(ctx[x:y]), _squeeze(word[x:y]), _squeeze(cnt[x:y])

    def merged(rows: list[dict]):
        rows, sizes = sorted(rows, key=lambda x: x["unit"]), [0]
        ctx, word, cnt = (np.concatenate([_expand(x[c]) for x in rows]) for c in ("ctx", "word", "cnt"))
        for x in rows:
            sizes.append(sizes[-1] + len(_expand(x["cnt"])))
        first, inverse = _met(_pair_hash(ctx, word))
        c = np.bincount(inverse, cnt, len(first)).astype(np.int64)
        return rows, ctx[first], word[first], c, inverse, cnt, sizes

    def part(key: tuple, rows: list[dict]) -> Iterator[tuple]:
        rows, ctx, word, c, inverse, _, sizes = merged(rows)
        unit = -1 - int(key[1])
        yield 0, key[0], unit, _squeeze(ctx), _squeeze(word), _squeeze(c), None
        for x, lo, hi in zip(rows, sizes[:-1], sizes[1:], strict=True):
            yield 1, key[0], x["unit"], _squeeze(inverse[lo:hi]), _squeeze(np.array([key[1]])), None, None

    def whole(key: tuple, rows: list[dict]) -> Iterator[tuple]:
        rows, ctx, word, c, inverse, cnt, sizes = merged(rows)
        many = c > 1
        place = np.where(many, np.cumsum(many) - 1, int(many.sum()))
        ids, of_word, of_ctx = _places(word[many], ctx[many], m.word_bits)
        at = (_squeeze(ids), _squeeze(of_word), _squeeze(of_ctx))
        yield 0, key[0], None, _squeeze(ctx[many]), _squeeze(word[many]), _squeeze(c[many]), [int((c == 1).sum()), int((c == 2).sum())], *at
        tell = (c[inverse] > 1) | ((c[inverse] == 1) & (cnt == 0))
        for x, lo, hi in zip(rows, sizes[:-1], sizes[1:], strict=True):
            at = np.flatnonzero(tell[lo:hi])
            yield 1, key[0], x["unit"], _squeeze(at), _squeeze(place[inverse[lo:hi][at]]), None, None, None, None, None
        single = c == 1
        for r, idx, as_word, as_ctx in _by_word(*_places(word[single], ctx[single], m.word_bits), None, m.word_bits):
            yield 2, key[0], r, _squeeze(idx), _squeeze(as_word), _squeeze(as_ctx), None, None, None, None

    asks = _cogrouped(blocks, ids, ["block"], send, columns)
    if lots == 1:
        return stored(_grouped(asks, ["range"], whole, _PLACED), "pairs"), None
    parts = stored(_grouped(asks, ["range", "lot"], part, _PAIRS), "lots")
    return stored(_grouped(parts.filter("kind = 0"), ["range"], whole, _PLACED), "pairs"), parts.filter("kind = 1")


def _places(word: np.ndarray, ctx: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of pairs in the order of their ranges, and which of them every pair's word and context are."""
    both = np.concatenate([word, ctx])
    place = both >> bits
    wide = int(place.max()).bit_length() if len(both) else 0
    ids, inverse = _distinct((both & (1 << bits) - 1) << wide | place, 1 << bits + wide)
    return (ids >> wide) + ((ids & (1 << wide) - 1) << bits), inverse[: len(word)], inverse[len(word) :]


def _by_word(ids: np.ndarray, of_word: np.ndarray, of_ctx: np.ndarray, t: np.ndarray | None, bits: int) -> Iterator[tuple]:
    """Per range of words: places in it, and the sums of t (None: one each) by word and by context."""
    as_word, as_ctx = (np.bincount(x, t, minlength=len(ids)).astype(np.int64) for x in (of_word, of_ctx))
    for k, x, y in _runs(ids & (1 << bits) - 1):
        yield k, ids[x:y] >> bits, as_word[x:y], as_ctx[x:y]


_SUMS = "range long, idx binary, as_word binary, as_ctx binary"
#: Of the words of a range, by place: customers as a context, tables of pairs with one customer by word and by context, and of all pairs, and tables of the unigram restaurant.
_STATE = "range long, n binary, c1 binary, k1 binary, c0 binary, k binary, t0 binary, stats array<double>"


def _added(sums: DataFrame, lots: int) -> DataFrame:
    """Sums by word, first within lots of the ranges they come from where these are many."""

    def add(key: tuple, rows: list[dict]) -> Iterator[tuple]:
        idx, inverse = np.unique(np.concatenate([_expand(x["idx"]) for x in rows]), return_inverse=True)
        out = []
        for c in ("as_word", "as_ctx"):
            s = np.zeros(len(idx), np.int64)
            np.add.at(s, inverse, np.concatenate([_expand(x[c]) for x in rows]))
            out.append(_squeeze(s))
        yield key[0], _squeeze(idx), *out

    return _grouped(sums.withColumn("lot", F.pmod(F.xxhash64("from"), F.lit(lots))), ["range", "lot"], add, _SUMS) if lots > 1 else sums.drop("from")


def _state(words: DataFrame, singles: DataFrame, m: Model) -> DataFrame:
    """The words' totals from the single pairs."""

    def run(key: tuple, held: list[dict], got: list[dict]) -> Iterator[tuple]:
        ids, counts = _expand(held[0]["ids"]) >> m.word_bits, _expand(held[0]["counts"])
        n, c1, k1 = np.zeros((3, len(ids)), np.int64)
        n[ids] = counts
        end = np.frombuffer(held[0]["words"], np.uint64) == END
        n[ids[end]] = 0  # nothing follows the end
        for x in got:
            idx = _expand(x["idx"])
            c1[idx] += _expand(x["as_word"])
            k1[idx] += _expand(x["as_ctx"])
        yield key[0], _squeeze(n), _squeeze(c1), _squeeze(k1), _squeeze(c1), _squeeze(k1), _squeeze(np.zeros(len(n), np.int64)), None

    return stored(_cogrouped(words, singles, ["range"], run, _STATE), "state")


def _reseat_words(state: DataFrame, sums: DataFrame, m: Model, sweep: int) -> tuple[DataFrame, np.ndarray]:
    """The words' totals after a sweep, with the unigram restaurant seated again (its large dishes anew, and stepped twice); and its customers and tables, and dishes of one and of two customers."""

    def run(key: tuple, held: list[dict], got: list[dict]) -> Iterator[tuple]:
        h = held[0]
        c1, k1 = _expand(h["c1"]), _expand(h["k1"])
        c0, k = c1.copy(), k1.copy()
        for x in got:
            idx = _expand(x["idx"])
            c0[idx] += _expand(x["as_word"])
            k[idx] += _expand(x["as_ctx"])
        rng = m.random(key[0], sweep, 1)
        tables = m.root[-1][1] if m.root else float(m.types)
        parent = np.full(len(c0), (1 - m.unknown) / max(m.types, 1))
        t0 = _expand(h["t0"]) if m.root else np.minimum(c0, 1)
        large = c0 > DRAWN
        t0[large] = first_tables(c0[large], (m.theta[1] + m.d[1] * tables) * parent[large], m.d[1], rng)
        sizes = first_sizes(c0[large], t0[large], m.d[1], rng)
        others = np.maximum(tables - t0, 0)
        t0, sizes = seated(c0, t0, sizes, others, parent, m.theta[1], m.d[1], rng)
        t0[large], _ = gibbs(c0[large], t0[large], sizes, np.maximum(tables - t0[large], 0), parent[large], m.theta[1], m.d[1], rng)
        stats = [float(c0.sum()), float(t0.sum()), float((c0 == 1).sum()), float((c0 == 2).sum())]
        yield key[0], h["n"], h["c1"], h["k1"], _squeeze(c0), _squeeze(k), _squeeze(t0), stats

    out = stored(_cogrouped(state, sums, ["range"], run, _STATE), "state")
    got = out.agg(*[F.coalesce(F.sum(F.get("stats", F.lit(k))), F.lit(0.0)) for k in range(4)]).collect()[0]
    return out, np.array([float(x) for x in got])


#: kind 0: tables of each dish, and their sizes where it is large; 1: sums by word.
_SEATS = "kind int, range long, to long, a binary, b binary, c binary"


def _sweep(pairs: DataFrame, seats: DataFrame | None, state: DataFrame, m: Model, sweep: int, lots: int) -> DataFrame:
    """One Gibbs sweep over all pairs with two customers or more, given the words' totals of the sweep before; with no seats yet, a first seating."""

    def ask(row) -> Iterator[tuple]:
        ids = _expand(row["ids"])
        for k, x, y in _runs(ids & (1 << m.word_bits) - 1):
            yield k, _lot(int(row["range"]), lots), int(row["range"]), _squeeze(ids[x:y] >> m.word_bits)

    def reply(key: tuple, held: list[dict], asked: list[dict]) -> Iterator[tuple]:
        if held:
            c0, t0, k = (_expand(held[0][c]) for c in ("c0", "t0", "k"))
            for x in asked:
                at = _expand(x["idx"])
                yield 2, x["unit"], key[0], _squeeze(c0[at]), _squeeze(t0[at]), _squeeze(k[at])

    def seat(key: tuple, held: list[dict], got: list[dict]) -> Iterator[tuple]:
        if not held:
            return
        ids, at_word, at_ctx, c = (_expand(held[0][x]) for x in ("ids", "of_word", "of_ctx", "cnt"))
        replies = sorted((x for x in got if x["kind"] == 2), key=lambda x: x["to"])
        c0, t0, k = (np.concatenate([np.zeros(0, np.int64), *[_expand(x[y]) for x in replies]]) for y in ("a", "b", "c"))
        rng = m.random(key[0], sweep, 2)
        before = [x for x in got if x["kind"] == 0]
        parent = m.unigram(sweep - 1, c0, t0)[at_word]
        if before:
            t, sizes = _expand(before[0]["a"]), _expand(before[0]["b"])
        else:
            t, large = np.minimum(c, 1), c > DRAWN
            t[large] = first_tables(c[large], (m.theta[0] + m.d[0] * k[at_ctx[large]]) * parent[large], m.d[0], rng)
            sizes = first_sizes(c[large], t[large], m.d[0], rng)
        others = k[at_ctx] - (t if before else 1)  # before the first seating every pair has one table
        t, sizes = seated(c, t, sizes, np.maximum(others, 0), parent, m.theta[0], m.d[0], rng)
        yield 0, key[0], None, _squeeze(t), _squeeze(sizes), None
        for r, idx, as_word, as_ctx in _by_word(ids, at_word, at_ctx, t, m.word_bits):
            yield 1, key[0], r, _squeeze(idx), _squeeze(as_word), _squeeze(as_ctx)

    many = pairs.filter("kind = 0").select("range", "cnt", "ids", "of_word", "of_ctx")
    asks = _each(many.select("range", "ids"), ask, "range long, lot int, unit long, idx binary")
    got = _cogrouped(_to_lots(state, lots), asks, ["range", "lot"], reply, _SEATS)
    if seats is not None:
        got = got.unionByName(seats.filter("kind = 0"))
    return stored(_cogrouped(many, got, ["range"], seat, _SEATS), "seats")


def train(blocks: DataFrame, sweeps: int = 4, seed: int = 7, range_tokens: int = RANGE_TOKENS, fan_in: int = FAN_IN):
    """The model, and as tables: ids by block, pairs, which pairs of a block are which of its lot, and the seats and the words' totals of each sweep."""
    n, size = blocks.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)) / 8).collect()[0]
    lots = max(1, -(-n // fan_in))
    m = Model(seed, _bits(size * range_tokens / RANGE_TOKENS / RANGE_WORDS))
    words, ids, once = _vocabulary(blocks, m, lots)
    m.pair_bits = _bits(m.tokens / range_tokens)
    pairs, links = _pairs(blocks, ids, m, lots)
    ranges = max(1, -(-(1 << m.pair_bits) // fan_in))
    n1, n2, many = pairs.filter("kind = 0").agg(*[F.coalesce(F.sum(F.get("stats", F.lit(k))), F.lit(0)) for k in range(2)], F.count("*")).collect()[0]
    singles = pairs.filter("kind = 2").select(F.col("unit").alias("range"), F.col("range").alias("from"), F.col("ctx").alias("idx"), F.col("word").alias("as_word"), F.col("cnt").alias("as_ctx"))
    start = _state(words, _added(singles, ranges), m)
    d0 = float(np.clip(n1 / max(n1 + 2 * n2, 1), 0.1, 0.95))
    m.d = (d0, 0.75)

    def one_each(row) -> Iterator[tuple]:
        for r, *sums in _by_word(*(_expand(row[x]) for x in ("ids", "of_word", "of_ctx")), None, m.word_bits):
            yield r, int(row["range"]), *map(_squeeze, sums)

    # before the first seating every pair has one table
    first = _each(pairs.filter("kind = 0").select("range", "ids", "of_word", "of_ctx"), one_each, "range long, from long, idx binary, as_word binary, as_ctx binary")
    state, (c, t, w1, w2) = _reseat_words(start, _added(first, ranges), m, 0)
    m.d = (d0, float(np.clip(w1 / max(w1 + 2 * w2, 1), 0.1, 0.95)))
    m.root.append((c, t))
    # the base distribution's share for unknown words makes their mean probability that of a type seen once
    share = d0 * (n1 + n2) / max(m.tokens, 1) * m.base(0)
    m.unknown = float(np.clip((once / max(m.tokens, 1)) / max(share, 1e-9), 0.01, 0.99))
    seats, states = [], [state]
    for s in range(1, sweeps + 1):
        seats.append(_sweep(pairs, seats[-1] if seats else None, states[-1], m, s, ranges))
        sums = seats[-1].filter("kind = 1").select(F.col("to").alias("range"), F.col("range").alias("from"), F.col("a").alias("idx"), F.col("b").alias("as_word"), F.col("c").alias("as_ctx"))
        state, (c, t, *_) = _reseat_words(states[-1], _added(sums, ranges), m, s)
        states.append(state)
        m.root.append((c, t))
    discard(words, start)
    return m, ids, pairs, links, seats, states, lots


#: Replies to blocks. kind 0: ids and counts of its words of a range; 1: totals of these by sweep (c0, t0 and tables as a context, in turn); 2: of its pairs of a range, the places, customers and tables over the kept sweeps.
_REPLY = "kind int, block long, range long, ids binary, counts binary, n binary, totals array<binary>, pos binary, c binary, t binary"


def _replies(ids: DataFrame, pairs: DataFrame, links: DataFrame | None, seats: list[DataFrame], states: list[DataFrame], m: Model, lots: int) -> DataFrame:
    numbers = [k for k in range(len(states))]

    def of_words(key: tuple, held: list[dict], asked: list[dict]) -> Iterator[tuple]:
        held = sorted(held, key=lambda x: x["sweep"])
        values = [_expand(held[k][c]) for k in numbers for c in ("c0", "t0", "k")] if held else []
        n = _expand(held[0]["n"]) if held else None
        for x in asked:
            known = _expand(x["ids"]) - 1
            at = known[known >= 0] >> m.word_bits
            yield 1, x["block"], key[0], x["ids"], x["counts"], _squeeze(n[at] if held else at), [_squeeze(v[at]) for v in values], None, None, None

    def of_pairs(key: tuple, held: list[dict], got: list[dict]) -> Iterator[tuple]:
        t = sum(_expand(x["a"]) for x in got)
        c = np.append(_expand(next(x for x in held if x["kind"] == 0)["cnt"]), 1)
        t = np.append(t, len(got))
        for x in held:
            if x["kind"] == 1:
                to = _expand(x["word"])
                yield 2, x["unit"], key[0], None, None, None, None, x["ctx"], _squeeze(c[to]), _squeeze(t[to])

    def relay(key: tuple, held: list[dict], got: list[dict]) -> Iterator[tuple]:
        told = {x["block"]: x for x in got}
        for x in held:
            y = told.get(-1 - int(_expand(x["word"])[0]))
            if y is not None:
                pos, c, t, mine = _expand(y["pos"]), _expand(y["c"]), _expand(y["t"]), _expand(x["ctx"])
                at = np.minimum(np.searchsorted(pos, mine), max(len(pos) - 1, 0))
                hit = np.flatnonzero(pos[at] == mine) if len(pos) else np.zeros(0, np.int64)
                yield 2, x["unit"], key[0], None, None, None, None, _squeeze(hit), _squeeze(c[at[hit]]), _squeeze(t[at[hit]])

    held = None
    for k, s in enumerate(states):
        s = s.withColumn("sweep", F.lit(k))
        held = s if held is None else held.unionByName(s)
    lot = F.udf(lambda b: _lot(b, lots), "int")
    asked = ids.withColumn("lot", lot("block") if lots > 1 else F.lit(0))
    words = _cogrouped(_to_lots(held, lots), asked, ["range", "lot"], of_words, _REPLY)
    got = None
    for s in seats:
        s = s.filter("kind = 0")
        got = s if got is None else got.unionByName(s)
    told = _cogrouped(pairs.filter("kind < 2").select("kind", "range", "unit", "ctx", "word", "cnt"), got, ["range"], of_pairs, _REPLY)
    if links is not None:
        lot_of = F.udf(lambda b: -1 - int(_expand(b)[0]), "long")
        told = _cogrouped(links.withColumn("via", lot_of("word")), told.withColumn("via", F.col("block")), ["range", "via"], relay, _REPLY)
    return words.unionByName(told)


def _scores(blocks: DataFrame, replies: DataFrame, m: Model, kept: list[int], kind: str) -> DataFrame:
    d, theta = m.d[0], m.theta[0]
    columns = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(held: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        row = held.iloc[0]
        b, got = _Block(row), got.to_dict("records")
        words = sorted((x for x in got if x["kind"] == 1), key=lambda x: x["range"])
        ids = _ids(words)
        counts = np.concatenate([_expand(x["counts"]) for x in words])
        known = ids >= 0
        n = np.zeros(len(ids), np.int64)
        n[known] = np.concatenate([_expand(x["n"]) for x in words])
        asked, part, (ctx, word, inverse, cnt) = b.asked(ids, m.pair_bits)
        c, t = np.minimum(cnt, 1), np.minimum(cnt, 1) * len(kept)
        begin = {r: x for r, x, _ in _runs(part)}
        for x in got:
            if x["kind"] == 2:
                at = asked[begin[x["range"]] + _expand(x["pos"])]
                c[at], t[at] = _expand(x["c"]), _expand(x["t"])
        p = np.maximum(c - d * t / len(kept), 0) / (theta + n[ctx])
        for k, s in enumerate(kept):
            c0, t0, k0 = (np.zeros(len(ids)) for _ in range(3))
            for to, j in ((c0, 0), (t0, 1), (k0, 2)):
                to[known] = np.concatenate([np.zeros(0, np.int64), *[_expand(x["totals"][3 * k + j]) for x in words if x["totals"] is not None and len(x["totals"])]])
            p0 = np.where(known, m.unigram(s, c0, t0), m.base(s) * m.unknown)
            over = (theta + d * k0) / (theta + n)
            p += over[ctx] * p0[word] / len(kept)
        count = counts[b.seq]
        at = b.begin[:-1]
        return pd.DataFrame(
            {
                "doc_id": list(row["ids"]), "held_out": b.held, "n_tokens": b.lens, "n_known": np.add.reduceat((count > 0).astype(np.int64), at),
                "train_tokens": m.tokens, "base_score": np.add.reduceat(np.log10((count + 1.0) / (m.tokens + m.types + 1.0)), at),
                "score": np.add.reduceat(np.log10(p)[inverse], at),
            }
        )

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, columns)


def score(
    docs: DataFrame, id: str = "doc_id", text: str = "text", modulus: int = 7, remainder: int = 2, sweeps: int = 4, burn: int = 2, seed: int = 7,
    range_tokens: int = RANGE_TOKENS, fan_in: int = FAN_IN,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are the words, lower-cased A-Z, and one end. Rows that are not held out train the model. ``score`` is the log10
    probability of the text, each token's averaged over the sweeps after ``burn``: words outside the training texts share one
    outcome, as in ``base_score``, the add-one unigram. Null and empty texts are an end alone. Repeated rows count as
    often as they occur; an empty table gives no rows; without training rows every word is unknown. Of the columns only
    ``id`` and ``text`` are read.
    """
    blocks = bucketed(encode(docs, id, text, held_out(F.col(f"`{id}`"), modulus, remainder)))
    m, ids, pairs, links, seats, states, lots = train(blocks, sweeps, seed, range_tokens, fan_in)
    burn = min(burn, sweeps - 1)
    kept = list(range(burn + 1, sweeps + 1))
    replies = _replies(ids, pairs, links, seats[burn:], states[burn + 1 :], m, lots)
    out = _scores(blocks, replies, m, kept, docs.schema[id].dataType.simpleString())
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
