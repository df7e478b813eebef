"""Quality: random-indexing word vectors pooled per document, and a two-layer numpy network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.text import Words, held_out, one_text, pieces, stored, words_of

DIMS = 32
#: A word's index vector follows from its hash; its context sum shares one of so many rows by hash. Word endings and shapes have index vectors of their own.
WORD_ROWS, END_ROWS, SHAPE_ROWS = 1 << 13, 1 << 12, 4096
_PIECE = 1 << 17
#: Context sums are added up in so many parts.
_SLABS = 64


def _index_vectors(rows: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors: a quarter of the entries are +1 or -1."""
    rng = np.random.default_rng(seed)
    return rng.choice(np.array([-1, 0, 0, 0, 0, 0, 0, 1], np.float32), size=(rows, DIMS))


END_INDEX, SHAPE_INDEX = (_index_vectors(n, s) for n, s in ((END_ROWS, 2), (SHAPE_ROWS, 3)))
#: An eighth of an index vector for each value of a byte of the hash: eight bytes give 2^64 vectors.
_EIGHTHS = _index_vectors(8 * 256, 1)[:, : DIMS // 8].reshape(8, 256, DIMS // 8)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """The sparse ternary index vectors of words, from their 64-bit hashes alone."""
    parts = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    return np.concatenate([_EIGHTHS[k][parts[:, k]] for k in range(8)], axis=1)


def _classes() -> np.ndarray:
    c = np.full(256, 6, np.int64)  # other signs
    c[ord("a") : ord("z") + 1] = 0
    c[ord("A") : ord("Z") + 1] = 1
    c[ord("0") : ord("9") + 1] = 2
    c[[ord("."), ord(","), ord(";"), ord(":"), ord("?")]] = 3
    c[128:] = 4
    c[[ord("|"), ord("#"), ord("$"), ord("%"), ord("&"), ord("*"), ord("!")]] = 5
    return c


_CLASS = _classes()


def _features(w: Words, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words a to b: the row of the word, of its last three bytes, and of its shape (classes of three bytes, length, whether it repeats)."""
    s, n = w.starts[a:b], w.lens[a:b]
    last = s + n - 1
    x, y, z = (w.data[np.maximum(last - k, s)].astype(np.int64) for k in (0, 1, 2))
    end = ((x * 257 + y) * 257 + z) * 2654435761 >> 7 & END_ROWS - 1
    second = w.data[np.minimum(s + 1, last)]
    again = np.zeros(b - a, np.int64)  # the word before it, of this piece, is the same
    again[1:] = w.hashes[a + 1 : b] == w.hashes[a : b - 1]
    shape = (((_CLASS[w.data[s]] * 7 + _CLASS[second]) * 7 + _CLASS[x]) * 4 + np.minimum(n // 4, 3)) * 2 + again
    return (w.hashes[a:b] & np.uint64(WORD_ROWS - 1)).astype(np.int64), end, shape


@dataclass
class WordVectors:
    """``context``: per row of words, the normalised sum of the index vectors of their neighbours in the corpus; a word's vector is its own plus that."""

    context: np.ndarray

    def pool(self, column: pa.Array) -> np.ndarray:
        """One row per text: the mean of its words' vectors (word, ending, shape), then log(1 + words). No words: zeros."""
        w = words_of(column)
        n = np.diff(w.first)
        out = np.zeros((len(n), DIMS + 1), np.float32)
        out[:, DIMS] = np.log1p(n) / 10
        for a in range(0, len(w.hashes), _PIECE):
            b = min(a + _PIECE, len(w.hashes))
            f, e, s = _features(w, a, b)
            v = index_vectors(w.hashes[a:b])
            for more in (self.context[f], END_INDEX[e], SHAPE_INDEX[s]):
                v += more
            d0, d1 = np.searchsorted(w.first, a, "right") - 1, np.searchsorted(w.first, b, "left")
            rows = np.arange(d0, d1)
            rows = rows[n[rows] > 0]
            out[rows, :DIMS] += np.add.reduceat(v, np.maximum(w.first[rows] - a, 0), axis=0)
        out[:, :DIMS] /= np.maximum(n, 1)[:, None]
        return out


def _context_sums(w: Words) -> np.ndarray:
    """Per hashed word, the sum of the index vectors of the two words before and after it in its text."""
    out = np.zeros((WORD_ROWS, DIMS), np.float32)
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    rows = (w.hashes & np.uint64(WORD_ROWS - 1)).astype(np.uint16)  # two bytes: sorted by radix
    for shift in (1, 2):
        left, right = rows[:-shift], rows[shift:]
        same = doc[:-shift] == doc[shift:]
        ahead, behind = w.hashes[shift:][same], w.hashes[:-shift][same]
        for a, b in ((left[same], ahead), (right[same], behind)):
            order = np.argsort(a, kind="stable")
            for k in range(0, len(order), _PIECE):
                o = order[k : k + _PIECE]
                key = a[o]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                out[key[first]] += np.add.reduceat(index_vectors(b[o]), first, axis=0)
    return out


def corpus_context(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The context sums over all texts. A task yields one sum of fixed size, in slabs, which Spark adds up; they are whole numbers, so in any order."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WORD_ROWS, DIMS))
        for b in pieces(batches, "t"):
            total += _context_sums(words_of(b.column("t")))
        parts = [x.tobytes() for x in total.reshape(_SLABS, -1)]
        yield pa.RecordBatch.from_pydict({"slab": pa.array(range(_SLABS), pa.int32()), "part": pa.array(parts, pa.binary())})

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slab": [key[0]], "part": [sum(np.frombuffer(x) for x in part["part"]).tobytes()]})

    parts = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(sums, "slab int, part binary")
    out = np.zeros((_SLABS, WORD_ROWS * DIMS // _SLABS))
    for r in parts.groupBy("slab").applyInPandas(add, "slab int, part binary").collect():
        out[r["slab"]] = np.frombuffer(r["part"])
    return out.reshape(WORD_ROWS, DIMS)


@dataclass
class Network:
    """Inputs are standardised by ``mean`` and ``scale``; one hidden layer of rectified units; logits are divided by ``temperature``."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 5, rate: float = 3e-3) -> Network:
    """Adam on the logistic loss. Every fifth row is kept back; the temperature that fits it best is searched on a grid."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    kept = np.arange(len(x)) % 5 == 4
    xt, yt = x[~kept], y[~kept]
    scale = np.maximum(xt.std(axis=0), 1e-3)
    net = Network(xt.mean(axis=0), scale, rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    xs = (xt - net.mean) / scale
    params = [net.w1, net.b1, net.w2, np.array([0.0])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(xs)), max(1, len(xs) // 256)):
            a = xs[rows]
            h = np.maximum(a @ params[0] + params[1], 0)
            z = h @ params[2] + params[3][0]
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - yt[rows]) / len(rows)
            back = np.outer(g, params[2]) * (h > 0)
            step += 1
            for k, grad in enumerate((a.T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ g + 1e-4 * params[2], np.array([g.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if kept.any():
        z = net.logits(x[kept])
        net.temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: _loss(z / t, y[kept]))
    return net


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000
) -> tuple[WordVectors, Network] | None:
    """Word vectors from all texts, and the network from at most ``max_rows`` labelled rows, chosen by a hash of the id; None without both labels.

    An id counts once: with the largest of its labels, and of its texts the one with the least hash.
    """
    key, mark = F.col(f"`{id}`"), F.col(f"`{label}`")
    known = labels.filter(mark.isNotNull() & key.isNotNull()).groupBy(key.alias("i")).agg(F.max(mark).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("i"), "i").limit(max_rows)
    rows = stored(one_text(docs, known, id, text).repartition(8), "labelled")

    if rows.select("y").distinct().count() < 2:
        return None
    context = corpus_context(docs, text)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = WordVectors((context / np.maximum(norm, 1e-6) * (DIMS / 4) ** 0.5).astype(np.float32))

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            x = vectors.pool(b.column("t"))
            yield pa.RecordBatch.from_pydict({"i": b.column("i").cast(pa.string()), "y": b.column("y"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    got = rows.mapInArrow(pooled, "i string, y double, x binary").toPandas().sort_values("i")
    x = np.stack([np.frombuffer(v, np.float32) for v in got["x"]])
    return vectors, train(x, got["y"].to_numpy())


def score(docs: DataFrame, model: tuple[WordVectors, Network] | None, id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, score, predicted. Null counts as empty; an empty text gets the network's value for no words. Without a model all score 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            p = model[1].probabilities(model[0].pool(b.column("t"))) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(p, pa.float64()), "predicted": pa.array((p >= threshold).astype(np.int32))})

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def learn_and_score(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", modulus: int = 5, remainder: int = 0) -> DataFrame:
    """Learns from labelled rows that are not held out, scores all rows, and adds ``held_out``. Rows are independent."""
    model = fit(docs, labels.filter(~held_out(F.col(f"`{id}`"), modulus, remainder)), id, text)
    return score(docs, model, id, text).withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder))
