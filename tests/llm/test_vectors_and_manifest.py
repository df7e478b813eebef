"""Centroid clustering, embedding near-duplicates and the Merkle manifest against brute force, with the edge cases of each."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import centroids, embedding_dedup, merkle, queries

VECTORS = "vec_id long, embedding array<float>, label int, cid int, v string, cluster int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "x", 2) for i, v in rows], VECTORS)


# ---- centroid clustering


def clustered(rows, k=16, rounds=3):
    """Plain Python: (vec_id, cluster, distance, cluster inertia, inertia, digest of the centroid), sorted."""
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in kept[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), n) for n, x in enumerate(c))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        c = [[sum(col) // len(mine) for col in zip(*mine, strict=True)] if (mine := [v for (_, v), a in zip(kept, at, strict=True) if a == n]) else x for n, x in enumerate(c)]
    last = [nearest(v) for _, v in kept]
    per = {n: sum(d for d, m in last if m == n) for n in range(len(c))}
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, n, d, per[n], sum(per.values()), digest[n]) for (i, _), (d, n) in zip(kept, last, strict=True)), key=str)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(64) * (0.1 + (i % 5))) for i in range(150)]
    rows += [(200 + i, rows[i % 4][1]) for i in range(40)]  # copies, so distances tie
    rows += [(None, rng.standard_normal(64)), (7, rng.standard_normal(64)), (300, np.zeros(64))]  # no id, an id twice, zero
    return rows + [(400, None), (401, []), (402, np.ones(63)), (403, [None, *np.ones(63)]), (404, [np.nan, *np.ones(63)]), (405, [np.inf, *np.ones(63)])]


def test_clusters_equal_plain_python(spark, points):
    got = sorted(map(tuple, centroids.cluster(table(spark, points)).collect()), key=str)
    assert got == clustered(points) and len(got) == 193


def test_clusters_of_few_and_no_vectors(spark, points):
    few = points[:3]
    assert sorted(map(tuple, centroids.cluster(table(spark, few)).collect()), key=str) == clustered(few)
    assert centroids.cluster(table(spark, points[-6:])).count() == 0 and centroids.cluster(table(spark, [])).count() == 0


def test_clusters_of_large_components(spark, points):
    rows = [*points[:20], (500, [3e6, *np.ones(63)]), (501, [-4e6, *np.ones(63)])]
    assert sorted(map(tuple, centroids.cluster(table(spark, rows)).collect()), key=str) == clustered(rows)
    assert centroids.cluster(table(spark, [*rows, (502, [3e38] * 64)])).count() == 23


def test_bounds_leave_few_centroids_and_never_the_wrong_one():
    rng = np.random.default_rng(8)
    v, c = rng.integers(-60, 60, (500, 64)), rng.integers(-60, 60, (20, 64))
    simplex = centroids.Simplex(np.concatenate([v[:1], v[:63], v[5:6]]))  # one that repeats, one in the span
    assert len(simplex.pivots) == 63
    at, d, compared = centroids.nearest(v, c, simplex, simplex.distances(v))
    whole = ((v[:, None] - c[None]) ** 2).sum(2)
    assert (at == whole.argmin(1)).all() and (d == whole.min(1)).all() and compared < 3 * len(v)


# ---- embedding near-duplicates


def linked(rows, cosine=0.95):
    good = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1], np.float64) / np.linalg.norm(np.array(rows[k][1], np.float64)) for k in good}
    near = {k: [j for j in good if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= cosine] for k in good}
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([label[k], *(label[j] for j in near.get(k, []))]) for k in range(len(rows))]
        if new == label:
            break
        label = new
    least = {}
    for k, c in enumerate(label):
        if rows[k][0] is not None:
            least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], len(near.get(k, [])), least.get(c), rows[k][0] == least.get(c)) for k, c in enumerate(label)), key=str)


@pytest.fixture(scope="module")
def neighbours():
    rng = np.random.default_rng(4)
    as_float = lambda v: np.array(v, np.float32).astype(float)
    rows = [(i, as_float(rng.standard_normal(64))) for i in range(300)]
    base = rng.standard_normal(64)
    rows += [(1000 + i, as_float(base + 0.12 * rng.standard_normal(64))) for i in range(90)]  # one tight group
    for i in range(40):  # a chain, each linked with the next ones
        base = base + 0.2 * rng.standard_normal(64)
        rows.append((2000 + i, as_float(base)))
    rows += [(3000 + i, 2 * rows[5][1]) for i in range(3)] + [(3010 + i, rows[6][1]) for i in range(30)]  # other lengths, equal vectors
    rows += [(None, rows[7][1]), (None, None), (8, rows[9][1]), (4000, [1.0, 2.0]), (4001, [2.0, 4.0]), (4002, [2.0, -4.0])]
    return rows + [(5000, None), (5001, []), (5002, np.zeros(64)), (5003, [None, 1.0]), (5004, [np.nan] * 64), (5005, [np.inf] * 64)]


@pytest.mark.parametrize("block", [512, 16])
def test_links_equal_brute_force(spark, neighbours, monkeypatch, block):
    """Blocks of 16 make hot buckets, balls and pairs of blocks of the groups."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    got = sorted(map(tuple, embedding_dedup.near_duplicates(table(spark, neighbours)).collect()), key=str)
    want = linked(neighbours)
    assert len(got) == len(want) and sum(r[1] for r in want) > 8000
    assert got == want


def test_recall_about_the_threshold(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        a, b = rng.standard_normal((2, 64))
        a, b = a / np.linalg.norm(a), b - (b @ a) * a / (a @ a)
        c = rng.uniform(0.94, 0.97)
        rows += [(2 * i, a), (2 * i + 1, c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b))]
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    got, want = embedding_dedup.near_duplicates(table(spark, rows)).collect(), {r[0]: r[1] for r in linked(rows)}
    assert all(r.n_links <= want[r.vec_id] for r in got) and sum(r.n_links for r in got) >= 0.98 * sum(want.values()) > 0


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(table(spark, [])).count() == 0
    assert [tuple(r) for r in embedding_dedup.near_duplicates(table(spark, [(3, None)])).collect()] == [(3, 0, 3, True)]


# ---- Merkle manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, place string, g int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return sha(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], r[1])])


def manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, i):
        return [(("L", at[s]) if i >> k & 1 else ("R", at[s])) if (s := (i >> k) ^ 1) < len(at) else None for k, at in enumerate(levels[:-1])]

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    top, out = tree([trees[g][-1][0] for g in order]), []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps, bad = path(trees[g], i) + path(top, k), r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                bad = (*r[:4], r[4] + 1)
            x = leaf(bad)
            for s in steps:
                x = sha(x) if s is None else sha(s[1], x) if s[0] == "L" else sha(x, s[1])
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha(*[s[1] for s in steps if s]), x, x == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("case", ["many", "one lang each", "single", "wide ids"])
def test_manifest_equals_brute_force(spark, tmp_path, case):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("ab é\n𝄞:-") for _ in range(rng.randrange(12)))
    if case == "many":
        rows = [(i * 3 % 4001 - 70, text(), rng.choice(["en", "de", "é", "", None]), rng.choice(["s", None]), rng.choice([None, 5])) for i in range(2600)]
        rows += [(None, "x", "en", None, 3), (None, None, None, None, None), rows[5], rows[5], (rows[5][0], "other", rows[5][2], None, 9), (7, "word " * 50_000, "en", "s", 2**63 - 1)]
    elif case == "one lang each":
        rows = [(k, text(), f"l{k}", "s", 1) for k in range(9)]
    elif case == "single":
        rows = [(14, "t", "en", "s", 1)]
    else:
        rows = [(rng.randrange(-(2**63), 2**63), text(), rng.choice(["en", "fr"]), None, 2) for _ in range(300)] + [(-(2**63), "a", "en", None, 1), (2**63 - 1, "b", "en", None, 1)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == manifest(rows)


def test_manifest_of_nothing_and_its_paths(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    rows = merkle.manifest(spark.createDataFrame([(k, "t", "en", "s", 1, "x", 1) for k in range(5)], DOCS)).collect()
    assert all(r.verified and merkle.fold(r.leaf, merkle.split_path(r.path)) == r.root for r in rows)
    changed = merkle.manifest(spark.createDataFrame([(k, "t", "en", "s", 1, "x", 1) for k in range(5)], DOCS), tampered={"text": F.lit("other")})
    assert not any(r.verified for r in changed.collect())
