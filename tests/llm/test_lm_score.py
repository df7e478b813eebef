"""The language model: seats against exact posteriors, probabilities that sum to one, and scores by brute force."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import lm_score
from ledgerscope.llm.text import held_out, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(5, 60), p=weights / weights.sum())) for _ in range(60)]
    return [*texts, None, "", " \n", "New words HERE w1", texts[0], texts[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string").coalesce(1)


def expected_tables(c, others, parent, theta, d):
    """The exact mean number of tables of a dish, by generalised Stirling numbers."""
    s = [0.0, 1.0]
    for n in range(1, c):
        s = [0.0] + [s[t - 1] + (n - d * t) * (s[t] if t < len(s) else 0.0) for t in range(1, n + 2)]
    p = np.array([s[t] * np.prod([(theta + d * (others + i)) * parent for i in range(t)]) for t in range(1, c + 1)])
    return float((p * np.arange(1, c + 1)).sum() / p.sum())


@pytest.mark.parametrize(("c", "others", "parent"), [(2, 3, 0.2), (6, 0, 0.3), (12, 40, 0.05), (30, 10, 0.2)])
def test_gibbs_steps_follow_the_posterior(c, others, parent):
    rng = np.random.default_rng(1)
    n, d, theta = 3000, 0.6, 1.0
    counts = np.full(n, c)
    t = lm_score.first_tables(counts, np.full(n, 0.5), d, rng)
    sizes = lm_score.first_sizes(counts, t, d, rng)
    seen = []
    for k in range(30):
        t, sizes = lm_score.gibbs(counts, t, sizes, np.full(n, others), np.full(n, parent), theta, d, rng)
        assert t.sum() == len(sizes) and (sizes > 0).all()
        assert (np.bincount(np.repeat(np.arange(n), t), sizes) == c).all()
        if k >= 10:
            seen.append(t.mean())
    assert np.mean(seen) == pytest.approx(expected_tables(c, others, parent, theta, d), rel=0.02)


def test_drawn_tables_follow_the_posterior_from_any_start():
    rng, d, theta = np.random.default_rng(2), 0.6, 1.0
    cases = [(2, 3, 0.2), (6, 0, 0.3), (90, 10, 0.2), (30, 10, 0.2), (0, 0, 0.1), (1, 5, 0.1), (lm_score.DRAWN, 50_000, 1e-5)]
    c, others, parent = map(np.array, zip(*[case for case in cases[:-1] for _ in range(3000)], cases[-1], strict=True))
    t, sizes = lm_score.seated(c, np.minimum(c, 1), np.zeros(0, int), others, parent, theta, d, rng)
    assert len(sizes) == 0 and (t <= c).all() and (t >= np.minimum(c, 1)).all()
    for k, (n, o, p) in enumerate(cases[:4]):
        assert t[3000 * k : 3000 * (k + 1)].mean() == pytest.approx(expected_tables(n, o, p, theta, d), rel=0.04)


def test_few_customers_are_drawn_as_many_are(monkeypatch):
    c, others, parent = (np.tile(x, 4000) for x in ([2, 5, lm_score.FEW], [3, 0, 40], [0.2, 0.3, 1e-3]))
    means = []
    for few in (lm_score.FEW, 1):
        monkeypatch.setattr(lm_score, "FEW", few)
        t = lm_score.drawn_tables(c, others, parent, 1.0, 0.6, np.random.default_rng(8))
        assert ((t >= 1) & (t <= c)).all()
        means.append(t.reshape(-1, 3).mean(0))
    assert means[0] == pytest.approx(means[1], rel=0.03)


def test_distinct_numbers_with_and_without_room_for_places():
    x = np.array([7, 0, 7, 3, 0], np.int64)
    for most in (7, 1 << 62):
        values, inverse = lm_score._distinct(x, most)
        assert values.tolist() == [0, 3, 7] and inverse.tolist() == [2, 0, 2, 1, 0]
    first, inverse = lm_score._met(x.astype(np.uint64))
    assert first.tolist() == [0, 1, 3] and inverse.tolist() == [0, 1, 0, 2, 1]
    assert [len(y) for y in (*lm_score._distinct(x[:0], 7), *lm_score._met(x[:0]))] == [0] * 4


def test_a_range_keeps_where_its_words_are(docs):
    """Sweeps read these places and sort nothing; the words are in the order of their ranges."""
    blocks = lm_score.bucketed(lm_score.encode(docs, "doc_id", "text", held_out(F.col("doc_id"), 7, 2)))
    m, _, pairs, *_ = lm_score.train(blocks, sweeps=1, range_tokens=200)
    rows = pairs.filter("kind = 0").collect()
    assert len(rows) > 1
    for r in rows:
        ids, word, ctx = (lm_score._expand(x) for x in (r.ids, r.of_word, r.of_ctx))
        assert ids[word].tolist() == lm_score._expand(r.word).tolist() and ids[ctx].tolist() == lm_score._expand(r.ctx).tolist()
    ids, word, ctx = lm_score._places(np.array([5, 8, 5, 2]), np.array([8, 7, 5, 2]), 2)
    assert ids.tolist() == [8, 5, 2, 7] and ids[word].tolist() == [5, 8, 5, 2] and ids[ctx].tolist() == [8, 7, 5, 2]


def test_large_dishes_step_beside_drawn_ones():
    rng, c = np.random.default_rng(6), np.array([5, lm_score.DRAWN + 1, 1, 0, lm_score.DRAWN + 7])
    t, sizes = lm_score.seated(c, np.array([1, 1, 1, 0, 1]), c[c > lm_score.DRAWN], np.zeros(5), np.full(5, 0.1), 1.0, 0.5, rng)
    assert len(sizes) == t[1] + t[4] and sizes[: t[1]].sum() == c[1] and sizes[t[1] :].sum() == c[4] and t[3] == 0 and t[2] == 1


@pytest.mark.parametrize("dishes", [1, 400])
def test_every_customer_of_a_large_dish_steps(dishes):
    rng = np.random.default_rng(4)
    c = np.full(dishes, 300)
    # nobody opens a table, so all who sit alone and step leave theirs: at most every second one is left
    t, sizes = lm_score.gibbs(c, c, np.ones(300 * dishes, int), np.zeros(dishes), np.zeros(dishes), 1.0, 0.5, rng)
    assert (t <= 150).all() and (np.bincount(np.repeat(np.arange(dishes), t), sizes) == c).all()


@pytest.mark.parametrize(("n", "c"), [(1, 90), (400, 90)])
def test_large_dishes_follow_the_posterior_alone_and_side_by_side(n, c):
    rng, d, theta, others, parent = np.random.default_rng(5), 0.6, 1.0, 10, 0.2
    counts = np.full(n, c)
    t = lm_score.first_tables(counts, np.full(n, 0.5), d, rng)
    sizes, seen = lm_score.first_sizes(counts, t, d, rng), []
    for _ in range(3000 if n == 1 else 200):
        t, sizes = lm_score.gibbs(counts, t, sizes, np.full(n, others), np.full(n, parent), theta, d, rng)
        seen.append(t.mean())
    assert np.mean(seen[100:]) == pytest.approx(expected_tables(c, others, parent, theta, d), rel=0.03)


def test_first_seats_are_bounded_and_follow_the_mass():
    rng = np.random.default_rng(2)
    c = np.array([1, 2, 40, 5000] * 200)
    few, many = (lm_score.first_tables(c, np.full(len(c), m), 0.5, rng) for m in (0.01, 50.0))
    assert ((few >= 1) & (few <= c)).all() and ((many >= 1) & (many <= c)).all() and many.mean() > few.mean()
    sizes = lm_score.first_sizes(c, many, 0.5, rng)
    assert (np.bincount(np.repeat(np.arange(len(c)), many), sizes) == c).all() and (sizes > 0).all()
    t, s = lm_score.gibbs(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0), 1.0, 0.5, rng)
    assert len(t) == len(s) == 0


def test_numbers_survive_packing():
    for x in ([], [0], [255, 256], [2**16, 1], [2**33, 2**62, 3]):
        assert lm_score._expand(lm_score._squeeze(np.array(x, np.int64))).tolist() == x


def tokens_of(t):
    return [*[w.lower() for w in WORD.findall(t or "")], None]


def test_base_columns(spark, docs):
    texts = corpus()
    rows = {r.doc_id: r for r in lm_score.score(docs).collect()}
    tokens = {k: tokens_of(t) for k, t in enumerate(texts)}
    c = collections.Counter(w for k, ts in tokens.items() if not rows[k].held_out for w in ts)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts) and any(r.held_out for r in rows.values())
    for k, ts in tokens.items():
        assert rows[k].n_tokens == len(ts) and rows[k].train_tokens == n and rows[k].n_known == sum(c[w] > 0 for w in ts)
        assert rows[k].base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ts))


def test_probabilities_sum_to_one_and_scores_equal_brute_force(spark, docs):
    texts = corpus()
    held = held_out(F.col("doc_id"), 7, 2)
    blocks = lm_score.bucketed(lm_score.encode(docs, "doc_id", "text", held))
    m, ids, pairs, _, seats, states, _ = lm_score.train(blocks, sweeps=3)
    rows = {r.doc_id: r for r in lm_score.score(docs, sweeps=3, burn=1).collect()}
    # the ids of the words: those of the only block are in the order of hashes
    vocabulary = sorted({w for t in texts for w in tokens_of(t) if w})
    hashes = dict(zip(vocabulary, (words_of(pa.array([w])).hashes[0] for w in vocabulary), strict=True))
    hashes |= {None: lm_score.END, "": lm_score.START}
    in_order = sorted(hashes, key=lambda w: int(hashes[w]))
    number = dict(zip(in_order, lm_score._ids([r.asDict() for r in ids.collect()]).tolist(), strict=True))
    count = collections.Counter()
    for k, t in enumerate(texts):
        ts = ["", *tokens_of(t)]
        if not rows[k].held_out:
            count.update(zip(ts, ts[1:], strict=False))
    word_of = {v: w for w, v in number.items() if v >= 0}
    place = pairs.filter("kind = 0").collect()
    assert len(place) == 1 and len(word_of) == m.types + 1
    many = [(word_of[a], word_of[b]) for a, b in zip(lm_score._expand(place[0].ctx), lm_score._expand(place[0].word), strict=True)]
    assert set(many) == {p for p, n in count.items() if n > 1}
    p = collections.defaultdict(float)
    contexts = {a for a, _ in count}
    for s in (2, 3):
        t = dict.fromkeys(count, 1) | dict(zip(many, lm_score._expand(seats[s - 1].filter("kind = 0").collect()[0].a).tolist(), strict=True))
        state = states[s].collect()[0]
        c0, t0, k0, n0 = (dict(zip((word_of[i] for i in range(len(word_of))), lm_score._expand(state[x]).tolist(), strict=True)) for x in ("c0", "t0", "k", "n"))
        for w in word_of.values():
            assert c0[w] == sum(x for (_, b), x in t.items() if b == w) and k0[w] == sum(x for (a, _), x in t.items() if a == w)
            assert n0[w] == sum(x for (a, _), x in count.items() if a == w) and (t0[w] >= 1) == (c0[w] >= 1)
        p0 = {w: float(m.unigram(s, np.array([c0[w]]), np.array([t0[w]]))[0]) for w in word_of.values() if w != ""}
        unknown = m.base(s) * m.unknown
        assert sum(p0.values()) + unknown == pytest.approx(1)
        for a in [*contexts, "never"]:
            n, k = n0.get(a, 0), k0.get(a, 0)
            over = (m.theta[0] + m.d[0] * k) / (m.theta[0] + n)
            own = {w: (count[a, w] - m.d[0] * t[a, w]) / (m.theta[0] + n) for w in p0 if (a, w) in t}
            assert sum(own.values()) + over * (sum(p0.values()) + unknown) == pytest.approx(1)
            for w in p0:
                p[a, w] += (own.get(w, 0.0) + over * p0[w]) / 2
            p[a, "never"] += over * unknown / 2
    for k, text in enumerate(texts):
        ts = ["", *[w if w is None or number[w] >= 0 else "never" for w in tokens_of(text)]]
        assert rows[k].score == pytest.approx(sum(np.log10(p[a, w]) for a, w in zip(ts, ts[1:], strict=False)), abs=1e-6)


def test_lots_change_nothing_but_the_draws(spark):
    """A word that is in every block: with small lots no group holds a row of every block, and all counts are the same."""
    rows = [(k, f"the cat {k % 5} sat on the mat {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20, "doc_id")
    one, lots = ({r.doc_id: r for r in lm_score.score(docs, fan_in=f, range_tokens=40).collect()} for f in (1024, 3))
    assert len(one) == len(lots) == 60
    for k, r in one.items():
        assert (lots[k].n_known, lots[k].base_score) == pytest.approx((r.n_known, r.base_score)) and lots[k].score == pytest.approx(r.score, rel=0.1)
    sizes = collections.Counter(lm_score._lot(b << 24, 7) for b in range(20))
    assert len(sizes) > 3 and max(sizes.values()) < 10


def test_edge_cases(spark):
    schema = "doc_id long, text string, block string, kind string"
    assert lm_score.score(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "x", "y"), (1, "a b c", "x", "y"), (None, "a b", "x", "y"), (2, None, None, None), (3, "zz " * 200_000, "x", "y")], schema)
    rows = lm_score.score(docs, modulus=1, remainder=1).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 3, 4, 4, 200_001] and all(r.score < 0 and not r.held_out for r in rows)
    nothing = lm_score.score(docs.filter("doc_id IS NOT NULL"), modulus=1, remainder=0).collect()  # all are held out
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in nothing)


def test_what_occurs_together_is_likelier(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"v{k}" for k in range(500)]
    texts = [" ".join(rng.permutation(vocabulary)) for _ in range(3)] + ["rare%d next%d" % (k % 40, k % 40) for k in range(400)]
    probes = ["rare%d next%d" % (k, j) for k in range(5) for j in (k, k + 20)]
    docs = spark.createDataFrame([(k if k >= len(texts) else None, t) for k, t in enumerate(texts + probes)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in lm_score.score(docs, modulus=1, remainder=0).collect()}  # rows without an id train
    for k in range(5):
        assert scores[len(texts) + 2 * k] > scores[len(texts) + 2 * k + 1] + 0.5
