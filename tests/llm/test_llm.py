"""The ten operators on small tables: nulls, empty and long texts, repeated rows, empty tables, and brute force."""

import collections
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import chat_format, exact_dedup, graph, html_extract, minhash_dedup, mixing, packing, quality_model, quality_rules, toxicity
from ledgerscope.llm.text import one_text, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, None, f"s{k % 3}" if k % 4 else None, None) for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(vocabulary, 60)) for _ in range(12)]
    near = [" ".join(w if i != 7 else "other" for i, w in enumerate(b.split())) for b in base[:5]]
    return [None, "", " \n\t", "one", "one", *base, *near, base[0], base[0] + " ", base[1].upper(), " ".join(rng.choice(vocabulary, 20_000))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, texts).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_html():
    page = "<html><head><title>x</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home page of the site</a></ul></nav><div class='cookie-notice'>We use cookies</div><div class='layout'><main><h1>A &amp; B</h1><p>First long paragraph of the\n  article, with many words in it.<p>Short.<aside>Related things</aside><p>Another long paragraph of the article, with words.</p><section class='comments'><p>A reader says hello</p></section></main></div><form><p>Sign up</p></form><footer>&copy; someone</footer></body></html>"
    assert html_extract.main_text(page) == "A & B\nFirst long paragraph of the article, with many words in it.\nShort.\nAnother long paragraph of the article, with words."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<script>x</script>") == ""


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None, 5), (2, "u", "<article><p>é</p></article>", 6)], "page_id long, url string, html string, n_chars long")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert got == {1: ("", 0), 2: ("é", 1)}


def test_packing_of_null_and_repeated_ids(spark):
    rows = [(None, "w " * (k % 7)) for k in range(400)] + [(3, "a b")] * 300 + [(k, "c") for k in range(50)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), buckets=3, budget=40).collect()
    assert len(got) == len(rows)
    for batch in {r.batch for r in got}:
        places = sorted(r.place for r in got if r.batch == batch)
        assert places == list(range(len(places)))


def test_packing_covers_all_rows(docs, none):
    rows = packing.pack(docs, buckets=4, budget=500).collect()
    assert len(rows) == docs.count()
    for _, group in itertools.groupby(sorted(rows, key=lambda r: r.batch), key=lambda r: r.batch):
        g = list(group)
        assert g[0].batch_tokens == len(g) * g[0].bucket_length and (len(g) == 1 or g[0].batch_tokens <= 500)
        assert sorted(r.place for r in g) == list(range(len(g)))
    assert packing.pack(none).count() == 0


def test_long_documents_are_padded_to_a_real_length(spark):
    rows = packing.pack(table(spark, ["w " * n for n in (3000, 3000, 5001, 5001, 7)]), buckets=3).collect()
    assert sorted((r.n_tokens, r.bucket_length, r.padding) for r in rows) == [(7, 7, 0), (3000, 3000, 0), (3000, 3000, 0), (5001, 5001, 0), (5001, 5001, 0)]


def test_bounds_are_optimal():
    rng = np.random.default_rng(4)
    x = np.sort(rng.choice(np.arange(1, 60), 9, replace=False))
    c = rng.integers(1, 9, 9)
    cost = lambda bounds: sum(n * (min(b for b in bounds if b >= v) - v) for v, n in zip(x, c, strict=True))
    best = min(cost([*p, x[-1]]) for p in itertools.combinations(x[:-1], 2))
    assert cost(packing.best_bounds(x, c, 3)) == best


def test_quality_model_learns(spark, none):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["the", "of", "words", "and"], 60)) if k % 2 else " ".join(w + "$$$" for w in rng.choice(["a", "b", "c"], 60)) for k in range(200)] + [None, ""]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    assert quality_model.learn_and_score(none, labels).count() == 0
    rows = quality_model.learn_and_score(docs, labels).collect()
    assert len(rows) == 202 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.doc_id % 2 for r in rows if r.doc_id < 200 and r.held_out]) > 0.95
    assert quality_model.learn_and_score(docs, labels.limit(0)).filter("score <> 0.5").count() == 0


def test_word_vectors_are_of_the_whole_corpus(spark):
    texts = ["plain words here" if k % 2 else "odd $$ here" for k in range(40)] + ["zorkmid beside quaxle", None]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    vectors, _ = quality_model.fit(table(spark, texts), labels)
    hashes = words_of(pa.array(["zorkmid beside quaxle"])).hashes
    rows = [int(h) % quality_model.WORD_ROWS for h in hashes]
    assert len(set(rows)) == 3
    own = quality_model.index_vectors(hashes)
    assert len({x.tobytes() for x in quality_model.index_vectors(words_of(pa.array(["a b c d e f g h"])).hashes)}) == 8
    for k in range(3):  # none of the three words is in a labelled text
        near = sum(own[j] for j in range(3) if j != k)
        assert vectors.context[rows[k]] == pytest.approx(near / np.linalg.norm(near) * (quality_model.DIMS / 4) ** 0.5, abs=1e-5)


def test_binary_fuse():
    keys = np.random.default_rng(6).integers(0, 1 << 63, 20_000).astype(np.uint64)
    f = exact_dedup.BinaryFuse.build(keys[:10_000])
    assert f.screen(keys[:10_000]).all() and f.screen(keys[10_000:]).mean() < 0.02
    assert int(keys[0]) in f and len(f.prints) < 14_000
    for n in (0, 1, 2, 5):
        assert exact_dedup.BinaryFuse.build(keys[:n]).screen(keys[:n]).all()


def test_exact_dedup(docs, texts, none):
    rows = {r.doc_id: r for r in exact_dedup.dedup(docs, F.col("doc_id") % 2 == 0).collect()}
    groups = collections.defaultdict(list)
    for k, t in enumerate(texts):
        groups["".join(WORD.findall(t or ""))].append(k)
    for g in groups.values():
        keep = min(g, key=lambda k: (-len(texts[k] or ""), k))
        assert all((rows[k].keep_id, rows[k].group_size, rows[k].kept) == (keep, len(g), k == keep) for k in g)
    assert exact_dedup.dedup(none, F.lit(True)).count() == 0


def test_exact_dedup_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "b")], "doc_id long, text string")
    assert sum(r.kept for r in exact_dedup.dedup(docs, F.lit(False)).collect()) == 2


def test_drop_copies_judges_a_repeated_id_text_by_text(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a  ", "y"), (1, "b", "x"), (3, "b", "z"), (None, "c", "x"), (None, "c", "x"), (4, None, "x"), (5, "", "x")], "doc_id long, text string, best string")
    left = exact_dedup.drop_copies(docs, exact_dedup.dedup(docs, F.col("doc_id") % 2 == 0))
    assert left.columns == docs.columns
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [(2, "a  ", "y"), (1, "b", "x"), (None, "c", "x"), (4, None, "x")]))


def rule_columns(t):
    w = WORD.findall(t or "")
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, docs, texts, none):
    rng = np.random.default_rng(12)
    odd = ["a # b\na # b\n \nc|d", "x\n\n" * 5, "é ü <b> é ü <b>", " ".join(rng.choice([f"w{k}" for k in range(50)], 66_000)), "one two three " * 30_000]
    every = [*texts, *odd]
    rows = quality_rules.apply_rules(table(spark, every).withColumn("failed", F.lit(1)).withColumn("__mine", F.col("doc_id"))).collect()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == rule_columns(every[r.doc_id]) and r.passed == (not r.failed) and r["__mine"] == r.doc_id
    assert len(rows) == len(every) and quality_rules.apply_rules(none).count() == 0
    by_rule = {r.doc_id: r.failed for r in rows}
    assert "too_short" in by_rule[3] and "repeated_words" in by_rule[len(texts) + 4] and by_rule[0] == ["too_short"]


def best_sum(n, c, budget):
    reach = {0}
    for x, k in zip(n, c, strict=True):
        reach |= {r + x * j for r in reach for j in range(k + 1) if r + x * j <= budget}
    return max(reach)


def test_fit_counts_is_as_near_as_can_be():
    rng = np.random.default_rng(7)
    short = []
    for _ in range(60):
        n = np.unique(rng.integers(1, 50, 6))
        c = rng.integers(1, 6, len(n))
        budget = int(rng.integers(0, (n * c).sum() + 5))
        take = mixing.fit_counts(n, c, budget)
        assert ((take >= 0) & (take <= c)).all() and (take * n).sum() <= budget
        # a share of every length is taken before the program, so that with a handful of documents the sum may miss the best by less than one
        short.append(best_sum(n, c, budget) - (take * n).sum())
        assert 0 <= short[-1] < n.max()
    assert np.mean(short) < 1.5 and np.mean(np.array(short) == 0) > 0.5
    long_ = np.concatenate([np.arange(1, 400), [60_000]])
    assert (mixing.fit_counts(long_, np.full(400, 3), 100_003) * long_).sum() == 100_003


@pytest.mark.parametrize("free", [200, 3])
def test_knapsack_way_back_over_many_lots(free):
    n = np.arange(1, 300)
    moves = mixing._reach(n, np.full(len(n), free), 20_011)
    assert sum(k * int(n[i]) for i, k in moves) == 20_011
    assert all(sum(k for j, k in moves if j == i) <= free for i, _ in moves)


def test_mixing(spark, docs, texts, none):
    mixed = lambda d: sorted(tuple(r) for r in mixing.mix_sources(d).drop("row").collect())
    key = lambda rows: sorted(map(str, rows))
    rows = mixing.mix_sources(docs).collect()
    assert key(tuple(r) for r in mixing.mix_sources(docs).drop("row").collect()) == key(tuple(r) for r in mixing.mix_sources(docs.repartition(3)).drop("row").collect())
    by = collections.defaultdict(list)
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size) and r.size == len(WORD.findall(texts[r.doc_id] or ""))
        by[r.source].append(r)
    assert sum(g[0].target for g in by.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    for g in by.values():
        assert g[0].target <= 2 * g[0].source_size
        taken = sum(r.taken for r in g)
        whole = g[0].source_size
        passes = int(g[0].target // whole)
        best = passes * whole + (best_sum([r.size for r in g], [1] * len(g), round(g[0].target) - passes * whole) if passes < 2 else 0)
        assert best - 60 <= taken <= best  # as near as whole documents can be, or within one of 60 words
    assert mixing.mix_sources(none).count() == 0 and mixed(none) == []


def test_mix_with_null_ids_empty_sources_and_repeats(spark):
    rows = [(None, "w " * k, "a") for k in range(1, 40)] + [(7, "x y z", "b")] * 3 + [(8, None, "c"), (9, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("number", F.monotonically_increasing_id())
    mix = mixing.mix_sources(docs, row="number").cache()
    assert mix.count() == len(rows)
    empty = mix.filter("source = 'c'").collect()
    assert all((r.size, r.source_size, r.target, r.taken) == (0, 0, 0.0, 0) for r in empty) and len(empty) == 2
    out = mixing.repeat(docs, mix, "number")
    assert out.columns == docs.columns and out.count() == mix.agg(F.sum("copies")).collect()[0][0]
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    taken = {r.source: r.n for r in mix.filter("taken > 0").groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert {k: v for k, v in words.items() if k in taken} == taken


def test_near_duplicates(docs, texts, none):
    sets = {}
    for k, t in enumerate(texts):
        w = [x.lower() for x in WORD.findall(t or "")]
        sets[k] = {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()
    comp = {k: k for k in sets}
    for _ in range(4):
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    rows = minhash_dedup.near_duplicates(docs, shingle=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {k: (len(sets[k]), comp[k], comp[k] == k) for k in sets}
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_with_repeated_rows_and_ids(spark):
    a = [f"a{k}" for k in range(40)]
    b = [f"b{k}" for k in range(40)]
    near = lambda w, k: " ".join([*w[:k], "x", *w[k + 1 :]])
    rows = [(1, " ".join(a)), (1, " ".join(a)), (7, near(a, 39)), (7, near(a, 39)), (7, " ".join(b)), (8, near(b, 0)), (9, None), (9, None), (None, " ".join(a))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash_dedup.near_duplicates(docs, shingle=3, percent=85)
    got = sorted({(r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in found.collect()})
    assert found.count() == len(rows)
    assert got == [(0, 38, 0, True), (1, 38, 1, True), (7, 38, 1, False), (8, 38, 1, False), (9, 0, 9, True)]
    assert sorted(r.doc_id or 0 for r in minhash_dedup.drop_near(docs, found).collect()) == [0, 1, 1, 9, 9]


def least_reachable(nodes, links):
    to = {k: k for k in nodes}

    def root(k):
        while to[k] != k:
            k = to[k]
        return k

    for a, b in ((a, b) for a, b in links if a != b):
        x, y = sorted((root(a), root(b)))
        to[y] = x
    return {k: root(k) for k in nodes}


@pytest.mark.parametrize("shape", ["none", "loops", "star", "inner", "path", "random"])
def test_components(spark, shape):
    rng = np.random.default_rng(17)
    links = {
        "none": [],
        "loops": [(3, 3), (4, 5), (5, 4), (4, 5)],
        "star": [(k, 0) for k in range(1, 60)],
        "inner": [(k, 30) for k in range(60) if k != 30],
        "path": [(int(a), int(b)) for a, b in itertools.pairwise(rng.permutation(90))],
        "random": [tuple(map(int, x)) for x in rng.integers(0, 300, (220, 2))],
    }[shape]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = [(r.node, r.component) for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert sorted(got) == sorted(least_reachable(nodes, links).items())


def test_near_duplicates_in_long_chains(spark):
    """Texts that drift: each is linked with a few neighbours, so that components of the first round meet in the second."""
    rng = np.random.default_rng(23)
    texts = []
    for chain in range(5):
        words = [f"c{chain}w{j}" for j in range(120)]
        for step in range(60):
            texts.append(" ".join(words))
            at = int(rng.integers(0, 116))
            words[at : at + 3] = [f"c{chain}s{step}x{j}" for j in range(3)]
    order = [int(x) for x in rng.permutation(len(texts))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    near = [(order[a], order[b]) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame([(order[k], t, 1) for k, t in enumerate(texts)], "doc_id long, text string, comp int")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == least_reachable(order, near)


def test_prefix_pairs_take_repeated_rows_once(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(1, 1 << 62, 60, np.uint64)
    a, b = np.unique(base[:56]), np.unique(base[4:])
    rows = [(1, 11, 1, a.tobytes())] * 3 + [(2, 12, 2, b.tobytes())]
    sets = spark.createDataFrame([(r, k, bytearray(s), c) for r, k, c, s in rows], "rep long, k long, s binary, comp long")
    assert [tuple(r) for r in minhash_dedup._prefix_pairs(sets, 80).collect()] == [(2, 1)]


def test_chat_round_trip_and_attachments(spark):
    said = "</s>[INST] <|end|>\n&lt; | ok"
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [(1, 1, "assistant", [part("text", said)]), (1, 0, "user", [part("text", "see"), part("image", None, "a.png", 2), part("odd", None, "b", None)]), (2, None, None, None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    out = chat_format.format_chats(df).withColumn("read", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))
    r = {x.conv_id: x for x in out.collect()}
    assert [tuple(t) for t in r[1].read] == [("user", "see<|image|><|document|>"), ("assistant", said)] and r[1].loss == said
    assert [(a.place, a.kind, a.ref) for a in r[1].attachments] == [(1, "image", "a.png"), (2, "document", "b")]
    assert r[1].attachment_tokens == 2 * 256 + 640 and r[2].n_turns == 1 and r[2].loss == ""


def test_toxicity_folding_and_exceptions():
    lex = toxicity.Lexicon({" idiot ": 8.0, " trash ": 8.0, " lowei": 5.0})
    for t in ("You IDIOT!", "an 1d10t", "іdіоt", "i​diot"):
        assert lex.hits(t)[1] == 1, t
    assert lex.hits("put it in the trash can")[1] == 0 and lex.hits("loweisch")[1] == 1 and lex.hits(None) == (0, 0, 0)


def test_toxicity_learns(spark):
    texts = [" ".join(["plain words here", "grumfel"] * 5) if k % 4 == 0 else "plain words here " * 9 for k in range(200)] + [None, ""]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(200)], "doc_id long, quality int, toxic int")
    rows = toxicity.learn_and_score(table(spark, texts), labels).collect()
    assert all(r.predicted == (r.doc_id < 200 and r.doc_id % 4 == 0) for r in rows)


def test_toxicity_counts_words_for_length():
    lex = toxicity.Lexicon({" idiot ": 8.0})
    total, _, words = lex.hits("you idiot " + "! " * 40_000)
    assert words == 2 and lex.score(total, words) == lex.score(8.0, 2)
    assert lex.score(8.0, 40_000) < lex.score(8.0, 400) == lex.score(8.0, 2)


def test_toxicity_edge_cases(spark, none):
    lex = toxicity.Lexicon({" idiot ": 8.0})
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "an idiot", "s"), (3, "an idiot", "s"), (None, "idiot " + "fine " * 200_000, "s")], "doc_id long, text string, score string")
    rows = toxicity.toxicity(docs, lex).collect()
    assert sorted((r.doc_id or 0, r.predicted, r.n_hits) for r in rows) == [(0, 0, 1), (1, 0, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1)]
    clean = toxicity.keep_clean(docs, lex)
    assert clean.columns == docs.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 1, 2]
    assert toxicity.toxicity(none, lex).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.learn_and_score(none, labels).count() == 0


def test_exact_dedup_of_a_very_long_text(spark):
    long_ = "many words " * 300_000
    docs = spark.createDataFrame([(1, long_), (2, long_ + "\n"), (3, long_ + "x")], "doc_id long, text string").withColumn("digest", F.lit("mine"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(docs, F.col("doc_id") == 1).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1)}


def test_bands_follow_the_threshold():
    assert minhash_dedup.band_plan(85) == (24, 6) and minhash_dedup.band_plan(80) == (32, 5)
    for percent in (50, 70, 80, 85, 90, 95, 100):
        bands, rows = minhash_dedup.band_plan(percent)
        assert bands * rows % 16 == 0 and (1 - min(percent, 99) ** rows / 100**rows) ** bands < 1e-4


def test_near_duplicates_at_the_threshold(spark):
    """Recall with bands, estimate and margin together: every pair of five-word shingle similarity of 0.8 or more, and no other."""
    rng = np.random.default_rng(31)
    rows, want = [], set()
    for k in range(250):
        n = int(rng.integers(60, 160))
        a = [f"t{k}x{j}" for j in range(n)]
        cut = round(n * rng.uniform(0.04, 0.16))  # words of the end changed
        b = a[: n - cut] + [f"u{k}x{j}" for j in range(cut)]
        sets = [{tuple(x[i : i + 5]) for i in range(n - 4)} for x in (a, b)]
        rows += [(2 * k, " ".join(a), "mine"), (2 * k + 1, " ".join(b), "mine")]
        if 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1]):
            want.add(2 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, bands string")
    found = minhash_dedup.near_duplicates(docs).collect()
    assert {r.doc_id for r in found if not r.kept} == want and 50 < len(want) < 250


def test_chat_ties_nulls_and_many_turns(spark, none):
    rows = [(1, 5, "user", "A"), (1, 5, "user", "[x"), (2, None, "user", None), (2, 1, "assistant", None)] + [(3, k, "assistant" if k % 2 else "user", f"t<{k}>") for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit(1))
    out = chat_format.format_chats(df.withColumn("parts", chat_format.text_part(F.col("text"))))
    got = {r.conv_id: r for r in out.withColumn("read", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [t.text for t in got[1].read] == ["A", "[x"] and [(t.role, t.text) for t in got[2].read] == [("user", ""), ("assistant", "")]
    assert [t.text for t in got[3].read] == [f"t<{k}>" for k in range(700)] and got[3].loss == "".join(f"t<{k}>" for k in range(1, 700, 2))
    assert chat_format.format_chats(df.limit(0).withColumn("parts", chat_format.text_part(F.col("text")))).count() == 0


def test_a_labelled_id_with_many_rows_counts_once(spark):
    """What is learned from has one row an id, so it is as small as its bound, and reruns agree; odd column names and clashing ones do no harm."""
    rows = [(0, f"row {k} of id zero", 1) for k in range(10_000)] + [(k, "you idiot moron" if k % 2 else "a calm word", 1) for k in range(1, 60)]
    docs = spark.createDataFrame(rows, "`my.id` long, `the text` string, y int").repartition(5)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(60)] + [(0, 1, 1), (None, 1, 0), (3, None, None)], "`my.id` long, toxic int, quality int")
    known = labels.filter("toxic IS NOT NULL AND `my.id` IS NOT NULL").groupBy(F.col("`my.id`").alias("i")).agg(F.max("toxic").alias("y"))
    got = [sorted(map(tuple, one_text(docs, known, "my.id", "the text").collect())) for _ in range(2)]
    assert len(got[0]) == 60 and got[0] == got[1]
    out = [sorted(map(tuple, m.learn_and_score(docs, labels, "my.id", "the text").collect())) for m in (toxicity, quality_model) for _ in range(2)]
    assert out[0] == out[1] and out[2] == out[3] and len(out[0]) == len(out[2]) == len(rows)


def test_helper_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7, 8, 9, 10), (2, "a b", "s", 7, 8, 9, 11), (3, "c", "s", 7, 8, 9, 12)], "doc_id long, text string, source string, __taken int, __copies int, __copy int, __key int")
    mixed = mixing.repeat(docs, mixing.mix_sources(docs, row="doc_id"), "doc_id")
    assert mixed.columns == docs.columns and mixed.count() > 0 and {(r["__taken"], r["__copies"], r["__copy"]) for r in mixed.collect()} == {(7, 8, 9)}
    left = exact_dedup.drop_copies(docs, exact_dedup.dedup(docs, F.col("doc_id") % 2 == 0))
    assert sorted(left.columns) == sorted(docs.columns) and {r.doc_id: r["__key"] for r in left.collect()} == {1: 10, 3: 12}
