"""The registered queries and the pipeline on a small folder of tables, held to brute force or to their operators."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerscope.llm import queries, toxicity
from ledgerscope.llm.text import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SAID = "</s>[INST] ok [/INST]"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(vocabulary, 80)) for _ in range(40)]
    toxic = ["you idiot moron scum trash loser clown " + b for b in base[:6]]
    near = [" ".join([*b.split()[:-3], "x", "y", "z"]) for b in base[10:16]]
    texts = [*base, *toxic, *near, base[20], base[20] + " ", None, "", "one", base[21], base[21]]
    ids = [*range(len(texts) - 2), 5, None]  # an id that repeats, and none
    return [(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or ""), "extra") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string")
    docs.write.parquet(f"{top}/documents.parquet")
    labels = [(i, 1 if len(t or "") > 60 else 0, int("idiot" in (t or ""))) for i, t, *_ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, "u", "<article><p>text</p></article>"), (2, "v", None)], "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "hi [x"), (1, 1, "assistant", "a|b"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{top}/conversations.parquet")
    return str(top)


def words(t):
    return WORD.findall(t or "")


def test_op1(spark, folder):
    assert sorted(map(tuple, queries.op1_html_extraction(spark, folder).collect())) == [(1, "u", "text", 4), (2, "v", "", 0)]


def test_op2(spark, folder, rows):
    got = queries.op2_lm_scoring(spark, folder).collect()
    assert len(got) == len(rows) and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    assert sorted(r.n_tokens for r in got) == sorted(len(words(t)) + 1 for _, t, *_ in rows)


def test_op3(spark, folder, rows):
    got = queries.op3_packing(spark, folder).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in got) == sorted((i if i is not None else -1, len(words(t))) for i, t, *_ in rows)
    assert all(r.n_tokens <= r.bucket_length for r in got)


def test_op4_and_op10(spark, folder, rows):
    for query, modulus, remainder in ((queries.op4_quality_classifier, 5, 0), (queries.op10_toxicity, 4, 2)):
        got = query(spark, folder).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) for r in got)


def test_op5(spark, folder, rows):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups["".join(words(t))].append((-len(t or ""), i if i is not None else -1))
    want = collections.Counter()
    for body, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            want[i, keep, len(members), hashlib.sha256(body.encode()).hexdigest()] += 1
    got = queries.op5_exact_dedup(spark, folder).collect()
    assert collections.Counter((r.doc_id if r.doc_id is not None else -1, r.keep_id if r.keep_id is not None else -1, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_op6(spark, folder, rows):
    by = collections.defaultdict(set)
    for i, t, *_ in rows:
        by[i].add(t)
    for r in queries.op6_quality_rules(spark, folder).collect():
        found = [t for t in by[r.doc_id] if len(words(t)) == r.n_words]
        assert found and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_op7(spark, folder, rows):
    got = queries.op7_source_mixing(spark, folder).collect()
    total = sum(len(words(t)) for _, t, *_ in rows)
    targets = {r.source: r.target for r in got}
    assert len(got) == len(rows) and sum(targets.values()) == pytest.approx(1.5 * total)
    for s, target in targets.items():
        mine = [r for r in got if r.source == s]
        assert -1 <= target - sum(r.taken for r in mine) < max(r.size for r in mine) and all(r.taken <= 2 * r.size for r in mine)


def test_op8(spark, folder, rows):
    got = queries.op8_minhash_dedup(spark, folder).collect()
    sets = {}
    for i, t, *_ in rows:
        w = [x.lower() for x in words(t)]
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 3]) for k in range(max(len(w) - 2, 1))) if w else frozenset())
    flat = [(i, s) for i, ss in sets.items() for s in ss if i is not None]
    linked = lambda a, b: bool(a) and 100 * len(a & b) >= 85 * len(a | b)
    comp = {i: i for i, _ in flat}
    for _ in range(4):
        for i, a in flat:
            for j, b in flat:
                if linked(a, b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    for r in got:
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
        if r.doc_id is not None and len(set(sets[r.doc_id])) == 1:
            assert r.component_id == comp[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_op9(spark, folder):
    turns = {1: [("user", "hi [x"), ("assistant", "a|b")], 2: [("user", "")], -1: [("user", SAID), ("assistant", SAID)]}
    got = {r.conv_id: r for r in queries.op9_chat_formatting(spark, folder).collect()}
    assert set(got) == set(turns)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for k, ts in turns.items():
        loss = "".join(t for who, t in ts if who == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(ts), sha("".join(f"{a}\n{b}\n" for a, b in ts)), len(loss), sha(loss))


def test_pipeline_stage_by_stage(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    as_rows = lambda df: sorted(map(str, map(tuple, df.select(corpus_pipeline.COLUMNS).collect())))
    clean = corpus_pipeline.drop_toxic(spark, docs, folder).cache()
    lexicon = toxicity.learn_lexicon(docs, spark.read.parquet(f"{folder}/labels.parquet").filter(~held_out(F.col("doc_id"), 4, 2)))
    kept = [r for r in rows if lexicon.score(*[lexicon.hits(r[1])[k] for k in (0, 2)]) < 0.3]
    assert as_rows(clean) == sorted(map(str, (r[:5] for r in kept))) and clean.columns == corpus_pipeline.COLUMNS
    assert not any("idiot" in (r.text or "") for r in clean.collect()) and clean.count() == len(rows) - 6
    single = corpus_pipeline.drop_exact_copies(spark, clean, folder).cache()
    bodies = ["".join(words(r.text)) for r in single.collect()]
    assert sorted(bodies) == sorted({"".join(words(r.text)) for r in clean.collect()})
    apart = corpus_pipeline.drop_near_copies(spark, single, folder).cache()
    assert apart.count() == single.count() - 6 and set(as_rows(apart)) <= set(as_rows(single))
    mixed = corpus_pipeline.mix_to_weights(spark, apart, folder).cache()
    n = sum(len(words(r.text)) for r in apart.collect())
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) - 1.5 * n) <= 3 * 80 and set(as_rows(mixed)) <= set(as_rows(apart))
    packed = corpus_pipeline.pack_batches(spark, mixed, folder)
    assert packed.count() == mixed.count()


def test_pipeline_runs_and_takes_empty_tables(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 40 and {"doc_id", "batch", "bucket_length"} <= set(out.columns)
    for name in ("documents", "labels"):
        t = spark.read.parquet(f"{folder}/{name}.parquet")
        spark.createDataFrame([], t.schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
