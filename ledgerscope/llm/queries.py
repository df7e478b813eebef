"""The registered queries of this subpackage, ``opN_<name>(spark, sf_dir)``, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm import centroids, chat_format, embedding_dedup, exact_dedup, html_extract, lm_score, merkle, minhash_dedup, mixing, packing, quality_model, quality_rules, toxicity
from ledgerscope.llm.text import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.learn_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(_table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 2, 0))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("passed")).alias("kept")
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    chats = chat_format.format_chats(rows.unionByName(probe).withColumn("parts", chat_format.text_part(F.col("text"))))
    chats = chats.withColumn("read", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learn_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, n.cast("decimal(20,0)") + 1).otherwise(n)
    found = merkle.manifest(_table(spark, sf_dir, "documents"), tampered={"n_chars": more})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict:
    found = [op1_html_extraction, op2_lm_scoring, op3_packing, op4_quality_classifier, op5_exact_dedup, op6_quality_rules, op7_source_mixing, op8_minhash_dedup, op9_chat_formatting, op10_toxicity, op11_centroid_clustering, op12_embedding_dedup, op13_merkle_manifest]
    return {f.__name__: f for f in found}


_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_NORMAL}) AS h, length(coalesce(text, '')) AS n FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size
      FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""

_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;')"
OP9_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length({_ESC.format("role")}) + length({_ESC.format("text")}) + 13) + 3 AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""



def _op11_sql(rounds: int = 3) -> str:
    """Lloyd's rounds, each a few common table expressions over (vec_id, place, v) and (cluster, place, v)."""
    ctes = [
        """e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "v AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS place, unnest(ints) AS v FROM e)",
        "c0 AS MATERIALIZED (SELECT cluster, unnest(range(64)) AS place, unnest(ints) AS v FROM (SELECT ints, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM e) WHERE cluster < 16)",
    ]
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, cluster, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS r FROM
  (SELECT v.vec_id, c.cluster, sum((v.v - c.v) * (v.v - c.v)) AS d FROM v JOIN c{k} c USING (place) GROUP BY ALL)) WHERE r = 1)""")
        if k < rounds:
            ctes.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.cluster, c.place, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN
  (SELECT cluster, place, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM a{k} JOIN v USING (vec_id) GROUP BY ALL) m USING (cluster, place))""")
    return f"""WITH {", ".join(ctes)} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM c{rounds} GROUP BY ALL) USING (cluster)"""


_FIELD = "coalesce(octet_length(encode({0})) || ':' || {0}, '-')"
#: crc32 of an id's digits: a byte is taken in, then eight shifts, marked -1.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: list_prepend(CAST(ascii(x) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))),
  lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST({n} AS VARCHAR)", "text")) + ")"

#: The trees of langs and the tree of subroots, level by level; a node is (tree, level, place, digest) of a tree of n nodes at its level.
OP13_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} ELSE {_LEAF.format(n="n_chars")} END AS bad FROM documents),
p AS MATERIALIZED (SELECT *, coalesce('+' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT g, 0 AS level, place, leaf AS h, n FROM p
  UNION ALL SELECT g, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY g, level, place // 2),
s AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, place, subroot AS h, n FROM s
  UNION ALL SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY level, place // 2),
steps AS MATERIALIZED (
  SELECT p.g, p.place, t.level, x.h AS sibling, (p.place >> t.level) & 1 AS side FROM p JOIN t ON t.g = p.g AND t.place = p.place >> t.level AND t.n > 1 LEFT JOIN t x ON x.g = t.g AND x.level = t.level AND x.place = xor(t.place, 1)
  UNION ALL SELECT p.g, p.place, 1000 + u.level, y.h, (s.place >> u.level) & 1 FROM p JOIN s USING (g) JOIN u ON u.place = s.place >> u.level AND u.n > 1 LEFT JOIN u y ON y.level = u.level AND y.place = xor(u.place, 1)),
paths AS MATERIALIZED (SELECT g, place, string_agg(coalesce(sibling, ''), '' ORDER BY level) AS proof, list(CASE WHEN sibling IS NULL THEN 'N' WHEN side = 1 THEN 'L' || sibling ELSE 'R' || sibling END ORDER BY level) AS path FROM steps GROUP BY ALL),
f AS (SELECT p.doc_id, p.leaf, p.g, coalesce(proof, '') AS proof, list_reduce(list_prepend(p.bad, coalesce(path, [])),
  lambda acc, x: sha256(CASE WHEN x = 'N' THEN acc WHEN x[1] = 'L' THEN x[2:] || acc ELSE acc || x[2:] END)) AS folded_root FROM p LEFT JOIN paths USING (g, place))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM f JOIN s USING (g), (SELECT h AS root FROM u WHERE n = 1)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op9_chat_formatting": OP9_SQL, "op11_centroid_clustering": _op11_sql(), "op13_merkle_manifest": OP13_SQL}
