"""The corpus pipeline: toxicity, exact duplicates, near duplicates, source mixing and packing, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm import exact_dedup, minhash_dedup, mixing, packing, toxicity
from ledgerscope.llm.text import discard, held_out, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number of the row, written, so that a decision holds for one row whatever its id."""
    return stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW)), "numbered")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go. Null and empty texts stay; repeated rows are judged alike; without labels the seed words judge."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id"), 4, 2))
    lexicon = toxicity.learn_lexicon(docs, labels)
    return toxicity.keep_clean(docs, lexicon).select(COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null and empty ones among them, one stays, whether their ids differ, repeat or are null."""
    return exact_dedup.drop_copies(docs, exact_dedup.dedup(docs, held_out(F.col("doc_id"), 2, 0))).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more. Rows are told apart by number, so null and repeated ids are judged row by row; a text without words stays."""
    rows = _numbered(docs)
    return minhash_dedup.drop_near(rows, minhash_dedup.near_duplicates(rows, id=ROW), id=ROW).select(COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: the words of a source sum to what the mix takes of it. Null is a source; empty texts are taken in whole passes only."""
    rows = _numbered(docs)
    return mixing.repeat(rows, mixing.mix_sources(rows, row=ROW), ROW).select(COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of the mix is packed; null and empty texts have no tokens and go to the lowest bucket."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_dedup", drop_near_copies),
    ("source_mixing", mix_to_weights),
    ("packing", pack_batches),
]

#: Learned weights, signatures and subset sums have no SQL; tests/llm holds run() to its operators, stage by stage, on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage returns is written to the shared folder and read for the next, and then deleted. The last stage's rows stay there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
