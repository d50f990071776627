"""A training corpus from documents: filtered, deduplicated, mixed and tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Nulls, empty texts, repeated rows and empty tables have the
results that the operators' modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from quire.llm.common import forget, stored, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.5."""
    machine = toxicity.fit(docs.where(toxicity.learnable(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, machine, score_col="__score").where("__score < 0.5").select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text."""
    return exact_dedup.drop_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles."""
    return near_dedup.drop_near_duplicates(docs, size=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents may be left out or repeated, as their source's target asks."""
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of the decoded text."""
    found = bpe.encode_decode(docs.select("doc_id", "source", "text"), bpe.default_vocabulary())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: Trained models and hashed signatures have no SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's own tables, and the result of the stage before it, are deleted as soon as its result is written."""
    docs = table(spark, sf_dir, "documents")
    since = written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
            forget(spark, since, written() - 1)
            since = written() - 1
    return docs
