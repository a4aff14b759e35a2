"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and reads it again as the next one's docs.

A row is known by its doc_id and its text's digest: a doc_id may be null or
belong to several texts, and what is decided of one of them holds for no other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relayscope.llm import exact_dedup, minhash, mixing, packing, toxicity
from relayscope.llm.shared import row_key, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Of the mixture's tokens, by the labels' quality.
SHARES = {0: 0.1, 1: 0.9}


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: The column with a text's digest.
DIGEST = "pipeline_text_sha256"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with DIGEST; null counts as an empty text."""
    return docs.withColumn(DIGEST, F.sha2(F.coalesce("text", F.lit("")), 256))


def same_row(keys: DataFrame, digest: str, *more: str) -> tuple[DataFrame, Column]:
    """The keys under names of their own, and the condition that a keyed row has one of them (null is a doc_id)."""
    named = keys.select(F.col("doc_id").alias("pipeline_id"), F.col(digest).alias("pipeline_digest"), *more)
    return named, F.col("doc_id").eqNullSafe(F.col("pipeline_id")) & (F.col(DIGEST) == F.col("pipeline_digest"))


def kept(docs: DataFrame, gone: DataFrame, digest: str = DIGEST) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text aren't those of a row of ``gone``."""
    keys, same = same_row(gone.select("doc_id", digest).distinct(), digest)
    return keyed(docs).join(keys, same, "left_anti").drop(DIGEST)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier predicts to be toxic."""
    return kept(docs, toxicity.toxicity_scores(keyed(docs), labels(spark, sf_dir), carried=(DIGEST,)).where("predicted = 1"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays, and one if several have it."""
    copies = written(exact_dedup.exact_duplicates(docs).where("group_size > 1").select("doc_id", "text_sha256", "kept"), "copies")
    again = copies.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id", "text_sha256")
    out = kept(docs, copies.where("not kept").select("doc_id", "text_sha256").union(again), "text_sha256")
    if again.isEmpty():
        return out
    keys, same = same_row(again, "text_sha256")
    return out.union(keyed(docs).join(keys, same, "left_semi").dropDuplicates(["doc_id", DIGEST]).drop(DIGEST))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts (shingles of five words, similarity 0.8), the row with the smallest doc_id stays; null is the smallest."""
    gone = minhash.rows_to_drop(docs).select(F.col("doc").alias("pipeline_id"), F.col("text_key").alias("pipeline_key"))
    doc, key = row_key()
    return docs.join(gone, (doc == F.col("pipeline_id")) & (key == F.col("pipeline_key")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents until each quality has its share; with a least rate of 1 none goes."""
    return mixing.resampled(docs, mixing.fitted(docs, labels(spark, sf_dir), SHARES, least_rate=1.0))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


def apart(stage: Stage) -> Stage:
    """``stage`` on doc_id, text and one column with all others, so that no name of theirs can clash with those inside."""

    def whole(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        held = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("pipeline_rest")] if others else []
        out = stage(spark, docs.select("doc_id", "text", *held), sf_dir)
        return out.select(*(F.col("pipeline_rest").getField(c).alias(c) if c in others else F.col(c) for c in docs.columns))

    return whole


STAGES = [
    ("toxicity", apart(without_toxic)),
    ("exact_dedup", apart(without_copies)),
    ("near_dedup", apart(without_near_copies)),
    ("mixing", apart(mixed)),
    ("packing", packed),
]

#: Training, hashing and tokenising have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
