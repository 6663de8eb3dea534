"""From raw documents to a training mix: classify, de-duplicate, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenlight.llm import line_dedup, mixing, near_dedup, quality, tokenizer
from wrenlight.llm.common import held_out_fold, ship_package
from wrenlight.llm.queries import vocabulary_path
from wrenlight.sources.scratch import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts; it learns from the training fold's labels."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(~held_out_fold(F.col("doc_id"))))
    return quality.accepted(docs, model)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with one line kept of each class; those that keep none of theirs go.

    Texts that are null or blank have no lines and stay.
    """
    ship_package(spark)
    found = line_dedup.deduplicated(docs).where("n_lines = 0 OR n_kept > 0")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id.

    Rows without an id are classes of their own; repeated rows share an id, so all stay or go.
    """
    ship_package(spark)
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("id"))
    same = F.col("given.doc_id").eqNullSafe(F.col("id"))
    return _given(docs).join(kept.distinct(), same, "left_semi").select("given.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes; a row for each copy.

    Rows of one id and source share their copies; a null id or source equals a null.
    """
    mixed = mixing.mix(docs.select("doc_id", "text", "source")).where("copies > 0")
    copies = mixed.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of")).agg(
        F.max("copies").alias("copies")
    )
    same = F.col("given.doc_id").eqNullSafe(F.col("id")) & F.col("given.source").eqNullSafe(
        F.col("of")
    )
    taken = _given(docs).join(copies, same)
    return taken.select("given", F.explode(F.sequence(F.lit(1), "copies"))).select("given.*")


def _given(docs: DataFrame) -> DataFrame:
    """All columns as one, so that no name can clash with those of a stage."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("given"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix."""
    ship_package(spark)
    encoded = tokenizer.encode(docs, tokenizer.read_spec(vocabulary_path()))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can express neither the classifier nor the fuzzy stages; tests hold brute force against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
