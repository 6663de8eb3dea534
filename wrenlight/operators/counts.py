"""Word, label and bigram counts; document frequencies; row counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenlight.functions import text as tx


def word_counts(
    docs: DataFrame,
    tokens: Column,
    label: Column | None = None,
    classes: Sequence[str] = (),
    lower: bool = True,
) -> DataFrame:
    """``(token, n, n_<class>...)`` in one pass with map-side partial sums."""
    rows = docs.select(
        (F.lit(None).cast("string") if label is None else label).alias("label"),
        F.explode(tokens).alias("token"),
    )
    token = F.lower("token") if lower else F.col("token")
    return rows.groupBy(token.alias("token")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("label") == name).alias(f"n_{name}") for name in classes],
    )


def label_totals(counts: DataFrame, classes: Sequence[str] = ()) -> DataFrame:
    """One row: tokens overall and per class."""
    return counts.agg(
        *[
            F.coalesce(F.sum(name), F.lit(0)).alias(name)
            for name in ["n", *[f"n_{c}" for c in classes]]
        ]
    )


def bigram_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """``(w1, w2, n)``; pairs never cross a document."""
    return (
        docs.select(F.inline(tx.bigrams(tokens)))
        .groupBy("w1", "w2")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def document_frequency(docs: DataFrame, tokens: Column) -> DataFrame:
    """``(term, df)``; a term counts once per document."""
    return (
        docs.select(F.explode(F.array_distinct(tokens)).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def row_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
