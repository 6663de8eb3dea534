"""Lexicon polarity: texts scored by the weights of their tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenlight.functions.scoring import SCORE_DIGITS
from wrenlight.operators.lookup import lookup
from wrenlight.sources.scratch import BROADCAST_ROWS

# Fixed value: the constant that maps a sum of weights into -1..1.
COMPOUND_ALPHA = 15.0


def lexicon_from_counts(counts: DataFrame, positive: str, negative: str) -> DataFrame:
    """Weights in -1..1 from word counts per label: ``(token, weight, n)``."""
    pos, neg = F.col(f"n_{positive}"), F.col(f"n_{negative}")
    return counts.where(pos + neg > 0).select(
        "token", ((pos - neg) / (pos + neg)).alias("weight"), "n"
    )


def lexicon_scores(
    docs: DataFrame,
    key: str,
    tokens: Column,
    lexicon: DataFrame,
    how: str = "mean",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(key, score)`` for every row; a text without lexicon tokens scores 0.

    ``lexicon`` is a stored table ``(token, weight)`` with distinct tokens, and perhaps their
    counts ``n``. ``how`` is the
    ``mean`` weight, or the ``compound`` of the summed weights. ``key`` should be
    unique: rows of one key, null included, are one text.
    """
    if how not in ("mean", "compound"):
        raise ValueError(f"unknown score: {how}")
    rows = docs.select(key, F.explode(tokens).alias("token"))
    known = [c for c in ("token", "weight", "n") if c in lexicon.columns]
    count = F.coalesce("n", F.lit(0)) if "n" in known else None
    hits = lookup(rows, lexicon.select(known), max_rows=max_rows, count=count).select(key, "weight")
    every = docs.select(key, F.lit(None).cast("double").alias("weight"))
    sums = hits.unionByName(every).groupBy(key).agg(
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"), F.count("weight").alias("found")
    )
    total = F.col("total")
    value = (
        total / F.greatest(F.col("found"), F.lit(1))
        if how == "mean"
        else total / F.sqrt(total * total + F.lit(COMPOUND_ALPHA))
    )
    return sums.select(key, F.round(value, SCORE_DIGITS).alias("score"))
