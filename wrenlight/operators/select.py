"""Choosing words and bigrams by an association score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenlight.functions.scoring import SCORE_DIGITS, ScoreFunction, chi_square
from wrenlight.operators.counts import label_totals
from wrenlight.operators.lookup import lookup
from wrenlight.operators.ranking import with_rank
from wrenlight.sources.scratch import stored

# Sizes of the selections, and the one added to the neutral total.
BEST_WORDS_THREE = 10_000
BEST_WORDS_TWO = 50_000
BEST_BIGRAMS = 1_000
THREE_CLASS_EXTRA = {"neutral": 1}

#: So many rows may be sorted in one task; more are selected by a histogram.
SORTED_ROWS = 1_000
#: Buckets of a histogram; so many rows come to the driver.
BUCKETS = 2_048


def score_words(
    counts: DataFrame,
    classes: Sequence[str],
    extra: Mapping[str, int] | None = None,
    score: ScoreFunction = chi_square,
) -> DataFrame:
    """``(token, n, score)``: the sum over classes of the word's association.

    The grand totals are a one-row scalar subquery over the same counts, whose
    shuffle the runtime reuses.
    """
    extra = extra or {}
    totals = label_totals(counts, classes)
    totals = totals.select(F.struct(*totals.columns).alias("totals"))
    scored = counts.withColumn("totals", totals.scalar())
    parts = [
        score(
            F.col(f"n_{name}"),
            F.col("n"),
            F.col("totals").getField(f"n_{name}") + F.lit(extra.get(name, 0)),
            F.col("totals").getField("n"),
        )
        for name in classes
    ]
    return scored.select(
        "token", "n", F.round(reduce(add, parts), SCORE_DIGITS).alias("score")
    )


def highest(rows: DataFrame, k: int, score: str, ties: Sequence[str]) -> DataFrame:
    """The ``k`` rows with the highest ``score``, equal ones by the lowest ``ties``.

    Scores are finite and not null; ``ties`` tell all rows apart. For a small ``k`` each
    task keeps its best. Else the k-th score is found by histograms of scores, made in
    the map tasks: each pass cuts the bucket that holds it anew, until that bucket is
    taken whole or is a single score. Rows of that score are ranked by ``ties``.
    No task gets more than its share of the rows. The result has no order.
    """
    if k <= SORTED_ROWS:
        return rows.orderBy(F.desc(score), *map(F.asc, ties)).limit(k)
    rows = stored(rows, "scored")
    value = F.col(score)
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(F.lit(1))).first()
    if n <= k:
        return rows
    needed = k
    while low < high:
        inside = value.between(low, high)
        share = (value - F.lit(low)) / F.lit(high - low)
        place = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        buckets = (
            rows.where(inside)
            .groupBy(place.alias("place"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
            .collect()
        )
        for bucket in sorted(buckets, key=lambda b: -b["place"]):
            low, high = bucket["low"], bucket["high"]
            if needed <= bucket["n"]:
                break
            needed -= bucket["n"]
        if needed == bucket["n"]:
            return rows.where(value >= low)
    equal = with_rank(rows.where(value == low), [], ties, "_rank")
    return rows.where(value > low).unionByName(
        equal.where(F.col("_rank") < needed).drop("_rank")
    )


def best_words(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores, ties by token."""
    return highest(scores, k, "score", ["token"])


def score_bigrams(
    bigrams: DataFrame, words: DataFrame, score: ScoreFunction = chi_square
) -> DataFrame:
    """``(w1, w2, n, score)`` from stored bigram counts and stored word counts."""
    total = words.agg(F.sum("n")).scalar()
    first = words.select(F.col("token").alias("w1"), F.col("n").alias("n1"))
    second = words.select(F.col("token").alias("w2"), F.col("n").alias("n2"))
    met = lookup(bigrams, first, "w1", is_stored=True, count=F.col("n1"))
    joined = lookup(met, second, "w2", count=F.col("n2"))
    value = score(F.col("n"), F.col("n1"), F.col("n2"), total)
    return joined.select("w1", "w2", "n", F.round(value, SCORE_DIGITS).alias("score"))


def best_bigrams(scores: DataFrame, k: int = BEST_BIGRAMS) -> DataFrame:
    """The ``k`` highest scores, ties by the pair."""
    return highest(scores, k, "score", ["w1", "w2"])


def feature_union(words: DataFrame, bigrams: DataFrame) -> DataFrame:
    """Selected words and bigrams as one list of features."""
    return words.select(F.col("token").alias("feature")).unionByName(
        bigrams.select(F.concat_ws(" ", "w1", "w2").alias("feature"))
    )
