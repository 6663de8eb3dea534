"""Association and evaluation formulas over count Columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# (joint count, word count, class count, total) -> score
ScoreFunction = Callable[[Column, Column, Column, Column], Column]

SCORE_DIGITS = 6


def chi_square(n_ii: Column, n_ix: Column, n_xi: Column, n_xx: Column) -> Column:
    """Chi-square of a two-by-two table; 0 where a margin is empty.

    Counts are cast to double first, because their products overflow a long.
    """
    n_ii, n_ix, n_xi, n_xx = (c.cast("double") for c in (n_ii, n_ix, n_xi, n_xx))
    n_io = n_ix - n_ii
    n_oi = n_xi - n_ii
    n_oo = n_xx - n_ii - n_io - n_oi
    difference = n_ii * n_oo - n_io * n_oi
    margins = (n_ii + n_io) * (n_ii + n_oi) * (n_io + n_oo) * (n_oi + n_oo)
    return F.coalesce(F.try_divide(n_xx * difference * difference, margins), F.lit(0.0))


def f_measure(precision: Column, recall: Column) -> Column:
    """Harmonic mean: null if either is null, 0 if either is 0."""
    undefined = precision.isNull() | recall.isNull()
    return (
        F.when(undefined, F.lit(None).cast("double"))
        .when((precision == 0) | (recall == 0), F.lit(0.0))
        .otherwise(F.lit(1.0) / (F.lit(0.5) / precision + F.lit(0.5) / recall))
    )


def best_label(scores: dict[str, Column], ties: str = "last") -> Column:
    """Label of the highest score, rounded so that summing order cannot decide.

    Equal scores go to the last label in sort order, or to the first.
    """
    names = sorted(scores, reverse=ties == "first")
    ranked: Sequence[Column] = [
        F.struct(
            F.round(scores[name], SCORE_DIGITS).alias("score"),
            F.lit(position).alias("position"),
            F.lit(name).alias("label"),
        )
        for position, name in enumerate(names)
    ]
    return (ranked[0] if len(ranked) == 1 else F.greatest(*ranked)).getField("label")
