"""Label mappings as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Polarity codes of the labelled files.
POLARITY = {4: "pos", 2: "neutral", 0: "neg"}
# Codes named while counting; every other code goes to the catch-all.
COUNTED_THREE = {4: "pos", 2: "neutral"}
COUNTED_TWO = {0: "0"}


def map_label(
    code: Column | str, names: Mapping[int, str] = POLARITY, otherwise: str | None = None
) -> Column:
    """Name of a code; unknown codes are null, or ``otherwise`` when given."""
    code = F.col(code) if isinstance(code, str) else code
    label = F
    for value, name in names.items():
        label = label.when(code == value, F.lit(name))
    return label.otherwise(F.lit(otherwise)) if otherwise is not None else label


def sign_label(
    score: Column | str,
    positive: str = "pos",
    negative: str = "neg",
    zero: str = "neutral",
) -> Column:
    """Label of a score by its sign."""
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score > 0, positive).when(score < 0, negative).otherwise(zero)


def gated(label: Column | str, keep: Column, otherwise: str = "none") -> Column:
    """The label where ``keep`` holds, else ``none``; a null condition is false."""
    label = F.col(label) if isinstance(label, str) else label
    return F.when(keep, label).otherwise(F.lit(otherwise))
