"""Evaluation of predictions, all from the confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenlight.functions.scoring import f_measure


def confusion(predictions: DataFrame) -> DataFrame:
    """``(label, prediction, n)``."""
    return predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy")
    )


def class_counts(confusion_counts: DataFrame) -> DataFrame:
    """``(label, tp, actual, predicted)`` per class that occurs on either side."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("label").alias("class"),
            hit.cast("long").alias("tp"),
            F.col("n").alias("actual"),
            none.alias("predicted"),
        ),
        F.struct(
            F.col("prediction").alias("class"),
            none.alias("tp"),
            none.alias("actual"),
            F.col("n").alias("predicted"),
        ),
    )
    return (
        confusion_counts.select(F.inline(sides))
        .groupBy(F.col("class").alias("label"))
        .agg(
            F.sum("tp").alias("tp"),
            F.sum("actual").alias("actual"),
            F.sum("predicted").alias("predicted"),
        )
    )


def class_scores(confusion_counts: DataFrame) -> DataFrame:
    """Precision, recall and F-measure per class; null where a set is empty."""
    scored = class_counts(confusion_counts).select(
        "label",
        F.try_divide(F.col("tp"), F.col("predicted")).alias("precision"),
        F.try_divide(F.col("tp"), F.col("actual")).alias("recall"),
    )
    return scored.withColumn("f_measure", f_measure(F.col("precision"), F.col("recall")))


def class_report(confusion_counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then three averages; 0 where undefined."""
    counts = class_counts(confusion_counts)

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    per_class = counts.select(
        F.col("label").alias("row"),
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("actual")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("actual")).alias("f1"),
        F.col("actual").alias("support"),
    )
    support = F.sum("support").alias("support")
    measures = ("precision", "recall", "f1")
    macro = per_class.agg(*[F.avg(m).alias(m) for m in measures], support)
    weighted = per_class.agg(
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
        support,
    )
    hits, predicted, actual = (F.sum(c) for c in ("tp", "predicted", "actual"))
    micro = counts.agg(
        ratio(hits, predicted).alias("precision"),
        ratio(hits, actual).alias("recall"),
        ratio(2 * hits, predicted + actual).alias("f1"),
        actual.alias("support"),
    )
    report = per_class
    for name, averages in (("micro avg", micro), ("macro avg", macro), ("weighted avg", weighted)):
        report = report.unionByName(averages.select(F.lit(name).alias("row"), "*"))
    return report
