"""Joins that stay even under hot keys, and slices of texts for Python tasks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenlight.session import ship_package  # noqa: F401  the operators take it from here

#: A key is hot when it holds more than one row in so many; fewer than this many keys can.
HOT_SHARE = 1000

#: A Python task works on about so many characters at a time (or one whole text).
SLICE_CHARS = 2_000_000


def group_count(spark: SparkSession) -> int:
    """Into how many groups work that is packed by hash is dealt.

    Follows ``spark.sql.shuffle.partitions``, which is sized to the data.
    """
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out_fold(doc_id: Column) -> Column:
    """Whether a row is kept from training: every fifth by CRC-32 of the id, no null id."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % 5
    return F.coalesce(fold == 0, F.lit(False))


def join_counted(
    rows: DataFrame, counted: DataFrame, key: str, count: str, total: int, spread: Column
) -> DataFrame:
    """Left join ``rows`` to ``counted``, which has one row a key and how many rows hold it.

    Keys with more than ``total / HOT_SHARE`` rows number less than
    ``HOT_SHARE``, so they are broadcast whatever the size of the data; their
    rows take no part in the key's shuffle and are dealt by ``spread``.
    ``counted`` should be a written table: it is read twice. A null key meets
    nothing.
    """
    limit = max(1, total // HOT_SHARE)
    values = [c for c in counted.columns if c != key]
    packed = counted.select(
        F.col(key).alias("_key"), F.col(count).alias("_count"), F.struct(*values).alias("_values")
    )
    hot = packed.where(F.col("_count") > limit).select("_key", F.col("_values").alias("_hot"))
    cold = packed.where(F.col("_count") <= limit).select(
        F.col("_key").alias("_cold_key"),
        F.lit(0).cast("long").alias("_cold_salt"),
        F.col("_values").alias("_cold"),
    )
    away = F.col("_hot").isNotNull() | F.col(key).isNull()
    salt = F.when(away, F.pmod(spread, F.lit(1 << 40)) + 1).otherwise(F.lit(0).cast("long"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").withColumn(
        "_salt", salt
    )
    meet = (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt"))
    return marked.join(cold, meet, "left").select(
        *(F.col(c) for c in rows.columns),
        *(F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values),
    )


def slices(batches, text: str = "text") -> Iterator[dict[str, list]]:
    """The columns of Arrow batches as lists, some ``SLICE_CHARS`` of text at a time."""
    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        sizes = [0 if x is None else x for x in _lengths(columns[text])]
        start = size = 0
        for end, n in enumerate(sizes, 1):
            size += n
            if size >= SLICE_CHARS or end == len(sizes):
                part = {k: v.slice(start, end - start).to_pylist() for k, v in columns.items()}
                yield part
                start, size = end, 0


def _lengths(column) -> list:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()
