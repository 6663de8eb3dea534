"""Written intermediate tables and the size check behind every broadcast."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    MapType,
    StringType,
    StructField,
    StructType,
)

from wrenlight.session import shared_dir

# A table is broadcast only when it has at most this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(
    df: DataFrame, name: str, session: SparkSession | None = None, **options: str | int
) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back, by ``session`` if given.

    Cuts the lineage with files that outlive any executor, and keeps column
    pruning and filter pushdown for the readers.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


def stored_observed(
    df: DataFrame, name: str, session: SparkSession | None = None, **measures: Column
) -> tuple[DataFrame, dict]:
    """``stored``, with ``rows`` and the given aggregates, worked out by the write itself.

    The tasks that write count as they go, so nothing is read a second time.
    """
    seen = Observation()
    counted = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), *(m.alias(n) for n, m in measures.items())
    )
    return stored(counted, name, session), seen.get


def fits_broadcast(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether ``df`` is small enough to broadcast, by its rows and the bytes of all columns.

    Call it on a stored table: the check is an action. Counts and sums are
    made in the map tasks; one row of each comes together.
    """
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width(df)), F.lit(0))).first()
    return rows <= max_rows and size <= BROADCAST_BYTES


def width(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    return reduce(add, [_width(field) for field in df.schema.fields])


def _width(field: StructField) -> Column:
    """About how many bytes a column takes in a row."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(16)
    if isinstance(field.dataType, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + F.lit(16)
    return F.lit(16)
