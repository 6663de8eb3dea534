"""Writes that hold a table's constraints: what breaks one goes to a table of rejects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenlight.operators import keyed
from wrenlight.sources.keyed_table import KeyedTable
from wrenlight.sources.scratch import stored

#: Reasons, in the order in which they are given.
REPEATED, KNOWN, ORPHAN = "repeated key", "stored key", "no parent"


def checked(
    batch: DataFrame,
    key: str,
    order: Sequence[str],
    known: DataFrame | None = None,
    parents: DataFrame | None = None,
    reference: str | None = None,
    parent_key: str | None = None,
) -> DataFrame:
    """``batch`` with ``reason``: null for a row that may be written, else the rule it breaks.

    Of rows of one ``key`` the first by ``order`` may be written, if ``known`` lacks the key;
    and the row of ``parents`` must be there that ``reference`` (by default the key) names.
    As in SQL, a null key repeats nothing and a null reference names nothing. The
    result is stored, as rows get a number to tell them apart.
    """
    rows = stored(batch.withColumn("_row", F.monotonically_increasing_id()), "unchecked")
    # A hot key is one row in each map task.
    firsts = (
        rows.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(F.struct(*order, F.col("_row").alias("_first"))).alias("_at"))
        .select(F.col("_at._first").alias("_row"), F.lit(True).alias("_first"))
    )
    marked = rows.join(firsts, "_row", "left")
    repeated = F.col(key).isNotNull() & F.col("_first").isNull()
    reason = F.when(repeated, REPEATED)
    reference = reference or key
    for name, table, column, of in (
        (KNOWN, known, key, key),
        (ORPHAN, parents, reference, parent_key or reference),
    ):
        if table is None:
            continue
        found = table.select(F.col(of).alias("_key"), F.lit(True).alias(f"_{of}_found")).where("_key IS NOT NULL")
        # Null references are spread, as none is found.
        spread = F.coalesce(F.col(column).cast("string"), F.concat(F.lit("null "), F.col("_row")))
        marked = marked.withColumn("_side", spread).join(
            found.distinct().withColumn("_side", F.col("_key").cast("string")).drop("_key"), "_side", "left"
        )
        seen = F.col(f"_{of}_found").isNotNull() & F.col(column).isNotNull()
        broken = seen if name == KNOWN else ~seen & F.col(column).isNotNull()
        marked = marked.withColumn(f"_{name}", broken).drop("_side", f"_{of}_found")
        reason = reason.when(F.col(f"`_{name}`"), name)
    return stored(marked.withColumn("reason", reason).select(*batch.columns, "reason"), "checked")


def insert_checked(
    table: KeyedTable,
    batch: DataFrame,
    order: Sequence[str],
    rejects: str,
    parents: DataFrame | None = None,
    reference: str | None = None,
    parent_key: str | None = None,
    name: str | None = None,
) -> None:
    """Insert the rows of ``batch`` that keep the constraints; append the others to ``rejects``.

    ``rejects`` is a folder of Parquet files with the batch's columns and ``reason``.
    """
    marked = checked(batch, table.key, order, table.read(), parents, reference, parent_key)
    table.insert_ignore(marked.where("reason IS NULL").drop("reason"), order, name)
    marked.where("reason IS NOT NULL").write.mode("append").parquet(rejects)
