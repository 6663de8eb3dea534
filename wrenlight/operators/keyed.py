"""Tables with a business key: keep-first, anti joins, upserts, checks.

Rows without a key never match anything. They bypass the windows and joins
here, or are spread over them, because a plain shuffle on the key would send
all of them to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenlight.sources.scratch import fits_broadcast

# Tasks that share the rows without a key in an anti join.
KEYLESS_SPREAD = 4096


def _has_key(key: str) -> Column:
    return F.col(key).isNotNull()


def _one_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Lowest row per key; rows without a key all stay.

    The rank filter becomes a group limit before the shuffle, so a hot key
    sends one row per task. The hash makes the choice repeatable on ties.
    """
    window = Window.partitionBy(key).orderBy(*order, F.xxhash64(*df.columns))
    kept = (
        df.where(_has_key(key))
        .withColumn("_place", F.row_number().over(window))
        .where("_place = 1")
        .drop("_place")
    )
    return kept.unionByName(df.where(~_has_key(key)))


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return _one_per_key(df, key, [F.asc(name) for name in order])


def last_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return _one_per_key(df, key, [F.desc(name) for name in order])


def absent(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the known ones; rows without a key stay.

    A second join column, 0 wherever there is a key, spreads the rows without
    one over all tasks. The known side computes its 0 from the key, as a
    literal would be optimized out of the shuffle. It is one row a key, merged
    in the map task: Spark can't split the right side of an anti join.
    """
    names = [name for name in rows.columns if name != key]
    spread = F.when(_has_key(key), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*names), F.lit(KEYLESS_SPREAD)).cast("int")
        if names
        else F.lit(0)
    )
    known_keys = known.select(key, F.pmod(F.hash(key), F.lit(1)).alias("_spread")).distinct()
    return (
        rows.withColumn("_spread", spread)
        .join(known_keys, [key, "_spread"], "left_anti")
        .select(*rows.columns)
    )


def insert_ignore(
    target: DataFrame, batch: DataFrame, key: str, order: Sequence[str]
) -> DataFrame:
    """The batch rows an insert that ignores existing keys would add."""
    return absent(first_per_key(batch, key, order), target, key)


def upsert(
    target: DataFrame,
    batch: DataFrame,
    key: str,
    update: Sequence[str],
    order: Sequence[str],
    max_rows: int | None = None,
) -> DataFrame:
    """The target after inserting new keys and refreshing ``update`` on existing ones.

    Repeated keys in the batch: the last by ``order`` wins.
    """
    return merge_unique(target, last_per_key(batch, key, order), key, update, max_rows)


def merge_unique(
    target: DataFrame,
    batch: DataFrame,
    key: str,
    update: Sequence[str],
    max_rows: int | None = None,
) -> DataFrame:
    """``upsert`` of a batch without repeated keys.

    Columns outside ``update`` keep their stored values; null incoming values
    do overwrite. A batch within the size check is broadcast, so the target is
    not shuffled; a larger one takes one full outer join. ``batch`` is read
    several times and should be stored.
    """
    names = target.columns
    missing = [name for name in names if name not in batch.columns]
    batch = batch.select("*", *[F.lit(None).alias(name) for name in missing]).select(
        *[F.col(n).cast(target.schema[n].dataType).alias(n) for n in names]
    )
    keyless = batch.where(~_has_key(key))
    keyed_batch = batch.where(_has_key(key))
    incoming = keyed_batch.select(
        key,
        *[F.col(n).alias(f"_new_{n}") for n in names if n != key],
        F.lit(True).alias("_incoming"),
    )

    def refreshed(name: str) -> Column:
        return F.when(F.col("_incoming"), F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)

    if fits_broadcast(incoming, max_rows=max_rows):
        matched = target.select(key).join(F.broadcast(incoming.select(key)), key, "left_semi")
        fresh = keyed_batch.join(matched, key, "left_anti")
        kept = target.join(F.broadcast(incoming), key, "left").select(
            *[refreshed(n) if n in update else F.col(n) for n in names]
        )
        return kept.unionByName(fresh).unionByName(keyless)

    def inserted(name: str) -> Column:
        return F.when(F.col("_stored"), F.col(name)).otherwise(F.col(f"_new_{name}")).alias(name)

    merged = (
        target.where(_has_key(key))
        .withColumn("_stored", F.lit(True))
        .join(incoming, key, "full_outer")
        .select(
            *[
                F.col(n) if n == key else refreshed(n) if n in update else inserted(n)
                for n in names
            ]
        )
    )
    return merged.unionByName(target.where(~_has_key(key))).unionByName(keyless)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def orphan_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Keys without a parent row, with their row counts.

    The child is counted per key before the join, so a hot key is one row.
    """
    counts = child.where(_has_key(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def orphan_rows(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows without a parent row."""
    return child.where(_has_key(key)).join(
        parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti"
    )


def latest_id(df: DataFrame, id_column: str, time_column: str) -> DataFrame:
    """One row: the id with the latest time, or null when there is none."""
    return df.where(F.col(time_column).isNotNull()).agg(
        F.max(F.struct(time_column, id_column)).getField(id_column).alias("latest_id")
    )


def newer_than(df: DataFrame, id_column: str, mark: DataFrame | int | None) -> DataFrame:
    """Rows above a high-water mark; no mark, or one not above 0, takes all.

    ``mark`` is a value, or a one-row, one-column DataFrame that is read for it,
    so that the scan can push the comparison down.
    """
    if isinstance(mark, DataFrame):
        mark = mark.first()[0]
    return df.where(F.col(id_column) > mark) if mark and mark > 0 else df
