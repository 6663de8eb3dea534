"""Positions in an order, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenlight.sources.scratch import fits_broadcast, stored

SPLIT_PARTS = ("train", "val", "test")
SPLIT_CUTS = (0.6, 0.8)


def with_rank(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank"
) -> DataFrame:
    """Add the 0-based position inside each group; ``order`` must be unique there.

    Rows are range-partitioned and sorted, so a group of any size spreads over
    many tasks. Each row takes its slot in its partition; one offset per
    partition and group, counted from the stored result, makes it a position.
    Storing matters: range bounds are sampled and must be drawn only once.
    """
    placed = _placed(
        df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order), "ranked"
    )
    return _positions(placed, group, df.columns, name)


def numbered(df: DataFrame, name: str, session: SparkSession | None = None) -> DataFrame:
    """Add a position from 0 on, in whatever order the rows come; no row is moved.

    The rows are stored and read by ``session``, if given.
    """
    return _positions(_placed(df, "numbered", session), [], df.columns, name)


def _placed(df: DataFrame, name: str, session: SparkSession | None = None) -> DataFrame:
    """``df``, stored with each row's partition and slot in it."""
    slots = {"_block": F.spark_partition_id(), "_slot": F.monotonically_increasing_id()}
    return stored(df.withColumns(slots), name, session)


def _positions(
    placed: DataFrame, group: Sequence[str], columns: Sequence[str], name: str
) -> DataFrame:
    block_keys = [*group, "_block"]
    blocks = placed.groupBy(*block_keys).agg(
        F.count(F.lit(1)).alias("_size"), F.min("_slot").alias("_first")
    )
    # One row per partition and group, so this window is small.
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = blocks.select(
        *[F.col(k).alias(f"_at_{k}") for k in block_keys],
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    if fits_broadcast(offsets):
        offsets = F.broadcast(offsets)
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in block_keys]
    return placed.join(offsets, same).select(
        *columns, (F.col("_slot") + F.col("_shift")).alias(name)
    )


def assign_ids(
    existing: DataFrame | int, fresh: DataFrame, order: Sequence[str], id_column: str = "id"
):
    """Fresh rows with new ids above the existing ones, in ``order``.

    ``existing`` is a table with ids or the highest id, if that is known.
    """
    if isinstance(existing, DataFrame):
        highest = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long")).scalar()
    else:
        highest = F.lit(existing).cast("long")
    ranked = with_rank(fresh.drop(id_column), [], order, "_rank")
    return ranked.select(
        (highest + F.lit(1) + F.col("_rank")).cast("long").alias(id_column),
        *[c for c in ranked.columns if c != "_rank"],
    )


def positional_split(
    df: DataFrame,
    label: str,
    classes: Sequence,
    key: str,
    cuts: Sequence[float] = SPLIT_CUTS,
    parts: Sequence[str] = SPLIT_PARTS,
) -> DataFrame:
    """Rows of ``classes`` with a ``part``: each class is cut by position in key order.

    Only ``(label, key)`` is ranked. The keys at the cut positions, one row per
    class, then split the full rows without moving them. ``key`` must be
    unique and not null.
    """
    chosen = df.where(F.col(label).isin(list(classes)))
    ranked = with_rank(chosen.select(label, key), [label], [key])
    sizes = F.broadcast(ranked.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    positions = ranked.join(sizes, label)
    bounds = positions.groupBy(label).agg(
        *[
            F.max(F.when(F.col("rank") == F.floor(F.lit(cut) * F.col("_n")), F.col(key))).alias(
                f"_cut_{i}"
            )
            for i, cut in enumerate(cuts)
        ]
    )
    part = F
    for i, name in enumerate(parts[:-1]):
        part = part.when(F.col(key) < F.col(f"_cut_{i}"), name)
    return chosen.join(F.broadcast(bounds), label).select(
        *df.columns, part.otherwise(parts[-1]).alias("part")
    )
