"""Joins of exploded tokens with a table that has one row per token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenlight.sources.scratch import BROADCAST_BYTES, BROADCAST_ROWS, fits_broadcast, stored, width

#: A token is hot when it is in more than one of so many rows; fewer than this many can be.
HOT_SHARE = 1000
#: Tokens that the count of frequent ones tracks; what it misses is in fewer rows than a hot one.
TRACKED = 16 * 1024
#: A longer hot token is not broadcast but dealt to this many salts.
HOT_TOKEN_BYTES = 256
SALTS = 64
#: Steps of a doubled count by which the most frequent part of a table is cut off.
STEPS = 16


def _head(key: str) -> Column:
    """What of a token is counted: all of it, unless it is too long to broadcast."""
    return F.left(F.col(key), F.lit(HOT_TOKEN_BYTES + 1))


def hot_tokens(rows: DataFrame, key: str = "token") -> DataFrame:
    """The tokens in more than a thousandth of ``rows``, and perhaps a few that aren't.

    Frequent items are counted in the map tasks, each in bounded memory, and the
    tasks' counts are merged, so no token is shuffled. Of long tokens the beginning is counted.
    """
    some = rows.where(F.col(key).isNotNull()).select(_head(key).alias("head"))
    merged = some.agg(
        F.expr(f"approx_top_k(head, {HOT_SHARE}, {TRACKED})").alias("top"),
        F.count(F.lit(1)).alias("all"),
    )
    listed = merged.select("all", F.inline("top"))
    return listed.where(F.col("count") > F.col("all") / HOT_SHARE).select(
        F.col("item").alias(key)
    )


def frequent(table: DataFrame, count: Column, max_rows: int = BROADCAST_ROWS) -> Column:
    """Tells the most frequent rows of ``table``, as many as fit a broadcast.

    Counts, not null, are cut into ``STEPS`` for each doubling; some hundred buckets come to
    the driver.
    """
    step = F.floor(F.log2(F.greatest(count, F.lit(1))) * STEPS)
    buckets = table.groupBy(step.alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(width(table)).alias("bytes")
    )
    rows = size = 0
    least = None
    for bucket in sorted(buckets.collect(), key=lambda b: -b["step"]):
        rows, size = rows + bucket["n"], size + bucket["bytes"]
        if rows > max_rows or size > BROADCAST_BYTES:
            break
        least = bucket["step"]
    return F.lit(False) if least is None else step >= least


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str = "token",
    max_rows: int = BROADCAST_ROWS,
    how: str = "inner",
    is_stored: bool = False,
    count: Column | None = None,
) -> DataFrame:
    """Join of ``rows`` with ``table`` (unique ``key``), ``inner`` or ``left``.

    A table within the size check is broadcast. Else the rows are stored, unless they
    are a stored table already, so that what makes them runs once, and the hot tokens are found in them: their part of the table,
    under ``HOT_SHARE`` rows, is broadcast, whether or not they are frequent in
    the table, and the other tokens are joined by a shuffle. Hot tokens too long to
    broadcast are spread there over ``SALTS``. ``table`` must be stored. A null
    token has no match.

    ``count`` says how frequent a token of the table is, as far as is known. The most frequent ones,
    as many as may be broadcast, are joined first then, so only the rows of the other tokens are
    stored, searched for hot tokens and shuffled. ``rows`` is worked out twice.
    """
    if fits_broadcast(table, max_rows):
        return rows.join(F.broadcast(table), key, how)
    if count is not None:
        inside = frequent(table, count, max_rows)
        top, others = table.where(inside), table.where(~inside)
        often = rows.join(F.broadcast(top), key)
        seldom = rows.join(F.broadcast(top.select(key)), key, "left_anti")
        return often.unionByName(lookup(seldom, others, key, 0, how, is_stored))
    rows = rows if is_stored else stored(rows, "lookup-rows")
    hot = stored(hot_tokens(rows, key), "hot-tokens")
    short = F.broadcast(hot.where(F.octet_length(key) <= HOT_TOKEN_BYTES))
    often = rows.join(short, key, "left_semi").join(
        F.broadcast(table.join(short, key, "left_semi")), key, how
    )
    seldom, others = (side.join(short, key, "left_anti") for side in (rows, table))
    long = hot.where(F.octet_length(key) > HOT_TOKEN_BYTES)
    if long.isEmpty():
        return often.unionByName(seldom.join(others, key, how))
    # Hashes of the long tokens' beginnings are few and short; another token with the same
    # hash is only spread without need.
    hashes = F.broadcast(long.select(F.xxhash64(key).alias("_hash")))
    head = F.xxhash64(_head(key))
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))
    spread = seldom.join(hashes, head == F.col("_hash"), "left").withColumn(
        "_salt", F.when(F.col("_hash").isNull(), 0).otherwise(place)
    )
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    repeated = others.join(hashes, head == F.col("_hash"), "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_hash").isNull(), F.array(F.lit(0).cast("long"))).otherwise(salts)),
    )
    met = spread.drop("_hash").join(repeated.drop("_hash"), [key, "_salt"], how).drop("_salt")
    return often.unionByName(met)


def in_vocabulary(rows: DataFrame, vocabulary: DataFrame, key: str = "token") -> DataFrame:
    """Rows whose token is in ``vocabulary``, a stored table with distinct tokens."""
    return lookup(rows, vocabulary.select(key), key)
