"""Mixing sources to target weights by thresholds on a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenlight.llm.common import join_counted
from wrenlight.sources.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 12


def id_hash(doc_id: Column) -> Column:
    """60 bits that any SQL engine can compute: the first 15 hex digits of the id's MD5."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2
) -> DataFrame:
    """How many words to take of each source: ``key, source_size, rows, target``.

    Sources in code-point order, null last, get the weights in turn and share
    ``percent`` of all words. A target stops at ``most`` times its source;
    what is left over is shared by weight among the others: a source is full
    when its size per weight lies below the level at which all others would
    stand. The table has one row a source and is windowed as one list.
    """
    totals = sizes.groupBy("key", "source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")
    )
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    cycle = F.array(*(F.lit(w) for w in weights))
    weighed = totals.withColumn("weight", F.element_at(cycle, place.cast("int") + 1).cast("long"))
    every = Window.partitionBy(F.lit(0))
    line = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after = line.rowsBetween(0, Window.unboundedFollowing)
    wanted = F.lit(percent) * F.sum("source_size").over(every)
    taken = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(100 * most)
    levels = weighed.withColumn("left", wanted - taken).withColumn(
        "weights_left", F.sum("weight").over(after)
    )
    cap = F.col("source_size") * most
    full = cap * 100 * F.col("weights_left") <= F.col("weight") * F.col("left")
    marked = levels.withColumn("level", F.when(~full, F.col("left") / F.col("weights_left") / 100.0))
    level = F.max("level").over(every)
    return marked.select(
        "key",
        "source_size",
        "rows",
        F.when(F.col("level").isNull(), cap.cast("double"))
        .otherwise(F.least(cap.cast("double"), F.col("weight") * level))
        .alias("target"),
    )


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``key, cut``: the rows of ``key`` with a hash below ``cut`` come nearest ``budget``.

    Sums sizes by source and the leading bits of the hash, keeps only the
    bucket in which the budget runs out, and sums that by its next bits, until
    a bucket is one hash. Every pass aggregates in the map task first; no pass
    sorts rows. Rows of one hash go together, and the last of them is taken
    if more than half of it fits.
    """
    state = budgets.select(
        "key", "rows", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left")
    )
    total = budgets.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    narrow = sizes.select("key", "size", "hash")
    for depth in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        shift = HASH_BITS - depth
        known = state.select("key", "rows", "prefix", "left")
        inside = join_counted(narrow, known, "key", "rows", total, F.xxhash64("hash")).where(
            F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")
        )
        buckets = inside.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("size"),
            F.first("left").alias("left"),
            F.first("rows").alias("rows"),
        )
        line = Window.partitionBy("key").orderBy("bucket")
        before = F.coalesce(
            F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
        state = (
            buckets.withColumn("left", F.col("left") - before)
            .where("left >= 0")
            .groupBy("key")
            .agg(F.max_by(F.struct("bucket", "left", "size", "rows"), "bucket").alias("last"))
            .select("key", "last.*")
            .withColumnRenamed("bucket", "prefix")
        )
        state = stored(state, "mix-buckets")
    fits = F.col("size") <= 2 * F.col("left")
    return state.select("key", (F.col("prefix") + F.when(fits, 1).otherwise(0)).alias("cut"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    percent: int = 150,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``size`` is the row's words (null: 0), ``copies`` how often the mix takes
    it, at most twice where the target exceeds the source, ``taken`` the words
    of all copies.
    Which rows, a hash of the id decides, so reruns agree and a larger budget
    takes a superset; repeated ids are taken together. Sources without words
    have target 0. Null sources form one source of their own, null ids count as
    the empty string. Other columns are ignored. An empty table gives no rows.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.col(source).cast("string")
    sizes = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            name.alias("source"),
            F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("key"),
            words.alias("size"),
            id_hash(F.col(doc_id)).alias("hash"),
        ),
        "mix-sizes",
    )
    wanted = stored(targets(sizes, weights, percent), "mix-targets")
    twice = F.col("target") > F.col("source_size")
    budgets = wanted.withColumn(
        "budget", F.when(twice, F.col("target") - F.col("source_size")).otherwise(F.col("target"))
    )
    cuts = thresholds(sizes, budgets)
    plan = stored(wanted.join(cuts, "key", "left"), "mix-plan")
    total = plan.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    placed = join_counted(
        sizes.select("doc_id", "source", "key", "size", "hash"), plan, "key", "rows", total, F.xxhash64("hash")
    )
    copies = F.when(twice, 1).otherwise(0) + F.when(F.col("hash") < F.col("cut"), 1).otherwise(0)
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
