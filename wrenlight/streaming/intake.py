"""Incremental intake of nested tweets from a landing folder into keyed tables."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wrenlight.operators import keyed, shape
from wrenlight.schemas import RAW_TWEET, TWEET_REFRESH, USER_REFRESH
from wrenlight.sources.keyed_table import KeyedTable
from wrenlight.sources.scratch import stored_observed

# Arrival order of a landed row: its file's time and name, its block and its place in it.
ARRIVAL = ["arrived_at", "arrived_in", "arrived_block", "arrived_row"]

# Fixed value: the cap of a run.
MAX_ROWS = 1_000_000


class Enough(Exception):
    """Ends a run that has taken as many rows as it may, before the next batch is stored."""


def landing_stream(
    spark: SparkSession, folder: str, max_files: int | None = None, newest_first: bool = False
) -> DataFrame:
    """New JSON-lines files of a folder, each read once; ``max_files`` caps a batch."""
    reader = spark.readStream.schema(RAW_TWEET).option("latestFirst", newest_first)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder).select(
        "*",
        F.col("_metadata.file_modification_time").alias("arrived_at"),
        F.col("_metadata.file_path").alias("arrived_in"),
        F.col("_metadata.file_block_start").alias("arrived_block"),
    )


def first_users(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of users in which each is seen once while the watermark remembers it.

    The state is bounded by ``delay``; the stored table removes later repeats.
    """
    rows = stream.where(F.col("user").isNotNull()).select(
        F.col("user.id").alias("twitter_user_id"),
        *[F.col("user").getField(name).alias(name) for name in USER_REFRESH],
        "arrived_at",
    )
    return rows.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(
        ["twitter_user_id"]
    )


def start_first_users(
    spark: SparkSession, folder: str, progress: str, users: KeyedTable, delay: str = "1 day"
) -> StreamingQuery:
    """Store each user as first seen, from what has landed since the last run, then stop.

    The stream's state, kept in ``progress`` over restarts, drops repeats while the watermark
    remembers them; ``users`` drops the later ones.
    """

    def store(batch: DataFrame, number: int) -> None:
        users.insert_ignore(batch, ["arrived_at"], f"{progress}#{number}")

    return (
        first_users(landing_stream(spark, folder), delay)
        .writeStream.option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )


def with_referenced(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tweets and users of a batch, with the tweets it refers to.

    A referenced tweet is added when the batch does not hold it already, and
    its user when no tweet of the batch names that user. A user is taken from
    the newest tweet that names it, which a search returns first.
    """
    tweets = shape.tweet_rows(raw, *ARRIVAL)
    users = keyed.last_per_key(
        shape.user_rows(raw, "id", *ARRIVAL), "twitter_user_id", ["id", *ARRIVAL]
    )
    nested = shape.referenced(raw, *ARRIVAL)
    repeated = keyed.last_per_key(shape.tweet_rows(nested, *ARRIVAL), "tweet_id", ARRIVAL)
    more_tweets = keyed.absent(repeated, tweets, "tweet_id")
    named = keyed.last_per_key(
        shape.user_rows(nested, "id", *ARRIVAL), "twitter_user_id", ["id", *ARRIVAL]
    )
    more_users = keyed.absent(named, users, "twitter_user_id")
    return tweets.unionByName(more_tweets), users.unionByName(more_users).drop("id")


def store_batch(
    raw: DataFrame,
    tweets: KeyedTable,
    users: KeyedTable | None = None,
    refresh_users: bool = True,
    name: str | None = None,
) -> int:
    """Upsert one batch of nested tweets and say how many; repeating a named one changes nothing.

    The rows are counted while they are stored. Arrival columns that ``raw`` lacks say nothing, but for the row's place. The
    stored batch is read by the tables' session: a micro-batch's own session
    runs without adaptive execution.
    """
    lacking = [c for c in ARRIVAL[:-1] if c not in raw.columns]
    raw = raw.select("*", *[F.lit(0).alias(c) for c in lacking])
    if ARRIVAL[-1] not in raw.columns:
        raw = raw.withColumn(ARRIVAL[-1], F.monotonically_increasing_id())
    raw, seen = stored_observed(raw, "intake", tweets.spark)
    tweet_batch, user_batch = with_referenced(raw)
    tweets.upsert(tweet_batch, TWEET_REFRESH, ARRIVAL, name)
    if users is not None:
        if refresh_users:
            users.upsert(user_batch, USER_REFRESH, ARRIVAL, name)
        else:
            users.insert_ignore(user_batch, ARRIVAL, name)
    return seen["rows"]


def start_intake(
    spark: SparkSession,
    folder: str,
    progress: str,
    tweets: KeyedTable,
    users: KeyedTable | None = None,
    max_files: int | None = None,
    refresh_users: bool = True,
    newest_first: bool = False,
    max_rows: int | None = None,
) -> StreamingQuery:
    """Process what has landed since the last run, batch by batch, then stop.

    ``progress`` is the streaming checkpoint: it records exactly which files
    were stored, and a batch that died is repeated under its name. A run that has taken
    ``max_rows`` ends with ``Enough`` before the next batch, which the next run
    begins with; see ``run_intake``.
    """
    taken = 0

    def store(batch: DataFrame, number: int) -> None:
        nonlocal taken
        if max_rows is not None and taken >= max_rows:
            raise Enough
        taken += store_batch(batch, tweets, users, refresh_users, f"{progress}#{number}")

    return (
        landing_stream(spark, folder, max_files, newest_first)
        .writeStream.option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )


def run_intake(
    spark: SparkSession,
    folder: str,
    progress: str,
    tweets: KeyedTable,
    users: KeyedTable | None = None,
    max_rows: int = MAX_ROWS,
    page_files: int = 1,
    refresh_users: bool = True,
) -> bool:
    """One run of collecting: newest files first, ``page_files`` a batch, up to ``max_rows``.

    The batch that reaches the cap is stored whole. Returns whether the cap ended the run;
    what it left is taken by the next.
    """
    query = start_intake(
        spark, folder, progress, tweets, users, page_files, refresh_users, True, max_rows
    )
    try:
        query.awaitTermination()
    except StreamingQueryException as error:
        if Enough.__name__ not in str(error):
            raise
        return True
    return False
