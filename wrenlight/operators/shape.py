"""Projections, filters and unions over tweets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenlight.schemas import TWEET, USER

# Fixed value: the text timestamp without its leading weekday name.
CREATED_AT = "MMM dd HH:mm:ss Z yyyy"


def created_at_timestamp(created_at: Column) -> Column:
    """Parse ``Wed Oct 10 20:19:24 +0000 2018``; null when it is not one."""
    return F.try_to_timestamp(F.substring(created_at, 5, 26), F.lit(CREATED_AT))


def tweet_rows(raw: DataFrame, *keep: str) -> DataFrame:
    """The stored tweet columns of nested tweets, linked to their user."""
    tweets = raw.select(
        F.col("id").alias("tweet_id"),
        F.coalesce("extended_tweet.full_text", "full_text").alias("tweet_text"),
        F.col("user.id").alias("user_id"),
        created_at_timestamp(F.col("created_at")).alias("created_at"),
        "in_reply_to_status_id",
        "in_reply_to_user_id",
        "source",
        "retweeted",
        "retweet_count",
        "favorited",
        "favorite_count",
        *keep,
    )
    return tweets.select(*[F.col(f.name).cast(f.dataType) for f in TWEET.fields], *keep)


def user_rows(raw: DataFrame, *keep: str) -> DataFrame:
    """The stored user columns of nested tweets, one row per tweet with a user."""
    users = raw.where(F.col("user").isNotNull()).select(
        F.col("user.id").alias("twitter_user_id"),
        *[F.col("user").getField(f.name).alias(f.name) for f in USER.fields[1:]],
        *keep,
    )
    return users.select(*[F.col(f.name).cast(f.dataType) for f in USER.fields], *keep)


def referenced(raw: DataFrame, *keep: str) -> DataFrame:
    """The nested tweets that rows refer to."""
    return raw.where(F.col("retweeted_status").isNotNull()).select("retweeted_status.*", *keep)


def of_class(df: DataFrame, code: int, column: str = "polarity") -> DataFrame:
    return df.where(F.col(column) == code)


def non_neutral(df: DataFrame, column: str = "polarity", neutral: int = 2) -> DataFrame:
    """Rows whose code is not neutral; a missing code is kept, as it is not neutral either."""
    return df.where(~F.col(column).eqNullSafe(F.lit(neutral)))


def on_topic(text: Column | str, pattern: str) -> Column:
    """Condition: the pattern occurs in the text."""
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(pattern)


def with_labels(tweets: DataFrame, labels: DataFrame, key: str = "tweet_id") -> DataFrame:
    """Tweets with label columns added by key; a tweet without labels keeps nulls."""
    return tweets.join(labels, key, "left")
