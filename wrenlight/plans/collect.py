"""Batch collection and migration over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wrenlight.operators import keyed
from wrenlight.sources.keyed_table import KeyedTable
from wrenlight.streaming.intake import store_batch


def collect(raw: DataFrame, tweets: KeyedTable, users: KeyedTable | None = None) -> None:
    """Store the nested tweets newer than the latest stored one."""
    mark = keyed.latest_id(tweets.read(), "tweet_id", "created_at")
    store_batch(keyed.newer_than(raw, "id", mark), tweets, users)


def store_labels(labels: DataFrame, sentiments: KeyedTable, name: str | None = None) -> None:
    """Append the labels of texts that have none stored yet."""
    sentiments.insert_ignore(labels, [c for c in labels.columns if c != "tweet_id"], name)


def migrate(staging: DataFrame, tweets: KeyedTable) -> None:
    """Append the staging rows whose key the table does not hold."""
    tweets.insert_ignore(staging, [c for c in staging.columns if c != "tweet_id"])
