"""Fixed schemas of the stored tables and of the input files."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


_LONG, _INT, _TEXT, _BOOL, _TIME = (
    LongType(),
    IntegerType(),
    StringType(),
    BooleanType(),
    TimestampType(),
)

# Stored users, without and with the surrogate id.
USER = _struct(
    twitter_user_id=_LONG,
    name=_TEXT,
    screen_name=_TEXT,
    statuses_count=_INT,
    followers_count=_INT,
    friends_count=_INT,
    location=_TEXT,
)
USERS = StructType([StructField("id", _LONG, True), *USER.fields])

# Stored tweets, without and with the surrogate id.
TWEET = _struct(
    tweet_id=_LONG,
    tweet_text=_TEXT,
    user_id=_LONG,
    created_at=_TIME,
    in_reply_to_status_id=_LONG,
    in_reply_to_user_id=_LONG,
    source=_TEXT,
    retweeted=_BOOL,
    retweet_count=_INT,
    favorited=_BOOL,
    favorite_count=_INT,
)
TWEETS = StructType([StructField("id", _LONG, True), *TWEET.fields])

# Labels kept per tweet.
SENTIMENTS = _struct(
    id=_LONG,
    tweet_id=_LONG,
    tweet_text=_TEXT,
    sentiment_naivebayes=_TEXT,
    sentiment_textblob=_TEXT,
    sentiment_vader=_TEXT,
)

# Labelled text files: six columns, no header.
LABELLED = _struct(
    polarity=_INT, tweet_id=_LONG, date=_TEXT, query=_TEXT, user=_TEXT, text=_TEXT
)

# One JSON document per tweet.
RAW_USER = _struct(
    id=_LONG,
    name=_TEXT,
    screen_name=_TEXT,
    statuses_count=_INT,
    followers_count=_INT,
    friends_count=_INT,
    location=_TEXT,
)
_RAW_FIELDS = dict(
    id=_LONG,
    full_text=_TEXT,
    created_at=_TEXT,
    in_reply_to_status_id=_LONG,
    in_reply_to_user_id=_LONG,
    source=_TEXT,
    retweeted=_BOOL,
    retweet_count=_INT,
    favorited=_BOOL,
    favorite_count=_INT,
    user=RAW_USER,
    extended_tweet=_struct(full_text=_TEXT),
)
RAW_REFERENCED = _struct(**_RAW_FIELDS)
RAW_TWEET = _struct(**_RAW_FIELDS, retweeted_status=RAW_REFERENCED)

# Columns refreshed when a key is already stored.
TWEET_REFRESH = ["retweeted", "retweet_count", "favorited", "favorite_count"]
USER_REFRESH = [
    "name",
    "screen_name",
    "statuses_count",
    "followers_count",
    "friends_count",
    "location",
]
