"""Every operator as a query over the given tables, whole tables each time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenlight.functions import labels as lb
from wrenlight.functions import text as tx
from wrenlight.operators import (
    bayes,
    counts,
    keyed,
    lexicon,
    linear,
    metrics,
    ranking,
    select,
    shape,
    stopwords,
    tfidf,
)
from wrenlight.plans import classify, collect
from wrenlight.schemas import RAW_TWEET, SENTIMENTS, TWEET, TWEETS, USERS
from wrenlight.sources import checked, files
from wrenlight.sources.keyed_table import KeyedTable
from wrenlight.sources.scratch import scratch_path, stored, stored_observed
from wrenlight.streaming import intake

TOPIC = r"([Oo]f\s+[Tt]he)|([Dd]e\s+[Ll]a)|(#[A-Za-z]+)"
STOPWORDS = 50
WORDS_CUT = 5_000
WEIGHT_DIGITS = 6
# All kinds of events.
EVENT_KINDS = ("view", "click", "purchase", "signup", "error")
CHANGE_ORDER = ["l_linenumber", "l_partkey", "o_totalprice", "o_orderdate"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a polarity code: toxic 0, good quality 4, others 2."""
    labels = table(spark, folder, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 4).otherwise(2).alias("polarity"),
    )
    return table(spark, folder, "documents").select("doc_id", "text").join(labels, "doc_id")


# Counts and selection


def word_freq(spark, folder):
    return counts.word_counts(table(spark, folder, "documents"), tx.tokenize("text"))


def _label_counts(spark, folder):
    return counts.word_counts(
        labelled(spark, folder),
        tx.tokenize("text", strip_handles=True),
        lb.map_label("polarity", lb.COUNTED_THREE, otherwise="neg"),
        classify.THREE,
    )


def label_totals(spark, folder):
    return counts.label_totals(_label_counts(spark, folder), classify.THREE)


def chi2_words_2class(spark, folder):
    scores = classify.two_class_scores(labelled(spark, folder))
    return select.best_words(scores, select.BEST_WORDS_TWO)


def chi2_words_cut(spark, folder):
    """A selection that is smaller than the vocabulary of every table size."""
    return select.best_words(classify.two_class_scores(labelled(spark, folder)), WORDS_CUT)


def chi2_words_3class(spark, folder):
    scores = classify.three_class_scores(labelled(spark, folder))
    return select.best_words(scores, select.BEST_WORDS_THREE)


def chi2_bigrams(spark, folder):
    return select.best_bigrams(classify.bigram_scores(table(spark, folder, "documents")))


def feature_union(spark, folder):
    return select.feature_union(chi2_words_2class(spark, folder), chi2_bigrams(spark, folder))


# Text functions


def _per_document(expression) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, folder):
        docs = table(spark, folder, "documents")
        return docs.select("doc_id", expression(F.col("text")).alias("cleaned"))

    return run


def page_cleaning(spark, folder):
    """Both cleanings and the tokens of texts that hold addresses."""
    return table(spark, folder, "pages").select(
        "page_id",
        tx.clean_spacing("url").alias("spacing"),
        tx.clean_strict("url").alias("strict"),
        F.array_join(tx.tokenize("url"), " ").alias("tokens"),
    )


def token_presence(spark, folder):
    tokens = tx.presence(tx.tokenize("text"))
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(F.sort_array(tokens), " ").alias("features")
    )


def vocab_presence(spark, folder):
    vocabulary = stored(chi2_words_3class(spark, folder), "vocabulary")
    rows = classify.best_word_features(labelled(spark, folder), vocabulary, "doc_id")
    return rows.withColumn("features", F.array_join("features", " "))


def stopword_removal(spark, folder):
    docs = table(spark, folder, "documents")
    words = counts.word_counts(docs, tx.tokenize("text"), lower=False)
    frequent = words.orderBy(F.desc("n"), F.asc("token")).limit(STOPWORDS)
    listed = stopwords.plain_stopwords(frequent, "token")
    return stopwords.remove_stopwords(docs.select("doc_id", "text"), listed).drop("text")


def polarity_label(spark, folder):
    codes = table(spark, folder, "labels").select(
        "doc_id",
        # Code 3 is none of the three.
        F.when((F.col("toxic") == 1) & (F.col("quality") == 1), 3)
        .when(F.col("toxic") == 1, 0)
        .when(F.col("quality") == 1, 4)
        .otherwise(2)
        .alias("polarity"),
    )
    return codes.select(
        "doc_id",
        lb.map_label("polarity").alias("label"),
        lb.map_label("polarity", lb.COUNTED_THREE, "neg").alias("counted_three"),
        lb.map_label("polarity", lb.COUNTED_TWO, "4").alias("counted_two"),
    )


def sign_label(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey",
        lb.sign_label("c_acctbal").alias("label"),
        lb.sign_label("c_acctbal", "positive", "negative").alias("long_label"),
    )


def topic_filter(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.where(shape.on_topic("text", TOPIC)).select("doc_id", "n_chars")


def gated_label(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    rows = labelled(spark, folder).join(docs, "doc_id")
    keep = shape.on_topic("text", TOPIC) & (F.col("lang") == "en")
    return rows.select("doc_id", lb.gated(lb.map_label("polarity"), keep).alias("label"))


# Nested tweets


def _event_struct(prefix: str = "") -> list:
    """Event columns as the fields of a nested tweet."""

    def at(name):
        return F.col(f"{prefix}{name}")

    moment = at("ts").cast("timestamp")
    none_id = F.lit(None).cast("long")
    return [
        at("event_id").alias("id"),
        at("event_type").alias("full_text"),
        F.date_format(moment, "EEE MMM dd HH:mm:ss Z yyyy").alias("created_at"),
        none_id.alias("in_reply_to_status_id"),
        none_id.alias("in_reply_to_user_id"),
        F.lit("web").alias("source"),
        F.lit(False).alias("retweeted"),
        F.get_json_object(at("props"), "$.k").cast("int").alias("retweet_count"),
        (at("value") > 50).alias("favorited"),
        F.floor(at("value")).cast("int").alias("favorite_count"),
        F.struct(
            at("user_id").alias("id"),
            F.concat(F.lit("user "), at("user_id")).alias("name"),
            F.concat(F.lit("seen at "), at("event_id")).alias("screen_name"),
            at("event_id").cast("int").alias("statuses_count"),
            F.lit(None).cast("int").alias("followers_count"),
            F.lit(None).cast("int").alias("friends_count"),
            F.lit(None).cast("string").alias("location"),
        ).alias("user"),
        F.when(
            at("event_type") == "view",
            F.struct(F.concat(F.lit("long "), at("event_type")).alias("full_text")),
        ).alias("extended_tweet"),
    ]


def _nested_events(spark, folder) -> DataFrame:
    """Events as nested tweets; a purchase refers to the event before it.

    The join moves the plain columns; tweets are made of them behind it.
    """
    events = table(spark, folder, "events")
    before = events.select(
        (F.col("event_id") + 1).alias("next_id"),
        *[F.col(name).alias(f"before_{name}") for name in events.columns],
    )
    joined = events.join(before, F.col("event_id") == F.col("next_id"), "left")
    refers = (F.col("event_type") == "purchase") & F.col("next_id").isNotNull()
    nested = joined.select(
        *_event_struct(),
        F.when(refers, F.struct(*_event_struct("before_"))).alias("retweeted_status"),
    )
    return nested.select(*[F.col(f.name).cast(f.dataType) for f in RAW_TWEET.fields])


def split_nested(spark, folder):
    tweets = shape.tweet_rows(_nested_events(spark, folder))
    return tweets.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).drop(
        "in_reply_to_status_id", "in_reply_to_user_id"
    )


def split_nested_users(spark, folder):
    return shape.user_rows(_nested_events(spark, folder)).drop(
        "followers_count", "friends_count", "location"
    )


def missing_refs(spark, folder):
    """Assistant turns, and the turns before them that the assistant did not write."""
    turns = table(spark, folder, "conversations").withColumn(
        "turn_key", F.concat_ws(":", "conv_id", "turn")
    )
    collected = turns.where("role = 'assistant'")
    wanted = collected.select(F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("turn_key"))
    found = turns.join(wanted.distinct(), "turn_key", "left_semi")
    added = keyed.absent(found, collected, "turn_key")
    return (
        collected.withColumn("added", F.lit(False))
        .unionByName(added.withColumn("added", F.lit(True)))
        .select("turn_key", "role", "text", "added")
    )


# Keyed tables


def first_per_user(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    return keyed.first_per_key(events, "user_id", ["ts", "event_id"])


def new_users(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    known = table(spark, folder, "events").select(F.col("user_id").alias("o_custkey"))
    return keyed.absent(
        keyed.first_per_key(orders, "o_custkey", ["o_orderdate", "o_orderkey"]), known, "o_custkey"
    )


def new_rows(spark, folder):
    orders = table(spark, folder, "orders")
    return keyed.absent(orders, orders.where("o_orderstatus = 'F'"), "o_orderkey")


def _order_changes(spark, folder) -> DataFrame:
    """Order lines as a batch of orders that repeats its keys."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_linestatus").alias("o_orderstatus"),
        F.col("l_extendedprice").alias("o_totalprice"),
        F.col("l_shipdate").alias("o_orderdate"),
        *CHANGE_ORDER[:2],
    )


def insert_ignore(spark, folder):
    target = table(spark, folder, "orders").where("o_orderpriority <> '5-LOW'")
    return keyed.insert_ignore(
        target, _order_changes(spark, folder), "o_orderkey", CHANGE_ORDER
    )


def _upsert_orders(max_rows):
    def run(spark, folder):
        target = table(spark, folder, "orders").where("o_orderpriority <> '5-LOW'")
        batch = stored(
            keyed.last_per_key(_order_changes(spark, folder), "o_orderkey", CHANGE_ORDER), "changes"
        )
        update = ["o_orderstatus", "o_totalprice"]
        return keyed.upsert(target, batch, "o_orderkey", update, CHANGE_ORDER, max_rows)

    return run


def upsert_full(spark, folder):
    # Keyed by user and minute, so that most keys of the target are not in the batch.
    events = table(spark, folder, "events").select(
        F.concat_ws(":", "user_id", F.date_format("ts", "HHmm")).alias("place"),
        "event_id", "event_type", "value",
    )
    late = F.col("event_type").isin("purchase", "error")
    target = keyed.first_per_key(events.where(~late), "place", ["event_id"])
    batch = events.where(late)
    return keyed.upsert(target, batch, "place", ["event_id", "event_type", "value"], ["event_id"])


def duplicate_keys(spark, folder):
    docs = table(spark, folder, "documents").select(F.md5("text").alias("digest"))
    return keyed.duplicate_keys(docs, "digest")


def orphan_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return keyed.orphan_rows(orders, "o_custkey", table(spark, folder, "events"), "user_id")


def orphan_keys(spark, folder):
    orders = table(spark, folder, "orders")
    return keyed.orphan_keys(orders, "o_custkey", table(spark, folder, "events"), "user_id")


def surrogate_ids(spark, folder):
    """Ids for one market segment first, then for the others above them."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    first, others = (customers.where(f"c_mktsegment {op} 'BUILDING'") for op in ("=", "<>"))
    nobody = customers.limit(0).withColumn("id", F.lit(None).cast("long"))
    existing = stored(ranking.assign_ids(nobody, first, ["c_custkey"]), "existing")
    return existing.unionByName(ranking.assign_ids(existing, others, ["c_custkey"]))


def latest_id(spark, folder):
    return keyed.latest_id(table(spark, folder, "events"), "event_id", "ts")


def ids_since(spark, folder):
    orders = table(spark, folder, "orders")
    mark = keyed.latest_id(orders.where("o_orderstatus = 'F'"), "o_orderkey", "o_orderdate")
    return keyed.newer_than(orders.select("o_orderkey", "o_orderdate"), "o_orderkey", mark)


# Split, models, metrics


def stratified_split(spark, folder):
    parts = ranking.positional_split(labelled(spark, folder), "polarity", [0, 4], "doc_id")
    return parts.select("doc_id", "polarity", "part")


def split_counts(spark, folder):
    return counts.row_counts(stratified_split(spark, folder), "polarity", "part")


def write_counts(spark, folder):
    """How many rows of each part there are, counted by the write of the split."""
    parts = ranking.positional_split(labelled(spark, folder), "polarity", [0, 4], "doc_id")
    of_part = {name: F.count_if(F.col("part") == name) for name in ranking.SPLIT_PARTS}
    _, seen = stored_observed(parts, "parts", **of_part)
    return spark.createDataFrame(sorted(seen.items()), "part string, n long")


def presence_nb_predict(spark, folder):
    model = classify.selected_word_bayes(labelled(spark, folder))
    return classify.predict_sentiment(model, table(spark, folder, "documents"), "doc_id")


def nb_informative(spark, folder):
    return classify.selected_word_bayes(labelled(spark, folder)).informative()


def multinomial_nb_predict(spark, folder):
    terms = tx.terms("text")
    model = bayes.fit_multinomial(
        labelled(spark, folder), lb.map_label("polarity"), terms, classify.TWO
    )
    return model.predict(table(spark, folder, "documents"), "doc_id", terms)


def _held_out(spark, folder) -> DataFrame:
    """Labels and predictions of the validation part, all three classes."""
    # Stored, as selection, fit and prediction each read the texts.
    rows = stored(labelled(spark, folder), "labelled")
    parts = ranking.positional_split(rows, "polarity", [0, 2, 4], "doc_id")
    train, test = (parts.where(F.col("part") == name) for name in ("train", "val"))
    model = classify.selected_word_bayes(train)
    return classify.evaluated(classify.predict_sentiment(model, test, "doc_id"), test, "doc_id")


def confusion(spark, folder):
    return metrics.confusion(_held_out(spark, folder))


def accuracy(spark, folder):
    return metrics.accuracy(_held_out(spark, folder))


def class_prf(spark, folder):
    return metrics.class_scores(confusion(spark, folder))


def class_report(spark, folder):
    rows = _held_out(spark, folder).where("label <> 'neutral'")
    return metrics.class_report(metrics.confusion(rows))


def idf(spark, folder):
    return tfidf.idf(table(spark, folder, "documents"), tx.terms("text", (1, 2)))


def tfidf_rows(spark, folder):
    docs = table(spark, folder, "documents")
    rows = tfidf.tfidf(docs, "doc_id", tx.terms("text", (1, 2)))
    return rows.withColumn("weight", F.round("weight", WEIGHT_DIGITS))


# Language and lexicon


def lang_predict(spark, folder):
    model = bayes.fit_language(table(spark, folder, "documents"))
    turns = table(spark, folder, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("turn_key"), "text"
    )
    return bayes.predict_language(model, turns, "turn_key")


def lang_filter(spark, folder):
    """Documents without a label, by a model of those with one."""
    docs = table(spark, folder, "documents")
    known = table(spark, folder, "labels").select("doc_id")
    seen = docs.join(known, "doc_id", "left_semi")
    others = docs.join(known, "doc_id", "left_anti")
    languages = bayes.predict_language(bayes.fit_language(seen), others, "doc_id")
    return bayes.keep_language(others, languages, "doc_id", "en").select("doc_id", "n_chars")


def _lexicon(spark, folder, positive: str = "pos", negative: str = "neg") -> DataFrame:
    """Word weights from the labelled documents."""
    return stored(
        lexicon.lexicon_from_counts(_label_counts(spark, folder), positive, negative), "lexicon"
    )


def lexicon_label(spark, folder):
    words = F.transform(tx.tokenize("text"), lambda token: F.lower(token))
    docs = table(spark, folder, "documents")
    scores = lexicon.lexicon_scores(docs, "doc_id", words, _lexicon(spark, folder))
    return scores.withColumn("label", lb.sign_label("score"))


def cleaned_sentiment(spark, folder):
    """Long labels of cleaned texts."""
    docs = table(spark, folder, "documents").select("doc_id", tx.clean_spacing("text").alias("text"))
    words = F.transform(tx.tokenize("text"), lambda token: F.lower(token))
    scores = lexicon.lexicon_scores(docs, "doc_id", words, _lexicon(spark, folder))
    return scores.withColumn("label", lb.sign_label("score", "positive", "negative"))


def sentiment_columns(spark, folder):
    docs = table(spark, folder, "documents")
    model = classify.selected_word_bayes(labelled(spark, folder))
    lexicons = [_lexicon(spark, folder), _lexicon(spark, folder, "neutral", "pos")]
    language = bayes.fit_language(docs)
    return classify.sentiment_table(docs, "doc_id", model, lexicons, language, TOPIC)


def sentiments_stored(spark, folder):
    """Labels in their table: those of the short texts first, then all, which adds the others."""
    labels = stored(sentiment_columns(spark, folder), "labels").select(
        F.col("doc_id").alias("tweet_id"),
        F.col("text").alias("tweet_text"),
        *[f"sentiment_{kind}" for kind in ("naivebayes", "textblob", "vader")],
    )
    place = scratch_path(spark, "sentiments")
    sentiments = KeyedTable(spark, place, SENTIMENTS, "tweet_id", span=1_000_000, id_column="id")
    short = labels.where(F.length("tweet_text") < 1_000)
    collect.store_labels(short.withColumn("sentiment_vader", F.lit("first")), sentiments, "short")
    collect.store_labels(labels, sentiments, "all")
    return sentiments.read().drop("id")


# Linear models


def _logistic(spark, folder, **settings) -> tuple[linear.LinearTextModel, DataFrame, DataFrame]:
    train, held_out = classify.logistic_split(labelled(spark, folder), "doc_id")
    train = stored(train, "train")
    label = lb.map_label("polarity")
    return linear.fit_tfidf_logistic(train, "doc_id", label, classify.TWO, **settings), train, held_out


def logreg_predict(spark, folder):
    model, _, held_out = _logistic(spark, folder)
    return classify.evaluated(model.predict(held_out, "doc_id"), held_out, "doc_id")


def logreg_report(spark, folder):
    """Accuracy, report and sizes of the logistic model on the held-out part."""
    return classify.evaluation_rows(classify.logistic_job(labelled(spark, folder), "doc_id")[1])


def logreg_optimum(spark, folder):
    """That the fitted model is the optimum: its gradient, worked out anew, is 0."""
    model, train, _ = _logistic(spark, folder, iterations=500, tolerance=1e-10)
    found = linear.largest_gradient(model, train, "doc_id", lb.map_label("polarity"))
    return found.select(
        "rows",
        "terms",
        F.lit(linear.INVERSE_STRENGTH).alias("strength"),
        F.round("gradient", 3).alias("gradient"),
    )


def linear_extremes(spark, folder):
    return _logistic(spark, folder)[0].extremes()


def linear_svc_predict(spark, folder):
    train, held_out = classify.logistic_split(labelled(spark, folder), "doc_id")
    model = linear.fit_linear_svc(
        stored(train, "train"), "doc_id", lb.map_label("polarity"), classify.TWO
    )
    return classify.evaluated(model.predict(held_out, "doc_id"), held_out, "doc_id")


def sgd_predict(spark, folder):
    train, held_out = classify.logistic_split(labelled(spark, folder), "doc_id")
    model = linear.fit_sgd(
        stored(train, "train"), "doc_id", lb.map_label("polarity"), classify.TWO
    )
    return classify.evaluated(model.predict(held_out, "doc_id"), held_out, "doc_id")


def grid_search(spark, folder):
    train, _ = classify.logistic_split(labelled(spark, folder), "doc_id")
    _, settings = linear.grid_search(
        stored(train, "train"), "doc_id", lb.map_label("polarity"), classify.TWO
    )
    return settings


# Files and streams


def json_round_trip(spark, folder):
    rows = table(spark, folder, "conversations")
    place = scratch_path(spark, "json")
    files.append_json_lines(rows, place)
    return files.read_json_lines(spark, f"{place}/part-", rows.schema)


def csv_round_trip(spark, folder):
    rows = labelled(spark, folder).select(
        "polarity",
        F.col("doc_id").alias("tweet_id"),
        F.lit("-").alias("date"),
        F.lit("NO_QUERY").alias("query"),
        F.concat(F.lit("user "), F.col("doc_id")).alias("user"),
        "text",
    )
    place = scratch_path(spark, "csv")
    files.write_labelled_csv(rows, place, encoding="UTF-8")
    return files.read_labelled_csv(spark, place, encoding="UTF-8")


def csv_export(spark, folder):
    turns = table(spark, folder, "conversations")
    place = scratch_path(spark, "export")
    files.export_csv(turns, ["conv_id", "turn", "text"], place)
    return files.read_export(spark, place, turns.select("conv_id", "turn", "text").schema)


def _landed(spark, folder, refresh_users) -> tuple[KeyedTable, KeyedTable]:
    """Two landings of events: all but signups, then clicks again with the signups."""
    place = scratch_path(spark, "stream")
    tweets = KeyedTable(spark, f"{place}/tweets", TWEETS, "tweet_id", span=2_000, id_column="id")
    users = KeyedTable(spark, f"{place}/users", USERS, "twitter_user_id", id_column="id")
    events = _nested_events(spark, folder)
    later = events.where("full_text IN ('click', 'signup')").select(
        *[F.col(f.name) for f in RAW_TWEET.fields if f.name not in ("full_text", "retweet_count")],
        F.concat(F.lit("late "), F.col("full_text")).alias("full_text"),
        (F.col("retweet_count") + 1000).alias("retweet_count"),
    )
    for landing in (events.where("full_text <> 'signup'"), later):
        files.append_json_lines(landing, f"{place}/landing")
        intake.start_intake(
            spark,
            f"{place}/landing",
            f"{place}/progress",
            tweets,
            users,
            refresh_users=refresh_users,
        ).awaitTermination()
    return tweets, users


def stream_upsert(spark, folder):
    tweets, _ = _landed(spark, folder, refresh_users=True)
    rows = tweets.read().select(*TWEET.names)
    return rows.select("tweet_id", "tweet_text", "user_id", "retweet_count", "favorite_count")


def collect_batch(spark, folder):
    """Events from files, but only those after the latest stored one."""
    place = scratch_path(spark, "collect")
    tweets = KeyedTable(spark, f"{place}/tweets", TWEETS, "tweet_id", span=2_000, id_column="id")
    events = _nested_events(spark, folder).drop("retweeted_status")
    files.append_json_lines(events, f"{place}/landing")
    raw = files.read_json_lines(spark, f"{place}/landing/part-", arrival=True)
    early = raw.where("id <= 4000 AND full_text <> 'error'")
    collect.collect(early, tweets)
    collect.collect(raw, tweets)
    return tweets.read().select("tweet_id", "tweet_text", "user_id", "retweet_count")


def stored_ids(spark, folder):
    """The stored keys after an intake of one file a batch, a landing for each kind of event."""
    place = scratch_path(spark, "capped")
    tweets = KeyedTable(spark, f"{place}/tweets", TWEETS, "tweet_id", span=2_000, id_column="id")
    events = _nested_events(spark, folder).drop("retweeted_status")
    for kind in EVENT_KINDS:
        landed = events.where(F.col("full_text") == kind).repartition(1)
        files.append_json_lines(landed, f"{place}/landing")
    intake.start_intake(
        spark, f"{place}/landing", f"{place}/progress", tweets, max_files=1
    ).awaitTermination()
    return files.stored_ids(tweets.read())


def capped_intake(spark, folder):
    """Keys after a run, newest files first, that may take one row more than the newest has."""
    place = scratch_path(spark, "newest")
    tweets = KeyedTable(spark, f"{place}/tweets", TWEETS, "tweet_id", span=2_000, id_column="id")
    events = _nested_events(spark, folder).drop("retweeted_status")
    for kind in EVENT_KINDS:
        landed = events.where(F.col("full_text") == kind).repartition(1)
        files.append_json_lines(landed, f"{place}/landing")
        # File times tell landings apart.
        time.sleep(0.05)
    newest = events.where(F.col("full_text") == EVENT_KINDS[-1]).count()
    intake.run_intake(spark, f"{place}/landing", f"{place}/progress", tweets, max_rows=newest + 1)
    return files.stored_ids(tweets.read())


def first_users_stream(spark, folder):
    """Each user with the landing that named it first, in two runs of one stream."""
    place = scratch_path(spark, "users")
    users = KeyedTable(spark, f"{place}/users", USERS, "twitter_user_id", id_column="id")
    events = table(spark, folder, "events")
    for landing, rows in (("first", events.where("value >= 99")), ("second", events.where("value < 99 OR value IS NULL"))):
        user = F.struct(
            F.col("user_id").alias("id"),
            F.concat(F.lit("user "), "user_id").alias("name"),
            F.lit(landing).alias("location"),
        )
        files.append_json_lines(rows.select(F.col("event_id").alias("id"), user.alias("user")), f"{place}/landing")
        intake.start_first_users(
            spark, f"{place}/landing", f"{place}/progress", users
        ).awaitTermination()
    return users.read().select("twitter_user_id", "name", "location")


def sentiments_checked(spark, folder):
    """Labels of all documents, those with a label twice, into a table that refers to the latter."""
    place = scratch_path(spark, "checked")
    sentiments = KeyedTable(spark, f"{place}/rows", SENTIMENTS, "tweet_id", id_column="id")
    parents = table(spark, folder, "labels").select(F.col("doc_id").alias("tweet_id"))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("tweet_id"), F.col("text").alias("tweet_text"))
    again = parents.select("tweet_id", F.lit("~ again").alias("tweet_text"))
    batch = docs.unionByName(again).withColumns(
        {f"sentiment_{kind}": F.lit("none") for kind in ("naivebayes", "textblob", "vader")}
    )
    rejects = f"{place}/rejects"
    first = batch.where(F.length("tweet_text") < 1_000)
    for part in (first, batch):
        checked.insert_checked(sentiments, part, ["tweet_text"], rejects, parents)
    written = sentiments.read().select("tweet_id", "tweet_text", F.lit("written").alias("outcome"))
    return written.unionByName(
        spark.read.parquet(rejects).select("tweet_id", "tweet_text", F.col("reason").alias("outcome"))
    )


def stream_users_once(spark, folder):
    _, users = _landed(spark, folder, refresh_users=False)
    return users.read().select("twitter_user_id", "name", "screen_name", "statuses_count")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "word_freq": word_freq,
    "word_freq_by_label": _label_counts,
    "label_totals": label_totals,
    "chi2_words_2class": chi2_words_2class,
    "chi2_words_cut": chi2_words_cut,
    "chi2_words_3class": chi2_words_3class,
    "chi2_bigrams": chi2_bigrams,
    "feature_union": feature_union,
    "clean_spacing": _per_document(tx.clean_spacing),
    "clean_strict": _per_document(tx.clean_strict),
    "squeeze_letters": _per_document(tx.squeeze_letters),
    "page_cleaning": page_cleaning,
    "token_presence": token_presence,
    "vocab_presence": vocab_presence,
    "stopword_removal": stopword_removal,
    "polarity_label": polarity_label,
    "sign_label": sign_label,
    "topic_filter": topic_filter,
    "gated_label": gated_label,
    "split_nested": split_nested,
    "split_nested_users": split_nested_users,
    "missing_refs": missing_refs,
    "first_per_user": first_per_user,
    "new_users": new_users,
    "new_rows": new_rows,
    "insert_ignore": insert_ignore,
    "upsert_partial": _upsert_orders(None),
    "upsert_partial_shuffled": _upsert_orders(0),
    "upsert_full": upsert_full,
    "duplicate_keys": duplicate_keys,
    "orphan_rows": orphan_rows,
    "orphan_keys": orphan_keys,
    "surrogate_ids": surrogate_ids,
    "latest_id": latest_id,
    "ids_since": ids_since,
    "stratified_split": stratified_split,
    "split_counts": split_counts,
    "write_counts": write_counts,
    "presence_nb_predict": presence_nb_predict,
    "nb_informative": nb_informative,
    "multinomial_nb_predict": multinomial_nb_predict,
    "confusion": confusion,
    "accuracy": accuracy,
    "class_prf": class_prf,
    "class_report": class_report,
    "idf": idf,
    "tfidf": tfidf_rows,
    "lang_predict": lang_predict,
    "lang_filter": lang_filter,
    "lexicon_label": lexicon_label,
    "cleaned_sentiment": cleaned_sentiment,
    "sentiment_columns": sentiment_columns,
    "sentiments_stored": sentiments_stored,
    "logreg_predict": logreg_predict,
    "logreg_report": logreg_report,
    "logreg_optimum": logreg_optimum,
    "linear_extremes": linear_extremes,
    "linear_svc_predict": linear_svc_predict,
    "sgd_predict": sgd_predict,
    "grid_search": grid_search,
    "json_round_trip": json_round_trip,
    "csv_round_trip": csv_round_trip,
    "csv_export": csv_export,
    "stream_upsert": stream_upsert,
    "stream_users_once": stream_users_once,
    "collect_batch": collect_batch,
    "stored_ids": stored_ids,
    "capped_intake": capped_intake,
    "first_users_stream": first_users_stream,
    "sentiments_checked": sentiments_checked,
}
