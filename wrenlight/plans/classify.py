"""The classification jobs end to end: select words, train, evaluate, label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenlight.functions import labels as lb
from wrenlight.functions import text as tx
from wrenlight.operators import bayes, counts, lexicon, linear, metrics, ranking, select, shape
from wrenlight.sources.scratch import stored, stored_observed

THREE = ("pos", "neutral", "neg")
TWO = ("neg", "pos")


def three_class_scores(labelled: DataFrame, text: str = "text") -> DataFrame:
    """Word scores over positive, neutral and (every other code) negative texts."""
    counted = counts.word_counts(
        labelled,
        tx.tokenize(text, strip_handles=True),
        lb.map_label("polarity", lb.COUNTED_THREE, otherwise="neg"),
        THREE,
    )
    return select.score_words(counted, THREE, select.THREE_CLASS_EXTRA)


def two_class_scores(labelled: DataFrame, text: str = "text") -> DataFrame:
    """Word scores over code 0 and every other code."""
    classes = ("0", "4")
    counted = counts.word_counts(
        labelled, tx.tokenize(text), lb.map_label("polarity", lb.COUNTED_TWO, "4"), classes
    )
    return select.score_words(counted, classes)


def bigram_scores(docs: DataFrame, text: str = "text") -> DataFrame:
    tokens = tx.tokenize(text)
    words = stored(counts.word_counts(docs, tokens, lower=False), "words")
    # Stored, as a look-up in a large table reads its rows more than once.
    bigrams = stored(counts.bigram_counts(docs, tokens), "bigrams")
    return select.score_bigrams(bigrams, words)


def best_word_features(
    labelled: DataFrame, vocabulary: DataFrame, key: str, text: str = "text"
) -> DataFrame:
    """``(key, label, features)``: distinct tokens in the stored vocabulary, sorted.

    Tokens keep their case, as the vocabulary's are lower-cased a capitalised
    token is no feature. Texts of other codes are dropped.
    """
    named = labelled.withColumn("label", lb.map_label("polarity")).where("label IS NOT NULL")
    tokens = tx.presence(tx.tokenize(text, strip_handles=True))
    rows = named.select(key, F.explode(tokens).alias("token"))
    kept = bayes.in_vocabulary(rows, vocabulary).groupBy(key).agg(
        F.sort_array(F.collect_list("token")).alias("features")
    )
    empty = F.array().cast("array<string>")
    return named.select(key, "label").join(kept, key, "left").select(
        key, "label", F.coalesce("features", empty).alias("features")
    )


def selected_word_bayes(
    train: DataFrame, k: int = select.BEST_WORDS_THREE, text: str = "text"
) -> bayes.TokenBayes:
    """Presence naive Bayes over the ``k`` best words of the training texts."""
    vocabulary = stored(select.best_words(three_class_scores(train, text), k), "vocabulary")
    return bayes.fit_presence(
        train,
        lb.map_label("polarity"),
        tx.tokenize(text, strip_handles=True),
        THREE,
        vocabulary,
    )


def predict_sentiment(
    model: bayes.TokenBayes, docs: DataFrame, key: str, text: str = "text"
) -> DataFrame:
    return model.predict(docs, key, tx.presence(tx.tokenize(text, strip_handles=True)))


def evaluated(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """``(key, label, prediction)`` of the rows with a known label."""
    known = truth.select(key, lb.map_label("polarity").alias("label")).where("label IS NOT NULL")
    return known.join(predictions, key)


@dataclass
class Evaluation:
    """Everything the classification jobs print, as DataFrames."""

    sizes: DataFrame
    accuracy: DataFrame
    by_class: DataFrame
    report: DataFrame


def evaluation(rows: DataFrame, train_rows: int, test_rows: int) -> Evaluation:
    confusion = stored(metrics.confusion(rows), "confusion")
    sizes = rows.sparkSession.createDataFrame(
        [("train", train_rows), ("test", test_rows)], "part string, n long"
    )
    accuracy = confusion.agg(
        (
            F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
            / F.sum("n")
        ).alias("accuracy")
    )
    return Evaluation(
        sizes, accuracy, metrics.class_scores(confusion), metrics.class_report(confusion)
    )


def bayes_job(
    train: DataFrame, test: DataFrame, key: str = "tweet_id", k: int = select.BEST_WORDS_THREE
) -> tuple[bayes.TokenBayes, Evaluation]:
    """Select words, train on one table, evaluate on another."""
    model = selected_word_bayes(train, k)
    rows = evaluated(predict_sentiment(model, test, key), test, key)
    return model, evaluation(rows, train.count(), test.count())


def logistic_split(
    labelled: DataFrame, key: str = "tweet_id", clean_validation: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Training and non-neutral validation rows of the 60/20/20 split.

    Only the training text is cleaned, unless asked otherwise.
    """
    parts = ranking.positional_split(labelled, "polarity", [0, 4], key)
    train = parts.where("part = 'train'").withColumn("text", tx.clean_strict("text"))
    held_out = shape.non_neutral(parts.where("part = 'val'"))
    if clean_validation:
        held_out = held_out.withColumn("text", tx.clean_strict("text"))
    return train.drop("part"), held_out.drop("part")


def logistic_job(
    labelled: DataFrame, key: str = "tweet_id", n: int = linear.EXTREMES
) -> tuple[linear.LinearTextModel, Evaluation, DataFrame]:
    """Split, clean, fit TF-IDF logistic regression, evaluate, list extreme terms."""
    (train, seen), (held_out, held) = (
        stored_observed(part, "part") for part in logistic_split(labelled, key)
    )
    model = linear.fit_tfidf_logistic(train, key, lb.map_label("polarity"), TWO)
    rows = evaluated(model.predict(held_out, key), held_out, key)
    return model, evaluation(rows, seen["rows"], held["rows"]), model.extremes(n)


def evaluation_rows(found: Evaluation) -> DataFrame:
    """All that a classification job prints as rows ``measure, row, value``."""

    def listed(table: DataFrame, row: str, *names: str) -> DataFrame:
        pairs = [F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names]
        return table.select(F.col(row).alias("row"), F.inline(F.array(*pairs)))

    return (
        listed(found.sizes, "part", "n")
        .unionByName(listed(found.accuracy.withColumn("row", F.lit("all")), "row", "accuracy"))
        .unionByName(listed(found.report, "row", "precision", "recall", "f1", "support"))
    )


def sentiment_table(
    docs: DataFrame,
    key: str,
    model: bayes.TokenBayes,
    lexicons: Sequence[DataFrame],
    language: bayes.TokenBayes,
    pattern: str,
    wanted: str = "en",
    text: str = "text",
) -> DataFrame:
    """Three label columns per text; ``none`` off topic or in another language.

    The labels come from the naive Bayes model, the mean weight of the first
    lexicon and the compound weight of the second.
    """
    words = F.transform(tx.tokenize(text), lambda token: F.lower(token))
    on_topic = docs.select(key, text).where(shape.on_topic(text, pattern))
    languages = bayes.predict_language(language, on_topic, key, text)
    chosen = stored(bayes.keep_language(on_topic, languages, key, wanted), "chosen")
    by_bayes = predict_sentiment(model, chosen, key, text)
    mean = lexicon.lexicon_scores(chosen, key, words, lexicons[0], "mean")
    compound = lexicon.lexicon_scores(chosen, key, words, lexicons[1], "compound")
    labels = (
        by_bayes.withColumnRenamed("prediction", "sentiment_naivebayes")
        .join(mean.select(key, lb.sign_label("score").alias("sentiment_textblob")), key)
        .join(compound.select(key, lb.sign_label("score").alias("sentiment_vader")), key)
    )
    joined = shape.with_labels(docs.select(key, text), labels, key)
    keep: Column = F.col("sentiment_naivebayes").isNotNull()
    return joined.select(
        key,
        text,
        *[
            lb.gated(name, keep).alias(name)
            for name in ("sentiment_naivebayes", "sentiment_textblob", "sentiment_vader")
        ],
    )
