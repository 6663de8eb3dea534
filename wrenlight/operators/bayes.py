"""Naive Bayes over token counts: the fitted model is a table, scoring is a join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenlight.functions.scoring import SCORE_DIGITS, best_label
from wrenlight.functions.text import letter_trigrams
from wrenlight.operators.lookup import in_vocabulary, lookup
from wrenlight.sources.scratch import BROADCAST_ROWS, stored

# Additive smoothing of the two estimators.
EXPECTED_LIKELIHOOD = 0.5
ADD_ONE = 1.0
# Distinct labels a model may have, unless told otherwise; more is taken for a mistake
# in the label column.
MAX_CLASSES = 500


def class_sizes(
    docs: DataFrame,
    label: Column,
    classes: Sequence[str] | None = None,
    max_classes: int = MAX_CLASSES,
) -> dict[str, int]:
    """Rows per label, for the labels that occur; one small row per class is collected."""
    rows = docs.select(label.alias("label")).where(F.col("label").isNotNull())
    if classes is not None:
        rows = rows.where(F.col("label").isin(list(classes)))
    counted = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(max_classes + 1)
    sizes = {row["label"]: row["n"] for row in counted.collect()}
    if len(sizes) > max_classes:
        raise ValueError(f"more than {max_classes} labels")
    return dict(sorted(sizes.items()))


@dataclass
class TokenBayes:
    """A fitted model: stored counts per token, and formulas over them.

    ``counts`` holds ``token, n, n_<i>`` with ``i`` the place of the class in
    ``classes``; ``log_likelihood`` gives each class's ``log P(token | class)``.
    """

    counts: DataFrame
    classes: list[str]
    log_prior: dict[str, float]
    log_likelihood: dict[str, Column]
    ties: str = "last"
    likelihood: dict[str, dict[bool, Column]] = field(default_factory=dict)

    def predict(
        self, docs: DataFrame, key: str, tokens: Column, max_rows: int = BROADCAST_ROWS
    ) -> DataFrame:
        """``(key, prediction)`` for every row; unknown tokens are skipped.

        The sums are combined per document inside the scan task when the model
        is broadcast. A document without known tokens gets the prior's label.
        ``key`` should be unique: rows of one key, null included, are one document.
        """
        weights = {name: f"w_{i}" for i, name in enumerate(self.classes)}
        table = self.counts.select(
            "token", *[self.log_likelihood[c].alias(w) for c, w in weights.items()]
        )
        rows = docs.select(key, F.explode(tokens).alias("token"))
        hits = lookup(rows, table, max_rows=max_rows).select(key, *weights.values())
        every = docs.select(key, *[F.lit(0.0).alias(w) for w in weights.values()])
        scores = hits.unionByName(every).groupBy(key).agg(
            *[F.sum(w).alias(w) for w in weights.values()]
        )
        totals = {c: F.col(w) + F.lit(self.log_prior[c]) for c, w in weights.items()}
        return scores.select(key, best_label(totals, self.ties).alias("prediction"))

    def informative(self, k: int = 10) -> DataFrame:
        """Features by the ratio of their highest to lowest class probability.

        A feature is a token with its presence or absence, and only the classes
        in which that was seen in training count.
        """
        features = [
            F.struct(
                F.lit(present).alias("present"),
                F.filter(
                    F.array(
                        *[
                            F.struct(
                                self.likelihood[c][present].alias("p"), F.lit(c).alias("label")
                            )
                            for c in self.classes
                        ]
                    ),
                    lambda entry: entry["p"].isNotNull(),
                ).alias("seen"),
            )
            for present in (True, False)
        ]
        rows = self.counts.select("token", F.inline(F.array(*features)))
        high, low = F.array_max("seen"), F.array_min("seen")
        return (
            rows.where(F.size("seen") > 0)
            .select(
                "token",
                "present",
                high["label"].alias("high_label"),
                low["label"].alias("low_label"),
                F.round(high["p"] / low["p"], SCORE_DIGITS).alias("ratio"),
            )
            .orderBy(F.desc("ratio"), F.asc("token"), F.desc("present"))
            .limit(k)
        )


def _counts(rows: DataFrame, classes: Sequence[str], weight: str | None = None) -> DataFrame:
    """``token, n, n_<i>`` of ``(label, token)`` rows, or of weighted ones."""
    amount = F.lit(1).cast("long") if weight is None else F.col(weight)
    return rows.groupBy("token").agg(
        F.sum(amount).alias("n"),
        *[
            F.sum(F.when(F.col("label") == name, amount).otherwise(F.lit(0))).alias(f"n_{i}")
            for i, name in enumerate(classes)
        ],
    )


def fit_presence(
    docs: DataFrame,
    label: Column,
    tokens: Column,
    classes: Sequence[str] | None = None,
    vocabulary: DataFrame | None = None,
) -> TokenBayes:
    """Presence-only naive Bayes with expected-likelihood estimates.

    Absent tokens do not score, unlike in a Bernoulli model. With a
    ``vocabulary`` (a stored table with distinct ``token``) only its tokens are
    features.
    """
    sizes = class_sizes(docs, label, classes)
    names, total = list(sizes), sum(sizes.values())
    rows = docs.select(label.alias("label"), F.explode(F.array_distinct(tokens)).alias("token"))
    rows = rows.where(F.col("label").isin(names))
    if vocabulary is not None:
        rows = in_vocabulary(rows, vocabulary)
    counts = stored(_counts(rows, names), "presence")

    bins = F.when(F.col("n") == F.lit(total), F.lit(1.0)).otherwise(F.lit(2.0))
    probability = {
        name: {
            True: (F.col(f"n_{i}") + EXPECTED_LIKELIHOOD)
            / (F.lit(float(sizes[name])) + EXPECTED_LIKELIHOOD * bins),
            False: (sizes[name] - F.col(f"n_{i}") + EXPECTED_LIKELIHOOD)
            / (F.lit(float(sizes[name])) + EXPECTED_LIKELIHOOD * bins),
        }
        for i, name in enumerate(names)
    }
    seen = {
        name: {
            True: F.when(F.col(f"n_{i}") > 0, probability[name][True]),
            False: F.when(F.col(f"n_{i}") < sizes[name], probability[name][False]),
        }
        for i, name in enumerate(names)
    }
    return TokenBayes(
        counts=counts,
        classes=names,
        log_prior={
            name: log((n + EXPECTED_LIKELIHOOD) / (total + EXPECTED_LIKELIHOOD * len(names)))
            for name, n in sizes.items()
        },
        log_likelihood={name: F.log(probability[name][True]) for name in names},
        ties="last",
        likelihood=seen,
    )


def _multinomial(counts: DataFrame, sizes: Mapping[str, int]) -> TokenBayes:
    names, total = list(sizes), sum(sizes.values())
    row = counts.agg(
        F.count(F.lit(1)).alias("v"),
        *[F.coalesce(F.sum(f"n_{i}"), F.lit(0)).alias(f"n_{i}") for i in range(len(names))],
    ).first()
    return TokenBayes(
        counts=counts,
        classes=names,
        log_prior={name: log(n / total) for name, n in sizes.items()},
        log_likelihood={
            name: F.log(
                (F.col(f"n_{i}") + ADD_ONE) / F.lit(float(row[f"n_{i}"]) + ADD_ONE * row["v"])
            )
            for i, name in enumerate(names)
        },
        ties="first",
    )


def fit_multinomial(
    docs: DataFrame, label: Column, tokens: Column, classes: Sequence[str] | None = None
) -> TokenBayes:
    """Multinomial naive Bayes: add-one smoothing, unsmoothed class prior."""
    sizes = class_sizes(docs, label, classes)
    rows = docs.select(label.alias("label"), F.explode(tokens).alias("token"))
    rows = rows.where(F.col("label").isin(list(sizes)))
    return _multinomial(stored(_counts(rows, list(sizes)), "multinomial"), sizes)


def fit_language(docs: DataFrame, text: str = "text", lang: str = "lang") -> TokenBayes:
    """Language model: multinomial naive Bayes over letter trigrams.

    Words are counted per language first, so each distinct word is cut into
    trigrams once.
    """
    sizes = class_sizes(docs, F.col(lang))
    word = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))
    words = (
        docs.where(F.col(lang).isNotNull())
        .select(F.col(lang).alias("label"), F.explode(word).alias("word"))
        .groupBy("label", "word")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    grams = words.select("label", "uses", F.explode(letter_trigrams("word")).alias("token"))
    return _multinomial(stored(_counts(grams, list(sizes), "uses"), "language"), sizes)


def predict_language(
    model: TokenBayes, docs: DataFrame, key: str, text: str = "text"
) -> DataFrame:
    return model.predict(docs, key, letter_trigrams(text)).withColumnRenamed("prediction", "lang")


def keep_language(docs: DataFrame, languages: DataFrame, key: str, wanted: str) -> DataFrame:
    """Rows whose predicted language is the wanted one."""
    keys = languages.where(F.col("lang") == wanted).select(key)
    return docs.join(keys, key, "left_semi")
