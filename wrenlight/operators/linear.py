"""Linear text classifiers: counts or TF-IDF of word n-grams.

Most terms occur in one text alone. Under a squared penalty their coefficients are
in proportion to their values in that text, so together they act as one column, whose value
is the root of the sum of their squares. After the fit the text's coefficient is dealt to its
own terms. The model is the same as with a column for every term.

A fitted model is a table of terms; scoring is a join. The penalized models are fitted by
``columns``, with a number for each row on the driver; the descent has its weights there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby, pairwise, product
from math import log
from operator import itemgetter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenlight.functions.text import term_counts, terms
from wrenlight.operators.columns import (
    CHUNK,
    SUMS_SCHEMA,
    Fit,
    TermColumns,
    added,
    descend,
    hinge_loss,
    logistic_loss,
    sent_sums,
    term_columns,
)
from wrenlight.operators.lookup import lookup
from wrenlight.operators.ranking import with_rank
from wrenlight.operators.tfidf import inverse_frequency
from wrenlight.session import ship_package
from wrenlight.sources.scratch import scratch_path, stored, stored_observed

# Solver settings of the three models and the parameter grid.
LOGISTIC_ITERATIONS = 100
INVERSE_STRENGTH = 1.0
HINGE_ALPHA = 1e-3
HINGE_ITERATIONS = 100
GRID_NGRAMS = ((1, 1), (1, 2))
GRID_ALPHA = (1e-2, 1e-3)
FOLDS = 3
TOLERANCE = 1e-6
SEED = 42
SGD_PASSES = 5
INTERCEPT_RATE = 0.01
EXTREMES = 20

# Blocks of rows that descend side by side.
SGD_BLOCKS = 4


@dataclass
class LinearTextModel:
    """A fitted model with its two labels, ``labels[1]`` being class 1.

    ``terms`` is a stored table ``term, idf, coef``; ``idf`` is null for a model of
    plain counts, and the values of one with idf are scaled to length 1.
    """

    terms: DataFrame
    intercept: float
    labels: tuple[str, str]
    ngram_range: tuple[int, int]

    def margins(self, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
        """``(key, margin)`` for every row; unknown terms count for nothing.

        ``key`` should be unique: rows of one key are one text.
        """
        counted = docs.select(key, F.inline(term_counts(terms(text, self.ngram_range))))
        met = lookup(counted, self.terms, "term")
        value = F.col("tf") * F.coalesce("idf", F.lit(1.0))
        length = F.when(F.col("idf").isNotNull(), value * value)
        hits = met.select(key, (value * F.col("coef")).alias("sum"), length.alias("square"))
        none = F.lit(0.0)
        every = docs.select(key, none.alias("sum"), F.lit(None).cast("double").alias("square"))
        summed = hits.unionByName(every).groupBy(key).agg(
            F.sum("sum").alias("sum"), F.sqrt(F.sum("square")).alias("length")
        )
        margin = F.col("sum") / F.coalesce("length", F.lit(1.0)) + F.lit(self.intercept)
        return summed.select(key, margin.alias("margin"))

    def predict(self, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
        chosen = F.when(F.col("margin") > 0, self.labels[1]).otherwise(self.labels[0])
        return self.margins(docs, key, text).select(key, chosen.alias("prediction"))

    def coefficients(self) -> DataFrame:
        """``(term, coef)``."""
        return self.terms.select("term", "coef")

    def extremes(self, n: int = EXTREMES) -> DataFrame:
        """The ``n`` lowest and ``n`` highest coefficients, paired by place."""
        found = []
        for order in (F.asc, F.desc):
            # Few rows: each task keeps its own n.
            rows = self.coefficients().orderBy(order("coef"), order("term")).limit(n).collect()
            found.append([(r["term"], r["coef"]) for r in rows])
        rows = [(i, *low, *high) for i, (low, high) in enumerate(zip(*found, strict=True), 1)]
        return self.terms.sparkSession.createDataFrame(
            rows, "place int, low_term string, low_coef double, high_term string, high_coef double"
        )


def training_rows(
    docs: DataFrame,
    key: str,
    label: Column,
    labels: tuple[str, str],
    text: str = "text",
    fit_rows: int | None = None,
) -> tuple[DataFrame, int]:
    """Stored ``row, key, label, text`` of all rows with one of the labels, and their number.

    Rows are numbered from 0 and counted while they are written. Only a caller that gives
    ``fit_rows`` has more than so many thinned, by a hash of the key; no model here does.
    """
    chosen = docs.where(label.isin(list(labels))).select(
        F.col(key).alias("key"),
        F.col(text).alias("text"),
        (label == labels[1]).cast("double").alias("label"),
    )
    if fit_rows is not None:
        chosen, seen = stored_observed(chosen, "linear-chosen")
        share = fit_rows / max(1, seen["rows"])
        if share < 1:
            chosen = chosen.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows, seen = stored_observed(with_rank(chosen, [], ["key"], "row"), "linear-rows")
    return rows, seen["rows"]


@dataclass
class Features:
    """The features of training rows and the way back from columns to terms."""

    path: str  # the rows in LIBSVM form
    columns: int
    rows: int
    shared: DataFrame  # term, slot, idf
    alone: DataFrame  # row, term, value, whole: a text's own terms and their root of squares
    single_idf: float | None

    def read(self) -> DataFrame:
        """``label, features``, the label as it was given."""
        reader = self.shared.sparkSession.read.format("libsvm")
        return reader.option("numFeatures", str(self.columns)).load(self.path)

    def by_term(self, weights: np.ndarray) -> DataFrame:
        """Stored ``term, idf, coef`` of all terms, by a weight for each column."""
        spark = self.shared.sparkSession
        ship_package(spark)
        sent = spark.sparkContext.broadcast(weights)
        weighed = _weighed(sent)
        slot = F.col("row") + F.lit(self.columns - self.rows)
        own = self.alone.select(
            "term",
            F.lit(self.single_idf).cast("double").alias("idf"),
            slot.alias("slot"),
            (F.col("value") / F.col("whole")).alias("share"),
        )
        columns = self.shared.select("term", "idf", "slot", F.lit(1.0).alias("share")).unionByName(own)
        model = stored(columns.mapInArrow(weighed, "term string, idf double, coef double"), "linear-model")
        sent.destroy()
        return model


def _weighed(sent):
    """Task: the coefficients of terms, each its share of its column's weight."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            coef = sent.value[batch.column("slot").to_numpy()] * batch.column("share").to_numpy()
            yield pa.RecordBatch.from_pydict(
                {"term": batch.column("term"), "idf": batch.column("idf"), "coef": pa.array(coef)}
            )

    return run


def term_features(
    rows: DataFrame,
    total: int,
    ngram_range: tuple[int, int],
    weighted: bool,
    label: Column | str = "label",
) -> Features:
    """Counts of n-grams of ``row, text``, or their TF-IDF scaled to length 1, by columns.

    Columns are the terms of several rows, in order, then one for each of the ``total`` rows.
    """
    kept = rows.select("row", (F.col(label) if isinstance(label, str) else label).alias("label"))
    counted = stored(
        rows.select("row", F.inline(term_counts(terms("text", ngram_range)))), "linear-terms"
    )
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    none = F.lit(None).cast("double")
    idf = inverse_frequency(F.lit(total), F.col("df")) if weighted else none
    ranked = with_rank(df, [], ["term"], "slot").select("term", "slot", idf.alias("idf"))
    shared, seen = stored_observed(ranked, "linear-shared")
    size = seen["rows"]
    # The idf of a term of one text.
    single = log((1 + total) / 2) + 1 if weighted else None
    value = F.col("tf") * F.coalesce("idf", F.lit(single if weighted else 1.0))
    met = stored(
        lookup(counted, shared, "term", how="left", is_stored=True).select(
            "row", "slot", F.when(F.col("slot").isNull(), F.col("term")).alias("term"), value.alias("value")
        ),
        "linear-values",
    )
    square = F.col("value") * F.col("value")
    inside = F.struct("slot", "value")
    by_row = met.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("slot").isNotNull(), inside))).alias("entries"),
        F.sqrt(F.sum(F.when(F.col("slot").isNull(), square))).alias("whole"),
        F.sqrt(F.sum(square)).alias("length"),
    )
    by_row = stored(by_row, "linear-by-row")
    scale = F.col("length") if weighted else F.lit(1.0)

    def entry(slot: Column, amount: Column) -> Column:
        return F.concat_ws(":", (slot + 1).cast("string"), (amount / scale).cast("string"))

    own = F.when(F.col("whole").isNotNull(), entry(F.col("row") + size, F.col("whole")))
    line = F.concat_ws(
        " ",
        F.col("label").cast("string"),
        F.transform("entries", lambda e: entry(e["slot"], e["value"])),
        own,
    )
    path = scratch_path(rows.sparkSession, "features")
    kept.join(by_row, "row", "left").select(line.alias("value")).write.text(path)
    alone = met.where("slot IS NULL").select("row", "term", "value")
    whole = by_row.where("whole IS NOT NULL").select("row", "whole")
    return Features(path, size + total, total, shared, alone.join(whole, "row"), single)


def fit_tfidf_logistic(
    docs: DataFrame,
    key: str,
    label: Column,
    labels: tuple[str, str] = ("neg", "pos"),
    ngram_range: tuple[int, int] = (1, 2),
    text: str = "text",
    iterations: int = LOGISTIC_ITERATIONS,
    tolerance: float = TOLERANCE,
) -> LinearTextModel:
    """Unit-length TF-IDF of word n-grams and L2 logistic regression.

    The objective is the mean loss, so the penalty of a summed loss with
    strength ``C`` is ``1 / (C n)``.
    """
    rows, total = training_rows(docs, key, label, labels, text)
    columns = term_columns(rows, total, ngram_range, weighted=True)
    ones = columns.labels.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = float(np.log(ones / (total - ones))) if total else 0.0
    logistic = Fit(
        logistic_loss,
        columns.labels,
        1.0 / (INVERSE_STRENGTH * max(1, total)),
        iterations,
        tolerance,
        start=odds,
    )
    descend(columns, [logistic])
    return _fitted(columns, logistic, labels, ngram_range)


def largest_gradient(
    model: LinearTextModel, docs: DataFrame, key: str, label: Column, text: str = "text"
) -> DataFrame:
    """One row: training rows, terms, and how far the logistic ``model`` is from its optimum.

    ``gradient`` is the largest entry, by size, of the gradient of the mean loss and the
    penalty, over all terms and the intercept; it is 0 at the optimum alone, whatever
    found it. Worked out from the texts and the table of terms by joins.
    """
    known = docs.where(label.isin(list(model.labels)))
    error = known.select(
        key, (label == model.labels[1]).cast("double").alias("truth")
    ).join(model.margins(known, key, text), key)
    error = stored(
        error.select(key, (1 / (1 + F.exp(-F.col("margin"))) - F.col("truth")).alias("error")), "errors"
    )
    counted = known.select(key, F.inline(term_counts(terms(text, model.ngram_range))))
    met = stored(
        lookup(counted, model.terms, "term").select(
            key, "term", "coef", (F.col("tf") * F.col("idf")).alias("value")
        ),
        "gradient-values",
    )
    square = F.col("value") * F.col("value")
    length = met.groupBy(key).agg(F.sqrt(F.sum(square)).alias("length"))
    of_row = error.join(length, key).select(key, (F.col("error") / F.col("length")).alias("error"))
    slope = met.join(of_row, key).groupBy("term").agg(
        (F.sum(F.col("value") * F.col("error")) + F.first("coef")).alias("slope")
    )
    at_terms = slope.agg(F.count(F.lit(1)).alias("terms"), F.max(F.abs("slope")).alias("slope"))
    at_rows = error.agg(F.count(F.lit(1)).alias("rows"), F.abs(F.sum("error")).alias("offset"))
    return at_rows.crossJoin(at_terms).select(
        "rows", "terms", (F.greatest("slope", "offset") / F.col("rows")).alias("gradient")
    )


def _fitted(columns: TermColumns, fit: Fit, labels, ngram_range) -> LinearTextModel:
    return LinearTextModel(columns.model(fit.at.numbers), fit.at.intercept, labels, ngram_range)


def _hinge(columns: TermColumns, alpha: float, used: np.ndarray | None = None) -> Fit:
    return Fit(hinge_loss, columns.labels, alpha, HINGE_ITERATIONS, TOLERANCE, used)


def fit_linear_svc(
    docs: DataFrame,
    key: str,
    label: Column,
    labels: tuple[str, str] = ("neg", "pos"),
    ngram_range: tuple[int, int] = (1, 2),
    alpha: float = HINGE_ALPHA,
    text: str = "text",
) -> LinearTextModel:
    """Counts of word n-grams and a linear classifier with hinge loss and L2 penalty."""
    rows, total = training_rows(docs, key, label, labels, text)
    columns = term_columns(rows, total, ngram_range, weighted=False)
    hinge = _hinge(columns, alpha)
    descend(columns, [hinge])
    return _fitted(columns, hinge, labels, ngram_range)


def sgd_pass(
    rows: Iterable[tuple[float, np.ndarray, np.ndarray]],
    weights: np.ndarray,
    intercept: float,
    alpha: float,
    done: int,
) -> tuple[np.ndarray, float, float]:
    """One pass of stochastic gradient descent on the hinge loss over ``sign, slots, values``.

    The step falls as ``1 / (alpha (t0 + t))``, ``t`` being the rows seen so far; ``t0`` makes the
    first step as long as typical weights. Returns weights less their common scale, that
    scale, and the intercept.
    """
    typical = alpha**-0.25
    offset = 1.0 / (typical * alpha)
    weights, scale = weights.copy(), 1.0
    for t, (sign, slots, values) in enumerate(rows, done):
        step = 1.0 / (alpha * (offset + t))
        margin = sign * (scale * float(values @ weights[slots]) + intercept)
        scale *= 1.0 - step * alpha
        if margin < 1.0:
            weights[slots] += step * sign / scale * values
            intercept += step * sign * INTERCEPT_RATE
    return weights, scale, intercept


def _listed(batches) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
    """``block, sign, slots, values`` of rows, one after the other, as arrays over the batch."""
    for batch in batches:
        blocks, signs = (batch.column(c).to_pylist() for c in ("block", "sign"))
        lists = [batch.column(c) for c in ("slots", "values")]
        bounds = lists[0].offsets.to_numpy()
        slots, values = (x.values.to_numpy() for x in lists)
        for i, (start, end) in enumerate(pairwise(bounds)):
            yield blocks[i], signs[i], slots[start:end], values[start:end]


def _descend(sent, alpha: float, number: int, sizes: dict[int, int]):
    """Task: the passes of its blocks from the weights that were sent, added up.

    Rows come block by block in the order of the pass and are let go one batch after the other.
    The last place holds the intercepts and the number of blocks.
    """

    def run(batches):
        start, offset = sent.value
        places = -(-len(start) // CHUNK)
        total, ends = np.zeros(0), np.zeros(2)
        for block, rows in groupby(_listed(batches), key=itemgetter(0)):
            entries = (row[1:] for row in rows)
            found, scale, shift = sgd_pass(entries, start, offset, alpha, number * sizes[block])
            found *= scale
            total = total + found if len(total) else found
            ends += [shift, 1.0]
        if ends[1]:
            task = TaskContext.get().partitionId()
            yield from sent_sums(total, task)
            yield from sent_sums(ends, task, places)

    return run


def fit_sgd(
    docs: DataFrame,
    key: str,
    label: Column,
    labels: tuple[str, str] = ("neg", "pos"),
    ngram_range: tuple[int, int] = (1, 2),
    alpha: float = HINGE_ALPHA,
    passes: int = SGD_PASSES,
    seed: int = SEED,
    blocks: int = SGD_BLOCKS,
    text: str = "text",
) -> LinearTextModel:
    """Counts of n-grams and a hinge model by ``passes`` of stochastic gradient descent.

    The rows, numbered by key, are dealt to ``blocks`` by a hash of number and seed. In each pass every block goes
    through its rows in an order drawn anew, from the same weights, and the blocks' weights
    are averaged; with one block it is plain descent. The number of blocks, not that of
    tasks, decides the result, so reruns agree. Terms of one text alone move
    together, so their common column changes nothing here either.

    A task holds the weights and one batch of rows, which Spark has sorted; the blocks' weights
    are added up by tasks.
    """
    rows, total = training_rows(docs, key, label, labels, text)
    # The files hold one value beside the features, so it says the row too.
    named = F.concat_ws(":", "row", (2 * F.col("label") - 1).cast("int"))
    features = term_features(rows, total, ngram_range, weighted=False, label=named)
    spark = docs.sparkSession
    ship_package(spark)
    words = F.split("value", " ")
    head = F.get(words, 0)
    name = F.substring_index(head, ":", 1)
    entries = F.filter(F.slice(words, 2, F.size(words)), lambda e: e != "")
    lines = spark.read.text(features.path).select(
        name.alias("name"),
        F.substring_index(head, ":", -1).cast("double").alias("sign"),
        F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(blocks)).cast("int").alias("block"),
        F.transform(
            entries, lambda e: F.substring_index(e, ":", 1).cast("int") - 1
        ).alias("slots"),
        F.transform(
            entries, lambda e: F.substring_index(e, ":", -1).cast("double")
        ).alias("values"),
    )
    lines = stored(lines, "sgd-rows")
    sizes = {r["block"]: r["count"] for r in lines.groupBy("block").count().collect()}
    weights, intercept = np.zeros(features.columns), 0.0
    for number in range(passes if sizes else 0):
        order = F.xxhash64("name", F.lit(seed), F.lit(number))
        sent = spark.sparkContext.broadcast((weights, intercept))
        dealt = lines.withColumn("order", order).repartition(blocks, "block")
        ordered = dealt.sortWithinPartitions("block", "order").drop("order", "name")
        found = added(ordered.mapInArrow(_descend(sent, alpha, number, sizes), SUMS_SCHEMA))
        sent.destroy()
        shift, used = found.pop(max(found))
        intercept = float(shift / used)
        weights = np.concatenate([found[place] for place in sorted(found)]) / used
    return LinearTextModel(features.by_term(weights), intercept, labels, ngram_range)


def grid_search(
    docs: DataFrame,
    key: str,
    label: Column,
    labels: tuple[str, str] = ("neg", "pos"),
    text: str = "text",
    folds: int = FOLDS,
    ngrams: Sequence[tuple[int, int]] = GRID_NGRAMS,
    alphas: Sequence[float] = GRID_ALPHA,
) -> tuple[LinearTextModel, DataFrame]:
    """Cross-validated choice of n-gram range and penalty for the hinge model.

    Returns the best model and ``(ngram_high, alpha, accuracy)`` per setting.

    All fits of an n-gram range share its columns, made once from all rows, and each pass over
    them: a row that is held out has no slope, so terms that a fold's training rows lack keep the
    coefficient 0. The margins of the rows held out are known when a fit ends. Folds are drawn by
    a hash of the key.
    """
    rows, total = training_rows(docs, key, label, labels, text)
    fold = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(folds)).cast("int")
    told = rows.select("row", fold.alias("fold")).toArrow()
    held = np.zeros(total, np.int32)
    held[told.column("row").to_numpy()] = told.column("fold").to_numpy()
    made, means = {}, {}
    for ngram_range in ngrams:
        columns = made[ngram_range] = term_columns(rows, total, ngram_range, False)
        fits = [_hinge(columns, alpha, held != k) for alpha, k in product(alphas, range(folds))]
        descend(columns, fits)
        for i, alpha in enumerate(alphas):
            reached = []
            for k, fit in enumerate(fits[i * folds : (i + 1) * folds]):
                above = fit.at.product + fit.at.intercept > 0
                hits = (above == (columns.labels > 0))[held == k]
                reached += [float(hits.mean())] if len(hits) else []
            means[ngram_range, alpha] = sum(reached) / len(reached) if reached else 0.0
    pairs = list(product(ngrams, alphas))
    ngram_range, alpha = max(pairs, key=means.__getitem__)
    columns = made[ngram_range]
    chosen = _hinge(columns, alpha)
    descend(columns, [chosen])
    settings = [(n[1], alpha, means[n, alpha]) for n, alpha in pairs]
    return _fitted(columns, chosen, labels, ngram_range), docs.sparkSession.createDataFrame(
        settings, "ngram_high int, alpha double, accuracy double"
    )
