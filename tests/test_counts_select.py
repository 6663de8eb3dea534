import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wrenlight.functions import text as tx
from wrenlight.functions.labels import gated, map_label, sign_label
from wrenlight.functions.scoring import chi_square
from wrenlight.operators import counts, lookup, select, stopwords
from wrenlight.plans import classify
from wrenlight.sources.scratch import stored


def docs(spark):
    rows = [(1, 4, "Good good day"), (2, 0, "bad day"), (3, 2, "day"), (4, 7, "odd @x")]
    return spark.createDataFrame(rows, "id long, polarity int, text string")


def chi(n_ii, n_ix, n_xi, n_xx):
    n_io, n_oi = n_ix - n_ii, n_xi - n_ii
    n_oo = n_xx - n_ii - n_io - n_oi
    bottom = (n_ii + n_io) * (n_ii + n_oi) * (n_io + n_oo) * (n_oi + n_oo)
    return n_xx * (n_ii * n_oo - n_io * n_oi) ** 2 / bottom if bottom else 0.0


def test_word_counts_and_labels(spark):
    label = map_label("polarity", {4: "pos", 2: "neutral"}, "neg")
    tokens = tx.tokenize("text", strip_handles=True)
    table = counts.word_counts(docs(spark), tokens, label, classify.THREE)
    found = {r["token"]: tuple(r)[1:] for r in table.collect()}
    assert found == {"good": (2, 2, 0, 0), "day": (3, 1, 1, 1), "bad": (1, 0, 0, 1), "odd": (1, 0, 0, 1)}
    assert tuple(counts.label_totals(table, classify.THREE).first()) == (7, 3, 1, 3)


def test_three_class_scores(spark):
    scores = {r["token"]: r["score"] for r in classify.three_class_scores(docs(spark)).collect()}
    expected = chi(1, 3, 3, 7) + chi(1, 3, 2, 7) + chi(1, 3, 3, 7)
    assert scores["day"] == round(expected, 6)


def test_chi_square_edges(spark):
    big = 10**9
    rows = [(0, 5, 5, 10), (5, 5, 5, 5), (3 * big, 4 * big, 5 * big, 20 * big), (1, 1, 0, 1)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    found = [r[0] for r in df.select(chi_square(*map(F.col, "abcd"))).collect()]
    for value, row in zip(found, rows):
        assert abs(value - chi(*row)) <= 1e-9 * max(1.0, abs(chi(*row)))


def test_two_class_scores_are_symmetric(spark):
    swapped = docs(spark).withColumn("polarity", F.when(F.col("polarity") == 0, 4).otherwise(0))
    first = {r["token"]: r["score"] for r in classify.two_class_scores(docs(spark)).collect()}
    second = {r["token"]: r["score"] for r in classify.two_class_scores(swapped).collect()}
    assert first == second


def test_bigrams_stay_inside_documents(spark):
    table = counts.bigram_counts(docs(spark), tx.tokenize("text"))
    found = {(r["w1"], r["w2"]): r["n"] for r in table.collect()}
    assert found == {("Good", "good"): 1, ("good", "day"): 1, ("bad", "day"): 1, ("odd", "@x"): 1}


def test_bigram_scores_against_brute_force(spark, folder):
    texts = spark.read.parquet(f"{folder}/benchmark.parquet")
    tokens = [r[0] for r in texts.select(tx.tokenize("text")).collect()]
    single = Counter(t for row in tokens for t in row)
    pairs = Counter(p for row in tokens for p in zip(row, row[1:]))
    total = sum(single.values())
    scored = sorted(
        ((-round(chi(n, single[a], single[b], total), 6), a, b) for (a, b), n in pairs.items())
    )[:50]
    best = select.best_bigrams(classify.bigram_scores(texts), 50).collect()
    assert [(r["w1"], r["w2"]) for r in best] == [(a, b) for _, a, b in scored]


LONG = "long" * 100


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_ways_are_equal(spark, how):
    """One token is hot in the rows and rare in the table, one hot and long, one not there."""
    tokens = ["hot"] * 3000 + [LONG] * 3000 + ["absent"] * 3000 + [None] * 20
    tokens += [f"t{i % 700}" for i in range(2800)]
    rows = spark.createDataFrame(list(enumerate(tokens)), "id int, token string").repartition(3)
    table = [("hot", 1), (LONG, 7)] + [(f"t{i}", 10_000) for i in range(0, 700, 2)]
    table = stored(spark.createDataFrame(table, "token string, n long"), "lookup")
    whole = lookup.lookup(rows, table, how=how).select("id", "token", "n")
    cut = lookup.lookup(rows, table, max_rows=0, how=how).select("id", "token", "n")
    found = Counter(map(tuple, cut.collect()))
    assert found == Counter(map(tuple, whole.collect()))
    assert sum(found.values()) == (7400 if how == "inner" else len(tokens))


def test_hot_tokens_are_found_in_the_rows(spark):
    tokens = ["the"] * 500 + [f"t{i}" for i in range(5000)] + [None] * 9
    rows = spark.createDataFrame([(t,) for t in tokens], "token string").repartition(5)
    assert [r[0] for r in lookup.hot_tokens(rows).collect()] == ["the"]
    assert lookup.hot_tokens(rows.limit(0)).count() == 0


def test_large_lookup_cuts_texts_once(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(50)], "id long, text string")
    rows = docs.select("id", F.explode(tx.tokenize("text")).alias("token"))
    table = stored(rows.groupBy("token").agg(F.count("*").alias("n")), "table")
    plan = lookup.lookup(rows, table, max_rows=0)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("buckets", [2, 7, 2048])
def test_highest_by_histogram(spark, monkeypatch, buckets):
    monkeypatch.setattr(select, "SORTED_ROWS", 0)
    monkeypatch.setattr(select, "BUCKETS", buckets)
    draw = random.Random(buckets)
    values = [draw.choice([0.0, 0.0, 1e-6, 2.5, draw.random(), 10 ** draw.randrange(12) / 7]) for _ in range(500)]
    rows = [(f"w{i:03}", v) for i, v in enumerate(values)]
    scores = spark.createDataFrame(rows, "token string, score double").repartition(4)
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (1, 3, 40, 250, 499, 500, 900):
        best = select.highest(scores, k, "score", ["token"]).collect()
        assert sorted(map(tuple, best)) == sorted(ordered[:k])
    assert select.highest(scores.limit(0), 5, "score", ["token"]).count() == 0


def test_large_selection_has_no_single_task(spark):
    scores = spark.range(5000).select(
        F.col("id").cast("string").alias("token"), (F.col("id") % 900).cast("double").alias("score")
    )
    best = select.best_words(scores, 2000)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan and best.count() == 2000


def test_feature_union_and_stopwords(spark):
    words = spark.createDataFrame([("a",)], "token string")
    pairs = spark.createDataFrame([("b", "c")], "w1 string, w2 string")
    union = select.feature_union(words, pairs)
    assert sorted(r[0] for r in union.collect()) == ["a", "b c"]
    listed = stopwords.plain_stopwords(spark.createDataFrame([("don't",), ("the",)], "word string"))
    text = spark.createDataFrame([("The cat dont  sit the cat ",), ("",)], "text string")
    kept = [r["kept"] for r in stopwords.remove_stopwords(text, listed).collect()]
    assert kept == ["The cat sit cat", ""]


def test_label_functions(spark):
    rows = spark.createDataFrame([(4, 0.5), (0, -1.0), (9, 0.0)], "p int, s double")
    found = rows.select(
        map_label("p"), sign_label("s"), gated(sign_label("s"), F.col("p") > 3)
    ).collect()
    assert [tuple(r) for r in found] == [
        ("pos", "pos", "pos"), ("neg", "neg", "none"), (None, "neutral", "neutral"),
    ]
