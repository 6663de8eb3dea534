import random
import re
from collections import Counter, defaultdict
from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from wrenlight.functions import text as tx
from wrenlight.functions.labels import map_label
from wrenlight.operators import bayes, lexicon, linear, metrics, tfidf
from wrenlight.plans import classify
from wrenlight.sources.scratch import stored

TRAIN = [
    (1, "pos", "good fine the"),
    (2, "pos", "good the"),
    (3, "neg", "bad the the"),
    (4, "neutral", "the plain bad"),
]


def words():
    return F.split("text", " ")


def train(spark):
    return spark.createDataFrame(TRAIN, "id long, label string, text string")


def presence_probability(token, label):
    rows = [(lab, set(text.split())) for _, lab, text in TRAIN]
    size = sum(lab == label for lab, _ in rows)
    seen = sum(lab == label and token in present for lab, present in rows)
    bins = 1 if all(token in present for _, present in rows) else 2
    return (seen + 0.5) / (size + 0.5 * bins), seen, size


def presence_label(text):
    known = {w for _, _, t in TRAIN for w in t.split()}
    sizes = Counter(lab for _, lab, _ in TRAIN)
    scores = {}
    for label, n in sizes.items():
        score = log((n + 0.5) / (len(TRAIN) + 0.5 * len(sizes)))
        for token in set(text.split()) & known:
            score += log(presence_probability(token, label)[0])
        scores[label] = round(score, 6)
    return max((score, label) for label, score in scores.items())[1]


def predictions(df):
    return {r[0]: r["prediction"] for r in df.collect()}


def test_presence_model(spark):
    model = bayes.fit_presence(train(spark), F.col("label"), words())
    texts = ["good", "bad bad", "the", "unknown words", "", "plain fine", "fine bad"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    expected = {i: presence_label(t) for i, t in enumerate(texts)}
    tokens = F.array_distinct(words())
    assert predictions(model.predict(rows, "id", tokens)) == expected
    assert predictions(model.predict(rows, "id", tokens, max_rows=2)) == expected


def test_presence_ties_go_to_the_last_label(spark):
    rows = spark.createDataFrame([(1, "neg", "a"), (2, "pos", "b")], train(spark).schema)
    model = bayes.fit_presence(rows, F.col("label"), words())
    nothing = spark.createDataFrame([(1, "zzz")], "id long, text string")
    assert predictions(model.predict(nothing, "id", words())) == {1: "pos"}


def test_informative(spark):
    model = bayes.fit_presence(train(spark), F.col("label"), words())
    found = {(r["token"], r["present"]): r["ratio"] for r in model.informative(100).collect()}
    labels = {lab for _, lab, _ in TRAIN}
    for token in {w for _, _, t in TRAIN for w in t.split()}:
        for present in (True, False):
            chances = []
            for label in labels:
                p, seen, size = presence_probability(token, label)
                if present and seen:
                    chances.append(p)
                if not present and size > seen:
                    bins = 1 if token == "the" else 2
                    chances.append((size - seen + 0.5) / (size + 0.5 * bins))
            if chances:
                assert found[token, present] == pytest.approx(max(chances) / min(chances), abs=2e-6)
            else:
                assert (token, present) not in found


def test_multinomial_model(spark):
    model = bayes.fit_multinomial(train(spark), F.col("label"), words(), ("neg", "pos"))
    rows = [(lab, t.split()) for _, lab, t in TRAIN if lab != "neutral"]
    counts = defaultdict(Counter)
    for label, tokens in rows:
        counts[label].update(tokens)
    known = set().union(*counts.values())
    texts = ["good bad bad", "the", "none", "fine fine bad"]
    expected = {}
    for i, text in enumerate(texts):
        scores = []
        for label in sorted(counts):
            size = sum(counts[label].values())
            score = log(sum(lab == label for lab, _ in rows) / len(rows))
            score += sum(
                log((counts[label][w] + 1) / (size + len(known))) for w in text.split() if w in known
            )
            scores.append((-round(score, 6), label))
        expected[i] = min(scores)[1]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert predictions(model.predict(docs, "id", words())) == expected


def test_language(spark):
    rows = [("the house and the dog", "en"), ("das haus und der hund", "de")]
    model = bayes.fit_language(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(1, "the dog"), (2, "der hund"), (3, "??")], "id long, text string")
    found = bayes.predict_language(model, docs, "id")
    assert {r["id"]: r["lang"] for r in found.collect()} == {1: "en", 2: "de", 3: "de"}
    assert [r["id"] for r in bayes.keep_language(docs, found, "id", "en").collect()] == [1]


def test_selected_word_bayes_and_case(spark):
    rows = [(1, 4, "good Good"), (2, 0, "bad"), (3, 2, "plain"), (4, 9, "odd")]
    docs = spark.createDataFrame(rows, "tweet_id long, polarity int, text string")
    vocabulary = spark.createDataFrame([("good",), ("bad",)], "token string")
    found = classify.best_word_features(docs, vocabulary, "tweet_id").orderBy("tweet_id")
    assert [tuple(r) for r in found.collect()] == [
        (1, "pos", ["good"]), (2, "neg", ["bad"]), (3, "neutral", []),
    ]
    model, outcome = classify.bayes_job(docs, docs)
    assert outcome.accuracy.first()[0] == 1.0
    assert sorted(map(tuple, outcome.sizes.collect())) == [("test", 4), ("train", 4)]
    assert set(model.classes) == {"pos", "neutral", "neg"}


def test_tfidf(spark):
    texts = {1: "a a b", 2: "b c", 3: ""}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    tokens = F.filter(words(), lambda w: w != "")
    lists = {i: t.split() for i, t in texts.items()}
    df = Counter(w for row in lists.values() for w in set(row))
    idf = {w: log(4 / (1 + n)) + 1 for w, n in df.items()}
    expected = {}
    for i, row in lists.items():
        raw = {w: n * idf[w] for w, n in Counter(row).items()}
        length = sqrt(sum(v * v for v in raw.values()))
        expected.update({(i, w): v / length for w, v in raw.items()})
    for rows in (tfidf.tfidf(docs, "id", tokens), tfidf.tfidf(docs, "id", tokens, max_rows=1)):
        found = {(r["id"], r["term"]): r["weight"] for r in rows.collect()}
        assert found == pytest.approx(expected)


def test_lexicon(spark):
    table = stored(spark.createDataFrame([("good", 1.0), ("bad", -0.5)], "token string, weight double"), "lex")
    docs = spark.createDataFrame([(1, "good bad"), (2, "bad"), (3, "none")], "id long, text string")
    mean = lexicon.lexicon_scores(docs, "id", words(), table)
    assert {r["id"]: r["score"] for r in mean.collect()} == {1: 0.25, 2: -0.5, 3: 0.0}
    compound = lexicon.lexicon_scores(docs, "id", words(), table, "compound")
    found = {r["id"]: r["score"] for r in compound.collect()}
    assert found[1] == round(0.5 / sqrt(0.25 + 15), 6) and found[3] == 0.0
    with pytest.raises(ValueError):
        lexicon.lexicon_scores(docs, "id", words(), table, "other")


def outcome(spark, rows):
    return metrics.confusion(spark.createDataFrame(rows, "label string, prediction string"))


def test_metrics(spark):
    counts = outcome(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("a", "d")])
    assert counts.agg(F.sum("n")).first()[0] == 5
    scores = {r["label"]: tuple(r)[1:] for r in metrics.class_scores(counts).collect()}
    assert scores["a"] == pytest.approx((0.5, 1 / 3, 0.4))
    assert scores["b"] == pytest.approx((0.5, 1.0, 2 / 3))
    assert scores["c"] == (None, 0.0, None)
    assert scores["d"] == (0.0, None, None)
    report = {r["row"]: tuple(r)[1:] for r in metrics.class_report(counts).collect()}
    assert report["c"] == (0.0, 0.0, 0.0, 1)
    assert report["micro avg"] == pytest.approx((0.4, 0.4, 0.4, 5))
    assert report["macro avg"][0] == pytest.approx((0.5 + 0.5 + 0 + 0) / 4)
    assert report["weighted avg"][1] == pytest.approx((3 * (1 / 3) + 1 + 0) / 5)


def test_metrics_all_correct(spark):
    rows = [("a", "a"), ("b", "b")]
    assert metrics.accuracy(spark.createDataFrame(rows, "label string, prediction string")).first()[0] == 1
    assert {tuple(r)[1:] for r in metrics.class_scores(outcome(spark, rows)).collect()} == {(1, 1, 1)}


@pytest.fixture(scope="module")
def texts(spark):
    good, bad = ["nice great day", "great fun nice", "lovely nice fun"], ["awful sad day", "sad bad awful", "bad awful rain"]
    rows = [(i, 4 if i % 2 else 0, (good if i % 2 else bad)[i // 2 % 3] + f" word{i % 5}") for i in range(40)]
    return stored(spark.createDataFrame(rows, "tweet_id long, polarity int, text string"), "texts")


def test_logistic_job(texts):
    model, result, extremes = classify.logistic_job(texts, n=3)
    assert result.accuracy.first()[0] == 1.0
    rows = extremes.orderBy("place").collect()
    assert [r["place"] for r in rows] == [1, 2, 3]
    assert rows[0]["low_coef"] < 0 < rows[0]["high_coef"]
    again = classify.logistic_job(texts, n=3)[2].orderBy("place").collect()
    assert [r["low_term"] for r in rows] == [r["low_term"] for r in again]


def plain_features(rows, weighted):
    """A column for every term: the values of each row, worked out one by one."""
    import numpy as np

    cut = []
    for text in rows:
        words = re.findall(r"\w{2,}", text.lower())
        cut.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    names = sorted(set().union(*cut))
    df = Counter(t for c in cut for t in c)
    x = np.array([[float(c[t]) for t in names] for c in cut])
    if weighted:
        x *= [log((1 + len(cut)) / (1 + df[t])) + 1 for t in names]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return names, x


def own_words(n=40):
    """Texts with shared words, words of their own, and one without any words."""
    draw = random.Random(3)
    kinds = {4: "nice great fun lovely day".split(), 0: "awful sad bad rain day".split()}
    rows = [(i, 4 if i % 2 else 0) for i in range(n)]
    return [
        (i, p, " ".join([*draw.choices(kinds[p] + kinds[4], k=5), *([f"own{i}", f"mine{i}"] * (i % 3))]))
        for i, p in rows
    ]


def test_logistic_is_the_optimum_over_all_terms(spark):
    """Coefficients as by Newton's method with a column for every term."""
    import numpy as np

    rows = own_words()
    docs = stored(spark.createDataFrame(rows, "tweet_id long, polarity int, text string"), "own")
    label = map_label("polarity")
    model = linear.fit_tfidf_logistic(docs, "tweet_id", label, iterations=500, tolerance=1e-13)
    names, x = plain_features([r[2] for r in rows], True)
    assert sum((x > 0).sum(0) == 1) > 20
    y = np.array([1.0 if r[1] == 4 else 0.0 for r in rows])
    wide = np.hstack([x, np.ones((len(rows), 1))])
    penalty = np.diag([1.0] * len(names) + [0.0])
    w = np.zeros(wide.shape[1])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-wide @ w))
        slope = wide.T @ (chance - y) + penalty @ w
        w -= np.linalg.solve(wide.T @ (wide * (chance * (1 - chance))[:, None]) + penalty, slope)
    found = {r["term"]: r["coef"] for r in model.coefficients().collect()}
    assert found == pytest.approx(dict(zip(names, w)), abs=1e-6)
    assert model.intercept == pytest.approx(w[-1], abs=1e-6)
    margins = {r["tweet_id"]: r["margin"] for r in model.margins(docs, "tweet_id").collect()}
    assert margins == pytest.approx(dict(enumerate(wide @ w)), abs=1e-5)
    proof = linear.largest_gradient(model, docs, "tweet_id", label).first()
    assert (proof["rows"], proof["terms"]) == (len(rows), len(names))
    assert proof["gradient"] < 1e-6
    worse = linear.LinearTextModel(model.terms, model.intercept + 0.5, model.labels, (1, 2))
    assert linear.largest_gradient(worse, docs, "tweet_id", label).first()["gradient"] > 0.02


def test_hinge_features_have_equal_products(spark):
    """Scalar products, all that the penalized models depend on, are those over all terms."""
    import numpy as np

    rows = own_words(15) + [(15, 4, "")]
    docs = spark.createDataFrame(rows, "tweet_id long, polarity int, text string")
    train, total = linear.training_rows(docs, "tweet_id", map_label("polarity"), classify.TWO)
    for weighted in (False, True):
        label = F.col("row").cast("double")
        features = linear.term_features(train, total, (1, 2), weighted, label)
        got = features.read().orderBy("label").collect()
        x = np.array([r["features"].toArray() for r in got])
        with np.errstate(invalid="ignore"):
            _, wanted = plain_features([r[2] for r in rows], weighted)
        assert np.allclose(x @ x.T, np.nan_to_num(wanted @ np.nan_to_num(wanted).T))
        assert x.shape[1] < wanted.shape[1]


def test_linear_svc(texts):
    labels = map_label("polarity")
    model = linear.fit_linear_svc(texts, "tweet_id", labels)
    wrong = classify.evaluated(model.predict(texts, "tweet_id"), texts, "tweet_id").where(
        "label <> prediction"
    )
    assert wrong.count() == 0


@pytest.mark.parametrize("blocks", [1, 3])
def test_sgd_as_by_brute_force(spark, blocks):
    """A column for every term, one row after the other, blocks averaged after each pass."""
    import numpy as np

    rows = own_words(30) + [(30, 4, "")]
    docs = spark.createDataFrame(rows, "tweet_id long, polarity int, text string").repartition(3)
    model = linear.fit_sgd(docs, "tweet_id", map_label("polarity"), blocks=blocks)
    names, x = plain_features([r[2] for r in rows], False)
    sign = [1.0 if r[1] == 4 else -1.0 for r in rows]
    drawn = docs.select("tweet_id", F.pmod(F.xxhash64(F.col("tweet_id").cast("string"), F.lit(42)), F.lit(blocks)).alias("block"), *(
        F.xxhash64(F.col("tweet_id").cast("string"), F.lit(42), F.lit(k)).alias(f"o{k}") for k in range(5)
    )).collect()
    w, b, alpha = np.zeros(len(names)), 0.0, 1e-3
    for number in range(5):
        ends = []
        for block in sorted({r["block"] for r in drawn}):
            mine = sorted((r for r in drawn if r["block"] == block), key=lambda r: r[f"o{number}"])
            v, c = w.copy(), b
            for k, r in enumerate(mine):
                i = r["tweet_id"]
                step = 1 / (alpha * (1 / (alpha**-0.25 * alpha) + number * len(mine) + k))
                short = sign[i] * (x[i] @ v + c) < 1
                v *= 1 - step * alpha
                if short:
                    v += step * sign[i] * x[i]
                    c += step * sign[i] * 0.01
            ends.append((v, c))
        w, b = np.mean([e[0] for e in ends], axis=0), np.mean([e[1] for e in ends])
    found = {r["term"]: r["coef"] for r in model.coefficients().collect()}
    assert found == pytest.approx(dict(zip(names, w)), abs=1e-8)
    assert model.intercept == pytest.approx(b, abs=1e-9)


def test_grid_search_shares_features(texts):
    labels = map_label("polarity")
    model, settings = linear.grid_search(texts, "tweet_id", labels)
    rows = {(r["ngram_high"], r["alpha"]): r["accuracy"] for r in settings.collect()}
    assert set(rows) == {(n, a) for n in (1, 2) for a in linear.GRID_ALPHA}
    assert max(rows.values()) == 1.0
    wrong = classify.evaluated(model.predict(texts, "tweet_id"), texts, "tweet_id").where(
        "label <> prediction"
    )
    assert wrong.count() == 0


def test_linear_models_have_every_term(texts):
    labels = map_label("polarity")
    model = linear.fit_tfidf_logistic(texts, "tweet_id", labels)
    words = texts.where(labels.isNotNull() & (labels != "neutral"))
    wanted = words.select(F.explode(tx.terms("text", (1, 2))).alias("term")).distinct().count()
    assert model.coefficients().count() == wanted


def test_fit_rows_thin_by_key(spark):
    rows = [(i, 4 if i % 2 else 0, "the same text") for i in range(4000)]
    docs = spark.createDataFrame(rows, "tweet_id long, polarity int, text string")
    train, total = linear.training_rows(docs, "tweet_id", map_label("polarity"), classify.TWO, fit_rows=1000)
    assert 900 < total < 1100 and train.count() == total
    assert train.select("row").distinct().count() == train.count()


def test_evaluation_as_rows(texts):
    found = classify.evaluation_rows(classify.logistic_job(texts)[1]).collect()
    rows = {(r["measure"], r["row"]): r["value"] for r in found}
    assert rows["accuracy", "all"] == 1.0 and rows["n", "train"] == 24
    assert rows["support", "pos"] == 4 and rows["f1", "macro avg"] == 1.0


def test_fits_hold_a_number_for_each_row(spark, monkeypatch):
    """What a pass is given and gives back has a number a row, whatever the terms are."""
    import numpy as np

    from wrenlight.operators import columns

    rows = own_words(25) + [(25, 4, "")]
    docs = spark.createDataFrame(rows, "tweet_id long, polarity int, text string").repartition(3)
    train, total = linear.training_rows(docs, "tweet_id", map_label("polarity"), classify.TWO)
    monkeypatch.setattr(columns, "CHUNK", 7)
    for weighted in (False, True):
        made = columns.term_columns(train, total, (1, 2), weighted)
        with np.errstate(invalid="ignore"):
            x = np.nan_to_num(plain_features([r[2] for r in rows], weighted)[1])
        v = np.random.default_rng(1).normal(size=(2, total))
        assert np.allclose(made.products(v), v @ x @ x.T)
        assert made.own.any() and x.shape[1] > total
    shapes, plain = [], columns.TermColumns.products
    monkeypatch.setattr(columns.TermColumns, "products", lambda self, v: shapes.append(v.shape) or plain(self, v))
    linear.fit_tfidf_logistic(docs, "tweet_id", map_label("polarity"), iterations=5)
    linear.fit_linear_svc(docs, "tweet_id", map_label("polarity"))
    assert set(shapes) == {(1, total)}


def test_folds_and_penalties_share_each_pass(texts, monkeypatch):
    from wrenlight.operators import columns

    shapes, plain = [], columns.TermColumns.products
    monkeypatch.setattr(columns.TermColumns, "products", lambda self, v: shapes.append(v.shape[0]) or plain(self, v))
    linear.grid_search(texts, "tweet_id", map_label("polarity"), ngrams=((1, 1),))
    assert shapes[0] == linear.FOLDS * len(linear.GRID_ALPHA)
    assert len(shapes) <= 2 * (linear.HINGE_ITERATIONS + 1)


def test_a_block_descends_batch_by_batch(monkeypatch):
    import numpy as np
    import pyarrow as pa

    pulled, seen = [], []

    def batches():
        for k in range(4):
            pulled.append(k)
            yield pa.RecordBatch.from_pydict(
                {"block": [0, 0], "sign": [1.0, -1.0], "slots": [[0], [1, 2]], "values": [[1.0], [1.0, float(k)]]}
            )

    def watch(rows, weights, intercept, alpha, done):
        seen.extend((len(pulled), sign, list(slots), list(values)) for sign, slots, values in rows)
        return weights.copy(), 1.0, 0.0

    class Sent:
        value = (np.zeros(3), 0.0)

    monkeypatch.setattr(linear, "sgd_pass", watch)
    monkeypatch.setattr(linear.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    ends = list(linear._descend(Sent, 1e-3, 0, {0: 8})(batches()))
    assert [s[0] for s in seen] == [1, 1, 2, 2, 3, 3, 4, 4]
    assert seen[5] == (3, -1.0, [1, 2], [1.0, 2.0]) and len(ends) == 2


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_of_frequent_tokens_first(spark, monkeypatch, how):
    """What the table's counts call frequent is broadcast; only the other rows are stored."""
    from wrenlight.operators import lookup

    rows = [(i, None if i % 50 == 0 else f"t{i % 90}" if i % 3 else "hot") for i in range(2000)]
    docs = stored(spark.createDataFrame(rows, "id long, token string"), "docs")
    listed = [(f"t{k}", k, 100 - k) for k in range(0, 80)] + [("hot", 1000, 1)]
    table = stored(spark.createDataFrame(listed, "token string, weight long, n long"), "listed")
    sizes, plain = [], lookup.stored
    monkeypatch.setattr(lookup, "stored", lambda df, name: sizes.append((name, df.count())) or plain(df, name))
    found = lookup.lookup(docs, table, max_rows=40, how=how, count=F.col("n"))
    got = sorted((r["id"], r["token"], r["weight"]) for r in found.collect()) if how == "inner" else None
    known = {t: w for t, w, _ in listed}
    if how == "inner":
        assert got == sorted((i, t, known[t]) for i, t in rows if t in known)
    else:
        got = {r["id"]: r["weight"] for r in found.collect()}
        assert got == {i: known.get(t) for i, t in rows} and found.count() == len(rows)
    kept = lookup.frequent(table, F.col("n"), 40)
    assert 20 <= table.where(kept).count() <= 40
    assert dict(sizes)["lookup-rows"] < 1700


class Stop(Exception):
    pass


@pytest.mark.parametrize("fit", ["fit_tfidf_logistic", "fit_linear_svc", "fit_sgd", "grid_search"])
def test_models_are_fitted_on_all_rows(spark, monkeypatch, fit):
    """More labelled rows than once were fitted at most, 200,000: none is left out."""
    rows = 201_000
    docs = spark.range(rows).select(
        F.col("id").alias("tweet_id"), (F.col("id") % 2 * 4).cast("int").alias("polarity"), F.lit("same").alias("text")
    )
    seen = []

    def stop(train, total, *args, **settings):
        seen.append((total, train.count(), train.select("key").distinct().count()))
        raise Stop

    monkeypatch.setattr(linear, "term_columns", stop)
    monkeypatch.setattr(linear, "term_features", stop)
    with pytest.raises(Stop):
        getattr(linear, fit)(docs, "tweet_id", map_label("polarity"))
    assert seen == [(rows, rows, rows)]


def test_fits_remember_their_steps_in_a_file(spark, monkeypatch):
    """Beyond some bytes; entries are joined before they are added up. Neither changes the model."""
    from wrenlight.operators import columns

    docs = stored(spark.createDataFrame(own_words(60), "tweet_id long, polarity int, text string"), "own")
    label, found = map_label("polarity"), []
    for mapped, packed in ((columns.MAPPED_BYTES, columns.PACKED), (0, 7)):
        monkeypatch.setattr(columns, "MAPPED_BYTES", mapped)
        monkeypatch.setattr(columns, "PACKED", packed)
        model = linear.fit_tfidf_logistic(docs, "tweet_id", label, iterations=12, tolerance=0.0)
        found.append({r["term"]: r["coef"] for r in model.coefficients().collect()})
    assert found[0] == pytest.approx(found[1], abs=1e-9) and len(found[0]) > 100
    assert columns._space(3, 5).base is not None and not columns._space(3, 5).any()


def test_entries_are_joined_before_they_are_added_up():
    import numpy as np
    import pyarrow as pa

    from wrenlight.operators import columns

    def batch(k):
        ints = [np.array(x, np.int32).tobytes() for x in ([k, k + 1], [1, 2], [2])]
        return pa.RecordBatch.from_pydict(dict(zip(("rows", "counts", "lengths"), ([i] * 3 for i in ints))))

    joined = list(columns._gathered(map(batch, range(4)), 40))
    assert [len(rows) for rows, _, _ in joined] == [10, 10, 4]
    assert [len(lengths) for _, _, lengths in joined] == [5, 5, 2]
    assert [len(rows) for rows, _, _ in columns._gathered(map(batch, range(2)), 3)] == [2] * 6


def test_a_pass_has_a_task_for_each_core(spark):
    from wrenlight.operators import columns

    many = spark.range(100).repartition(40)
    assert columns.few_tasks(many).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_tfidf_packs(spark, monkeypatch):
    """Several packs and ranges; rows of one key, or of none, have one length; null tokens are none."""
    from wrenlight.operators import packs, tfidf as module

    draw = random.Random(5)
    names = [f"w{i}" for i in range(12)] + ["\u00e9t\u00e9", "", "\U0001f600 x"]
    rows = [
        (i if i % 5 else (None if i % 10 else 5), [draw.choice([*names, f"own{i}", None]) for _ in range(draw.randrange(9))])
        for i in range(1, 60)
    ] + [(100, None), (101, []), (102, [None])]
    monkeypatch.setattr(packs, "RANGE_TERMS", 25)
    # Tasks import the package anew, so small packs come from small partitions.
    docs = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(7)
    df = Counter(t for _, ts in rows for t in {*(ts or ())} - {None})
    raw = [(k, t, n, n * (log((1 + len(rows)) / (1 + df[t])) + 1)) for k, ts in rows for t, n in Counter(ts or ()).items() if t is not None]
    square = Counter()
    for k, _, _, w in raw:
        square[k] += w * w
    wanted = sorted((str(k), t, n, round(w / sqrt(square[k]), 9)) for k, t, n, w in raw)
    for one in (docs, docs.where("id > 5 AND id < 100")):
        found = module.tfidf(one, "id", F.col("tokens"))
        assert found.dtypes == [("id", "bigint"), ("term", "string"), ("tf", "int"), ("weight", "double")]
        if one is docs:
            assert sorted((str(r["id"]), r["term"], r["tf"], round(r["weight"], 9)) for r in found.collect()) == wanted
        else:
            assert found.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).where("abs(n - 1) > 1e-9").isEmpty()
    assert module.tfidf(docs.where("false"), "id", F.col("tokens")).count() == 0


def test_tfidf_moves_no_term_rows(spark):
    """Of a thousand copies of terms a task sends one, packed: once 60,000 rows and more were shuffled."""
    docs = spark.range(3000, numPartitions=3).select("id", F.lit("a b c d e f g h i j k l m n o p q r s t").alias("text"))
    from wrenlight.operators import packs

    made, plain = [], packs.stored
    try:
        packs.stored = lambda df, name, **to: made.append((name, plain(df, name, **to))) or made[-1][1]
        found = tfidf.tfidf(docs, "id", words())
    finally:
        packs.stored = plain
    assert found.count() == 60_000
    assert {name: df.count() for name, df in made} == {"packs": 3, "pack-frequencies": 3}


def test_squeezed_numbers_and_terms():
    import numpy as np
    import pyarrow as pa

    from wrenlight.operators import packs

    for numbers in ([], [0], [1, 2**32 - 1, 7, 300]):
        assert packs.loose_ints(packs.squeezed_ints(np.array(numbers, np.int64))).tolist() == numbers
    for terms in ([], [b""], [b"a", b"", b"\xff\x00"]):
        array = pa.array([b"skip", *terms], pa.binary()).slice(1)
        assert packs.loose_terms(*packs.squeezed_terms(array)).to_pylist() == terms
