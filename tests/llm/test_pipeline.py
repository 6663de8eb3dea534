from collections import Counter

import corpus_pipeline
import pytest
from brute import deduplicated, near_classes
from pyspark.sql import functions as F

import __spark_entry__ as driver
from wrenlight.llm.queries import QUERIES
from wrenlight.sources.scratch import stored


@pytest.fixture(scope="module")
def steps(spark):
    """The rows after each stage over the smallest tables."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), name)
        found.append(docs)
    return [df.toPandas() for df in found]


def test_stages_keep_the_columns(steps):
    names = list(steps[0].columns)
    assert all(list(step.columns) == names for step in steps[:5])
    assert list(steps[5].columns) == ["doc_id", "n_tokens", "ids"]


def test_quality_stage_rejects_bad_and_keeps_clean(spark, steps):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").toPandas()
    quality = dict(zip(labels.doc_id, labels.quality, strict=True))
    kept = set(steps[1].doc_id)
    assert all(i in kept for i, q in quality.items() if q == 1 and i in set(steps[0].doc_id))
    # The smallest table has nine bad texts to learn from.
    bad = [i for i, q in quality.items() if q == 0]
    assert sum(i in kept for i in bad) <= 0.25 * len(bad)


def test_line_stage_by_brute_force(steps):
    before = steps[1].sort_values("doc_id")
    want = deduplicated(dict(zip(before.doc_id, before.text, strict=True)))
    want = {i: t for i, t in want.items() if t.strip()}
    got = dict(zip(steps[2].doc_id, steps[2].text, strict=True))
    assert got == want
    assert (steps[2].n_chars == steps[2].text.str.len()).all()


def test_near_stage_by_brute_force(steps):
    classes = near_classes(dict(zip(steps[2].doc_id, steps[2].text, strict=True)))
    assert sorted(steps[3].doc_id) == sorted(i for i, c in classes.items() if i == c)


def test_mixing_stage_takes_the_words(steps):
    before, after = steps[3], steps[4]
    words = before.text.str.split().str.len().sum()
    taken = after.text.str.split().str.len().sum()
    assert abs(taken - 1.5 * words) <= 0.1 * words
    assert after.doc_id.value_counts().max() <= 2 and set(after.doc_id) <= set(before.doc_id)


def test_encoding_stage_is_whole(steps):
    assert sorted(steps[5].doc_id) == sorted(steps[4].doc_id)
    assert (steps[5].n_tokens == steps[5].ids.str.len()).all()


def test_registered():
    names = driver.queries()
    assert "pipeline" in names and set(QUERIES) <= set(names)
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}

#: Names that stages use themselves.
CLASHING = "given id of copies col kept _kept _id _source _copies _copy row gone key n class".split()


def odd_documents(spark, rows):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kinds)
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit(7))
    return docs


ODD = [
    (1, "a line of its own here\nshared line of words", "en", "web", 0),
    (1, "a line of its own here\nshared line of words", "en", "web", 0),
    (2, "shared line of words\nand one more line", "en", None, 0),
    (None, "no id has this line\nshared line of words", "en", "web", 0),
    (None, None, None, None, None),
    (3, "", "en", "books", 0),
    (4, None, "en", "web", None),
    (5, "one two three four five six seven eight nine ten", "en", "web", 0),
    (6, "one two three four five six seven eight nine ten", "en", "books", 0),
]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_clashing_names(spark, name, stage):
    folder = "/root/testdata/sf0.001"
    docs = odd_documents(spark, ODD)
    found = stage(spark, docs, folder)
    rows = found.collect()
    if name == "bpe_encoding":
        assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
        return
    assert found.columns == docs.columns
    assert all(r[c] == 7 for r in rows for c in CLASHING)
    if name == "line_dedup":
        texts = Counter((r["doc_id"], r["text"]) for r in rows)
        assert texts == Counter(
            [
                (None, "no id has this line\nshared line of words"),
                (None, None),
                (1, "a line of its own here"),
                (1, "a line of its own here"),
                (2, "and one more line"),
                (3, ""),
                (4, None),
                (5, "one two three four five six seven eight nine ten"),
            ]
        )
    if name == "near_dedup":
        assert Counter(r["doc_id"] for r in rows) == Counter({1: 2, 2: 1, None: 2, 3: 1, 4: 1, 5: 1})
    if name == "source_mixing":
        assert {r["doc_id"] for r in rows} <= {r[0] for r in ODD} and len(rows) >= 9


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, name, stage):
    found = stage(spark, odd_documents(spark, ODD).limit(0), "/root/testdata/sf0.001")
    assert found.count() == 0
