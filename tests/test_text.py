import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wrenlight.functions import text as tx

# Texts, and what the two cleanings make of them.
CASES = [
    ("@bob hello @ann_x", "hello x", "hello x"),
    ("http://a.b/c start", "start", "start"),
    ("mid http://a.b/c?d=1 end", "mid end", "mid end"),
    ("end https://x.y", "end", "end"),
    ("xhttp://joined now", "now", "now"),
    ("a &amp; b &quote; c", "a amp b quote c", "a b c"),
    ("one\ntwo", "one two", "onetwo"),
    ("12 apples 3rd", "12 apples 3rd", "apples rd"),
    ("!!! ???", "", ""),
    ("", "", ""),
    ("café naïve", "caf na ve", "caf nave"),
    ("  tabs\t and  spaces ", "tabs and spaces", "tabs and spaces"),
    ("mail me@home.org now", "mail me org now", "mail me org now"),
    ("ftp://x.y/@z #tag1", "tag1", "tag"),
    (None, None, None),
]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    rows = df.select("i", expression.alias("out")).orderBy("i").collect()
    return [row["out"] for row in rows]


def test_cleaning(spark):
    texts, spaced, strict = zip(*CASES)
    assert column(spark, texts, tx.clean_spacing("text")) == list(spaced)
    assert column(spark, texts, tx.clean_strict("text")) == list(strict)


def in_order(part, whole):
    """Whether the letters of ``part`` stand in ``whole`` one after the other."""
    rest = iter(whole)
    return all(letter in rest for letter in part if letter != " ")


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text("aA@b:/. &é1\n#", max_size=20), min_size=150, max_size=150))
def test_properties_of_cleaned_texts(spark, texts):
    for clean, allowed in ((tx.clean_spacing, "[0-9A-Za-z ]*"), (tx.clean_strict, "[A-Za-z ]*")):
        once = column(spark, texts, clean("text"))
        assert all(re.fullmatch(allowed, t) for t in once)
        assert not any("  " in t or t != t.strip() for t in once)
        assert all(in_order(new, old) for new, old in zip(once, texts))
        assert column(spark, once, clean("text")) == once
        # Texts of letters and single blanks are clean already.
        plain = [" ".join(re.findall("[A-Za-z]+", t)) for t in texts]
        assert column(spark, plain, clean("text")) == plain


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text("aAbé \n", max_size=20), min_size=150, max_size=150))
def test_properties_of_squeezed_texts(spark, texts):
    once = column(spark, texts, tx.squeeze_letters("text"))
    for new, old in zip(once, texts):
        low = new.lower()
        assert not any(low[i] == low[i + 1] == low[i + 2] for i in range(len(low) - 2))
        assert in_order(new.replace(" ", ""), old) and len(new) <= len(old)
        assert [k for k, _ in itertools.groupby(low)] == [k for k, _ in itertools.groupby(old.lower())]
    assert column(spark, once, tx.squeeze_letters("text")) == once


def test_squeeze(spark):
    texts = ["sooooo GooOOd", "aaa", "AaA", "ÉéÉ!", "aabb", "\n\n\n"]
    assert column(spark, texts, tx.squeeze_letters("text")) == [
        "soo Good", "aa", "Aa", "Éé!", "aabb", "\n\n",
    ]


def test_tokens(spark):
    texts = ["@bob don't go #now :) café 3.14 2nd http://a.b/c?d, well-known <3", "", None]
    whole = column(spark, texts, tx.tokenize("text"))
    assert whole[0] == [
        "@bob", "don't", "go", "#now", ":)", "café", "3.14", "2nd", "http://a.b/c?d,",
        "well-known", "<3",
    ]
    assert whole[1:] == [[], None]
    assert column(spark, texts, tx.tokenize("text", strip_handles=True))[0][0] == "don't"
    assert column(spark, ["A a A"], tx.presence(tx.tokenize("text"))) == [["A", "a"]]


def test_terms_and_bigrams(spark):
    assert column(spark, ["A Bc de, bc"], tx.terms("text")) == [["bc", "de", "bc"]]
    assert column(spark, ["bc de", "bc", ""], tx.terms("text", (1, 2))) == [
        ["bc", "de", "bc de"], ["bc"], [],
    ]
    pairs = column(spark, ["a b c", "a", ""], tx.bigrams(tx.tokenize("text")))
    assert [[tuple(p) for p in row] for row in pairs] == [[("a", "b"), ("b", "c")], [], []]
    with pytest.raises(ValueError):
        tx.terms("text", (1, 3))


def test_term_counts(spark):
    texts = ["b a b b", "", "x"]
    counted = column(spark, texts, tx.term_counts(tx.tokenize("text")))
    assert [[tuple(e) for e in row] for row in counted] == [[("a", 1), ("b", 3)], [], [("x", 1)]]


def test_trigrams(spark):
    assert column(spark, ["Ab, c1d"], tx.letter_trigrams("text")) == [
        [" ab", "ab ", " c ", " d "]
    ]


def test_plain_stopwords(spark):
    assert column(spark, ["don't"], tx.without_apostrophes(F.col("text"))) == ["dont"]
