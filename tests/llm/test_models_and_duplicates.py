import random
from collections import Counter

import numpy as np
import pytest
from brute import Union, deduplicated, merged, near_classes
from pyspark.sql import functions as F

from wrenlight.llm import language, line_dedup, linking, near_dedup, quality, queries, tokenizer

LINE_NAMES = (
    "line n_kept _row _gone _at _given row id gone at of word mask bucket class place first n"
).split()
TEXTS = "doc_id long, text string"


@pytest.fixture(scope="module")
def spec():
    pytest.importorskip("public_tokenizers")
    return tokenizer.read_spec(queries.vocabulary_path())


def test_automaton_follows_the_merges():
    draw = random.Random(1)
    for _ in range(60):
        symbols = list("abc")
        vocab, merges = {s: i for i, s in enumerate(symbols)}, []
        while len(merges) < 14:
            pair = draw.choice(symbols), draw.choice(symbols)
            if "".join(pair) not in vocab:
                vocab["".join(pair)] = len(vocab)
                symbols.append("".join(pair))
                merges.append(pair)
        machine = tokenizer.Automaton(vocab, merges)
        for _ in range(80):
            word = [draw.choice("abc") for _ in range(draw.randrange(1, 14))]
            want = [vocab[x] for x in merged(list(word), merges)]
            assert machine.encode(word) == want


def test_tokens_as_the_library_makes_them(spark, spec):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec)
    draw = random.Random(2)
    texts = ["", None, "Σίσυφος ΑΣ", "it's we'll <|endoftext|>x<|startoftext|>", "a" * 3000, "🙂é漢"]
    texts += ["".join(draw.choice("abehtiSRnO'!?19é漢ß \n\t<|>") for _ in range(80)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), TEXTS).withColumn("ids", F.lit(1))
    rows = tokenizer.encode(df, spec).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    again = tokenizer.decode(tokenizer.encode(df, spec).withColumn("was", F.col("decoded")), spec)
    assert again.where("was <> decoded").count() == 0
    assert tokenizer.encode(df.limit(0), spec).count() == 0


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all() and len(got) == 1000


def test_languages_of_odd_texts(spark):
    rows = [("der hund und die katze sind im garten", "de"), ("the dog and the cat are outside", "en")]
    rows += [(None, "en"), ("quelque chose", None), ("", "en")]
    filters = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert filters.langs == ["de", "en"]
    odd = ["the cat", "die katze", None, "", "12 3!", "漢字", "x", "the cat " * 20_000]
    df = spark.createDataFrame(list(enumerate(odd)), TEXTS).withColumn("lang", F.lit("xx"))
    got = {r["doc_id"]: r for r in language.identify(df, filters).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 3, 4, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert all(got[i]["lang_pred"] in ("de", "en") for i in (5, 6)) and got[5]["score"] == 0
    assert language.identify(df.limit(0), filters).count() == 0
    nothing = language.train(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in language.identify(df, nothing).collect()} == {"und"}


def plain_grams(text):
    """The 3- and 4-grams of a text's words, with a blank at each end."""
    found, word = [], ""
    for c in text + " ":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
            continue
        if word:
            padded = f" {word} "
            found += [padded[i : i + n] for n in (3, 4) for i in range(len(padded) - n + 1)]
        word = ""
    return found


def test_languages_by_sets_of_grams(spark):
    """Filters decide as sets of n-grams do, but for texts that are almost even."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    rows = [r for r in docs.collect() if r["lang"] and r["text"]]
    counts = {}
    for r in rows:
        counts.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    share = {k: {g: n / c.total() for g, n in c.items()} for k, c in counts.items()}
    most = Counter()
    for s in share.values():
        for g, x in s.items():
            most[g] = max(most[g], x)
    sets = {k: {g for g, x in s.items() if x >= 2e-6 and x >= 0.2 * most[g]} for k, s in share.items()}
    filters = language.train(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, filters).collect()}
    compared = 0
    for r in rows:
        grams = plain_grams(r["text"])
        hits = {k: sum(g in s for g in grams) for k, s in sets.items()}
        first, second = sorted(hits.values(), reverse=True)[:2]
        if first - second > 0.05 * len(grams):
            compared += 1
            assert got[r["doc_id"]]["lang_pred"] == max(hits, key=hits.get)
            assert abs(got[r["doc_id"]]["score"] - first / sum(hits.values())) < 0.05
    assert compared > 0.9 * len(rows)


def test_filters_hold_every_gram_and_few_others():
    draw = np.random.default_rng(1)
    grams = draw.integers(0, 2**63, 20_000, dtype=np.uint64)
    words = np.zeros((2, 1 << 16), np.uint64)
    for places in language._places(grams, 16):
        for i, place in enumerate(places):
            words[i % 70 // 64, place] |= np.uint64(1 << (i % 70 % 64))
    part, place = np.nonzero(words)
    filters = language.Filters.of([str(i) for i in range(70)], part, place, words[part, place], 16)
    masks = filters.containing(grams)
    for i in (0, 3, 64, 69):
        bit = (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        assert bit[i::70].all()
        others = np.delete(bit, np.arange(i, len(bit), 70)).mean()
        assert abs(others - filters.false_rate[i]) < 0.01


def test_quality_of_held_out_texts(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    got = queries.op4_quality(spark, "/root/testdata/sf0.01")
    assert got.count() == 1000
    held = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (held.predicted == held.quality).mean() > 0.93
    kept = held[held.quality == 1].predicted.mean()
    assert kept > 0.97 and ((held.score >= 0) & (held.score <= 1)).all()


def test_trees_step_as_written():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(600, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y, trees=30, depth=3)
    scores = model.scores(x)
    assert ((scores > 0.5) == (y > 0)).mean() > 0.97
    for row, score in zip(x[:40], scores[:40], strict=True):
        total = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def test_quality_without_labels(spark):
    rows = [(1, None), (2, ""), (3, "words " * 50_000), (None, "x"), (1, None)]
    docs = spark.createDataFrame(rows, TEXTS).withColumn("score", F.lit("x"))
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert {round(r["score"], 6) for r in quality.score(docs, model).collect()} == {0.5}
    one = quality.train(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert quality.score(docs, one).where("score > 0.5").count() == 5
    assert quality.accepted(docs, one).columns == docs.columns
    assert quality.score(docs.limit(0), one).count() == 0


def planted(seed: int) -> dict[int, str | None]:
    """Texts with copies, edited copies, chains of edits and shared passages."""
    draw = random.Random(seed)
    word = [f"w{i}" for i in range(400)]
    texts: dict[int, str | None] = {}
    common = " ".join(draw.choice(word) for _ in range(60))
    while len(texts) < 150:
        base = [draw.choice(word) for _ in range(draw.choice([2, 4, 30, 80, 150]))]
        for _ in range(draw.choice([1, 1, 2, 6, 14])):
            texts[len(texts) * 3 + 1] = " ".join(base)
            for _ in range(draw.choice([0, 1, 1, 2])):
                base[draw.randrange(len(base))] = draw.choice(word)
        texts[len(texts) * 3 + 1] = common + " " + " ".join(draw.choice(word) for _ in range(12))
    return texts | {0: None, 3: "", 6: "  \n ", 9: common.upper()}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_by_brute_force(spark, seed):
    texts = planted(seed)
    df = spark.createDataFrame(list(texts.items()), TEXTS).withColumn("key", F.lit("x"))
    got = near_dedup.near_duplicates(df.repartition(5)).toPandas()
    want = near_classes(texts)
    # Bands miss few pairs, and no pair that isn't there is found.
    found = dict(zip(got.doc_id, got.class_id, strict=True))
    assert sum(found[i] != want[i] for i in texts) <= 1
    assert dict(zip(got.doc_id, got.kept, strict=True)) == {i: found[i] == i for i in texts}
    sizes = got.groupby("class_id").size()
    assert (got.class_size == got.class_id.map(sizes)).all()


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b  c d e f")]
    rows += [(3, None), (4, None), (None, None), (5, "one"), (6, "one"), (7, "x " * 100_000)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, TEXTS)).collect()
    assert len(got) == len(rows)
    classes = {r["doc_id"]: r["class_id"] for r in got}
    assert classes == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, None: None}
    assert near_dedup.near_duplicates(spark.createDataFrame([], TEXTS)).count() == 0


def test_draws_agree_as_often_as_sets_do():
    draw = np.random.default_rng(3)
    elements = np.sort(draw.integers(0, 2**48, 300, dtype=np.uint64))
    agree, want = [], []
    for _ in range(40):
        wa, wb = draw.exponential(1, 300), draw.exponential(1, 300)
        wb = np.where(draw.random(300) < 0.7, wa, wb)
        owner = np.repeat([0, 1], 300)
        d = near_dedup.draws(np.tile(elements, 2), np.concatenate([wa, wb]), owner, 2)
        agree.append((d[0] == d[1]).mean())
        want.append(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
        elements = np.sort(draw.integers(0, 2**48, 300, dtype=np.uint64))
    assert abs(np.mean(agree) - np.mean(want)) < 0.03


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    draw = random.Random(4)
    pairs = {
        "path": [(i, i + 1) for i in range(120)],
        "star": [(0, i) for i in range(1, 200)],
        "random": [(draw.randrange(300), draw.randrange(300)) for _ in range(200)],
    }[shape]
    union = Union(range(400))
    for a, b in pairs:
        union.join(a, b)
    got = linking.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    roots = {r["id"]: r["root"] for r in got}
    assert set(roots) == {x for a, b in pairs if a != b for x in (a, b)}
    groups = {}
    for i, root in roots.items():
        groups.setdefault(root, set()).add(union.find(i))
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({union.find(i) for i in roots})


def weighted_sets(seed: int, n: int):
    draw = np.random.default_rng(seed)
    base = draw.choice(2**40, 60, replace=False)
    sets = []
    for _ in range(n):
        elements = np.unique(np.where(draw.random(60) < draw.choice([0.02, 0.3]), draw.integers(0, 2**40, 60), base))
        sets.append((elements.astype(np.uint64), draw.choice([0.5, 1.0, 2.5], len(elements), p=[0.1, 0.8, 0.1])))
    return sets


def jaccard(a, b):
    wa, wb = dict(zip(*map(list, a), strict=True)), dict(zip(*map(list, b), strict=True))
    both = sum(min(w, wb[e]) for e, w in wa.items() if e in wb)
    return both / (sum(wa.values()) + sum(wb.values()) - both)


@pytest.mark.parametrize("columns", [7, 2048])
def test_links_span_the_similar_sets(monkeypatch, columns):
    monkeypatch.setattr(linking, "COLUMNS", columns)
    sets = weighted_sets(1, 60)
    got, want = Union(range(60)), Union(range(60))
    found = list(linking.links(sets, 0.6))
    for a, b in found:
        got.join(a, b)
    for a in range(60):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.6:
                want.join(a, b)
    assert [got.find(i) for i in range(60)] == [want.find(i) for i in range(60)]
    assert 0 < len(found) < 60 and list(linking.links(sets[:1], 0.6)) == []


def test_links_in_large_buckets_are_all_found(spark, monkeypatch):
    """A bucket of several chunks, one that overlaps it, and two on their own."""
    monkeypatch.setattr(linking, "CHUNK", 16)
    sets = weighted_sets(2, 100)
    members = [(1, i) for i in range(80)] + [(2, 79), (2, 80), (3, 90), (3, 91), (4, 95)]
    rows = [(i, bytearray(e.tobytes()), bytearray(w.tobytes())) for i, (e, w) in enumerate(sets)]
    table = spark.createDataFrame(rows, "id long, elements binary, weights binary")
    buckets = spark.createDataFrame(members, "bucket long, id long")
    linked = linking.link(buckets, table, near_dedup.loaded, 0.6).collect()
    want = Union(range(100))
    for group in (range(81), (90, 91)):
        for a in group:
            for b in group:
                if a < b and jaccard(sets[a], sets[b]) >= 0.6:
                    want.join(a, b)
    least = {r["id"]: r["class"] for r in linked}
    assert [least.get(i, i) for i in range(100)] == [want.find(i) for i in range(100)]


@pytest.mark.parametrize("seed,chars", [(1, 5), (2, 5), (1, 9)])
def test_line_dedup_by_brute_force(spark, monkeypatch, seed, chars):
    # Some bands are shared often enough to be sent once.
    monkeypatch.setattr(line_dedup, "OFTEN", 4)
    draw = random.Random(seed)
    word = ["the", "garden", "house", "walks", "under", "green", "stone", "reads", "a", "of"]
    lines = [" ".join(draw.choice(word) for _ in range(draw.choice([1, 8, 14]))) for _ in range(60)]

    def edited(line):
        at = draw.randrange(len(line))
        return line[:at] + draw.choice("xyz") + line[at + 1 :] if draw.random() < 0.5 else line

    texts = {
        i: "\n".join(edited(draw.choice(lines)) if draw.random() < 0.9 else " " for _ in range(7))
        for i in range(90)
    }
    texts |= {200: None, 201: "", 202: "\n\n", 203: "long line " * 20_000}
    df = spark.createDataFrame(list(texts.items()), TEXTS)
    for name in LINE_NAMES:
        df = df.withColumn(name, F.lit("x"))
    rows = line_dedup.deduplicated(df.repartition(4), chars=chars).collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    want = deduplicated(texts, chars=chars)
    assert sum(got[i] != want[i] for i in texts) <= 1
    assert all(r[name] == "x" for r in rows for name in LINE_NAMES if name != "n_kept")
    assert {r["line"] for r in rows} == {"x"} and len(rows) == len(texts)
    for r in rows:
        held = [x for x in (texts[r["doc_id"]] or "").split("\n") if x.strip()]
        kept = [x for x in (r["text"] or "").split("\n") if x.strip()]
        assert (r["n_lines"], r["n_kept"]) == (len(held), len(kept))


def test_line_dedup_of_string_ids(spark):
    rows = [("b", "one line of some length\nother"), ("a", "one line of some length"), (None, "x")]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id string, text string"))
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_kept"]) for r in got.collect()} == {
        "b": ("other", 2, 1),
        "a": (rows[1][1], 1, 1),
        None: ("x", 1, 1),
    }


def test_bucket_links_span_the_similar(monkeypatch):
    monkeypatch.setattr(linking, "PAIRS", 50)
    draw = np.random.default_rng(4)
    base = [draw.choice(5000, n, replace=False) for n in (40, 400, 3000)]
    sets = []
    for k in range(60):
        kept = base[k % 3][draw.random(len(base[k % 3])) > draw.choice([0, 0.05, 0.15])]
        sets.append(np.unique(kept.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    sets = [np.sort(s) for s in sets]
    buckets = [np.arange(0, 40), np.arange(30, 60), np.array([0, 59])]
    found = linking.bucket_links(sets, buckets, 0.8)
    got, want = Union(range(60)), Union(range(60))
    for a, b in found:
        got.join(a, b)
    for bucket in buckets:
        for a in bucket:
            for b in bucket:
                both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
                if a < b and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-6:
                    want.join(int(a), int(b))
    assert [got.find(i) for i in range(60)] == [want.find(i) for i in range(60)]
    assert len(found) == 60 - len({want.find(i) for i in range(60)})


def test_buckets_of_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(linking, "CHUNK", 16)
    draw = random.Random(6)
    lines = [" ".join(draw.choice(["ab", "cd", "ef", "gh"]) for _ in range(20)) for _ in range(70)]
    members = [(1, i) for i in range(50)] + [(2, i) for i in range(50)] + [(3, i) for i in range(45, 70)]
    members += [(4, 1)]
    linked = linking.link_buckets(
        spark.createDataFrame(members, "bucket long, id long"),
        spark.createDataFrame(list(enumerate(lines)), "id long, body string"),
        line_dedup.loaded,
        0.6,
    )
    sets, want = line_dedup.loaded(lines), Union(range(70))
    for bucket in (range(50), range(45, 70)):
        for a in bucket:
            for b in bucket:
                both = len(np.intersect1d(sets[a], sets[b]))
                if a < b and both >= 0.6 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    want.join(a, b)
    least = {r["id"]: r["class"] for r in linked.collect()}
    assert [least.get(i, i) for i in range(70)] == [want.find(i) for i in range(70)]
    assert least


def test_compared_pairs_grow_with_shared_buckets(spark):
    """Members come from shared buckets alone, a line in each bucket once."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    for share in (0.25, 0.5, 1.0):
        part = rows.limit(int(1000 * share))
        sent = part.mapInArrow(line_dedup._bands(5, 3), line_dedup.PACKED)
        met = sent.groupBy("deal").applyInArrow(line_dedup._meet, "bucket long, id long").toPandas()
        texts = {x for r in part.collect() for x in r["text"].split("\n") if len(x) >= 5 and x.strip()}
        bands, sketch = line_dedup.signatures(list(texts))
        shared = 0
        for b in range(line_dedup.BANDS):
            _, size = np.unique(bands[:, b], return_counts=True)
            shared += int(size[size > 1].sum())
        assert 0 < len(met) <= shared and not met.duplicated().any()


def test_line_dedup_of_odd_rows(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (None, "b\nc"), (2, "c")]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, TEXTS)).collect()
    texts = sorted((str(r["doc_id"]), r["text"]) for r in got)
    assert texts == [("1", "a"), ("1", "a"), ("2", ""), ("None", "b\nc")]
    assert line_dedup.deduplicated(spark.createDataFrame([], TEXTS)).count() == 0


def test_lines_with_one_edit_are_found(spark):
    draw = random.Random(9)

    def letters(n):
        return "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    def edited(line, n):
        at = (len(line) - n) // 2
        return line[:at] + "#" * n + line[at + n :]

    lines = [letters(n) for n in range(30, 91)]
    texts = {i: line for i, line in enumerate(lines)}
    texts |= {100 + i: edited(line, 1) for i, line in enumerate(lines)}
    texts |= {200 + i: edited(line, 4) for i, line in enumerate(lines)}
    df = spark.createDataFrame(list(texts.items()), TEXTS)
    found = line_dedup.deduplicated(df).collect()
    kept = {r["doc_id"]: r["n_kept"] for r in found}
    assert all(kept[i] for i in range(len(lines)))
    # A pair at exactly 0.8 is missed by the bands once in 170 times.
    for edit, least in ((100, 49), (200, 76)):
        assert sum(kept[edit + i] for i, line in enumerate(lines) if len(line) >= least) <= 1
        assert all(kept[edit + i] for i, line in enumerate(lines) if len(line) < least)


def test_near_duplicates_of_string_ids(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [("b", " ".join(words)), ("a", " ".join(words + ["more"])), ("c", "other text"), (None, "x y")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    found = {r["doc_id"]: (r["class_id"], r["class_size"], r["kept"]) for r in got}
    assert found == {"a": ("a", 2, True), "b": ("a", 2, False), "c": ("c", 1, True), None: (None, 1, True)}
