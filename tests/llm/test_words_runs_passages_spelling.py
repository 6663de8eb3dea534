import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrenlight.llm import periodic, queries, spelling, substring_dedup
from wrenlight.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = (
    "id row word n runs kept collapsed fragments deal flush kind payload more start stop period"
    " n_words n_removed key last letters pivot near best root form"
).split()


def crowded(df):
    for name in CLASHING:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def plain_runs(words, least=12):
    """Every maximal stretch for every period, the smallest period of equal ones."""
    best = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                best.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((start, length, p) for (start, length), p in best.items())


def plain_collapse(words, runs):
    gone = {i for start, length, p in runs for i in range(start + p, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeating(draw):
    kind, n = draw.randrange(6), draw.randrange(0, 160)
    if kind == 0:
        return ["ab"[draw.randrange(2)] for _ in range(n)]
    if kind == 1:
        return ["a"] * n
    if kind == 2:
        part = [str(draw.randrange(30)) for _ in range(draw.randrange(1, 40))]
        return ["x"] * draw.randrange(4) + part * draw.randrange(1, 7) + part[: len(part) // 2] + ["y"]
    if kind == 3:
        return [str(draw.randrange(900)) for _ in range(n)]
    if kind == 4:
        found = ["0"]
        while len(found) < n:
            found += ["1" if w == "0" else "0" for w in found]
        return found[:n]
    return ["long" * 700 + str(draw.randrange(2)) for _ in range(n // 4)]


@pytest.mark.parametrize("tile", [16, periodic.TILE])
def test_runs_as_by_brute_force(spark, tile):
    draw = random.Random(tile)
    texts = {i: draw.choice([" ", "\n", "\t "]).join(repeating(draw)) for i in range(120)}
    texts |= {500: None, 501: "", 502: " \n ", 503: "a " * 11, 504: "a " * 12, 505: "é\x0b" * 4000}
    rows = [*texts.items(), (7, texts[7]), (None, "b c " * 9)]
    df = crowded(spark.createDataFrame(rows, "doc_id long, text string"))
    got = periodic.runs(df, tile=tile).collect()
    assert len(got) == len(rows)
    for r in got:
        words = WORD.findall(("b c " * 9 if r["doc_id"] is None else texts[r["doc_id"]]) or "")
        runs = plain_runs(words)
        assert r["n_words"] == len(words)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == runs
        assert r["collapsed"] == plain_collapse(words, runs)
    assert periodic.runs(df.limit(0)).count() == 0


def test_runs_with_string_ids(spark):
    df = spark.createDataFrame([("x/1", "a b " * 8), (None, None)], "key string, body string")
    got = {r["key"]: r for r in periodic.runs(df, "key", "body").collect()}
    assert got["x/1"]["collapsed"] == "a b" and got[None]["collapsed"] == ""


def test_op11_texts_repeat_by_id(spark):
    import zlib

    rows = [(i, " ".join(f"w{k}" for k in range(i % 90))) for i in range(300)] + [(0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", "text", queries.looped(F.col("doc_id"), F.col("text")).alias("e"))
    changed = 0
    for r in got.collect():
        words = WORD.findall(r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        assert (r["e"] or "") == " ".join(words) and (r["e"] is None) == (r["text"] is None)
    assert changed > 10


def plain_repeats(texts, width):
    """For each text the words that stay; all windows are compared."""
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    found = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        found.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return found


@pytest.mark.parametrize("width,flush", [(35, 1 << 23), (35, 3000), (21, 2000), (40, 3000)])
def test_passages_as_by_brute_force(spark, monkeypatch, width, flush):
    monkeypatch.setattr(substring_dedup, "FLUSH_BYTES", flush)
    draw = random.Random(width + flush)
    shared = [[f"s{k}x{i}" for i in range(draw.randrange(20, 90))] for k in range(6)]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(draw.randrange(0, 4)):
            words += [f"u{draw.randrange(10**6)}" for _ in range(draw.randrange(0, 50))]
            part = draw.choice(shared)
            cut = draw.randrange(0, 12)
            words += part[cut : len(part) - draw.randrange(0, 12)]
        texts.append(draw.choice([" ", "\n", " \t"]).join(words))
    texts += [None, "", " ", "z " * 34, "z2 " * 35, "z3 " * 36, texts[3], texts[3], "é " * 3000]
    ids = [None, None, *range(len(texts) - 2)]
    df = crowded(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"))
    got = substring_dedup.without_repeats(df.repartition(3), width=width).collect()
    expected = plain_repeats(texts, width)
    assert Counter(map(tuple, got)) == Counter((i, *e) for i, e in zip(ids, expected))
    assert substring_dedup.without_repeats(df.limit(0)).count() == 0


def test_cover_meets_every_difference():
    for difference in range(substring_dedup.PERIOD):
        assert any(
            (c + difference) % substring_dedup.PERIOD in substring_dedup.COVER
            for c in substring_dedup.COVER
        )


def test_window_hashes_follow_their_words():
    draw = np.random.default_rng(3)
    x = draw.integers(0, 3, 4000).astype(np.uint64)
    for width in (1, 2, 3, 15, 35):
        h = substring_dedup.windows(x, width, 1)
        keys = [tuple(x[i : i + width]) for i in range(len(x) - width + 1)]
        assert len(h) == len(keys) and len(set(zip(h.tolist(), keys))) == len(set(keys)) == len(set(h.tolist()))
    assert len(substring_dedup.windows(x[:4], 35, 1)) == 0


def test_words_of_texts():
    words = Words.of([b"a  bb\tccccccccccccc ", None, b"", b" x", ("w" * 9000).encode(), b"a"])
    assert words.first.tolist() == [0, 3, 3, 3, 4, 5, 6]
    keep = np.array([True, False, True, True, True, False])
    assert words.joined(keep).to_pylist() == ["a ccccccccccccc", "", "", "x", "w" * 9000, ""]
    h = words.hashes()
    assert h[0] == h[5] and len(set(h.tolist())) == 5


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def plain_variants(counts, least=6, often=5, times=5):
    known = {w: n for w, n in counts.items() if len(w) >= least and n >= often}
    near = defaultdict(list)
    for a in known:
        for b in known:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for w in known:
        best = min(near[w], key=lambda x: (-known[x], x), default=None)
        form[w] = best if best and known[best] >= times * known[w] else None
    found = {}
    for w in known:
        root = w
        while form[root]:
            root = form[root]
        found[w] = (form[w], root, known[w], len(near[w]), known.get(form[w]))
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_as_by_brute_force(spark, seed):
    draw = random.Random(seed)
    letters = ["ab", "abcdefgh", "aéÿxyz"][seed - 1]
    counts = Counter()
    for _ in range(250):
        word = "".join(draw.choice(letters) for _ in range(draw.randrange(4, 12)))
        counts[word] += int(5 ** draw.uniform(0, 6))
        for _ in range(draw.randrange(4)):
            at, kind = draw.randrange(len(word)), draw.randrange(3)
            put = draw.choice(letters) if kind else ""
            word = word[:at] + put + word[at + (kind != 1) :]
            counts[word] += int(5 ** draw.uniform(0, 4))
    rows = [*counts.items(), (None, 100), ("", 50), ("twotimes", 3), ("twotimes", 4)]
    counts["twotimes"] = 7
    df = crowded(spark.createDataFrame(rows, "word string, n long").repartition(3))
    got = spelling.variants(df).collect()
    assert {r["word"]: tuple(r)[1:] for r in got} == plain_variants(counts)
    assert len(got) == len({r["word"] for r in got})
    assert spelling.variants(df.limit(0)).count() == 0


def test_chains_of_forms_end_at_their_root(spark):
    word, rows = "abcdefghijkl", []
    for k in range(9):
        rows.append((word[: 12 - k] if k < 6 else "z" * k + word[6:], 5 ** (10 - k)))
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got[word[:7]] == word and got[word] == word


def test_pivots_do_not_overlap():
    assert spelling.pivots([(1, "ab", 0), (2, "bc", 1), (3, "cd", 2)]) == [0, 2]
    assert spelling.pivots([(1, "bc", 1), (9, "ab", 0), (2, "ef", 4)]) == [1, 4]
    assert spelling.pivots([(5, "ab", 0), (1, "bc", 3), (2, "cd", 4)]) == [0, 3]


def test_counts_of_words(spark):
    import zlib

    rows = [(i, "Straße ÉTUDES études NAÏVETÉ naïveté ordinary-words ORDINARY words12words") for i in range(400)]
    rows += [(None, "ordinary naïveté"), (1, None), (2, ""), (3, "x" * 100_000)]
    expected, lost = Counter(), 0
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
                lost += 1
            if len(run) >= 6:
                expected[run] += 1
    df = crowded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = {r["word"]: r["n"] for r in spelling.word_counts(df, edit=queries.misspelt).collect()}
    assert got == expected and lost > 0
    assert spelling.word_counts(df.limit(0)).count() == 0
