"""Spelling variants: words one edit apart, found by pivotal grams.

Each word's bigrams are ordered from rare to common. The rarest three are its prefix, and
dynamic programming picks two of them that don't overlap, its pivots. One edit
leaves one pivot whole, and of two words an edit apart, the one whose prefix ends first
in that order has a whole pivot in the other's prefix. The edit lies on one side of it, so
the other side is equal too, up to the gram, and the lengths differ by one at most:
these position limits make the key under which pivots meet prefixes. What meets is
verified.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenlight.llm.common import ship_package
from wrenlight.llm.words import text_bytes, text_slices
from wrenlight.sources.scratch import stored

#: Code points of a word, and how often it occurs, at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5

#: By how much more often the standard form of a word occurs, at least.
TIMES = 5

#: Edits, bigrams in a prefix (one edit spoils two) and pivots (one must stay whole).
EDITS = 1
PREFIX = 2 * EDITS + 1
PIVOTS = EDITS + 1

#: Places of the table that counts bigrams. Bigrams of one place only share their rank.
GRAM_PLACES = 1 << 16

#: A task sends its counts after so many distinct words.
FLUSH = 400_000

SLICE_BYTES = 4 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _count(least: int, edit: Callable | None):
    """Map task: how often each word occurs."""

    def run(batches) -> Iterator:
        import re

        import pyarrow as pa

        runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)
        found: Counter = Counter()

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                names=["word", "n"],
            )

        for part in text_slices(batches, SLICE_BYTES):
            ids = part.column("id").to_pylist()
            for doc, text in zip(ids, text_bytes(part.column("text")), strict=True):
                if not text:
                    continue
                words = runs.findall(text.translate(_LOWER).decode("utf-8", "replace"))
                if edit is None:
                    found.update(words)
                    continue
                for word, n in edit(doc, Counter(words)):
                    if len(word) >= least:
                        found[word] += n
            if len(found) >= FLUSH:
                yield batch()
                found.clear()
        if found:
            yield batch()

    return run


def word_counts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = LEAST_LENGTH,
    edit: Callable | None = None,
) -> DataFrame:
    """``word, n``: how often each word of at least ``least`` code points occurs in ``docs``.

    A word is a longest stretch of letters from A to Z and from U+00C0 to U+00FF, of
    which only A to Z become lower case. ``edit`` may change them: it gets a
    row's id as text (null stays null) and the counts of its words, and gives words
    and counts. A null text has no words; an empty table gives no rows; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_count(least, edit), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def gram_place(a: str, b: str) -> int:
    return (ord(a) * 1021 + ord(b)) % GRAM_PLACES


def _gram_counts(batches) -> Iterator:
    """Map task: how many bigrams of the words fall to each place of the table."""
    import pyarrow as pa

    counts = np.zeros(GRAM_PLACES, np.int64)
    for batch in batches:
        words = batch.column("word").to_pylist()
        code = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), "<u4").astype(np.int64)
        place = (code[:-1] * 1021 + code[1:]) % GRAM_PLACES
        counts += np.bincount(place[(code[:-1] > 0) & (code[1:] > 0)], minlength=GRAM_PLACES)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["place", "n"])


def pivots(prefix: list[tuple[int, str, int]], many: int = PIVOTS) -> list[int]:
    """Places of ``many`` bigrams of ``rank, gram, place`` that don't overlap, the rarest in sum."""
    by_place = sorted(prefix, key=lambda g: g[2])
    # best[c][k]: the lowest sum of c of the first k bigrams, and their places.
    best = [[(0, [])] * (len(by_place) + 1)]
    for c in range(1, many + 1):
        row: list = [None]
        for k, (rank, _, place) in enumerate(by_place, 1):
            before = sum(p <= place - 2 for _, _, p in by_place[: k - 1])
            rest = best[c - 1][before]
            taken = None if rest is None else (rest[0] + rank, [*rest[1], place])
            row.append(min((x for x in (row[-1], taken) if x is not None), default=None))
        best.append(row)
    return best[many][-1][1]


def _letters(word: str) -> int:
    """A bit for each letter, as a signed number. One edit changes two at most."""
    bits = 0
    for letter in word:
        bits |= 1 << (ord(letter) * 37 % 64)
    return bits - (1 << 64) if bits >> 63 else bits


def _index(counts: np.ndarray):
    """Map task: the keys of each word's pivots and of its prefix."""

    def keys(word: str, place: int) -> tuple[str, str]:
        return "<" + word[: place + 2], ">" + word[place:]

    def run(batches) -> Iterator:
        import pyarrow as pa
        import xxhash

        rank = counts.tolist()
        names = ["pivot", "key", "word", "n", "last", "letters"]
        kinds = [pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

        def hashed(side: str, length: int) -> int:
            value = xxhash.xxh3_64_intdigest(side.encode(), length)
            return value - (1 << 64) if value >> 63 else value

        for batch in batches:
            rows = []
            pairs = zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True)
            for word, n in pairs:
                grams = sorted(
                    (rank[gram_place(word[i], word[i + 1])], word[i : i + 2], i)
                    for i in range(len(word) - 1)
                )
                prefix, size = grams[:PREFIX], len(word)
                end, letters = prefix[-1][:2], _letters(word)
                for place in pivots(prefix):
                    for side in keys(word, place):
                        for length in range(size - EDITS, size + EDITS + 1):
                            rows.append((True, hashed(side, length), word, n, end[0], letters))
                for gram in grams:
                    if gram[:2] > end:
                        break
                    for side in keys(word, gram[2]):
                        rows.append((False, hashed(side, size), word, n, end[0], letters))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

    return run


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: both ways, the pairs of ``words`` one edit apart.

    ``words`` has distinct words of four code points at least and is read more
    than once. A pair may come several times.
    """
    spark = words.sparkSession
    ship_package(spark)
    grams = words.select("word").mapInArrow(_gram_counts, "place long, n long")
    # At most GRAM_PLACES rows come to the driver.
    table = grams.groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(GRAM_PLACES, np.int64)
    counts[table["place"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    index = words.select("word", "n").mapInArrow(
        _index(counts), "pivot boolean, key long, word string, n long, last long, letters long"
    )
    index = stored(index, "spelling-index")
    pivot = index.where("pivot").drop("pivot").alias("p")
    prefix = index.where("NOT pivot").drop("pivot").alias("q")
    met = (
        (F.col("p.key") == F.col("q.key"))
        & (F.col("q.last") >= F.col("p.last"))
        & (F.bit_count(F.col("p.letters").bitwiseXOR(F.col("q.letters"))) <= 2 * EDITS)
        & (F.col("p.word") != F.col("q.word"))
        & (F.levenshtein(F.col("p.word"), F.col("q.word"), EDITS) >= 0)
    )
    found = pivot.join(prefix, met)

    def pair(a: str, b: str) -> Column:
        return F.struct(
            F.col(f"{a}.word").alias("word"),
            F.col(f"{a}.n").alias("n"),
            F.col(f"{b}.word").alias("other"),
            F.col(f"{b}.n").alias("other_n"),
        )

    return found.select(F.explode(F.array(pair("p", "q"), pair("q", "p"))).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for each row ``word, form``: the last of the chain of forms.

    Each round doubles how far a row looks. A form occurs several times as often as
    its word, so chains are short.
    """
    found = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = found.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        further = stored(further, "spelling-roots")
        found = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            return found


def variants(
    words: DataFrame,
    least: int = LEAST_LENGTH,
    often: int = LEAST_COUNT,
    times: int = TIMES,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``word, n``.

    Counted are words of at least ``least`` code points (four or more) that occur ``often``
    times; the counts of a repeated word are summed, and null words are left out. Near
    words are one inserted, deleted or replaced code point apart; ``n_near`` is their
    number. The form of a word is the near word that occurs most often (of equals the
    first in code-point order) if it occurs ``times`` times as often as the word, else
    null. The root is the last of the chain of forms, or the word. Other columns
    are ignored; an empty table gives no rows.
    """
    if least < PREFIX + 1:
        raise ValueError(f"words need {PREFIX + 1} code points at least")
    known = words.where(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))
    known = stored(known.where(F.col("n") >= often), "spelling-words")
    others = F.collect_set(F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("word")))
    near = near_words(known).groupBy("word").agg(others.alias("near"))
    best = F.array_min("near")
    near = near.select(
        "word",
        F.size("near").cast("long").alias("n_near"),
        best["word"].alias("best"),
        (-best["rank"]).alias("best_n"),
    )
    enough = F.col("best_n") >= times * F.col("n")
    formed = known.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best")).alias("form"),
        F.when(enough, F.col("best_n")).alias("form_n"),
    )
    formed = stored(formed, "spelling-forms")
    last = roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
