"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of words with a bit for each language answers, for an n-gram, which
languages contain it: the words at its hash places are and-ed. How often each
language's bit comes up in a text, less what chance alone would set, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenlight.llm.common import ship_package, slices

#: Characters in an n-gram; a word is seen with a blank before and after it.
GRAMS = (3, 4)

#: Places at which a Bloom filter is set for each n-gram.
PLACES = 2

#: What stands for a language that can't be told.
UNDETERMINED = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """For every code point its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' n-grams, and which text each is from.

    Everything that is no letter parts words. Works on all texts at once.
    """
    joined = "\x00" + "\x00".join(texts) + "\x00"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letter_table()[code]
    owner_of = np.zeros(len(code), np.int32)
    ends = np.cumsum([1 + len(t) for t in texts])
    owner_of[ends[:-1]] = 1
    owner_of = np.cumsum(owner_of, dtype=np.int32)
    # A run of blanks counts as one; NULs between texts do so too.
    keep = letter != 0
    keep[1:] |= letter[:-1] != 0
    keep[0] = True
    letter, owner_of = letter[keep].astype(np.uint64), owner_of[keep]
    hashes, owners = [], []
    h = letter * _MIX
    for n in range(2, max(GRAMS) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _FOLD + letter[n - 1 :] * _MIX
        if n in GRAMS and len(h):
            # Blanks only at the edges of an n-gram.
            inner = np.ones(len(h), bool)
            for k in range(1, n - 1):
                inner &= letter[k : k + len(h)] != 0
            hashes.append(h[inner])
            owners.append(owner_of[1 : 1 + len(h)][inner])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    found = np.concatenate(hashes)
    found = (found ^ (found >> np.uint64(32))) * _FOLD
    return found ^ (found >> np.uint64(29)), np.concatenate(owners)


@dataclass
class Filters:
    """Bloom filters of all languages: ``words[slice, place]`` holds a bit a language."""

    langs: list[str]
    words: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def of(
        cls, langs: list[str], part: np.ndarray, place: np.ndarray, mask: np.ndarray, bits: int
    ) -> Filters:
        """``mask``: the languages of slice ``part`` whose filters hold ``place``, once each."""
        words = np.zeros((-(-max(len(langs), 1) // 64), 1 << bits), np.uint64)
        words[part, place] = mask
        filled = [
            np.count_nonzero(words[i // 64] & np.uint64(1 << (i % 64))) for i in range(len(langs))
        ]
        return cls(langs, words, (np.array(filled, float) / (1 << bits)) ** PLACES)

    def containing(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram, in each slice of 64 languages, the mask of those containing it."""
        bits = self.words.shape[1].bit_length() - 1
        first, *others = _places(hashes, bits)
        mask = self.words[:, first]
        for place in others:
            mask &= self.words[:, place]
        return mask

    def decide(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language of each text and how sure that is."""
        hashes, owners = grams(texts)
        total = np.bincount(owners, minlength=len(texts)).astype(float)
        mask = self.containing(hashes)
        hits = np.zeros((len(texts), len(self.langs)))
        for i in range(len(self.langs)):
            bit = (mask[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits[:, i] = np.bincount(owners[bit != 0], minlength=len(texts))
        # Of the n-grams a language lacks, its share of false positives shows up too.
        true = (hits - total[:, None] * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9)
        true = np.clip(true, 0, None)
        langs, scores = [], []
        for row, n in zip(true, total, strict=True):
            if not n or not self.langs:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int(row.argmax())
            langs.append(self.langs[best])
            scores.append(float(row[best] / max(row.sum(), 1e-9)) if row[best] else 0.0)
        return langs, scores


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    low = np.uint64((1 << bits) - 1)
    return [((hashes >> np.uint64(k * 28)) & low).astype(np.int64) for k in range(PLACES)]


def _count_grams(batches) -> Iterator:
    """For each slice of texts and language: each n-gram's hash and count."""
    import pyarrow as pa

    for part in slices(batches):
        hashes, owners = grams([t or "" for t in part["text"]])
        names = sorted(set(part["lang"]))
        lang = np.array([names.index(x) for x in part["lang"]])
        for i, name in enumerate(names):
            found, counts = np.unique(hashes[lang[owners] == i], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(found), pa.string()),
                    pa.array(found.view(np.int64)),
                    pa.array(counts.astype(np.int64)),
                ],
                names=["lang", "gram", "n"],
            )


def train(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    rows_per_language: int = 4000,
    least_share: float = 2e-6,
    rival: float = 0.2,
    bits: int = 21,
) -> Filters:
    """Filters of the languages of ``docs``, learnt from text and non-null ``lang`` only.

    Fits on about ``rows_per_language`` rows of each language, chosen by a hash
    of their text; a language with fewer gives all. A language contains an
    n-gram if that makes up ``least_share`` of its n-grams and ``rival`` of the
    share in any other language, which keeps names, quotes and words from
    elsewhere out. Spark sets the bits; at most ``2 ** bits`` words for each 64
    languages, which are the filters, come to the driver.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    names = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not names:
        return Filters.of([], *(np.zeros(0, np.int64) for _ in range(3)), bits)
    shares = F.create_map(
        *(F.lit(x) for k, n in names.items() for x in (k, min(1.0, rows_per_language / n)))
    )
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.where(draw < shares[F.col("lang")])
    counted = chosen.mapInArrow(_count_grams, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    per_gram = counted.groupBy("gram").agg(
        F.collect_list(F.struct("lang", "n")).alias("langs")
    )
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()
    total = {k: 1 for k in names} | {r["lang"]: r["n"] for r in totals}
    langs = sorted(names)
    sums = F.create_map(*(F.lit(x) for k in langs for x in (k, float(total[k]))))
    with_shares = per_gram.withColumn(
        "langs",
        F.transform(
            "langs",
            lambda x: F.struct(x["lang"].alias("lang"), (x["n"] / sums[x["lang"]]).alias("share")),
        ),
    ).withColumn("most", F.array_max(F.transform("langs", lambda x: x["share"])))
    holding = with_shares.select(
        "gram",
        F.filter(
            "langs", lambda x: (x["share"] >= least_share) & (x["share"] >= rival * F.col("most"))
        )
        .getField("lang")
        .alias("langs"),
    ).where(F.size("langs") > 0)
    index = F.create_map(*(F.lit(x) for i, k in enumerate(langs) for x in (k, i)))
    low = F.lit((1 << bits) - 1)
    places = [F.shiftrightunsigned("gram", 28 * k).bitwiseAND(low) for k in range(PLACES)]
    held = holding.select("gram", F.explode("langs").alias("lang")).select(
        index[F.col("lang")].alias("index"), F.explode(F.array(*places)).alias("place")
    )
    bit = F.expr("shiftleft(1L, index % 64)")
    table = (
        held.groupBy(F.expr("index div 64").alias("part"), "place")
        .agg(F.bit_or(bit).alias("mask"))
        .toPandas()
    )
    part, place = (table[c].to_numpy(np.int64) for c in ("part", "place"))
    return Filters.of(langs, part, place, table["mask"].to_numpy(np.int64).view(np.uint64), bits)


def identify(
    docs: DataFrame, filters: Filters, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text alone.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter.
    Ties go to the first language by name; a text that no language's n-grams
    meet gets that one too, with score 0. The score is the language's part of
    all true hits. Repeated rows and other columns need no care.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def decided(batches):
        import pyarrow as pa

        for part in slices(batches):
            langs, scores = sent.value.decide([t or "" for t in part["text"]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(part["doc_id"], arrow), pa.array(langs), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return rows.mapInArrow(decided, schema)
