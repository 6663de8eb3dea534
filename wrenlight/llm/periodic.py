"""Runs: stretches of words that repeat with a period, and texts without the repeats.

For every octave of periods, L to 2L - 1, a text is cut into tiles of many boundaries,
L words apart. A stretch that repeats with such a period has at least L places whose
word is the same a period later, so it holds a boundary. From each boundary, how far the
text and the text a period later agree to the right and to the left (the values of the
Z-functions of the two halves at that period) gives a fragment of the stretch. Fragments
of one text and period are stitched together; of equal stretches the smallest
period counts.

Nearly all pairs of a boundary and a period fail at once: one of the two values must be
half an octave, so a hash of so many words must agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenlight.llm.common import ship_package
from wrenlight.llm.near_dedup import mixed
from wrenlight.llm.words import Words, text_bytes, text_slices
from wrenlight.sources.scratch import scratch_path

#: Words in a run, at least; it also holds two periods.
LEAST = 12

#: Words whose boundaries a tile holds (a power of two). Longer texts have several tiles.
TILE = 1 << 18

#: Bytes of text that are looked at together.
SLICE_BYTES = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)


def boundary_matches(
    x: np.ndarray, octaves: list[int], sizes: list[int], low: int, high: int
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each octave L: ``period, start, stop, L`` of fragments ``[start, stop)`` of places
    whose element is the same a period later.

    Boundaries are the multiples of L from ``low`` (one of them) to below ``high``;
    of octave k only the first ``sizes[k]`` elements count. Fragments of one
    period that touch are one. Elements differ wherever a stretch must not go on.
    """
    widest = octaves[-1]
    lead = widest
    ladder = [
        np.concatenate(
            [
                mixed(np.arange(lead, dtype=np.uint64) + np.uint64(1 << 62)),
                x,
                mixed(np.arange(5 * widest, dtype=np.uint64) + np.uint64(1 << 63)),
            ]
        )
    ]
    found = []
    for octave, size in zip(octaves, sizes, strict=True):
        half = max(octave // 2, 1)
        while 1 << len(ladder) - 1 < half:
            last, width = ladder[-1], 1 << len(ladder) - 1
            wider = last.copy()
            wider[:-width] = mixed((last[:-width] ^ (last[:-width] << np.uint64(7))) * _STEP + last[width:])
            ladder.append(wider)
        g = ladder[half.bit_length() - 1]
        rows = -(-(min(high, size) - low) // octave)
        if rows <= 0:
            continue
        at = lead + low

        def ahead(shift: int, g=g, at=at, rows=rows, octave=octave) -> np.ndarray:
            """Where the hash at a boundary is the one a period later, all moved by ``shift``."""
            later = g[at + octave + shift : at + octave + shift + rows * octave]
            here = g[at + shift : at + shift + rows * octave : octave]
            return later.reshape(rows, octave) == here[:, None]

        row, more = np.nonzero(ahead(0) | ahead(-half))
        b, p = at + row * octave, octave + more
        right, left = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
        for level in range(half.bit_length() - 1, -1, -1):
            h, step = ladder[level], 1 << level
            right += step * (h[b + right] == h[b + p + right])
            left += step * (h[b - left - step] == h[b + p - left - step])
        start, stop = b - left - lead, b + right - lead
        order = np.lexsort((start, p))
        p, start, stop = p[order], start[order], stop[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (start[1:] > stop[:-1])
        first = np.flatnonzero(new)
        found.append((p[first], start[first], stop[np.append(first[1:], len(p)) - 1] if len(p) else stop, octave))
    return found


def _smallest(p: np.ndarray, start: np.ndarray, stop: np.ndarray, least: int) -> tuple:
    """Of whole stretches those that are runs, each with its smallest period."""
    keep = stop - start >= np.maximum(p, least - p)
    p, start, stop = p[keep], start[keep], stop[keep]
    order = np.lexsort((p, stop + p, start))
    p, start, stop = p[order], start[order], stop[order]
    new = np.ones(len(p), bool)
    new[1:] = (start[1:] != start[:-1]) | ((stop + p)[1:] != (stop + p)[:-1])
    return p[new], start[new], stop[new]


def _octaves(words: int) -> list[int]:
    return [1 << k for k in range(max(words // 2, 1).bit_length())]


def short_fragments(x: np.ndarray, first: np.ndarray, least: int) -> tuple:
    """``text, period, start, stop`` of the runs of texts in one tile.

    The texts are laid out by falling length, so that those long enough for an
    octave come first.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    laid = np.concatenate([[0], np.cumsum(sizes[order])])
    owner = np.repeat(order, sizes[order])
    within = np.arange(laid[-1]) - np.repeat(laid[:-1], sizes[order])
    # The text goes into the element, so that no stretch goes on into the next.
    y = mixed(x[first[owner] + within] + mixed(owner.astype(np.uint64)))
    octaves = _octaves(int(sizes.max(initial=0)))
    # Texts of at least so many words can hold two periods and the least length.
    able = [int(laid[np.searchsorted(-sizes[order], -max(2 * o, least), "right")]) for o in octaves]
    parts = boundary_matches(y, octaves, able, 0, len(y)) if len(y) else []
    p, start, stop = (
        np.concatenate([part[k] for part in parts] or [np.zeros(0, np.int64)]) for k in range(3)
    )
    p, start, stop = _smallest(p, start, stop, least)
    return owner[start], p, within[start], within[start] + stop - start


def long_fragments(x: np.ndarray, least: int, tile: int) -> tuple:
    """``period, start, stop`` of fragments of one text in many tiles, not yet stitched."""
    octaves = _octaves(len(x))
    together = [o for o in octaves if 4 * o <= tile]
    found = []
    for group in [together, *([o] for o in octaves[len(together) :])]:
        if not group:
            continue
        core, margin = max(tile, 4 * group[-1]), group[-1]
        for low in range(0, len(x), core):
            a = max(0, low - margin)
            part = x[a : low + core + 4 * margin]
            high = min(low + core, len(x)) - a
            sizes = [len(part)] * len(group)
            for p, start, stop, octave in boundary_matches(part, group, sizes, low - a, high):
                goes_on = (start <= low - a - octave + 1) & (low > 0) | (stop >= high - 1)
                whole = _smallest(p[~goes_on], start[~goes_on], stop[~goes_on], least)
                for q, s, e in (whole, (p[goes_on], start[goes_on], stop[goes_on])):
                    found.append((q, s + a, e + a))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _solve(least: int, tile: int):
    """Map task: each text's words and the fragments of its runs."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in text_slices(batches, SLICE_BYTES):
            words = Words.of(text_bytes(batch.column("text")))
            x, first = words.hashes(), words.first
            sizes = np.diff(first)
            if sizes.max(initial=0) > tile:
                # Slices hold several texts only if all are short.
                parts = [
                    (np.full(len(f[0]), k), *f)
                    for k in range(len(sizes))
                    if sizes[k]
                    for f in [long_fragments(x[first[k] : first[k + 1]], least, tile)]
                ]
                text, p, start, stop = (np.concatenate([q[c] for q in parts]) for c in range(4))
            else:
                text, p, start, stop = short_fragments(x, first, least)
            order = np.argsort(text, kind="stable")
            ends = np.searchsorted(text[order], np.arange(len(sizes) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays(
                [pa.array(v[order].astype(np.int64)) for v in (p, start, stop)],
                names=["period", "start", "stop"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    words.joined(np.ones(len(x), bool)),
                    pa.array(sizes.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), spans),
                ],
                names=["id", "text", "n_words", "fragments"],
            )

    return run


SOLVED = (
    "id string, text string, n_words long,"
    " fragments array<struct<period:long,start:long,stop:long>>"
)
RUNS = "array<struct<start:long,length:long,period:long>>"


def _collapse(batches) -> Iterator:
    """Map task: texts without the words of runs that repeat an earlier period."""
    import pyarrow as pa

    for batch in text_slices(batches, SLICE_BYTES):
        words = Words.of(text_bytes(batch.column("text")))
        change = np.zeros(len(words.starts) + 1, np.int64)
        for k, runs in enumerate(batch.column("runs").to_pylist()):
            for r in runs:
                at = words.first[k] + r["start"]
                change[at + r["period"]] += 1
                change[at + r["length"]] -= 1
        kept = words.joined(np.cumsum(change[:-1]) == 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), kept, batch.column("n_words"), batch.column("runs")],
            names=["id", "collapsed", "n_words", "runs"],
        )


def stitched(fragments: DataFrame, least: int = LEAST) -> DataFrame:
    """``row, start, length, period`` of each run of ``row, period, start, stop``.

    A long text's fragments of one period lie in one group; there are a few for each tile.
    """
    by = Window.partitionBy("row", "period").orderBy("start", "stop")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    numbered = fragments.withColumn("new", new).withColumn("part", F.sum("new").over(by))
    whole = numbered.groupBy("row", "period", "part").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop")
    )
    length = F.col("stop") - F.col("start") + F.col("period")
    return (
        whole.where(length >= F.greatest(F.lit(least), 2 * F.col("period")))
        .groupBy("row", "start", length.alias("length"))
        .agg(F.min("period").alias("period"))
    )


def runs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    tile: int = TILE,
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs``.

    ``runs`` lists ``start, length, period`` by start, then period, in words from 0: the
    stretches of at least ``least`` words and two periods that no neighbouring word
    extends, each with its smallest period. ``collapsed`` has the words, joined by one
    blank, less those that any run holds after its first period.

    A null text has no words, nor has one of blanks only; both collapse to an
    empty text. Null and repeated ids, and repeated rows, are rows of their own. Other
    columns are ignored; an empty table gives no rows.

    Words are compared by 64-bit hashes within one text. Only texts with
    fragments are shuffled, and fragments of longer texts than ``tile`` words
    meet by text and period.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    path = scratch_path(spark, "periodic")
    solved = rows.mapInArrow(_solve(least, tile), SOLVED)
    solved = solved.withColumn("row", F.monotonically_increasing_id())
    solved.write.option("compression", "zstd").parquet(path)
    solved = spark.read.schema(solved.schema).parquet(path)
    plain = solved.where(F.size("fragments") == 0).select(
        "id", F.col("text").alias("collapsed"), "n_words", F.array().cast(RUNS).alias("runs")
    )
    some = solved.where(F.size("fragments") > 0)
    fragments = some.select("row", F.explode("fragments").alias("f")).select("row", "f.*")
    listed = (
        stitched(fragments, least)
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
        .select("row", F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])).alias("runs"))
    )
    met = some.select("row", "id", "text", "n_words").join(listed, "row", "left")
    empty = F.array().cast(RUNS)
    wide = met.select("id", "text", "n_words", F.coalesce("runs", empty).alias("runs"))
    done = wide.mapInArrow(_collapse, f"id string, collapsed string, n_words long, runs {RUNS}")
    return plain.unionByName(done).select(
        F.col("id").cast(kind).alias(doc_id), "n_words", "runs", "collapsed"
    )
