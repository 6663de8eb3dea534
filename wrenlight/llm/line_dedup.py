"""Fuzzy line de-duplication: MinHash bands, exact Jaccard similarity, union-find.

Bands travel packed: a task sends, by hash range, what its lines' bands are, and with each the
line's hash and one bit of each MinHash value. Where the bands of different lines
meet and those bits don't tell them apart, the lines are members of a bucket. Only such
lines' texts are fetched, and only pairs that share a bucket are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from wrenlight.llm.common import SLICE_CHARS, join_counted, ship_package, slices
from wrenlight.llm.linking import link_buckets
from wrenlight.llm.near_dedup import mixed
from wrenlight.llm.words import text_slices
from wrenlight.sources.scratch import stored

#: Characters in a shingle. A shorter line is compared as a whole.
CHARS = 5

#: Jaccard similarity of shingle sets from which lines are the same.
SIMILARITY = 0.8

#: Hashes in a band and bands: of pairs at the least similarity 99.4 % share a band.
ROWS, BANDS = 5, 13

#: Of so many bits, one of each MinHash value, similar lines differ in this many at most: at the
#: least similarity a tenth differs, and this lies five standard deviations above.
SKETCH, SKETCH_APART = 64, 18

#: Characters whose signatures are worked out at a time.
BLOCK_CHARS = 250_000

#: A task sends its bands after so many lines.
FLUSH = 40_000

#: A band that more lines of a flush share is sent once; its lines are members at once.
OFTEN = 32

#: Bands of one hash range, about: so many are met in one task's memory.
RANGE_BANDS = 600_000

#: Characters for each band, about; it only decides into how many ranges they are cut.
CHARS_A_BAND = 25

#: Bits of the maps that tell which lines' texts are wanted and which rows change. When
#: they fill up, more than needed is moved, to the same result.
WANTED_BITS = 24

_STEP = 0x9E3779B97F4A7C15


def line_hash(line: str) -> int:
    """64 bits of a line, as a signed number."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def shingles(lines: list[str], chars: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of lines of at least ``chars`` characters, and where each line's start."""
    sizes = np.array([len(x) for x in lines])
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a[: len(b)] * np.uint64(_STEP) + b
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    one = code.astype(np.uint64)
    h, width = one, 1
    while 2 * width <= chars:
        h, width = joined(h, h[width:]), 2 * width
    for k in range(width, chars):
        h = joined(h, one[k:])
    ends = np.cumsum(sizes)
    whole = np.ones(len(code), bool)
    for k in range(chars - 1):
        whole[ends - 1 - k] = False
    return h[whole[: len(h)]], np.concatenate([[0], np.cumsum(sizes - chars + 1)[:-1]])


def signatures(lines: list[str], chars: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and the sketch of each line of at least ``chars`` characters."""
    found = np.empty((len(lines), BANDS), np.uint64)
    sketch = np.zeros(len(lines), np.uint64)
    start = size = 0
    for end, line in enumerate(lines, 1):
        size += len(line)
        # Short enough for the processor's cache, long enough for numpy.
        if size >= BLOCK_CHARS or end == len(lines):
            _signatures(lines[start:end], found[start:end], sketch[start:end], chars)
            start, size = end, 0
    return found, sketch


def _signatures(lines: list[str], found: np.ndarray, sketch: np.ndarray, chars: int) -> None:
    hashes, starts = shingles(lines, chars)
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    v = np.empty_like(values)
    seeds = mixed(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64)).astype(np.uint32)
    for b in range(BANDS):
        band = np.full(len(lines), b, np.uint64)
        for r in range(ROWS):
            k = b * ROWS + r
            np.bitwise_xor(values, seeds[2 * k], out=v)
            np.multiply(v, seeds[2 * k + 1] | np.uint32(1), out=v)
            least = np.minimum.reduceat(v, starts).astype(np.uint64)
            band = mixed(band + np.uint64(_STEP)) + least
            if k < SKETCH:
                sketch |= (mixed(least + np.uint64(k)) & np.uint64(1)) << np.uint64(k)
        found[:, b] = mixed(band)


def _cut(names: list[str]):
    """Map task: every line that isn't blank."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for part in text_slices(batches, SLICE_CHARS):
            at, places, hashes = [], [], []
            for k, text in enumerate(part.column("text").to_pylist()):
                for place, line in enumerate(text.split("\n")):
                    if line and not line.isspace():
                        at.append(k)
                        places.append(place)
                        hashes.append(line_hash(line))
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row").take(taken),
                    part.column("id").take(taken),
                    pa.array(places, pa.int32()),
                    pa.array(hashes, pa.int64()),
                ],
                names=names,
            )

    return run


PACKED = "deal long, hashes binary, lines binary, sketches binary, often binary"
_ALL = np.uint64((1 << 40) - 1)


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _packed(lines: list[str], hashes: list[int], chars: int, groups: int, own: int) -> Iterator:
    """The bands of different lines as ``PACKED`` rows; ``own`` is a range of the task's own."""
    found, sketch = signatures(lines, chars)
    named = np.array(hashes, np.int64)
    hashed, line = found.ravel(), np.repeat(np.arange(len(lines)), BANDS)
    order = np.argsort(hashed)
    hashed, line = hashed[order], line[order]
    # The range is the hash's top, so it ascends too; what is sent lies below.
    group = ((hashed >> np.uint64(40)) * np.uint64(groups) >> np.uint64(24)).astype(np.int64)
    low = hashed & _ALL
    new = np.ones(len(low), bool)
    new[1:] = hashed[1:] != hashed[:-1]
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(low))) > OFTEN
    often = np.repeat(many, np.diff(np.append(first, len(low))))
    if often.any():
        bucket = _bucket(group[often], low[often])
        yield own, bucket.tobytes(), named[line[often]].tobytes(), b"", b""
    hot = first[many]
    sent = np.flatnonzero(~often)
    ends = np.searchsorted(group[sent], np.arange(groups + 1))
    hot_ends = np.searchsorted(group[hot], np.arange(groups + 1))
    for g in np.flatnonzero((np.diff(ends) > 0) | (np.diff(hot_ends) > 0)):
        at, more = sent[ends[g] : ends[g + 1]], hot[hot_ends[g] : hot_ends[g + 1]]
        yield (
            int(g),
            _five(low[at]),
            named[line[at]].tobytes(),
            sketch[line[at]].tobytes(),
            _five(low[more]),
        )


def _bucket(group: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mixed((np.asarray(group).astype(np.uint64) << np.uint64(40)) | low).view(np.int64)


def _bands(chars: int, groups: int):
    """Map task: the bands of lines, each line where it comes first in the flush."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen: set[int] = set()
        lines, hashes, flushes = [], [], 0

        def batch():
            nonlocal flushes
            flushes += 1
            rows = list(_packed(lines, hashes, chars, groups, -1 - (task << 24 | flushes)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=["deal", "hashes", "lines", "sketches", "often"],
            )

        for part in slices(batches):
            for text in part["text"]:
                for line in text.split("\n"):
                    if len(line) < chars or line.isspace():
                        continue
                    h = line_hash(line)
                    if h not in seen:
                        seen.add(h)
                        lines.append(line)
                        hashes.append(h)
            if len(lines) >= FLUSH:
                yield batch()
                lines, hashes = [], []
                if len(seen) > 300_000:
                    seen.clear()
        if lines:
            yield batch()

    return run


def _alike(sketches: np.ndarray) -> np.ndarray:
    """Which of the lines of a bucket have another that their sketch doesn't tell apart."""
    found = np.zeros(len(sketches), bool)
    for start in range(0, len(sketches), 512):
        apart = np.bitwise_count(sketches[start : start + 512, None] ^ sketches[None, :])
        near = apart <= SKETCH_APART
        found[start : start + 512] |= near.sum(1) > 1
    return found


def _meet(table):
    """Group task: ``bucket, id`` of the lines that share a band of one hash range."""
    import pyarrow as pa

    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    if columns["deal"][0] < 0:
        bucket = np.frombuffer(b"".join(columns["hashes"]), np.int64)
        line = np.frombuffer(b"".join(columns["lines"]), np.int64)
        return pa.table({"bucket": bucket, "id": line})
    low = _from_five(b"".join(columns["hashes"]))
    line = np.frombuffer(b"".join(columns["lines"]), np.int64)
    sketch = np.frombuffer(b"".join(columns["sketches"]), np.uint64)
    often = np.unique(_from_five(b"".join(columns["often"])))
    order = np.argsort(low)
    low = low[order]
    # Most bands are of one line alone.
    shared = np.isin(low, often) if len(often) else np.zeros(len(low), bool)
    same = low[1:] == low[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    order, low = order[shared], low[shared]
    line, sketch = line[order], sketch[order]
    order = np.lexsort((line, low))
    low, line, sketch = low[order], line[order], sketch[order]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != low[:-1]) | (line[1:] != line[:-1])
    low, line, sketch = low[keep], line[keep], sketch[keep]
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(low)))
    member = np.repeat(np.isin(low[first], often), size)
    two = first[size == 2]
    near = two[np.bitwise_count(sketch[two] ^ sketch[two + 1]) <= SKETCH_APART]
    member[near] = member[near + 1] = True
    for at, n in zip(first[size > 2], size[size > 2], strict=True):
        if not member[at]:
            member[at : at + n] = _alike(sketch[at : at + n])
    bucket = _bucket(np.full(member.sum(), columns["deal"][0]), low[member])
    return pa.table({"bucket": bucket, "id": line[member]})


def _fetch(wanted: np.ndarray, chars: int):
    """Map task: the texts of lines whose bit is set in ``wanted``."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        masks = wanted.tolist()
        for part in slices(batches):
            found = {}
            for text in part["text"]:
                for line in text.split("\n"):
                    if len(line) < chars:
                        continue
                    h = line_hash(line)
                    bit = h & ((1 << WANTED_BITS) - 1)
                    if masks[bit >> 6] >> (bit & 63) & 1 and h not in seen:
                        found[h] = line
                        seen.add(h)
            if len(seen) > 300_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())],
                names=["line", "body"],
            )

    return run


def loaded(lines: list[str], chars: int = CHARS) -> list[np.ndarray]:
    """Lines as the sets of their shingles' hashes, ascending."""
    found = []
    for start in range(0, len(lines), 1024):
        hashes, starts = shingles(lines[start : start + 1024], chars)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(hashes)], strict=True):
            part = np.sort(hashes[a:b])
            new = np.empty(len(part), bool)
            new[0] = True
            np.not_equal(part[1:], part[:-1], out=new[1:])
            found.append(part[new])
    return found


def line_classes(
    rows: DataFrame, similarity: float = SIMILARITY, chars: int = CHARS
) -> DataFrame:
    """``id, class`` for each line hash of the texts of ``rows`` that is linked to another."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(partitions, 1 + size // (CHARS_A_BAND * RANGE_BANDS))
    sent = rows.select("text").mapInArrow(_bands(chars, groups), PACKED)
    met = sent.groupBy("deal").applyInArrow(_meet, "bucket long, id long")
    members = stored(met, "line-members")
    texts = _texts(rows, members.select(F.col("id").alias("line")), chars)
    return link_buckets(members, texts, partial(loaded, chars=chars), similarity)


def _word_and_bit(hashed: Column) -> tuple[Column, Column]:
    """Where the bit of a hash lies in a map of ``WANTED_BITS`` bits of 64 each."""
    bit = hashed.bitwiseAND(F.lit((1 << WANTED_BITS) - 1))
    return F.shiftright(bit, 6), bit.bitwiseAND(F.lit(63)).cast("int")


def _bit_map(hashes: DataFrame, column: str) -> DataFrame:
    """``word, mask`` of the bits of the hashes, at most 2^(``WANTED_BITS`` - 6) rows."""
    word, bit = _word_and_bit(F.col(column))
    bits = hashes.select(word.alias("word"), bit.alias("bit"))
    return bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))


def _texts(rows: DataFrame, wanted: DataFrame, chars: int) -> DataFrame:
    """``id, body`` for all wanted lines.

    A map of a fixed number of bits goes to the scan, so that only texts that
    may be wanted are moved.
    """
    lines = stored(wanted.distinct(), "line-wanted")
    table = _bit_map(lines, "line").toPandas()
    bits_set = np.zeros(1 << (WANTED_BITS - 6), np.uint64)
    bits_set[table["word"].to_numpy()] = table["mask"].to_numpy(np.int64).view(np.uint64)
    found = rows.select("text").mapInArrow(_fetch(bits_set, chars), "line long, body string")
    texts = found.join(lines, "line", "left_semi").dropDuplicates(["line"])
    return stored(texts.withColumnRenamed("line", "id"), "line-texts")


def deduplicated(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    chars: int = CHARS,
) -> DataFrame:
    """``docs`` with one line kept of each class, and ``n_lines, n_kept`` for every row.

    Lines are in one class if they are equal, or if a chain of lines joins them
    with a Jaccard similarity of their shingles of ``chars`` characters of at
    least ``similarity``. The line of the smallest id, and in it the first, stays; the
    others go, with their line breaks. Blank lines stay and are not counted;
    lines under ``chars`` characters are only compared as a whole.

    A null text stays null and has no lines; a null id counts as the smallest;
    ids may be of any type with an order. Repeated rows share what happens to them.
    Other columns are kept as they are, whatever their names, but for ``n_lines``
    and ``n_kept``, which are replaced. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    id_type = docs.schema[doc_id].dataType
    # The given columns travel as one, so that no name can clash.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_given")).select(
        "_given",
        F.col("_given")[doc_id].alias("id"),
        F.coalesce(F.col("_given")[text], F.lit("")).alias("text"),
        F.xxhash64(F.col("_given")[doc_id], F.col("_given")[text]).alias("row"),
    )
    rows = whole.select("row", "id", "text")
    fields = [("row", LongType()), ("id", id_type), ("place", IntegerType()), ("line", LongType())]
    schema = StructType([StructField(name, kind) for name, kind in fields])
    lines = stored(rows.mapInArrow(_cut([name for name, _ in fields]), schema), "lines")
    here = F.struct("id", "place", "row")
    distinct = lines.groupBy("line").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n"))
    linked = line_classes(rows, similarity, chars)
    firsts = stored(
        distinct.join(linked.withColumnRenamed("id", "line"), "line", "left").where(
            "n > 1 OR class IS NOT NULL"
        ),
        "line-firsts",
    )
    total = lines.count()
    named = firsts.withColumn("class", F.coalesce("class", "line"))
    kept = stored(
        named.groupBy("class").agg(F.min("first").alias("keep"), F.count(F.lit(1)).alias("lines")),
        "line-kept",
    )
    ruled = join_counted(named, kept, "class", "lines", total, F.xxhash64("line"))
    ruled = stored(ruled.select("line", "n", "keep"), "line-rules")
    met = join_counted(lines, ruled, "line", "n", total, F.xxhash64("row", "place"))
    goes = F.col("keep").isNotNull() & (here != F.col("keep"))
    gone = met.where(goes).groupBy("row", "id").agg(F.collect_set("place").alias("gone"))
    gone = stored(gone, "line-gone")
    word, bit = _word_and_bit(F.col("row"))
    # Rows that lose no line stay where they are, but for those whose bit another has set.
    mapped = whole.join(F.broadcast(_bit_map(gone, "row")), word == F.col("word"), "left")
    may = F.coalesce(F.expr("shiftright(mask, cast(row & 63 AS int)) & 1") == 1, F.lit(False))
    places = gone.select(F.col("row").alias("at"), F.col("id").alias("of"), "gone")
    same = (F.col("row") == F.col("at")) & F.col("id").eqNullSafe(F.col("of"))
    none = F.lit(None).cast("array<int>")
    every = (
        mapped.where(~may)
        .select("_given", none.alias("gone"))
        .unionAll(mapped.where(may).join(places, same, "left").select("_given", "gone"))
    )
    body = F.col("_given")[text]
    rest = F.when(F.size("gone") > 0, _without(body, F.col("gone"))).otherwise(body)
    n_lines = F.coalesce(_filled(body), F.lit(0)).cast("long")
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return every.select(
        *((rest if c == text else F.col("_given")[c]).alias(c) for c in columns),
        n_lines.alias("n_lines"),
        (n_lines - n_gone).alias("n_kept"),
    )


#: A character that doesn't leave a line blank, as Python tells them.
FILLED = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _filled(text: Column) -> Column:
    """How many lines of a text aren't blank."""
    return F.size(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(FILLED)))


def _without(text: Column, places: Column) -> Column:
    """The text less the lines at those places."""

    def left(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
        return F.transform(stay, lambda i: F.get(lines, i))

    # Binds the lines once.
    lines = F.transform(F.array(F.split(text, "\n", -1)), left)
    return F.array_join(F.flatten(lines), "\n")
