"""Near-duplicates by consistent weighted sampling over TF-IDF shingles.

Improved consistent weighted sampling draws from a weighted set so that two sets
draw the same with a chance equal to their weighted Jaccard similarity. The
weights need the document frequency of every shingle over all documents, and
nearly all shingles occur once. So a task sums up what it has seen and sends
each shingle once, packed by hash range; only those met elsewhere too come
back. Shingles of one document alone have one weight and meet no other
document: together they are one element, which changes no similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from wrenlight.llm.common import group_count, join_counted, ship_package, slices
from wrenlight.llm.linking import link
from wrenlight.operators.ranking import with_rank
from wrenlight.sources.scratch import stored

#: Words in a shingle; a shorter text is one shingle.
WORDS = 5

#: Weighted Jaccard similarity from which texts are near-duplicates.
SIMILARITY = 0.8

#: How much more a shingle of no text weighs than one of every text. At most this, or an
#: edit of a text with many copies outweighs what they share.
RARITY = 0.25

#: Draws in a band and bands: of pairs at the least similarity 99.5 % share a band.
ROWS, BANDS = 4, 10

#: A shingle's hash; only weights depend on its being unique, and texts that share
#: one by chance still have to be similar in all others.
HASH_BITS = 48

#: A task sends what it has after so many shingles.
FLUSH = 1_000_000

#: Bytes of text whose shingles fall into one hash range, about; a task counts one range.
RANGE_BYTES = 10 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15

#: Rows between tasks: the kind says what the packed columns hold.
PACKED = "deal long, flush long, kind int, " + ", ".join(f"p{i} binary" for i in range(6))
_ONCE, _SHARED, _TEXTS, _MET, _KNOWN = range(5)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def shingles(words: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a text, ascending, and how often each occurs."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        total = mixed(total + np.uint64(_STEP)) + h[k : k + n]
    hashes, counts = np.unique(mixed(total) >> np.uint64(64 - HASH_BITS), return_counts=True)
    return hashes, counts


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _rows(found: list[tuple]):
    """A record batch of ``PACKED`` rows ``(deal, flush, kind, p0, ...)``."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
    padded = [(*row, *[b""] * (9 - len(row))) for row in found]
    columns = list(zip(*padded, strict=True)) or [[]] * 9
    names = ["deal", "flush", "kind", "p0", "p1", "p2", "p3", "p4", "p5"]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names
    )


def _cut(groups: int):
    """Map task: texts to packed shingles. Equal texts of one flush are sent once."""

    def run(batches) -> Iterator:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        known, part, texts, size = _WordHashes(), 0, {}, 0
        for rows in slices(batches):
            for key, doc, text in zip(rows["key"], rows["doc_id"], rows["text"], strict=True):
                if key is None:
                    continue
                if (seen := texts.get(key)) is not None:
                    seen[0] += 1
                    if doc is not None:
                        seen[1] = doc if seen[1] is None else min(seen[1], doc)
                    continue
                words = text.lower().split()
                if words:
                    texts[key] = [1, doc, *shingles(words, known)]
                    size += len(texts[key][2])
                if size >= FLUSH:
                    yield _rows(_packed(task << 24 | part, texts, groups))
                    part, texts, size = part + 1, {}, 0
        if texts:
            yield _rows(_packed(task << 24 | part, texts, groups))

    return run


def _packed(flush: int, texts: dict[bytes, list], groups: int) -> list[tuple]:
    n = len(texts)
    copies = np.array([t[0] for t in texts.values()], "<u4")
    sizes = [len(t[2]) for t in texts.values()]
    hashes = np.concatenate([t[2] for t in texts.values()])
    often = np.concatenate([t[3] for t in texts.values()]).astype("<u4")
    owner = np.repeat(np.arange(n, dtype=np.uint32), sizes)
    order = np.argsort(hashes, kind="stable")
    run = hashes[order]
    new = np.concatenate([[True], run[1:] != run[:-1]])
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(run)))
    several = lengths > 1
    alone = np.zeros(len(run), bool)
    alone[order[starts[~several]]] = True
    found = []
    # Shingles of one text of the flush, by group and text.
    h, who, tf = hashes[alone], owner[alone], often[alone]
    group = (h % np.uint64(groups)).astype(np.int64)
    order1 = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order1], np.arange(groups + 1))
    # Shingles of several, once with the number of rows that hold them.
    held = np.add.reduceat(copies[owner[order]].astype(np.int64), starts)[several]
    shared = run[starts[several]]
    group2 = (shared % np.uint64(groups)).astype(np.int64)
    order2 = np.argsort(group2, kind="stable")
    ends2 = np.searchsorted(group2[order2], np.arange(groups + 1))
    copies_bytes = copies.tobytes()
    for g in range(groups):
        at = order1[ends[g] : ends[g + 1]]
        if len(at):
            counts = np.bincount(who[at], minlength=n).astype("<u4")
            found.append(
                (g, flush, _ONCE, counts.tobytes(), copies_bytes, _six(h[at]), tf[at].tobytes())
            )
        at = order2[ends2[g] : ends2[g + 1]]
        if len(at):
            found.append((g, flush, _SHARED, held[at].astype("<i8").tobytes(), _six(shared[at])))
    counts = np.bincount(owner[~alone], minlength=n).astype("<u4")
    places = np.searchsorted(shared, hashes[~alone]).astype("<u4")
    ids = [t[1] for t in texts.values()]
    meta = np.zeros(n, [("copies", "<u4"), ("id", "<i8"), ("known", "u1"), ("total", "<u8")])
    meta["copies"], meta["known"] = copies, [i is not None for i in ids]
    meta["id"], meta["total"] = [i or 0 for i in ids], [int(t[3].sum()) for t in texts.values()]
    found.append(
        (
            -1 - flush,
            flush,
            _TEXTS,
            b"".join(texts),
            meta.tobytes(),
            counts.tobytes(),
            places.tobytes(),
            often[~alone].tobytes(),
            _six(shared),
        )
    )
    return found


def _columns(table) -> list[list]:
    return [table.column(f"p{i}").to_pylist() for i in range(6)]


def _count(table):
    """Group task: what each flush has to learn of the shingles of one hash range."""
    import pyarrow as pa

    kind, flush = table.column("kind").to_pylist(), table.column("flush").to_pylist()
    if kind[0] == _TEXTS:
        return table
    p = _columns(table)
    hashes, held, where = [], [], []
    for i, k in enumerate(kind):
        if k == _ONCE:
            counts = np.frombuffer(p[0][i], "<u4")
            who = np.repeat(np.arange(len(counts), dtype="<u4"), counts)
            hashes.append(_from_six(p[2][i]))
            held.append(np.frombuffer(p[1][i], "<u4")[who].astype(np.int64))
            where.append(who)
        else:
            hashes.append(_from_six(p[1][i]))
            held.append(np.frombuffer(p[0][i], "<i8"))
            where.append(None)
    every, inverse, times = np.unique(
        np.concatenate(hashes), return_inverse=True, return_counts=True
    )
    df = np.zeros(len(every), np.int64)
    np.add.at(df, inverse, np.concatenate(held))
    found, start = [], 0
    for i, k in enumerate(kind):
        mine = inverse[start : start + len(hashes[i])]
        start += len(hashes[i])
        if k == _SHARED:
            found.append((0, flush[i], _KNOWN, df[mine].astype("<i8").tobytes(), _six(hashes[i])))
        else:
            met = times[mine] > 1
            if met.any():
                found.append(
                    (
                        0,
                        flush[i],
                        _MET,
                        where[i][met].tobytes(),
                        _six(hashes[i][met]),
                        df[mine][met].astype("<i8").tobytes(),
                        np.frombuffer(p[3][i], "<u4")[met].tobytes(),
                    )
                )
    return pa.Table.from_batches([_rows(found)])


def draws(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """``ROWS * BANDS`` draws for each of ``n`` weighted sets, as 64-bit numbers.

    Per element and draw: r and c from Gamma(2, 1), b uniform, all from the
    element's hash. The weight is rounded down to exp(r (t - b)) for a whole t,
    and the element with the smallest c / exp(r (t - b) + r) is drawn, with t.
    Every set has an element; ``owner`` ascends.
    """
    unique, inverse = np.unique(elements, return_inverse=True)
    log_weight = np.log(weights)
    starts = np.searchsorted(owner, np.arange(n))
    found = np.zeros((n, ROWS * BANDS), np.uint64)

    def uniform(seed: int) -> np.ndarray:
        salted = unique + np.uint64(seed * _STEP & (2**64 - 1))
        return ((mixed(salted) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53

    for d in range(ROWS * BANDS):
        r = -np.log(uniform(5 * d + 1) * uniform(5 * d + 2))[inverse]
        log_c = np.log(-np.log(uniform(5 * d + 3) * uniform(5 * d + 4)))[inverse]
        b = uniform(5 * d + 5)[inverse]
        t = np.floor(log_weight / r + b)
        rank = log_c - r * (t - b) - r
        least = np.minimum.reduceat(rank, starts)
        place = np.flatnonzero(rank == least[owner])
        _, first = np.unique(owner[place], return_index=True)
        at = place[first]
        found[:, d] = mixed(elements[at] + mixed(t[at].astype(np.int64).view(np.uint64)))
    return found


def _draw(rows_in_all: int, similarity: float):
    """Flush task: weighted sets and bands of the texts that can have a near-duplicate."""

    def run(table):
        import pyarrow as pa

        kind, p = table.column("kind").to_pylist(), _columns(table)
        t = kind.index(_TEXTS)
        meta = np.frombuffer(
            p[1][t], [("copies", "<u4"), ("id", "<i8"), ("known", "u1"), ("total", "<u8")]
        )
        n = len(meta)
        shared = _from_six(p[5][t])
        df_of = np.zeros(len(shared), np.int64)
        counts = np.frombuffer(p[2][t], "<u4")
        place = np.frombuffer(p[3][t], "<u4")
        hashes, owner = [shared[place]], [np.repeat(np.arange(n, dtype=np.uint32), counts)]
        often, df = [np.frombuffer(p[4][t], "<u4")], []
        for i, k in enumerate(kind):
            if k == _KNOWN:
                df_of[np.searchsorted(shared, _from_six(p[1][i]))] = np.frombuffer(p[0][i], "<i8")
        df.append(df_of[place])
        for i, k in enumerate(kind):
            if k == _MET:
                owner.append(np.frombuffer(p[0][i], "<u4"))
                hashes.append(_from_six(p[1][i]))
                df.append(np.frombuffer(p[2][i], "<i8"))
                often.append(np.frombuffer(p[3][i], "<u4"))
        owner, hashes = np.concatenate(owner).astype(np.int64), np.concatenate(hashes)
        often, df = np.concatenate(often).astype(float), np.concatenate(df)

        def idf(rows):
            rarity = np.log((1 + rows_in_all) / (1 + rows)) / np.log(1 + rows_in_all)
            return 1 + RARITY * rarity

        weights = often * idf(df)
        met = np.bincount(owner, weights, n)
        own = (meta["total"] - np.bincount(owner, often, n)) * idf(meta["copies"].astype(float))
        # Similar texts share at least that part of the weight of each.
        able = met >= (similarity - 1e-9) * (met + own)
        keep = able[owner]
        owner, hashes, weights = owner[keep], hashes[keep], weights[keep]
        keys = [p[0][t][i * 16 : i * 16 + 16] for i in range(n)]
        alone = np.flatnonzero(able & (own > 0.5))
        # Ids of private elements lie above all shingle hashes.
        named = np.array([int.from_bytes(keys[i][:8], "little") for i in alone], np.uint64)
        named = (named >> np.uint64(2)) | np.uint64(1 << 62)
        owner = np.concatenate([owner, alone])
        hashes, weights = np.concatenate([hashes, named]), np.concatenate([weights, own[alone]])
        order = np.lexsort((hashes, owner))
        owner, hashes, weights = owner[order], hashes[order], weights[order]
        chosen = np.flatnonzero(able)
        place_of = np.cumsum(able) - 1
        rows = len(chosen)
        bands = np.zeros((rows, BANDS), np.uint64)
        if rows:
            drawn = draws(hashes, weights, place_of[owner], rows)
            for b in range(BANDS):
                value = np.full(rows, b, np.uint64)
                for k in range(ROWS):
                    value = mixed(value + np.uint64(_STEP)) + drawn[:, b * ROWS + k]
                bands[:, b] = mixed(value)
        ends = np.searchsorted(owner, chosen, side="left"), np.searchsorted(owner, chosen, "right")
        flush = table.column("flush")[0].as_py()
        return pa.Table.from_arrays(
            [
                pa.array([keys[i] for i in chosen], pa.binary()),
                pa.array([flush] * rows, pa.int64()),
                pa.array(
                    [int(meta["id"][i]) if meta["known"][i] else None for i in chosen], pa.int64()
                ),
                pa.array([hashes[a:b].tobytes() for a, b in zip(*ends, strict=True)], pa.binary()),
                pa.array([weights[a:b].tobytes() for a, b in zip(*ends, strict=True)], pa.binary()),
                pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())),
            ],
            names=["key", "flush", "id", "elements", "weights", "bands"],
        )

    return run


SETS = "key binary, flush long, id long, elements binary, weights binary, bands array<long>"


def loaded(elements: list[bytes], weights: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weighted sets as they came from ``_draw``."""
    return [
        (np.frombuffer(e, np.uint64), np.frombuffer(w))
        for e, w in zip(elements, weights, strict=True)
    ]


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """``doc_id, class_id, class_size, kept`` for every row of ``docs``.

    Rows are in one class if a chain of near-duplicates joins them: shingles of
    five lower-case words, weighted by count times an idf over all rows that lies
    between 1 and 1.25, with a weighted Jaccard similarity of at least ``similarity``. ``class_id`` is the
    class's smallest id, ``kept`` is true for the row that has it.

    Equal texts are one candidate. Those that lack the shared weight for any
    near-duplicate are left out, which loses no pair; of the others all pairs
    that share a band are verified, and some more (see ``link``).

    A text without words, null included, is a class of its own, and so is a row
    without id, whose class is null. Ids should be unique: repeated ones count
    as one text's. They may be of any type with an order; those that are no whole numbers
    are numbered first. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        return _by_number(docs, doc_id, text, similarity)
    body = F.col(text)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        body.alias("text"),
        F.when(body.rlike(r"\S"), F.unhex(F.md5(body))).alias("key"),
    )
    keyed = rows.select("doc_id", "key")
    texts = stored(
        keyed.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")),
        "near-texts",
    )
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    groups = max(group_count(spark), 1 + size // RANGE_BYTES)
    sent = rows.mapInArrow(_cut(groups), PACKED)
    answers = sent.groupBy("deal").applyInArrow(_count, PACKED)
    weighted = answers.groupBy("flush").applyInArrow(_draw(total, similarity), SETS)
    found = stored(weighted, "near-sets")
    # One set for each text, from the first flush that had it.
    best = (
        found.where("id IS NOT NULL")
        .groupBy("key")
        .agg(F.min(F.struct("id", "flush")).alias("best"))
    )
    chosen = best.select("key", "best.id", "best.flush")
    sets = stored(found.join(chosen, ["key", "id", "flush"]), "near-chosen")
    members = sets.select(F.explode("bands").alias("bucket"), "id")
    linked = link(members, sets.select("id", "elements", "weights"), loaded, similarity)
    classes = texts.join(linked, "id", "left").select(
        "key", "n", F.coalesce("class", "id").alias("class_id")
    )
    sizes = classes.groupBy("class_id").agg(
        F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("texts")
    )
    sizes = stored(sizes, "near-sizes")
    sized = join_counted(classes, sizes, "class_id", "texts", total, F.xxhash64("key"))
    classes = stored(sized.drop("texts"), "near-classes")
    placed = join_counted(keyed, classes, "key", "n", total, F.xxhash64("doc_id"))
    single = F.col("key").isNull() | F.col("doc_id").isNull()
    class_id = F.when(single, F.col("doc_id")).otherwise(F.col("class_id"))
    return placed.select(
        "doc_id",
        class_id.alias("class_id"),
        F.when(single, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        class_id.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def _by_number(docs: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame:
    """``near_duplicates`` of rows whose ids are replaced by their numbers in order."""
    rows = docs.select(F.col(doc_id).alias("name"), F.col(text).alias("text"))
    names = rows.select("name").where("name IS NOT NULL").distinct()
    numbers = stored(with_rank(names, [], ["name"], "number"), "near-ids")
    numbered = rows.join(numbers, "name", "left").select(F.col("number").alias("doc_id"), "text")
    found = near_duplicates(numbered, similarity=similarity)
    for column in ("doc_id", "class_id"):
        back = numbers.select(F.col("number").alias(column), "name")
        found = found.join(back, column, "left").drop(column).withColumnRenamed("name", column)
    return found.select("doc_id", "class_id", "class_size", "kept")
