"""Repeated passages of words: difference-cover anchors that extend to whole windows.

Of every PERIOD places in a row those of a difference cover carry an anchor, a hash of
the next few words. For any two places some shift below PERIOD puts both on the cover, so two
equal windows share an anchor at the same place in both. Only windows around a repeated
anchor can be repeated; an anchor extends to them by hashes of whole windows.

Hashes travel packed. A task works on a flush of texts, sends each hash once, by hash
range, and gets back one bit for each: whether another flush has it too. The texts wait,
compressed, in a row that is the flush's own, so a passage that many texts share is
one entry for each flush.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenlight.llm.common import ship_package
from wrenlight.llm.near_dedup import mixed
from wrenlight.llm.words import Words, text_bytes, text_slices

#: Words in a window.
WINDOW = 35

#: A perfect difference set: every difference but 0 occurs once modulo the period.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)

#: Bytes of text in a flush, or one whole text.
FLUSH_BYTES = 8 << 20

#: Hashes of one range, about: so many are compared in one task's memory.
RANGE_HASHES = 1_500_000

#: Bytes of text for each anchor, about; it only decides into how many ranges hashes are cut.
BYTES_AN_ANCHOR = 24

_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Rows between tasks: hashes of a range, the answer to them, or a flush's texts.
PACKED = "deal long, flush long, kind int, payload binary, more binary"
_TEXTS, _HASHES, _ANSWER = range(3)


def windows(x: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` elements in a row."""
    power, covered, found = mixed(x + np.uint64(seed)), 0, None
    part = 1
    while True:
        if width & part:
            # The part of this power of two that follows what is covered already.
            n = max(len(x) - covered - part + 1, 0)
            piece = power[covered : covered + n]
            found = piece.copy() if found is None else mixed((found[:n] * _STEP) ^ (piece << np.uint64(1))) + piece
            covered += part
        if 2 * part > width:
            return found[: max(len(x) - width + 1, 0)]
        power = mixed(power[: max(len(power) - part, 0)] * _STEP + (power[part:] ^ (power[part:] >> np.uint64(31))))
        part *= 2


def _starts(words: Words, width: int) -> np.ndarray:
    """Which words start a stretch of ``width`` words of one text; all words, as booleans."""
    left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(len(words.starts))
    return left >= width


def _anchors(words: Words, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors, and their hashes."""
    within = np.arange(len(x)) - np.repeat(words.first[:-1], np.diff(words.first))
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True
    # Anchors that no whole window holds are left out by the length of their text.
    long = np.repeat(np.diff(words.first) >= width, np.diff(words.first))
    size = width - PERIOD + 1
    at = np.flatnonzero(covered[within % PERIOD] & _starts(words, size) & long)
    return at, windows(x, size, 1)[at]


def _windows(words: Words, x: np.ndarray, near: np.ndarray, width: int) -> tuple:
    """Places of the windows around the anchors at ``near``, and 64 + 16 bits of each."""
    reach = np.zeros(len(x) + 1, np.int32)
    first = np.repeat(words.first[:-1], np.diff(words.first))[near]
    np.add.at(reach, np.maximum(near - PERIOD + 1, first), 1)
    np.add.at(reach, near + 1, -1)
    at = np.flatnonzero((np.cumsum(reach[:-1]) > 0) & _starts(words, width))
    return at, windows(x, width, 2)[at], windows(x, width, 3)[at].astype(np.uint16)


class _Sent:
    """The distinct hashes of a flush by range, in an order that can be made again."""

    def __init__(self, hashes: np.ndarray, more: np.ndarray | None, groups: int):
        order = np.argsort(hashes, kind="stable") if more is None else np.lexsort((more, hashes))
        run = hashes[order]
        new = np.ones(len(run), bool)
        new[1:] = run[1:] != run[:-1]
        if more is not None:
            new[1:] |= more[order][1:] != more[order][:-1]
        first = np.flatnonzero(new)
        self.hashes = run[first]
        self.more = None if more is None else more[order][first]
        self.index = np.empty(len(run), np.int64)
        self.index[order] = np.cumsum(new) - 1
        self.often = np.diff(np.append(first, len(run)))
        # Ranges of equal width of the hash.
        bounds = [(g << 64) // groups for g in range(1, groups)]
        inner = np.searchsorted(self.hashes, np.array(bounds, np.uint64))
        self.ends = np.concatenate([[0], inner, [len(self.hashes)]]).astype(np.int64)

    def rows(self, flush: int) -> Iterator[tuple]:
        for g in np.flatnonzero(np.diff(self.ends)):
            a, b = self.ends[g], self.ends[g + 1]
            more = b"" if self.more is None else self.more[a:b].tobytes()
            payload = self.hashes[a:b] if self.more is not None else self.hashes[a:b] >> np.uint64(16)
            yield int(g), flush, _HASHES, payload.tobytes() if self.more is not None else _six(payload), more

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each hash that was given: whether it occurs more than once anywhere."""
        found = self.often > 1
        for g, bits in answers.items():
            a, b = self.ends[g], self.ends[g + 1]
            found[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        return found[self.index]


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _batches(rows) -> Iterator:
    """Record batches of ``PACKED`` rows, some megabytes each."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    names = ["deal", "flush", "kind", "payload", "more"]

    def batch(part: list[tuple]):
        columns = list(zip(*part, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names
        )

    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[3]) + len(row[4]) + 32
        if size > 4 << 20:
            yield batch(part)
            part, size = [], 0
    yield batch(part)


def _pack(ids: list, texts: list[bytes | None]) -> tuple[bytes, bytes]:
    import pickle

    import zstandard

    packed = zstandard.ZstdCompressor(level=3).compress(b"".join(t or b"" for t in texts))
    return packed, pickle.dumps((ids, np.array([len(t or b"") for t in texts])))


def _unpack(payload: bytes, more: bytes) -> tuple[list, list[bytes]]:
    import pickle

    import zstandard

    ids, sizes = pickle.loads(more)
    data = zstandard.ZstdDecompressor().decompress(payload)
    ends = np.cumsum(sizes).tolist()
    return ids, [data[b - n : b] for b, n in zip(ends, sizes.tolist(), strict=True)]


def _cut(width: int, groups: int):
    """Map task: flushes of texts, and the hashes of their anchors."""

    def flushes(batches) -> Iterator[tuple[list, list]]:
        ids, texts, size = [], [], 0
        for batch in text_slices(batches, FLUSH_BYTES):
            ids += batch.column("id").to_pylist()
            more = text_bytes(batch.column("text"))
            texts += more
            size += sum(len(t or b"") for t in more)
            if size >= FLUSH_BYTES // 2:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def rows(batches) -> Iterator[tuple]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for part, (ids, texts) in enumerate(flushes(batches)):
            flush = task << 32 | part
            words = Words.of(texts)
            yield -1 - flush, flush, _TEXTS, *_pack(ids, texts)
            yield from _Sent(_anchors(words, words.hashes(), width)[1], None, groups).rows(flush)

    return lambda batches: _batches(rows(batches))


def _meet(table):
    """Group task: one bit for each hash of a range, whether several flushes sent it."""
    import pyarrow as pa

    kind = table.column("kind").to_pylist()
    if kind[0] == _TEXTS:
        return table
    deal, flush = table.column("deal").to_pylist(), table.column("flush").to_pylist()
    more = table.column("more").to_pylist()
    payload = table.column("payload").to_pylist()
    wide = any(more)
    parts = [np.frombuffer(p, "<u8") if wide else _from_six(p) for p in payload]
    hashes = np.concatenate(parts)
    if wide:
        extra = np.frombuffer(b"".join(more), np.uint16)
        order = np.lexsort((extra, hashes))
        run, rest = hashes[order], extra[order]
        same = (run[1:] == run[:-1]) & (rest[1:] == rest[:-1])
    else:
        order = np.argsort(hashes)
        run = hashes[order]
        same = run[1:] == run[:-1]
    again = np.zeros(len(run), bool)
    again[1:] |= same
    again[:-1] |= same
    found = np.empty(len(run), bool)
    found[order] = again
    ends = np.cumsum([len(p) for p in parts])
    rows = [
        (d, f, _ANSWER, np.packbits(found[b - len(p) : b]).tobytes(), b"")
        for d, f, p, b in zip(deal, flush, parts, ends, strict=True)
    ]
    return pa.Table.from_batches(list(_batches(rows)))


def _answers(table) -> tuple[tuple[bytes, bytes], dict[int, bytes]]:
    texts, answers = None, {}
    columns = (table.column(c).to_pylist() for c in ("deal", "kind", "payload", "more"))
    for deal, kind, payload, more in zip(*columns, strict=True):
        if kind == _TEXTS:
            texts = payload, more
        else:
            answers[deal] = payload
    return texts, answers


def _near(texts: list[bytes], answers: dict[int, bytes], width: int, groups: int):
    """The words of a flush, and its windows around repeated anchors."""
    words = Words.of(texts)
    x = words.hashes()
    at, hashes = _anchors(words, x, width)
    near = at[_Sent(hashes, None, groups).repeated(answers)]
    return words, x, near


def _extend(width: int, groups: int):
    """Flush task: the hashes of the windows around repeated anchors."""

    def run(table):
        import pyarrow as pa

        flush = table.column("flush")[0].as_py()
        packed, answers = _answers(table)
        ids, texts = _unpack(*packed)
        words, x, near = _near(texts, answers, width, groups)
        at, hashes, more = _windows(words, x, near, width)
        rows = [
            (-1 - flush, flush, _TEXTS, *_pack_found(packed, near)),
            *_Sent(hashes, more, groups).rows(flush),
        ]
        return pa.Table.from_batches(list(_batches(rows)))

    return run


def _pack_found(packed: tuple[bytes, bytes], near: np.ndarray) -> tuple[bytes, bytes]:
    import pickle

    gaps = np.diff(near, prepend=0).astype("<u4")
    return packed[0], pickle.dumps((packed[1], gaps.tobytes()))


def _remove(width: int, groups: int):
    """Flush task: the texts less what repeated windows cover."""

    def run(table):
        import pickle

        import pyarrow as pa

        (payload, more), answers = _answers(table)
        more, gaps = pickle.loads(more)
        ids, texts = _unpack(payload, more)
        words = Words.of(texts)
        x = words.hashes()
        near = np.cumsum(np.frombuffer(gaps, "<u4").astype(np.int64))
        at, hashes, rest = _windows(words, x, near, width)
        at = at[_Sent(hashes, rest, groups).repeated(answers)]
        change = np.zeros(len(x) + 1, np.int64)
        change[at] += 1
        change[at + width] -= 1
        keep = np.cumsum(change[:-1]) == 0
        n = np.diff(words.first)
        kept = np.bincount(words.owner()[keep], minlength=len(n))
        return pa.Table.from_arrays(
            [
                pa.array(ids, pa.string()),
                pa.array(n, pa.int64()),
                pa.array(n - kept, pa.int64()),
                words.joined(keep),
            ],
            names=["id", "n_words", "n_removed", "kept"],
        )

    return run


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row of ``docs``.

    A window is ``width`` words in a row of one text, at least ``PERIOD`` of them. A word
    goes if it lies in a window whose words also start anywhere else, in the same
    text or another. Windows are judged on the texts as they are given. ``kept``
    has the other words, joined by one blank.

    A null text has no words, nor has one of blanks only, and shorter texts than a
    window keep all. Rows are texts of their own, so repeated rows lose all that their
    windows cover; a null id is an id. Other columns are ignored; an empty table gives
    no rows.

    Windows are the same by 80 bits of hash, anchors by 48, which only adds
    windows to look at.
    """
    if width < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(partitions, 1 + size // (BYTES_AN_ANCHOR * RANGE_HASHES))
    sent = rows.mapInArrow(_cut(width, groups), PACKED)
    met = sent.groupBy("deal").applyInArrow(_meet, PACKED)
    wider = met.groupBy("flush").applyInArrow(_extend(width, groups), PACKED)
    again = wider.groupBy("deal").applyInArrow(_meet, PACKED)
    done = again.groupBy("flush").applyInArrow(
        _remove(width, groups), "id string, n_words long, n_removed long, kept string"
    )
    return done.select(F.col("id").cast(kind).alias(doc_id), "n_words", "n_removed", "kept")
