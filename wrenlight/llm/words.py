"""Words of many texts at once, as numpy arrays over their bytes.

A word is a stretch without the characters ``\\x20`` and ``\\x09`` to ``\\x0D``. They are
single bytes in UTF-8, so the bytes can be cut without being decoded.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

from wrenlight.llm.near_dedup import mixed

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)

#: The bytes of a word that count in its last eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)

#: A longer word is hashed by itself.
LONG_WORD = 2048


@dataclass
class Words:
    """The words of ``n`` texts in a row."""

    data: np.ndarray  # the bytes of all texts, a blank after each
    starts: np.ndarray  # of each word
    stops: np.ndarray
    first: np.ndarray  # of each text and of the end: the number of its first word

    @classmethod
    def of(cls, texts: Iterable[bytes | None]) -> Words:
        found = [t or b"" for t in texts]
        data = np.frombuffer(b" ".join([*found, b""]) or b" ", np.uint8)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = ~_SPACE[data]
        edge = np.diff(inside)
        starts = np.flatnonzero(edge == 1)
        stops = np.flatnonzero(edge == -1)
        ends = np.cumsum([len(t) + 1 for t in found], dtype=np.int64)
        first = np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)
        return cls(data, starts, stops, first)

    def owner(self) -> np.ndarray:
        """The place of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data),), "<u8", padded, strides=(1,))
        sizes = self.stops - self.starts
        found = mixed(sizes.astype(np.uint64) * _STEP)
        at = np.flatnonzero(sizes <= LONG_WORD)
        done = 0
        while len(at):
            part = eight[self.starts[at] + done] & _LOW[np.minimum(sizes[at] - done, 8)]
            found[at] = mixed((found[at] ^ part) + _STEP)
            done += 8
            at = at[sizes[at] > done]
        for k in np.flatnonzero(sizes > LONG_WORD):
            import xxhash

            found[k] = xxhash.xxh3_64_intdigest(
                self.data[self.starts[k] : self.stops[k]].tobytes()
            )
        return found

    def joined(self, keep: np.ndarray):
        """An Arrow array of the texts made of the words with ``keep``, one blank between."""
        import pyarrow as pa

        kept = np.flatnonzero(keep)
        owner = self.owner()[kept]
        last = np.ones(len(kept), bool)
        last[:-1] = owner[1:] != owner[:-1]
        starts, stops = self.starts[kept], self.stops[kept] + ~last
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[starts] += 1
        edge[stops] -= 1
        out = self.data[np.cumsum(edge[:-1], dtype=np.int8) > 0].copy()
        out[_SPACE[out]] = 0x20
        sizes = np.bincount(owner, stops - starts, len(self.first) - 1).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        text = pa.LargeStringArray.from_buffers(
            len(sizes), pa.py_buffer(offsets), pa.py_buffer(out)
        )
        return text.cast(pa.string())


def text_slices(batches, size: int, text: str = "text"):
    """Record batches of some ``size`` bytes of text each, or of one whole text."""
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, end - start)
            start = end


def text_bytes(column) -> list[bytes | None]:
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()
