"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that byte-pair
encoding produces. It starts as one state with an arc for every base symbol
and takes up the merges one by one. The gadget for a merge of ``u`` and ``v``
copies the state that ``u`` leads to, leaves ``v`` out of the copy, lets ``u``
lead there, and gives every state with an arc ``u`` an arc ``uv`` to where
``v`` led. So all arcs of one token lead to one state, and a state never changes
once it is made. The states that a token has led to form a chain: it begins at
a state of the token's right part, and each next one lacks one token more. The
tables hold those chains instead of states times tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenlight.llm.common import ship_package, slices

WORD_END = "</w>"

#: Neither letter, digit nor blank in any version of Unicode.
UNASSIGNED = "\uffff"

#: Words a Python task remembers at most before it starts afresh; results don't depend on it.
CACHE_WORDS = 600_000
CACHE_ARCS = 1_000_000

#: Stands for the start state, which no token leads to.
START = -1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the rest follow from U+0100.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Automaton:
    """Encodes words to token ids and decodes ids to labels.

    ``vocab`` gives each token's id, ``merges`` the pairs in order of rank.
    Parts of a merge must be base symbols or results of earlier merges.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.labels = {i: token for token, i in vocab.items()}
        made = {vocab[u + v] for u, v in merges}
        if len(made) != len(merges):
            raise ValueError("two merges make the same token")
        # The rank that made a token, and its left part.
        self.born = {i: -1 for i in vocab.values() if i not in made}
        self.left: dict[int, int] = {}
        # A token's chain: the chain and length it begins at, the tokens left
        # out since with their position, and the ranks at which that was.
        self.begins: dict[int, tuple[int, int] | None] = dict.fromkeys(self.born)
        self.lacks: dict[int, dict[int, int]] = {i: {} for i in self.born}
        self.since: dict[int, list[int]] = {i: [] for i in self.born}
        # A merge whose parts never meet makes no arc.
        self.arcs = {token: i for token, i in vocab.items() if i in self.born}
        for rank, (first, second) in enumerate(merges):
            self._gadget(rank, vocab[first], vocab[second], vocab[first + second])
        self.longest = max(map(len, vocab))
        self._allowed: dict[int, bool] = {}

    def _gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        if self.labels[u] not in self.arcs or self.labels[v] not in self.arcs:
            return
        if not self.has_arc(u, v):
            return
        self.arcs[self.labels[uv]] = uv
        self.born[uv], self.left[uv] = rank, u
        self.begins[uv], self.lacks[uv], self.since[uv] = (v, len(self.since[v])), {}, []
        self.lacks[u][v] = len(self.since[u])
        self.since[u].append(rank)

    def has_arc(self, last: int, token: int) -> bool:
        """Whether the state that ``last`` leads to has an arc for ``token``.

        It has not if its chain left the token out before. Else it has one if,
        when the token was made, the state of the chain at that time had one
        for the token's left part; a base symbol starts out on every state.
        """
        chain, length = last, len(self.since[last])
        while True:
            out = self.lacks[chain].get(token)
            if out is not None and out < length:
                return False
            length = min(length, bisect_right(self.since[chain], self.born[token]))
            if length:
                token = self.left[token]
            elif self.begins[chain] is None:
                if self.born[token] < 0:
                    return True
                token = self.left[token]
            else:
                chain, length = self.begins[chain]

    def encode(self, symbols: list[str]) -> list[int]:
        """The ids of one word given as base symbols.

        Follows the longest arc that the state at hand has, and steps back where
        none is left. A prefix has one accepted sequence, so a place that was
        left once never has to be entered again: time grows with the word's
        length times that of the longest token.
        """
        n, longest = len(symbols), self.longest
        arcs, known = self.arcs, self._allowed
        text = "".join(symbols)
        size = len(text)
        path: list[tuple[int, int, int, int]] = []
        left: set[int] = set()
        start, last, end = 0, START, min(n, longest)
        while True:
            while end > start:
                token = arcs.get(text[start : end if end < n else size])
                if token is not None and end not in left:
                    arc = last << 32 | token
                    ok = known.get(arc)
                    if ok is None:
                        if len(known) >= CACHE_ARCS:
                            known.clear()
                        ok = known[arc] = last == START or self.has_arc(last, token)
                    if ok:
                        break
                end -= 1
            if end > start:
                path.append((start, last, end, token))
                if end == n:
                    return [step[3] for step in path]
                start, last = end, token
                end = min(n, start + longest)
            else:
                left.add(start)
                start, last, end, _ = path.pop()
                end -= 1

    def decode(self, ids) -> str:
        """The labels of the arcs, joined by spaces."""
        labels = self.labels
        return " ".join([labels[i] for i in ids])


class Tokenizer:
    """A word-level BPE read from a ``tokenizer.json`` text: split, encode, decode.

    Supports what such files state for vocabularies with word ends: added
    tokens matched in the raw text; NFC, blanks to one space, lower case; a
    regular expression for words; byte symbols. Anything else raises.
    """

    def __init__(self, spec: str):
        import regex

        parts = json.loads(spec)
        model = parts["model"]
        steps = [s["type"] for s in parts["normalizer"]["normalizers"]]
        split, byte_level = parts["pre_tokenizer"]["pretokenizers"]
        if (
            steps != ["NFC", "Replace", "Lowercase"]
            or split["type"] != "Split"
            or byte_level["type"] != "ByteLevel"
            or model["end_of_word_suffix"] != WORD_END
            or parts["decoder"] is not None
        ):
            raise ValueError("not a word-level byte-pair vocabulary as supported")
        self.automaton = Automaton(model["vocab"], [tuple(m) for m in model["merges"]])
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        for content, i in self.added.items():
            self.automaton.labels[i] = content
        longest_first = sorted(self.added, key=len, reverse=True)
        self._added = regex.compile("|".join(map(regex.escape, longest_first)) or r"(?!)")
        self._words = regex.compile(split["pattern"]["Regex"])
        self._bytes = dict(enumerate(byte_symbols()))
        # The regex module may know letters and digits of a later Unicode version.
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        named = regex.findall(r"[\p{L}\p{N}]", every)
        self._later = {c for c in named if unicodedata.category(c) == "Cn"}
        first = min(self._later, default=chr(0x10FFFF))
        self._may_be_later = re.compile(f"[{first}-\U0010ffff]")
        self._plain = str.maketrans(dict.fromkeys(self._later, UNASSIGNED))

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without added tokens."""
        # Blanks part words, be it one or many, so runs of them stay as they are.
        text = unicodedata.normalize("NFC", text)
        # Each character is lowered by itself, so a final sigma is no exception.
        text = text.replace("Σ", "σ").lower()
        if self._may_be_later.search(text) and not self._later.isdisjoint(text):
            found = self._words.finditer(text.translate(self._plain))
            return [text[m.start() : m.end()] for m in found]
        return self._words.findall(text)

    def encode_word(self, word: str) -> list[int]:
        symbols = [*word.encode("utf-8").decode("latin-1").translate(self._bytes)]
        symbols[-1] += WORD_END
        return self.automaton.encode(symbols)

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """Runs of plain text (False) and added tokens (True)."""
        start = 0
        for m in self._added.finditer(text):
            yield False, text[start : m.start()]
            yield True, m.group()
            start = m.end()
        yield False, text[start:]


class _Remembered(dict):
    """Word to (ids as bytes, labels); starts afresh when full."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, word: str):
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self.tokenizer.encode_word(word)
        found = array("i", ids).tobytes(), self.tokenizer.automaton.decode(ids)
        self[word] = found
        return found


@lru_cache(maxsize=2)
def _loaded(spec: str) -> _Remembered:
    return _Remembered(Tokenizer(spec))


def _encode(spec: str, id_type, batches) -> Iterator:
    import numpy as np
    import pyarrow as pa

    known = _loaded(spec)
    tokenizer = known.tokenizer
    for part in slices(batches):
        packed, decoded, counts = [], [], []
        for text in part["text"]:
            found = []
            for added, piece in tokenizer.pieces(text or ""):
                if added:
                    found.append((array("i", [tokenizer.added[piece]]).tobytes(), piece))
                else:
                    found += [known[w] for w in tokenizer.words(piece)]
            ids = b"".join([x[0] for x in found])
            packed.append(ids)
            counts.append(len(ids) // 4)
            decoded.append(" ".join([x[1] for x in found]))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype("int32")
        values = np.frombuffer(b"".join(packed), np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part["doc_id"], id_type),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                pa.array(decoded, pa.string()),
            ],
            names=["doc_id", "ids", "decoded"],
        )


def encode(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` for every row: the text's tokens and what they decode to.

    ``spec`` is the text of a ``tokenizer.json`` file; it is read on the driver
    and sent to the tasks, its size being that of the vocabulary. Words are
    remembered per task up to ``CACHE_WORDS``. Null and empty texts give no
    tokens; a text is encoded whole, however long; rows are independent, so
    repeated rows, null ids and other columns need no care.
    """
    ship_package(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )
    return rows.mapInArrow(lambda batches: _encode(spec, arrow, batches), schema)


def decode(encoded: DataFrame, spec: str) -> DataFrame:
    """``encoded`` with ``decoded`` made anew from its ``ids``; null ids decode to null."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def text_of(ids):
        automaton = _loaded(spec).tokenizer.automaton
        return ids.map(lambda x: None if x is None else automaton.decode(x.tolist()))

    return encoded.withColumn("decoded", text_of("ids"))


def read_spec(path: str) -> str:
    """The text of a vocabulary file on the driver."""
    with open(path, encoding="utf-8") as file:
        return file.read()
