"""Quality of texts by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wrenlight.llm.common import ship_package, slices

#: A text is accepted from this score on.
ACCEPT = 0.3

FEATURES = (
    "log_chars letters upper digits blanks points marks bars bangs symbols log_words word_length "
    "distinct_words repeated_words log_lines words_per_line distinct_lines bare_words "
    "mark_words top_word".split()
)

# Classes of characters that are counted.
_OTHER, _LOWER, _UPPER, _DIGIT, _BLANK, _POINT, _MARK, _BAR, _BANG, _SYMBOL = range(10)


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = _UPPER if ch.isupper() else _LOWER
        elif ch.isdigit():
            table[c] = _DIGIT
        elif ch.isspace():
            table[c] = _BLANK
    for chars, kind in ((".,;:'\"-()?", _POINT), ("*#%$&@", _MARK), ("|", _BAR), ("!", _BANG)):
        for ch in chars:
            table[ord(ch)] = kind
    for c in range(0x21, 0x7F):
        if table[c] == _OTHER:
            table[c] = _SYMBOL
    return table


def statistics(texts: list[str]) -> np.ndarray:
    """One row of ``FEATURES`` a text; an empty text has zeros."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _class_table()[code].astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(n) * 10, sizes) + kinds, minlength=10 * n)
    counts = counts.reshape(n, 10) / np.maximum(sizes, 1)[:, None]
    rest = np.zeros((n, 10))
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        lines = text.split("\n")
        kept = set(words)
        ends = "".join([w[-1] for w in words])
        starts = "".join([w[0] for w in words])
        rest[i] = (
            np.log1p(len(words)),
            sum(map(len, kept)) / len(kept),
            len(kept) / len(words),
            sum(map(eq, words, words[1:])) / len(words),
            np.log1p(len(lines)),
            len(words) / len(lines),
            len(set(lines)) / len(lines),
            sum(not w[0].isalnum() for w in kept) / len(kept),
            sum(map(ends.count, "*#%$&!|")) / len(words),
            sum(map(starts.count, "*#%$&!|")) / len(words),
        )
    letters = counts[:, _LOWER] + counts[:, _UPPER]
    return np.column_stack(
        [
            np.log1p(sizes),
            letters,
            counts[:, _UPPER] / np.maximum(letters, 1e-9),
            counts[:, [_DIGIT, _BLANK, _POINT, _MARK, _BAR, _BANG, _SYMBOL]],
            rest,
        ]
    )


#: Characters whose statistics are worked out at a time; a worker keeps what memory they took.
SCORED_CHARS = 250_000


@dataclass
class Trees:
    """Boosted trees as arrays: the children of node ``i`` are ``2i + 1`` and ``2i + 2``."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row, all rows stepping down a tree at once."""
        depth = (self.leaf.shape[1] - 1).bit_length() if self.leaf.size else 0
        inner = self.feature.shape[1] if self.feature.size else 0
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    least: float = 5.0,
    ridge: float = 1.0,
) -> Trees:
    """Boost ``trees`` trees of full ``depth`` on the logistic loss.

    Features are cut into ``bins`` at quantiles once. For each level the sums of
    gradients and curvatures by node, feature and bin are taken in one pass,
    and the split with the largest gain is read off their running sums. A node
    without a useful split sends everything left.
    """
    none = np.zeros((0, 0))
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Trees(float(np.log(share / (1 - share))), none.astype(int), none, none)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack(
        [np.searchsorted(cut, c, side="left") for cut, c in zip(cuts, x.T, strict=True)]
    )
    n, width = binned.shape
    flat = binned + np.arange(width) * bins
    share = y.mean()
    model = Trees(
        float(np.log(share / (1 - share))),
        np.zeros((trees, 2**depth - 1), np.int64),
        np.full((trees, 2**depth - 1), np.inf),
        np.zeros((trees, 2**depth)),
    )
    total = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, curve = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 2**level
            key = ((node * width * bins)[:, None] + flat).ravel()
            shape = (nodes, width, bins)
            g, h = (
                np.bincount(key, np.repeat(v, width), nodes * width * bins).reshape(shape)
                for v in (gradient, curve)
            )
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = gt - gl, ht - hl
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least / 4) | (hr < least / 4)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            feature, cut = best // bins, best % bins
            useful = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            first = nodes - 1
            for i in np.flatnonzero(useful):
                edges = cuts[feature[i]]
                if cut[i] < len(edges):
                    model.feature[t, first + i] = feature[i]
                    model.threshold[t, first + i] = edges[cut[i]]
                else:
                    useful[i] = False
            right = useful[node] & (binned[np.arange(n), feature[node]] > cut[node])
            node = 2 * node + right
        leaves = 2**depth
        g, h = (np.bincount(node, v, leaves) for v in (gradient, curve))
        model.leaf[t] = -rate * g / (h + ridge)
        total += model.leaf[t, node]
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = 20_000,
) -> Trees:
    """Trees fitted to the labelled texts.

    Fits on about ``sample_rows`` labelled rows, chosen by a hash of the id; if
    there are fewer, on all. So the ids broadcast to the scan of texts and the
    statistics that come to the driver are bounded by that parameter. Rows
    without id or label are left out; without labels of both kinds the score
    is a constant.
    """
    ship_package(docs.sparkSession)
    marked = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")).where(
        "_id IS NOT NULL AND y IN (0, 1)"
    )
    share = min(1.0, sample_rows / max(1, marked.count()))
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = F.broadcast(marked.where(draw < share))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(chosen, "_id")
    names = [f"f{i}" for i in range(len(FEATURES))]

    def measured(batches) -> Iterator:
        import pyarrow as pa

        for part in slices(batches):
            x = statistics([t or "" for t in part["text"]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in x.T] + [pa.array(part["y"], pa.int32())], names=[*names, "y"]
            )

    schema = ", ".join(f"{name} double" for name in names) + ", y int"
    table = rows.select("text", "y").mapInArrow(measured, schema).toPandas()
    # The order of rows differs from run to run; sums of floats must not.
    table = table.sort_values([*names, "y"])
    return fit(table[names].to_numpy(), table["y"].to_numpy(float))


def scorer(model: Trees):
    """``model`` as a function of a text column: the chance of label 1."""

    @pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        found, start, size = [], 0, 0
        whole = texts.fillna("").tolist()
        for end, text in enumerate(whole, 1):
            size += len(text)
            if size >= SCORED_CHARS or end == len(whole):
                found.append(model.scores(statistics(whole[start:end])))
                start, size = end, 0
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    return scored


def score(
    docs: DataFrame, model: Trees, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, score`` for every row, from its whole text alone.

    Null and empty texts have statistics of zero and are scored like others.
    Repeated rows and other columns need no care.
    """
    ship_package(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), scorer(model)(F.col(text)).alias("score"))


def accepted(docs: DataFrame, model: Trees, text: str = "text", least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, all columns as they are."""
    ship_package(docs.sparkSession)
    return docs.where(scorer(model)(F.col(text)) >= least)
