"""Terms of training rows by column, and penalized linear models fitted over them.

Under a squared penalty the weights are a sum of the rows, each times a number, and so are all
gradients and steps on the way. So the solver holds one number a row, never one a term. What
an iteration needs of the terms is one product of the rows' scalar products, ``X X'``, with such
numbers: every task has whole columns, so it works out its share alone, and shares are added up.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenlight.functions.text import term_counts, terms
from wrenlight.session import bound_batches, ship_package
from wrenlight.sources.scratch import stored

#: About so many entries of the columns make one row of the packed table.
PACKED = 1 << 16
#: So many numbers of a sum travel as one.
CHUNK = 1 << 16
#: Steps that the solver remembers.
MEMORY = 10
#: Bytes that all fits side by side may take on the driver, and how many numbers a row each holds at a time.
SIDE_BY_SIDE_BYTES = 256 * 1024 * 1024
AT_A_TIME = 8
#: What a fit remembers beyond so many bytes is in a file that the driver maps.
MAPPED_BYTES = 16 * 1024 * 1024
#: Iterations over which the objective must fall by the tolerance.
PATIENCE = 10

PACKED_SCHEMA = (
    "terms array<string>, lengths binary, rows binary, counts binary, "
    "own_terms array<string>, own_rows binary, own_counts binary"
)


def sent_sums(sums: np.ndarray, task: int, first: int = 0):
    """Arrow batches ``place, task, sums`` of one task's sums, ``CHUNK`` numbers each."""
    import pyarrow as pa

    flat = np.ascontiguousarray(sums, float).reshape(-1)
    for start in range(0, len(flat), CHUNK):
        part = flat[start : start + CHUNK].tobytes()
        yield pa.RecordBatch.from_pydict(
            {
                "place": pa.array([first + start // CHUNK], pa.int32()),
                "task": pa.array([task], pa.int32()),
                "sums": pa.array([part], pa.binary()),
            }
        )


SUMS_SCHEMA = "place int, task int, sums binary"


def _added(table):
    import pyarrow as pa

    table = table.sort_by("task")
    total = sum(np.frombuffer(x.as_buffer()) for x in table.column("sums"))
    return pa.table(
        {"place": table.column("place").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())}
    )


def added(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sums of all tasks by place, added up by tasks in the order of the tasks' numbers."""
    total = parts.groupBy("place").applyInArrow(_added, "place int, sums binary").toArrow()
    return {
        place: np.frombuffer(x.as_buffer())
        for place, x in zip(total.column("place").to_pylist(), total.column("sums"), strict=True)
    }


def placed(found: dict[int, np.ndarray], size: int) -> np.ndarray:
    """The ``size`` sums of ``added`` as one vector."""
    result = np.zeros(size)
    for place in list(found):
        sums = found.pop(place)
        result[place * CHUNK : place * CHUNK + len(sums)] = sums
    return result


def few_tasks(packed: DataFrame) -> DataFrame:
    """In one task a core: each sends a sum for every row, so more tasks would send more of them."""
    return packed.coalesce(max(1, packed.sparkSession.sparkContext.defaultParallelism))


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _pack(batches) -> Iterator:
    """Entries ``term, row, tf``, in order, as packed columns.

    What is held is some ``PACKED`` entries and the rows of the last term, one a row at most.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def packed(table):
        term = table.column("term").combine_chunks()
        row = table.column("row").to_numpy().astype(np.int32)
        tf = table.column("tf").to_numpy().astype(np.int32)
        differ = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1))
        starts = np.append(0, np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1)
        lengths = np.diff(np.append(starts, len(term)))
        own = lengths == 1
        alone = np.repeat(own, lengths)
        texts = pa.list_(pa.string())
        return pa.RecordBatch.from_pydict(
            {
                "terms": pa.array([term.take(pa.array(starts[~own])).to_pylist()], texts),
                "lengths": [lengths[~own].astype(np.int32).tobytes()],
                "rows": [row[~alone].tobytes()],
                "counts": [tf[~alone].tobytes()],
                "own_terms": pa.array([term.take(pa.array(starts[own])).to_pylist()], texts),
                "own_rows": [row[alone].tobytes()],
                "own_counts": [tf[alone].tobytes()],
            }
        )

    held, size, wanted = [], 0, PACKED
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = table.column("term")[size - 1]
        whole = pc.index(table.column("term"), last).as_py()
        if whole:
            yield packed(table.slice(0, whole))
        rest = table.slice(whole)
        held, size = rest.to_batches(), rest.num_rows
        wanted = max(PACKED, 2 * size)
    if size:
        yield packed(pa.Table.from_batches(held).combine_chunks())


def _ints(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int32)


def _single(total: int) -> float:
    """The inverse frequency of a term of one row."""
    return log((1 + total) / 2) + 1


def _entries(batch, prefix: str = ""):
    """``rows, counts`` of each packed row, and the lengths of its columns."""
    names = [f"{prefix}rows", f"{prefix}counts", *([] if prefix else ["lengths"])]
    for packed in zip(*(batch.column(n) for n in names), strict=True):
        yield tuple(map(_ints, packed))


def _gathered(batches, total: int, prefix: str = "") -> Iterator[tuple]:
    """``_entries`` of all batches, joined to a quarter of ``total`` entries or more.

    What follows goes over all rows once for each of them, so its work is in proportion to the entries.
    """
    held, size = [], 0
    for batch in batches:
        for parts in _entries(batch, prefix):
            if len(parts[0]):
                held.append(parts)
                size += len(parts[0])
            if held and size >= total // 4:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _values(counts, lengths, total: int, weighted: bool) -> np.ndarray:
    if not weighted:
        return counts.astype(float)
    return counts * np.repeat(np.log((1.0 + total) / (lengths + 1)) + 1, lengths)


def _shared_squares(total: int, weighted: bool):
    """Task: sums of squares by row, of shared terms."""

    def run(batches):
        sums = np.zeros(total)
        for rows, counts, lengths in _gathered(batches, total):
            value = _values(counts, lengths, total, weighted)
            sums += np.bincount(rows, value * value, total)
        yield from sent_sums(sums, _task())

    return run


def _own_squares(total: int, weighted: bool):
    """Task: sums of squares by row, of a row's own terms."""

    def run(batches):
        sums = np.zeros(total)
        single = _single(total) if weighted else 1.0
        for rows, counts in _gathered(batches, total, "own_"):
            sums += np.bincount(rows, (counts * single) ** 2, total)
        yield from sent_sums(sums, _task())

    return run


def _product(sent, total: int, weighted: bool):
    """Task: its columns' share of ``X X' v`` for each ``v`` that was sent."""

    def run(batches):
        vectors = sent.value
        sums = np.zeros_like(vectors)
        for rows, counts, lengths in _gathered(batches, total):
            value = _values(counts, lengths, total, weighted)
            starts = np.append(0, np.cumsum(lengths)[:-1])
            for v, out in zip(vectors, sums, strict=True):
                slope = np.add.reduceat(v[rows] * value, starts)
                out += np.bincount(rows, value * np.repeat(slope, lengths), total)
        yield from sent_sums(sums, _task())

    return run


def _coefficients(sent, total: int, weighted: bool):
    """Task: ``term, idf, coef`` of its columns, ``coef`` being ``X' v``."""

    def run(batches):
        import pyarrow as pa

        def rows_of(names, idf, coef):
            size = len(coef)
            frequency = pa.array(idf if weighted else [None] * size, pa.float64())
            columns = {"term": pa.array(names, pa.string()), "idf": frequency, "coef": pa.array(coef)}
            return pa.RecordBatch.from_pydict(columns)

        v = sent.value
        single = _single(total) if weighted else 1.0
        for batch in batches:
            names = (x.values for x in batch.column("terms"))
            for term, (rows, counts, lengths) in zip(names, _entries(batch), strict=True):
                if len(rows):
                    value = _values(counts, lengths, total, weighted)
                    starts = np.append(0, np.cumsum(lengths)[:-1])
                    idf = np.log((1.0 + total) / (lengths + 1)) + 1
                    yield rows_of(term, idf, np.add.reduceat(v[rows] * value, starts))
            names = (x.values for x in batch.column("own_terms"))
            for term, (rows, counts) in zip(names, _entries(batch, "own_"), strict=True):
                if len(rows):
                    yield rows_of(term, np.full(len(rows), single), v[rows] * counts * single)

    return run


@dataclass
class TermColumns:
    """Training rows as columns of terms: counts of n-grams, or TF-IDF scaled to length 1.

    Terms of one row alone only add ``own``, the sum of their squares, to that row's product
    with itself.
    """

    packed: DataFrame
    labels: np.ndarray
    scale: np.ndarray
    own: np.ndarray
    weighted: bool

    @property
    def rows(self) -> int:
        return len(self.labels)

    def _run(self, task: Callable, vectors: np.ndarray, schema: str, names: list[str]) -> DataFrame:
        context = self.packed.sparkSession.sparkContext
        self._sent = context.broadcast(vectors)
        run = task(self._sent, self.rows, self.weighted)
        return few_tasks(self.packed.select(*names)).mapInArrow(run, schema)

    def products(self, vectors: np.ndarray) -> np.ndarray:
        """``X X' v`` for each row ``v`` of ``vectors``."""
        scaled = vectors * self.scale
        parts = self._run(_product, scaled, SUMS_SCHEMA, ["lengths", "rows", "counts"])
        result = placed(added(parts), scaled.size).reshape(scaled.shape)
        self._sent.destroy()
        scaled *= self.own
        result += scaled
        result *= self.scale
        return result

    def model(self, numbers: np.ndarray) -> DataFrame:
        """Stored ``term, idf, coef`` of the sum of the rows, each times its number."""
        schema = "term string, idf double, coef double"
        found = self._run(_coefficients, numbers * self.scale, schema, self.packed.columns)
        model = stored(found, "linear-model")
        self._sent.destroy()
        return model


def term_columns(
    rows: DataFrame, total: int, ngram_range: tuple[int, int], weighted: bool
) -> TermColumns:
    """Columns of the ``total`` stored rows ``row, key, label, text``.

    Texts are cut once, and their terms shuffled once, by term.
    """
    spark = rows.sparkSession
    ship_package(spark)
    bound_batches(spark)
    counted = rows.select(
        F.inline(term_counts(terms("text", ngram_range))), F.col("row").cast("int").alias("row")
    ).select("term", "row", "tf")
    dealt = counted.repartition("term").sortWithinPartitions("term")
    packed = stored(dealt.mapInArrow(_pack, PACKED_SCHEMA), "linear-columns")
    labels = np.zeros(total)
    told = rows.select("row", "label").toArrow()
    labels[told.column("row").to_numpy()] = told.column("label").to_numpy()
    shared, own = (
        placed(added(few_tasks(packed.select(*names)).mapInArrow(task(total, weighted), SUMS_SCHEMA)), total)
        for task, names in (
            (_shared_squares, ["rows", "counts", "lengths"]),
            (_own_squares, ["own_rows", "own_counts"]),
        )
    )
    length = np.sqrt(shared + own) if weighted else np.ones(total)
    scale = np.divide(1.0, length, out=np.zeros(total), where=length > 0)
    return TermColumns(packed, labels, scale, own, weighted)


def logistic_loss(margins: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The loss of each row and its slope by margin."""
    z = sign * margins
    fall = np.exp(-np.abs(z))
    loss = np.log1p(fall) + np.maximum(-z, 0.0)
    return loss, -sign * np.where(z > 0, fall, 1.0) / (1.0 + fall)


def hinge_loss(margins: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    short = 1.0 - sign * margins
    return np.maximum(short, 0.0), np.where(short > 0, -sign, 0.0)


@dataclass
class _Point:
    """A point or direction: a number for each row, their product with ``X X'``, the intercept."""

    numbers: np.ndarray
    product: np.ndarray
    intercept: float

    def dot(self, other: _Point) -> float:
        return float(self.numbers @ other.product) + self.intercept * other.intercept

    def plus(self, times: float, other: _Point) -> _Point:
        return _Point(
            self.numbers + times * other.numbers,
            self.product + times * other.product,
            self.intercept + times * other.intercept,
        )


def _space(count: int, rows: int) -> np.ndarray:
    """``count`` vectors of a number a row; large ones are in a file without a name, gone when they are."""
    size = 8 * count * rows
    if size <= MAPPED_BYTES:
        return np.zeros((count, rows))
    file = tempfile.TemporaryFile()
    file.truncate(size)
    return np.asarray(np.memmap(file, float, "r+", shape=(count, rows)))


class Fit:
    """Mean loss of the rows in ``used`` and ``penalty / 2`` times the squared weights, by L-BFGS.

    Each iteration gives out ``slopes`` and goes on when told their product with ``X X'``. A
    search along a line needs the rows' margins only, which are known, so it costs none.

    The point, the last step and all steps that are remembered have their place in ``_space``.
    """

    def __init__(self, loss, labels, penalty, iterations, tolerance, used=None, start=0.0):
        self.loss, self.penalty = loss, penalty
        self.iterations, self.tolerance = iterations, tolerance
        self.sign = (2 * labels - 1).astype(np.int8)
        self.used = np.ones(len(labels), bool) if used is None else used.astype(bool)
        self.count = max(1.0, float(self.used.sum()))
        self.space = _space(6 + 4 * MEMORY, len(labels))
        self.kept = 0
        self.at = _Point(self.space[0], self.space[1], start)
        self.value, self.slopes = self._look(self.at.product, self.at.intercept, 0.0)
        self.values, self.pairs, self.before = [self.value], [], None
        self.done = not len(labels) or not np.isfinite(start)

    def _look(self, margins, intercept, square):
        loss, slope = self.loss(margins + intercept, self.sign)
        value = float(loss @ self.used) / self.count + self.penalty / 2 * square
        return value, slope * self.used / self.count

    def told(self, product: np.ndarray) -> None:
        """The next iteration; ``product`` is that of ``X X'`` with the slopes."""
        at, held = self.at, self.penalty
        gradient = _Point(
            self.slopes + held * at.numbers, product + held * at.product, float(self.slopes.sum())
        )
        if self.before is not None:
            step, old = self.before
            change = gradient.plus(-1.0, old)
            curve = step.dot(change)
            if curve > 1e-14 * step.dot(step):
                place = 6 + 4 * (self.kept % MEMORY)
                self.kept += 1
                pair = self._keep(place, step), self._keep(place + 2, change), curve
                self.pairs = [*self.pairs[1 - MEMORY :], pair]
        past = self.values[-1 - PATIENCE] if len(self.values) > PATIENCE else np.inf
        small = gradient.dot(gradient) <= (self.tolerance * max(abs(self.value), 1e-8)) ** 2
        still = past - self.value <= self.tolerance * self.values[0]
        if small or still or len(self.values) > self.iterations:
            self.done = True
            return
        if not self._step(gradient):
            self.done = True

    def _keep(self, place: int, point: _Point) -> _Point:
        """``point``, kept in two vectors of the space from ``place`` on."""
        numbers, product = self.space[place], self.space[place + 1]
        numbers[:], product[:] = point.numbers, point.product
        return _Point(numbers, product, point.intercept)

    def _step(self, gradient: _Point) -> bool:
        while True:
            way = self._direction(gradient)
            slope = gradient.dot(way)
            if slope < 0 and (found := self._search(way, slope)):
                break
            if not self.pairs:
                return False
            self.pairs = []
        times, self.value, self.slopes = found
        self.at = self._keep(0, self.at.plus(times, way))
        step = _Point(*(times * x for x in (way.numbers, way.product, way.intercept)))
        self.before = self._keep(2, step), self._keep(4, gradient)
        self.values.append(self.value)
        return True

    def _direction(self, gradient: _Point) -> _Point:
        way, shares = gradient, []
        for step, change, curve in reversed(self.pairs):
            share = step.dot(way) / curve
            shares.append(share)
            way = way.plus(-share, change)
        if self.pairs:
            _, change, curve = self.pairs[-1]
            times = curve / change.dot(change)
        else:
            times = 1.0 / max(1e-300, gradient.dot(gradient)) ** 0.5
        way = _Point(-times * way.numbers, -times * way.product, -times * way.intercept)
        for (step, change, curve), share in zip(self.pairs, reversed(shares), strict=True):
            way = way.plus(-share - change.dot(way) / curve, step)
        return way

    def _search(self, way: _Point, slope: float):
        """A length of the step that lowers the value enough and leaves little slope."""
        at = self.at
        square, cross, long = (float(x) for x in (at.numbers @ at.product, at.numbers @ way.product, way.numbers @ way.product))
        low, high, times, best = 0.0, np.inf, 1.0, None
        for _ in range(50):
            value, slopes = self._look(
                at.product + times * way.product,
                at.intercept + times * way.intercept,
                square + 2 * times * cross + times * times * long,
            )
            if value > self.value + 1e-4 * times * slope:
                high = times
            else:
                best = (times, value, slopes)
                now = float(slopes @ way.product) + self.penalty * (cross + times * long)
                if now + way.intercept * float(slopes.sum()) >= 0.1 * slope:
                    return best
                low = times
            times = (low + high) / 2 if np.isfinite(high) else 2 * times
        return best


def descend(columns: TermColumns, fits: list[Fit]) -> None:
    """Runs the fits, as many side by side as the driver may hold; they share each pass."""
    each = 8 * columns.rows * AT_A_TIME
    most = max(1, SIDE_BY_SIDE_BYTES // max(1, each))
    for start in range(0, len(fits), most):
        group = fits[start : start + most]
        while running := [f for f in group if not f.done]:
            found = columns.products(np.array([f.slopes for f in running]))
            for fit, product in zip(running, found, strict=True):
                fit.told(product)
        for fit in group:
            # What of its space is still used; the rest goes.
            fit.at = _Point(fit.at.numbers.copy(), fit.at.product.copy(), fit.at.intercept)
            fit.pairs, fit.before, fit.space = [], None, None
