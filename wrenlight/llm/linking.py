"""From buckets of candidates to classes: verified links and a distributed union-find."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenlight.llm.common import group_count, join_counted
from wrenlight.sources.scratch import stored

#: Members of a group that are compared in one step; a larger group is cut into such
#: chunks, and every two chunks meet in a task.
CHUNK = 512

#: Columns of the comparison that are laid out at a time.
COLUMNS = 2048

#: Bytes of texts that a task compares together, about.
GROUP_BYTES = 4 << 20

#: Bits of the map that bounds what two sets share, and pairs that are bounded at a time.
MAP_BITS, PAIRS = 1024, 30_000


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every end of the edges ``a, b`` (long): equal roots where connected.

    Each round every vertex is merged into that neighbour, or itself, which
    comes first in an order drawn anew for the round; the edges between the
    merged vertices are the next round's. The expected number of rounds is
    logarithmic whatever the shape. Then the merges are followed from the last
    round to the first. All tables are written to the shared folder; joins
    on hot vertices are spread.
    """
    merges: list[DataFrame] = []
    edges = edges.where("a <> b").select("a", "b")
    while True:
        edges = stored(edges.distinct(), "edges")
        total = 2 * edges.count()
        if not total:
            break
        seed = len(merges)

        def drawn(v: Column, seed: int = seed) -> Column:
            return F.xxhash64(v, F.lit(seed))

        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(
            F.min_by("b", drawn(F.col("b"))).alias("b"), F.count(F.lit(1)).alias("n")
        )
        into = F.when(drawn(F.col("b")) < drawn(F.col("a")), F.col("b")).otherwise(F.col("a"))
        merge = stored(first.select(F.col("a").alias("id"), into.alias("root"), "n"), "merges")
        merges.append(merge)
        for end in ("a", "b"):
            known = merge.select(F.col("id").alias(end), "root", "n")
            edges = join_counted(edges, known, end, "n", total, F.xxhash64("a", "b")).select(
                *(F.col("root").alias(c) if c == end else c for c in ("a", "b"))
            )
        edges = edges.where("a <> b")
    if not merges:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    labels = merges[-1].select("id", "root")
    for merge in reversed(merges[:-1]):
        uses = merge.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        later = stored(
            labels.select(F.col("id").alias("root"), F.col("root").alias("top")).join(uses, "root"),
            "labels",
        )
        total = merge.count()
        labels = join_counted(
            merge.select("id", "root"), later, "root", "n", total, F.xxhash64("id")
        ).select("id", F.coalesce("top", "root").alias("root"))
        labels = stored(labels, "labels")
    return labels


def link(
    members: DataFrame, sets: DataFrame, load: Callable[..., list[tuple]], similarity: float
) -> DataFrame:
    """``id, class`` for each id linked to another: the smallest id of its component.

    ``members`` holds ``bucket, id`` (long) and is read more than once; ``sets``
    has one row an id, the other columns binary or text; ``load`` turns lists of its other columns into ascending
    elements (64 bits) and their weights, a pair for each row.

    Buckets that overlap form a group: first the members of each are joined to
    its smallest, whatever their similarity. Then the weighted Jaccard
    similarity of all pairs of a group is worked out, so every pair that shares
    a bucket is verified and no bucket is capped. A group of more than ``CHUNK``
    members is spread over tasks by pairs of chunks. No pair is ever a row: a
    task adds up what its members share, a matrix for some columns at a time,
    and gives back links that span the components it has found.
    """
    counts = (
        members.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
        .where("low < high")
    )
    counts = stored(counts.select("bucket", "n", "low"), "bucket-counts")
    found = join_counted(members, counts, "bucket", "n", members.count(), F.xxhash64("id"))
    near = found.where("low <> id").select(F.col("low").alias("a"), F.col("id").alias("b"))
    loose = components(near)
    sizes = stored(loose.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    total = loose.count()
    grouped = join_counted(loose, sizes, "root", "n", total, F.xxhash64("id"))
    # A stable hash, as the chunk is worked out for each pair of chunks.
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("id"), chunks).cast("int")
    placed = stored(grouped.select("id", "root", chunks.alias("chunks"), chunk.alias("chunk")), "placed")
    payload = [c for c in sets.columns if c != "id"]
    width = sets.agg(F.sum(reduce(add, (F.octet_length(c) for c in payload)))).first()[0] or 0
    groups = max(group_count(members.sparkSession), 1 + width // GROUP_BYTES)
    alone = F.array(
        F.struct(
            F.pmod(F.xxhash64("root"), F.lit(groups)).alias("deal"),
            F.lit(-1).alias("i"),
            F.lit(-1).alias("j"),
        )
    )
    several = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda k: F.struct(
            F.col("root").alias("deal"),
            F.least("chunk", k).alias("i"),
            F.greatest("chunk", k).alias("j"),
        ),
    )
    seats = F.when(F.col("chunks") == 1, alone).otherwise(several)
    wide = placed.join(sets, "id")
    dealt = wide.withColumn("_seat", F.explode(seats)).select(
        "_seat.deal", "_seat.i", "_seat.j", "root", *sets.columns
    )
    edges = dealt.groupBy("deal", "i", "j").applyInArrow(
        _spanning(load, payload, similarity), "a long, b long"
    )
    labels = components(stored(edges, "links"))
    least = stored(
        labels.groupBy("root").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n")),
        "classes",
    )
    total = labels.count()
    return join_counted(labels, least, "root", "n", total, F.xxhash64("id")).select("id", "class")


def _spanning(load: Callable[..., list[tuple]], payload: list[str], similarity: float):
    """Task: the links that span each group's components, among the members at hand."""

    def run(table):
        import pyarrow as pa

        rows = table.to_pydict()
        by_root: dict[int, list[int]] = {}
        for at, root in enumerate(rows["root"]):
            by_root.setdefault(root, []).append(at)
        loaded = load(*(rows[c] for c in payload))
        ends: list[tuple[int, int]] = []
        for places in by_root.values():
            found = links([loaded[at] for at in places], similarity)
            ends += [(rows["id"][places[a]], rows["id"][places[b]]) for a, b in found]
        columns = [pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)]
        return pa.Table.from_arrays(columns, names=["a", "b"])

    return run


def link_buckets(
    members: DataFrame, texts: DataFrame, load: Callable[..., list[np.ndarray]], similarity: float
) -> DataFrame:
    """``id, class`` for each id linked to another: the smallest id of its component.

    ``members`` holds ``bucket, id`` (long), once each, and is read more than once;
    ``texts`` has one row ``id, body``; ``load`` turns bodies into sets of ascending 64-bit
    elements. All pairs that share a bucket are linked if their Jaccard similarity is
    high enough, unless other links join them already.

    Of buckets with the same members one is looked at. Members of several buckets go to a
    task together with their texts; a bucket of more than ``CHUNK`` members
    is spread over tasks by pairs of chunks. No pair is ever a row: a task gives back
    links that span the components it has found.
    """
    spark = members.sparkSession
    of = F.col("id")
    named = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64(of, F.lit(1))).alias("one"),
        F.bit_xor(F.xxhash64(of, F.lit(2))).alias("two"),
    )
    kept = named.groupBy("n", "one", "two").agg(F.min("bucket").alias("bucket"))
    kept = stored(kept.where("n > 1").select("bucket", "n"), "buckets")
    total = members.count()
    met = join_counted(members, kept, "bucket", "n", total, F.xxhash64("id"))
    met = stored(met.where("n IS NOT NULL"), "bucket-members")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("id"), chunks).cast("int")
    mean = texts.agg(F.avg(F.octet_length("body"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(partitions, 1 + int(met.count() * mean) // GROUP_BYTES)
    alone = F.array(
        F.struct(
            F.pmod(F.xxhash64("bucket"), F.lit(groups)).alias("deal"),
            F.lit(-1).alias("i"),
            F.lit(-1).alias("j"),
        )
    )
    several = F.transform(
        F.sequence(F.lit(0), chunks - 1),
        lambda k: F.struct(
            F.col("bucket").alias("deal"), F.least(chunk, k).alias("i"), F.greatest(chunk, k).alias("j")
        ),
    )
    seats = F.when(F.col("n") <= CHUNK, alone).otherwise(several)
    seated = met.select("bucket", "id", F.explode(seats).alias("seat"))
    dealt = seated.join(texts, "id").select("seat.deal", "seat.i", "seat.j", "bucket", "id", "body")
    edges = dealt.groupBy("deal", "i", "j").applyInArrow(
        _spanning_buckets(load, similarity), "a long, b long"
    )
    labels = components(stored(edges, "links"))
    least = stored(
        labels.groupBy("root").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n")),
        "classes",
    )
    linked = labels.count()
    return join_counted(labels, least, "root", "n", linked, F.xxhash64("id")).select("id", "class")


def _spanning_buckets(load: Callable[..., list[np.ndarray]], similarity: float):
    """Task: the links that span the components of lines that share buckets."""

    def run(table):
        import pyarrow as pa

        ids, first, place = np.unique(
            table.column("id").to_numpy(), return_index=True, return_inverse=True
        )
        bodies = table.column("body").take(pa.array(first)).to_pylist()
        bucket = table.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        ends = bucket_links(load(bodies), np.split(place[order], cuts), similarity)
        return pa.table({"a": ids[[a for a, _ in ends]], "b": ids[[b for _, b in ends]]})

    return run


def bucket_links(
    sets: list[np.ndarray], buckets: list[np.ndarray], similarity: float
) -> list[tuple[int, int]]:
    """Pairs of places that span the components of sets that share a bucket and are similar.

    Of a pair, what a map of ``MAP_BITS`` bits shows bounds how much it can share; those
    that may be similar, and aren't joined yet, are compared element by element.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    maps = np.zeros((n, MAP_BITS // 64), np.uint64)
    for start in range(0, n, 2048):
        part = sets[start : start + 2048]
        marks = np.zeros((len(part), MAP_BITS), bool)
        owner = np.repeat(np.arange(len(part)), [len(s) for s in part])
        marks[owner, np.concatenate(part) % np.uint64(MAP_BITS)] = True
        maps[start : start + 2048] = np.packbits(marks, axis=1).view(np.uint64)
    extra = sizes - np.bitwise_count(maps).sum(1)
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    found: list[tuple[int, int]] = []

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        need = (similarity - 1e-9) / (1 + similarity) * (sizes[a] + sizes[b])
        able = np.minimum(sizes[a], sizes[b]) >= need
        a, b, need = a[able], b[able], need[able]
        most = np.bitwise_count(maps[a] & maps[b]).sum(1) + np.minimum(extra[a], extra[b])
        able = most >= need
        for x, y, least in zip(a[able].tolist(), b[able].tolist(), need[able], strict=True):
            rx, ry = find(x), find(y)
            if rx == ry:
                continue
            if len(np.intersect1d(sets[x], sets[y], assume_unique=True)) >= least:
                up[max(rx, ry)] = min(rx, ry)
                found.append((x, y))

    left, right, waiting = [], [], 0
    for members in buckets:
        # A row of pairs at a time, so that large buckets need no more memory.
        for k in range(len(members) - 1):
            rest = members[k + 1 :]
            left.append(np.full(len(rest), members[k]))
            right.append(rest)
            waiting += len(rest)
            if waiting > PAIRS:
                compare(np.concatenate(left), np.concatenate(right))
                left, right, waiting = [], [], 0
    if waiting:
        compare(np.concatenate(left), np.concatenate(right))
    return found


def links(sets: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> Iterator[tuple]:
    """Pairs of places that span the components of similar weighted sets.

    What two sets share is a scalar product once every weight of an element is
    cut into steps from one occurring weight to the next: a set has all steps
    up to its own weight.
    """
    n = len(sets)
    if n < 2:
        return
    if n == 2:
        (ea, wa), (eb, wb) = sets
        _, at_a, at_b = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
        both = np.minimum(wa[at_a], wb[at_b]).sum()
        if both >= (similarity - 1e-9) * (wa.sum() + wb.sum() - both):
            yield 0, 1
        return
    owner = np.repeat(np.arange(n), [len(e) for e, _ in sets])
    elements = np.concatenate([e for e, _ in sets])
    weights = np.concatenate([w for _, w in sets])
    totals = np.bincount(owner, weights, n)
    order = np.lexsort((weights, elements))
    owner, elements, weights = owner[order], elements[order], weights[order]
    new_element = np.concatenate([[True], elements[1:] != elements[:-1]])
    new_step = new_element | np.concatenate([[True], weights[1:] != weights[:-1]])
    step = np.cumsum(new_step) - 1
    first = np.flatnonzero(new_step)
    before = np.concatenate([[0.0], weights[first][:-1]])
    before[new_element[first]] = 0.0
    rise = weights[first] - before
    # The first step of the entry's element; an entry has those from there to its own.
    lowest = step[np.maximum.accumulate(np.where(new_element, np.arange(len(step)), 0))]
    many = step - lowest + 1
    who = np.repeat(owner, many)
    column = np.repeat(lowest, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    held = np.bincount(column, minlength=len(rise))
    keep = held[column] > 1
    who, column = who[keep], column[keep]
    used, column = np.unique(column, return_inverse=True)
    scale = np.sqrt(rise[used])
    shared = np.zeros((n, n))
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    for start in range(0, len(used), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((n, min(COLUMNS, len(used) - start)))
        part[who[a:b], column[a:b] - start] = scale[column[a:b]]
        shared += part @ part.T
    similar = shared >= (similarity - 1e-9) * (totals[:, None] + totals[None, :] - shared)
    waiting = np.ones(n, bool)
    for start in range(n):
        if not waiting[start]:
            continue
        waiting[start] = False
        front = [start]
        while front:
            at = front.pop()
            for other in np.flatnonzero(similar[at] & waiting):
                waiting[other] = False
                front.append(other)
                yield at, other
