"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer is chosen if the smallest hash among its inner s-mers stands at its
first or last place. The choice looks at nothing but the k-mer, so a passage
has the same anchors wherever it stands, and an edit changes only the anchors
that touch it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points in a k-mer and in its inner s-mers: about 2 / (K - S + 1) of all places are chosen.
K, S = 16, 5

#: With fewer anchors than this in either text, likeness is that of all runs of so many code points.
FEW, GRAM = 10, 3

#: A text is worked on in pieces of so many places, which overlap by ``K - 1``.
PIECE = 2048

#: Inner hashes of which the smallest is worked out once, at most K - S - 1.
RUN = 3

#: Ranges of ids for each shuffle partition, so that hashing the ranges deals them evenly.
RANGES_PER_PARTITION = 4

_WIDE = 4  # bytes of a code point in UTF-32


def anchors(text: Column) -> Column:
    """The anchors of a text as ``array<struct<place:int, hash:int>>``, by place from 0.

    The text is laid out as UTF-32, so that every piece is reached in one step;
    a piece's inner hashes are made once and looked at by all its k-mers. A text
    shorter than K has none.
    """
    window = K - S + 1

    def of_text(wide: Column) -> Column:
        n = (F.octet_length(wide) / F.lit(_WIDE)).cast("int") - (K - 1)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(PIECE))).otherwise(
            F.array().cast("array<int>")
        )
        return F.flatten(F.transform(starts, lambda start: of_piece(wide, start, n)))

    def of_piece(wide: Column, start: Column, n: Column) -> Column:
        count = F.least(F.lit(PIECE), n - start)
        first = start * _WIDE + 1
        inner = F.transform(
            F.sequence(first, first + (count + (window - 2)) * _WIDE, F.lit(_WIDE)),
            lambda at: F.xxhash64(F.substring(wide, at, F.lit(S * _WIDE))),
        )

        # The smallest of RUN hashes from each place on; such runs then cover all that lie
        # between the edges. Nearly half of the places fail at the first run.
        def runs(hashes: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), count + (window - RUN - 1)),
                lambda i: F.least(*(F.get(hashes, i + k) for k in range(RUN))),
            )

        def chosen(hashes: Column, least: Column) -> Column:
            def closed(i: Column) -> Column:
                at = [*range(1, window - 1 - RUN, RUN), window - 1 - RUN]
                edge = F.least(F.get(hashes, i), F.get(hashes, i + (window - 1)))
                return reduce(and_, (edge <= F.get(least, i + k) for k in at))

            return F.transform(
                F.filter(F.sequence(F.lit(0), count - 1), closed),
                lambda i: F.struct(
                    (start + i).alias("place"),
                    F.hash(F.substring(wide, first + i * _WIDE, F.lit(K * _WIDE))).alias("hash"),
                ),
            )

        return _with(inner, lambda hashes: _with(runs(hashes), lambda least: chosen(hashes, least)))

    return _with(F.encode(text, "UTF-32"), of_text)


def _with(value: Column, function) -> Column:
    """``function`` of an array-valued step, with ``value`` worked out once."""
    return F.flatten(F.transform(F.array(value), function))


def hashes_of(anchor_list: Column, text: Column) -> Column:
    """The anchor hashes, or the hash of the whole text where there is no anchor."""
    hashes = F.transform(anchor_list, lambda a: a["hash"])
    return F.when(F.size(hashes) > 0, hashes).otherwise(F.array(F.hash(text)))


def fingerprint(hashes: Column) -> Column:
    """The anchor hashes in order of place, eight hex digits each."""
    return F.array_join(
        F.transform(hashes, lambda h: F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared by all distinct hashes, 0 to 1."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - shared)


def grams(text: Column) -> Column:
    """The hashes of all runs of ``GRAM`` code points; of a shorter text, its own."""

    def of_text(wide: Column) -> Column:
        last = F.greatest(F.lit(1), F.octet_length(wide) - (GRAM * _WIDE - 1))
        return F.transform(
            F.sequence(F.lit(1), last, F.lit(_WIDE)),
            lambda at: F.xxhash64(F.substring(wide, at, F.lit(GRAM * _WIDE))),
        )

    return _with(F.encode(text, "UTF-32"), of_text)


def text_likeness(a: Column, a_text: Column, b: Column, b_text: Column) -> Column:
    """The likeness of two texts by their anchors, or by all grams where anchors are few."""
    pair = F.array(F.struct(grams(a_text).alias("a"), grams(b_text).alias("b")))
    fine = F.transform(pair, lambda p: likeness(p["a"], p["b"]))[0]
    few = (F.size(a) < FEW) | (F.size(b) < FEW)
    return F.when(few, fine).otherwise(likeness(a, b))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, anchors, hashes, fingerprint`` for every row (null text: empty).

    Equal texts have equal fingerprints. Repeated rows and other columns need
    no care.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    found = rows.withColumn("anchors", anchors(F.col("text")))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "anchors",
        hashes_of(F.col("anchors"), F.col("text")).alias("hashes"),
    ).withColumn("fingerprint", fingerprint(F.col("hashes")))


def ranged(docs: DataFrame, doc_id: str) -> DataFrame:
    """``docs`` with ``range`` and ``guest``: ranges of ids, each with the row that follows it.

    The first row of every range also stands, as a guest, at the end of the
    range before; the first of all at the end of the last. What comes to the
    driver and is broadcast is one id for each range.
    """
    spark = docs.sparkSession
    n = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(doc_id)
    steps = [i / n for i in range(1, n)]
    edges = docs.agg(F.percentile_approx(doc_id, steps, 100 * n).alias("edges")).first()["edges"]
    edges = sorted(set(edges or []))
    # Two steps of about the square root of all edges each.
    stride = max(1, int(len(edges) ** 0.5))
    kind = docs.schema[doc_id].dataType.simpleString()
    fine = F.array(*(F.lit(e) for e in edges)).cast(f"array<{kind}>")
    coarse = F.array(*(F.lit(e) for e in edges[stride - 1 :: stride])).cast(f"array<{kind}>")
    behind = F.size(F.filter(coarse, lambda e: e <= key)) * stride
    rest = F.filter(F.slice(fine, behind + 1, stride), lambda e: e <= key)
    place = F.coalesce(F.when(key.isNotNull(), behind + F.size(rest)), F.lit(0))
    rows = docs.withColumn("range", place)
    firsts = (
        rows.groupBy("range")
        .agg(F.min(F.struct(key.isNotNull().alias("known"), key.alias("id"))).alias("first"))
        .orderBy("range")
        .collect()
    )
    at = [r["range"] for r in firsts]
    guests = spark.createDataFrame(
        [(r["first"]["id"], at[i - 1]) for i, r in enumerate(firsts)], f"_first {kind}, _host int"
    )
    hosts = F.when(
        F.col("_host").isNotNull(), F.array(_seat("range", False), _seat("_host", True))
    ).otherwise(F.array(_seat("range", False)))
    return (
        rows.join(F.broadcast(guests), key.eqNullSafe(F.col("_first")), "left")
        .withColumn("_seat", F.explode(hosts))
        .select(*(F.col(c) for c in docs.columns), "_seat.range", "_seat.guest")
    )


def _seat(place: str, guest: bool) -> Column:
    return F.struct(F.col(place).alias("range"), F.lit(guest).alias("guest"))


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's fingerprint next to that of its edited text and of the next row.

    The edited text has its last quarter replaced by the beginning of the next
    text by ascending id (after the last: the first). Its anchors are those of
    the kept part and those of the places that the edit touches; nothing else is
    hashed again. Where one of two texts has fewer than ``FEW`` anchors, their
    likeness is that of their runs of ``GRAM`` code points.

    Returns ``doc_id, n_chars, edited, fingerprint, edited_fingerprint,
    near_edited, near_next``. Null texts are empty, null ids come first,
    repeated ids are ordered by a hash of their text, a single row is its own
    next. The texts are shuffled once, by ranges of the id; no task gets more
    than a few ranges.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranged(rows, "doc_id").repartition(parts, "range")
    order = Window.partitionBy("range").orderBy("guest", "doc_id", F.xxhash64("text"))
    mine = dealt.withColumn("anchors", anchors(F.col("text"))).withColumn(
        "hashes", hashes_of(F.col("anchors"), F.col("text"))
    )
    following = (
        mine.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_hashes", F.lead("hashes").over(order))
        .where(~F.col("guest"))
    )
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    cut = following.withColumn("cut", n - quarter).withColumn(
        "edited", F.concat(F.expr("left(text, cut)"), F.left("next_text", quarter))
    )
    touched = F.greatest(F.lit(0), F.col("cut") - (K - 1))
    tail = cut.withColumn("touched", touched).withColumn(
        "tail", anchors(F.substring("edited", F.col("touched") + 1, F.length("edited")))
    )
    kept = F.filter("anchors", lambda a: a["place"] < F.col("touched"))
    edited = tail.withColumn(
        "edited_hashes", hashes_of(F.concat(kept, F.col("tail")), F.col("edited"))
    )
    return edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "edited",
        fingerprint(F.col("hashes")).alias("fingerprint"),
        fingerprint(F.col("edited_hashes")).alias("edited_fingerprint"),
        text_likeness(
            F.col("hashes"), F.col("text"), F.col("edited_hashes"), F.col("edited")
        ).alias("near_edited"),
        text_likeness(
            F.col("hashes"), F.col("text"), F.col("next_hashes"), F.col("next_text")
        ).alias("near_next"),
    )
