"""Exact duplicates: a 128-bit content hash, then the bytes themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenlight.llm.common import join_counted
from wrenlight.sources.scratch import stored

BLANKS = r"[\x20\x09-\x0D]+"


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """For every row the smallest id among the rows with an equal text.

    Texts are equal when identical after each run of blanks became one space;
    null counts as empty. Returns ``doc_id, keep_id, group_size, kept,
    text_sha256``, one row for each input row.

    Rows are grouped by content hash *and* text, so that texts whose hashes
    collide are told apart by their bytes; copies of one text are merged in
    the map task before the shuffle, however many there are. Rows then find
    their group by the hash alone; a hash shared by different texts, should
    there be one, is looked up by the text as well.

    A null id never is the kept one unless its group has no other; ``kept`` is
    true for every row with the kept id, so repeated rows share the decision.
    Other columns of ``docs`` are ignored. An empty table gives no rows.
    """
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"))
    rows = rows.withColumn("hash", hashed(F.col("body")))
    groups = rows.groupBy("hash", "body").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    by_hash = stored(
        groups.groupBy("hash").agg(
            F.min("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
            F.count(F.lit(1)).alias("texts"),
        ),
        "exact-groups",
    )
    total, most = by_hash.agg(
        F.coalesce(F.sum("group_size"), F.lit(0)), F.coalesce(F.max("texts"), F.lit(1))
    ).first()
    narrow = rows.select("doc_id", "hash", F.sha2("body", 256).alias("text_sha256"))
    found = join_counted(
        narrow, by_hash, "hash", "group_size", total, F.xxhash64("doc_id", "text_sha256")
    )
    if most > 1:
        shared = by_hash.where("texts > 1").select("hash")
        told_apart = groups.join(shared, "hash", "left_semi")
        clashing = (
            rows.join(shared, "hash", "left_semi")
            .join(told_apart, ["hash", "body"])
            .select("doc_id", "keep_id", "group_size", F.sha2("body", 256).alias("text_sha256"))
        )
        found = found.where("texts = 1").select(clashing.columns).unionAll(clashing)
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
