"""Secret scans over content-addressed texts, with a ledger of what was scanned."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenlight.llm.common import join_counted, slices, ship_package
from wrenlight.sources.scratch import stored

# The patterns of each kind, in the order in which ties are listed.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = (
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"

#: Changes whenever a rule does, so that every text is scanned again.
RULE_VERSION = 1

ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# The longest run wins and a shorter one fails, so the least length can be in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4))
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
_PRIVATE_KEY = re.compile(PRIVATE_KEY)
_WEB_TOKEN = re.compile(WEB_TOKEN)

LEDGER = T.StructType(
    [
        T.StructField("blob", T.StringType()),
        T.StructField("rule_version", T.IntegerType()),
        T.StructField("copies", T.LongType()),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("kind", T.StringType()),
                        T.StructField("start", T.IntegerType()),
                        T.StructField("stop", T.IntegerType()),
                    ]
                )
            ),
        ),
    ]
)


def find_spans(text: str) -> list[dict]:
    """The spans of one text in code points, by start, then kind; the end is exclusive."""
    found = []
    if "=" in text or ":" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.append((m.start(), 0, "assign", m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), 3, "private_key", m.end()) for m in _PRIVATE_KEY.finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), 4, "web_token", m.end()) for m in _WEB_TOKEN.finditer(text)]
    return [{"kind": k, "start": a, "stop": b} for a, _, k, b in sorted(found)]


def _scan(batches) -> Iterator:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(LEDGER)
    for part in slices(batches):
        n = len(part["text"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part["blob"], schema.field(0).type),
                pa.array([RULE_VERSION] * n, schema.field(1).type),
                pa.array(part["copies"], schema.field(2).type),
                pa.array([find_spans(t) for t in part["text"]], schema.field(3).type),
            ],
            schema=schema,
        )


#: Spans in a list that may be broadcast; there are less than a thousand such lists.
SHORT_LIST = 1_000


def addressed(versions: DataFrame, text: str = "text") -> DataFrame:
    """``versions`` with the content address of its text (null: empty)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return versions.withColumn("blob", F.sha2(body, 256))


def scan_unseen(
    versions: DataFrame, ledger: DataFrame | None = None, text: str = "text"
) -> DataFrame:
    """Ledger rows for the texts of ``versions`` not yet scanned by this rule version.

    Copies of a text become one row in the map task already and are scanned
    once. ``ledger`` holds the rows of earlier calls; append the result to it.
    """
    ship_package(versions.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    blobs = (
        versions.select(F.sha2(body, 256).alias("blob"), body.alias("text"))
        .groupBy("blob", "text")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    return blobs.mapInArrow(_scan, LEDGER)


def findings_of(versions: DataFrame, ledger: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``versions`` with the ``spans`` of its text (an empty list if none).

    ``versions`` may hold any path or time columns; they are kept.
    Ledger rows of other rule versions are ignored.
    """
    current = ledger.where(F.col("rule_version") == RULE_VERSION)
    hits = current.where(F.size("spans") > 0).select("blob", "spans", "copies")
    rows = addressed(versions, text).drop(text)
    total = current.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    # Lists are broadcast with the blobs of many rows if they are short; long ones
    # are joined by a shuffle, in which Spark can split the rows of one blob.
    short = F.size("spans") <= SHORT_LIST
    found = join_counted(
        rows, hits.where(short), "blob", "copies", total, F.xxhash64(*rows.columns)
    )
    long = hits.where(~short).select(F.col("blob").alias("_blob"), F.col("spans").alias("_long"))
    found = found.join(long, F.col("blob") == F.col("_blob"), "left")
    none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    return found.drop("copies", "_blob").withColumn(
        "spans", F.coalesce("spans", "_long", none)
    ).drop("_long")


def secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ledger: DataFrame | None = None
) -> DataFrame:
    """``doc_id, spans`` for every row: where its text holds what looks like a secret.

    Base kinds are assignments, access keys and long hex runs, leftmost and
    without overlap within a kind; private-key headers and web tokens are added.
    Null texts are empty and hold none; repeated rows each get a row; other
    columns are ignored; an empty table gives no rows.
    """
    versions = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fresh = stored(scan_unseen(versions, ledger), "secret-ledger")
    known = fresh if ledger is None else ledger.select(fresh.columns).unionAll(fresh)
    return findings_of(versions, known).select("doc_id", "spans")
