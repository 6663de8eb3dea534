"""JSON-lines and CSV files, read with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wrenlight.schemas import LABELLED, RAW_TWEET
from wrenlight.sources.scratch import fits_broadcast, stored

# Layout of the labelled files. Outer blanks are part of a text.
LABELLED_OPTIONS = {
    "header": "false",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
LABELLED_ENCODING = "ISO-8859-1"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_json_lines(
    spark: SparkSession, prefix: str, schema: StructType = RAW_TWEET, arrival: bool = False
) -> DataFrame:
    """Every ``*.json`` file whose path starts with the prefix, one document per line.

    ``arrival`` adds when and where each row arrived, in the order of its file.
    """
    rows = spark.read.schema(schema).json(f"{prefix}*.json")
    if not arrival:
        return rows
    return rows.select(
        "*",
        F.col("_metadata.file_modification_time").alias("arrived_at"),
        F.col("_metadata.file_path").alias("arrived_in"),
        F.col("_metadata.file_block_start").alias("arrived_block"),
        F.monotonically_increasing_id().alias("arrived_row"),
    )


def append_json_lines(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def _marked_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Stored lines of the files, each with the place of the record it starts, if it does.

    A line starts a record if the quotes before it in its file are even in number. They
    are counted in every block of a file alone; a running sum over the blocks, one row
    each, says with which parity a block begins.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(
        F.decode(F.col("value").cast("binary"), encoding).alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    ).withColumn("quotes", F.regexp_count("line", F.lit('"')))
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    parity = stored(blocks.select("file", "block", first.alias("parity")), "csv-blocks")
    parity = F.broadcast(parity) if fits_broadcast(parity) else parity
    inside = Window.partitionBy("file", "block").orderBy("id")
    ahead = F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    numbered = lines.select(
        "line", "file", "block", F.coalesce(ahead, F.lit(0)).alias("ahead"), F.row_number().over(inside).alias("row")
    ).join(parity, ["file", "block"])
    start = F.when((F.col("ahead") + F.col("parity")) % 2 == 0, F.col("row"))
    place = Window.partitionBy("file", "block").orderBy("row")
    marked = numbered.select("line", "file", "block", "row", start.alias("start")).select(
        "*",
        F.max("start").over(place).alias("of"),
        F.lead(F.col("start").isNotNull()).over(place).alias("ends"),
    )
    return stored(marked, "csv-lines")


def csv_records(
    spark: SparkSession, path: str, encoding: str = "UTF-8", header: bool = False
) -> DataFrame:
    """``record``: the records of CSV files whose quoted fields may hold line breaks.

    Files are cut into blocks and read by as many tasks. Quotes must stand around fields or
    be doubled inside them. With a ``header`` each file's first record is left out.
    Only lines of records that have several, or end a block, are grouped.
    """
    marked = _marked_lines(spark, path, encoding)
    if header:
        title = (F.col("block") == 0) & F.coalesce(F.col("of") == 1, F.lit(False))
        marked = marked.where(~title)
    alone = F.col("start").isNotNull() & F.coalesce("ends", F.lit(False))
    # A block that begins inside a record goes on with the last that a block before it began.
    last = marked.groupBy("file", "block").agg(F.max("start").alias("of"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.struct(F.col("block").alias("block"), F.col("of").alias("of"))
    carried = last.select(
        "file",
        "block",
        F.last(F.when(F.col("of").isNotNull(), begun), ignorenulls=True).over(before).alias("carried"),
    )
    parts = marked.where(~alone).join(carried, ["file", "block"])
    own = F.struct(F.col("block").alias("block"), F.col("of").alias("of"))
    grouped = parts.groupBy(
        "file", F.when(F.col("of").isNotNull(), own).otherwise(F.col("carried")).alias("record_at")
    ).agg(F.sort_array(F.collect_list(F.struct("block", "row", "line"))).alias("lines"))
    several = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    records = marked.where(alone).select(F.col("line").alias("record")).unionAll(
        grouped.select(several.alias("record"))
    )
    ended = F.regexp_replace("record", r"\r\z", "")
    return records.select(ended.alias("record")).where(F.length(F.trim("record")) > 0)


def _parsed(records: DataFrame, schema: StructType, options: dict) -> DataFrame:
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    row: Column = F.from_csv("record", ddl, {k: str(v) for k, v in options.items()})
    return records.select(row.alias("row")).select("row.*")


def read_labelled_csv(
    spark: SparkSession,
    path: str,
    schema: StructType = LABELLED,
    encoding: str = LABELLED_ENCODING,
) -> DataFrame:
    """Labelled texts without header; an empty text comes back as null."""
    return _parsed(csv_records(spark, path, encoding), schema, LABELLED_OPTIONS)


def write_labelled_csv(df: DataFrame, path: str, encoding: str = LABELLED_ENCODING) -> None:
    """Write in the layout ``read_labelled_csv`` reads.

    The default encoding is that of the labelled files; it has no place for
    characters beyond Latin-1, which need UTF-8.
    """
    df.write.options(**LABELLED_OPTIONS, encoding=encoding).csv(path)


def export_csv(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """Chosen columns with a header line, in UTF-8, texts as they are."""
    options = LABELLED_OPTIONS | {"header": "true", "encoding": "UTF-8"}
    df.select(*columns).write.options(**options).csv(path)


def read_export(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``export_csv`` wrote; an empty text comes back as null."""
    return _parsed(csv_records(spark, path, header=True), schema, LABELLED_OPTIONS)


def stored_ids(tweets: DataFrame, key: str = "tweet_id") -> DataFrame:
    """One column of a stored table; only that column is read."""
    return tweets.select(key)
