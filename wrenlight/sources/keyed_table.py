"""A table on Parquet with one row a key; a batch rewrites the key ranges it touches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wrenlight.operators import keyed
from wrenlight.operators.ranking import numbered
from wrenlight.sources.files import exists
from wrenlight.sources.scratch import stored

#: Folders that share the rows without a key.
KEYLESS = 64

#: So many touched folders are named to the scan; more are found by a join.
LISTED = 4_096

#: A batch's new keys go to about so many folders at most: each costs a file, and each read a listing.
FOLDERS = 256

# Fixed value: each level of folders is so many times as wide as the one below.
WIDER = 16


@dataclass
class KeyedTable:
    """Rows under ``path`` in one folder for each ``span`` of key values, their ``slice``.

    The new keys of a batch that has more than ``FOLDERS`` of these ranges go to wider ones, so
    the folders don't grow with the batch. A stored key stays where it is.

    Spark's dynamic partition overwrite replaces the touched folders; the new content is staged
    in the shared folder first. One writer at a time. Rows carry the name of the batch that wrote
    them, so a batch that died half-way, or comes again, changes nothing when it is
    repeated: keys are upserted anew, and its rows without a key replaced.

    With an ``id_column`` new rows draw surrogate ids above all stored ones.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    span: int = 1 << 40
    id_column: str | None = None

    def _schema(self) -> StructType:
        own = [StructField("batch", StringType()), StructField("slice", LongType())]
        return StructType([*self.schema.fields, *own])

    def _rows(self) -> DataFrame:
        schema = self._schema()
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        """The content."""
        return self._rows().select(*self.schema.names)

    def _spans(self, chosen: DataFrame) -> DataFrame:
        """The spans that hold keys of the batch."""
        keys = chosen.where(F.col(self.key).isNotNull())
        return keys.select(F.expr(f"`{self.key}` div {self.span}").alias("span")).distinct()

    def _folders(self) -> list[Column]:
        """The folder of a ``span`` on each level: the span itself, then hashes of wider ranges.

        Hashes that meet put two ranges into one folder, which is only larger.
        """
        levels, width = [F.col("span")], WIDER
        while self.span * width < 1 << 62:
            levels.append(F.xxhash64(F.lit(width), F.expr(f"span div {width}")))
            width *= WIDER
        return levels

    def _widened(self, staged: DataFrame) -> DataFrame:
        """The stored batch with its keys on the lowest level that has few enough folders."""
        folders = self._folders()
        counts = self._spans(staged).agg(*[F.approx_count_distinct(f) for f in folders]).first()
        level = next((k for k, n in enumerate(counts) if n <= FOLDERS), len(folders) - 1)
        if not level:
            return staged
        own = staged.withColumn("span", F.expr(f"`{self.key}` div {self.span}"))
        wide = F.when(F.col(self.key).isNotNull(), folders[level]).otherwise(F.col("slice"))
        return own.withColumn("slice", wide).drop("span")

    def _staged(self, chosen: DataFrame, name: str | None) -> DataFrame:
        """The batch with slices and ids, stored."""
        # Where a row without a key goes must not depend on its id.
        keyless = -1 - F.pmod(F.xxhash64(*chosen.columns), F.lit(KEYLESS))
        slices = F.coalesce(F.expr(f"`{self.key}` div {self.span}"), keyless)
        own = {"batch": F.lit(name).cast("string"), "slice": slices.cast("long")}
        chosen = chosen.withColumns(own)
        if not self.id_column:
            return self._widened(stored(chosen, "batch", self.spark))
        highest = self._rows().agg(F.max(self.id_column)).first()[0] or 0
        drawn = numbered(chosen.drop(self.id_column), self.id_column, self.spark)
        return self._widened(
            drawn.withColumn(self.id_column, F.col(self.id_column) + F.lit(highest + 1))
        )

    def _touched(self, chosen: DataFrame, name: str | None) -> DataFrame:
        """The stored rows of the folders that the batch touches, less its own without a key."""
        ranges = self._spans(chosen).select(F.explode(F.array(*self._folders())).alias("slice"))
        keyless = chosen.where(F.col(self.key).isNull()).select("slice")
        held = self._rows().select("slice").distinct()
        slices = held.join(ranges.unionAll(keyless).distinct(), "slice", "left_semi")
        listed = [r["slice"] for r in slices.limit(LISTED + 1).collect()]
        if len(listed) <= LISTED:
            # Folders are left out when the scan is planned.
            rows = self._rows().where(F.col("slice").isin(listed))
        else:
            rows = self._rows().join(slices, "slice", "left_semi")
        mine = F.col(self.key).isNull() & (F.col("batch") == F.lit(name))
        return rows.where(~F.coalesce(mine, F.lit(False)))

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = rows.hint("rebalance", "slice").write.mode(mode).partitionBy("slice")
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def upsert(
        self, batch: DataFrame, update: Sequence[str], order: Sequence[str], name: str | None = None
    ) -> None:
        """Insert new keys, refresh ``update`` on stored ones; the last repeat wins."""
        chosen = self._staged(keyed.last_per_key(batch, self.key, order), name)
        rows = keyed.merge_unique(
            self._touched(chosen, name), chosen, self.key, [*update, "batch"]
        )
        self._write(stored(rows, "merged", self.spark), "overwrite")

    def insert_ignore(self, batch: DataFrame, order: Sequence[str], name: str | None = None) -> None:
        """Insert new keys and leave stored ones, whose files stay; the first repeat wins."""
        if name is not None:
            known = self._rows().where(F.col(self.key).isNull() & (F.col("batch") == name))
            if not known.isEmpty():
                batch = batch.where(F.col(self.key).isNotNull())
        fresh = keyed.absent(keyed.first_per_key(batch, self.key, order), self.read(), self.key)
        chosen = self._staged(fresh, name)
        names = [*self.schema.names, "batch", "slice"]
        lacking = {n: F.lit(None) for n in names if n not in chosen.columns}
        kinds = {f.name: f.dataType for f in self._schema().fields}
        rows = chosen.withColumns(lacking) if lacking else chosen
        self._write(rows.select(*(F.col(n).cast(kinds[n]).alias(n) for n in names)), "append")
