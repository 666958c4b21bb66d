"""Units collapsed once and kept: each question over re-tested units then reads a row a unit instead of collapsing all rows anew.

The table is bucketed by SN. A new batch is collapsed by itself and merged into it: only the batch is shuffled, to the buckets that the
table has already. Which batches are in it is part of the same manifest entry as its data, so an update happens once or not at all, and
batches may come in any order. Questions that filter rows before they are collapsed need the rows, not this table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.functions.columns import time_of
from yieldloom.operators.latest import latest_per_unit
from yieldloom.plans import defects, rectification, yields
from yieldloom.sources.tableset import TableSet

#: The column that buckets are made by: SN, where a missing one has a bucket of its own kind.
_KEY = "__unit"


def _named(kind: str, path: str) -> str:
    """The name by which the session's catalog knows the buckets of a path."""
    return f"{kind}_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


class KeptUnits:
    """tie: the columns that decide between equal times of a unit; the larger wins. Times must be timestamps. buckets: of a new table;
    as many as a shuffle has partitions by default, as Spark keeps the buckets of a side only if they are not fewer."""

    def __init__(self, spark: SparkSession, folder: str, tie: list[str], name: str = "units", buckets: int | None = None):
        self.spark, self.tables, self.tie, self.name = spark, TableSet(spark, folder), tie, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @property
    def batches(self) -> list[str]:
        """The batches that are in the table: its version."""
        entry = self.tables.entry(self.name)
        return entry["batches"] if entry else []

    def _table(self, entry: dict) -> DataFrame:
        path = self.tables.paths(self.name)[0]
        known = _named("kept", path)
        if not self.spark.catalog.tableExists(known):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(entry["schema"]))
            self.spark.sql(f"CREATE TABLE {known} ({columns}) USING parquet CLUSTERED BY ({_KEY}) INTO {entry['buckets']} BUCKETS LOCATION '{path}'")
        return self.spark.table(known)

    def rows(self) -> DataFrame:
        """A row a unit: the columns of its last row, and first_prod_time."""
        entry = self.tables.entry(self.name)
        if not entry:
            raise FileNotFoundError(f"no table {self.name} in {self.tables.folder}")
        return self._table(entry).drop(_KEY)

    def update(self, batch: str, judged: DataFrame) -> bool:
        """Take a batch's judged rows in; False if they are in already."""
        before = self.tables.entry(self.name)
        if before and batch in before["batches"]:
            return False
        new = latest_per_unit(judged, judged.columns, self.tie).withColumn(_KEY, F.coalesce(F.concat(F.lit("+"), F.col("SN").cast("string")), F.lit("-")))
        buckets = before["buckets"] if before else self.buckets
        out = self._merged(self._table(before), new) if before else new
        path = self.tables.new_folder(self.name)
        target = f"{self.tables.folder}/{path}"
        made = _named("kept_new", target)
        dealt = out if before else out.repartition(buckets, _KEY)  # else each task would write a file for each bucket
        dealt.write.bucketBy(buckets, _KEY).format("parquet").option("path", target).saveAsTable(made)
        self.spark.sql(f"DROP TABLE {made}")  # its files stay
        entry = {"paths": [path], "batches": sorted([*(before["batches"] if before else []), batch]), "buckets": buckets, "schema": out.schema.jsonValue()}
        self.tables.commit({self.name: entry}, {self.name: before})
        return True

    def _merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Of each unit the later of both rows, at the earlier of both first times. One side's missing columns are null."""
        side = lambda df, name: df.select(F.col(_KEY).alias(f"{name}_key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), self._order(df).alias(f"{name}_order"))
        both = side(old, "o").join(side(new, "n"), F.col("o_key") == F.col("n_key"), "full_outer")
        later = F.col("o_key").isNull() | F.coalesce(F.col("n_order") > F.col("o_order"), F.lit(False))
        kinds = {f.name: f.dataType for df in (new, old) for f in df.schema}
        pick = lambda c, name, df: F.col(name).getField(c) if c in df.columns else F.lit(None)
        own = [F.when(later, pick(c, "n", new).cast(k)).otherwise(pick(c, "o", old).cast(k)).alias(c) for c, k in kinds.items() if c not in (_KEY, "first_prod_time")]
        first = F.least(F.col("o.first_prod_time"), F.col("n.first_prod_time")).alias("first_prod_time")
        return both.select(*own, first, F.coalesce("o_key", "n_key").alias(_KEY))

    def _order(self, df: DataFrame) -> Column:
        return F.struct(time_of(df), *[F.col(c) for c in self.tie])

    def recorded(self) -> DataFrame:
        """Units with a time."""
        return self.rows().filter("Time IS NOT NULL")

    def daily(self, cutoff: int = 7) -> DataFrame:
        return yields.daily_of(self.recorded(), cutoff)

    def daily_top(self, n: int = 10, cutoff: int = 7) -> DataFrame:
        return defects.daily_top_of(self.recorded(), n, cutoff)

    def repair(self) -> DataFrame:
        return rectification.stats_of(self.recorded())

    def daily_repair(self, cutoff: int = 7) -> DataFrame:
        return rectification.daily_of(self.recorded(), cutoff)

    def unit_rows(self, columns: str = "core") -> DataFrame:
        return yields.rows_of(self.rows(), columns)


def update_all(units: KeptUnits, folder: str) -> list[str]:
    """Take in the judged batches of a folder that the table lacks; their ids."""
    judged = TableSet(units.spark, folder)
    names = [n for n in judged.names("judged_") if n.removeprefix("judged_") not in units.batches]
    return [n.removeprefix("judged_") for n in names if units.update(n.removeprefix("judged_"), judged.read(n))]
