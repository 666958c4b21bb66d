"""Versioned specifications: two small tables and what is asked of them."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yieldloom.config import UNBOUNDED
from yieldloom.sources import files, tables

VERSIONS = "version_id string, source_file string, imported_at timestamp_ntz, is_active boolean, description string"
LIMITS = "id string, version_id string, fai_name string, lower_limit double, upper_limit double, nominal double"


def versions_with_counts(versions: DataFrame, limits: DataFrame) -> DataFrame:
    """All versions, newest first, with their number of limits."""
    own = ["version_id", "source_file", "imported_at", "is_active", "description"]
    return versions.join(limits.select("version_id", "id"), "version_id", "left").groupBy(*own).agg(F.count("id").alias("fai_count")).orderBy(F.col("imported_at").desc_nulls_last(), "version_id")


def active(versions: DataFrame, limits: DataFrame) -> DataFrame:
    """The limits, by name, of the newest active version."""
    newest = versions.filter("is_active").orderBy(F.col("imported_at").desc_nulls_last(), "version_id").limit(1)
    return newest.select("version_id").join(limits, "version_id").select("version_id", "fai_name", "lower_limit", "upper_limit", "nominal").orderBy("fai_name")


def at_times(versions: DataFrame, times: DataFrame, column: str, grain: str = "hour") -> DataFrame:
    """For each time the newest version imported by then, or null.

    Times are looked up by hour (or another unit of date_trunc): an equi-join whose other side has, for each hour that any time is in,
    the version that the hour begins with and those imported within it. To find what an hour begins with, hours and versions are
    sorted as one stream, which the last version is carried along; that stream is as long as the hours and versions there are,
    however many times fall into them. Times are neither sorted nor spread by anything but their hour, and not even that where Spark
    finds the other side small enough to send to every task. A finer grain suits versions that come by the thousand an hour.
    """
    marks = versions.filter("imported_at IS NOT NULL").groupBy(F.col("imported_at").alias("__from")).agg(F.max("version_id").alias("version_id"))
    t = F.col(column)
    hour = lambda c: F.date_trunc(grain, c).cast("timestamp_ntz")
    hours = times.select(hour(t).alias("__from")).filter("__from IS NOT NULL").distinct()
    points = hours.withColumn("__mark", F.lit(0)).unionByName(marks.withColumn("__mark", F.lit(1)), allowMissingColumns=True)
    stream = Window.orderBy("__from", "__mark")
    held = points.select("__from", F.last("version_id", ignorenulls=True).over(stream).alias("version_id"), F.lead("__from").over(stream).alias("__until"), hour(F.col("__from")).alias("__hour"))
    on = (hour(t) == F.col("__hour")) & (t >= F.col("__from")) & (F.col("__until").isNull() | (t < F.col("__until")))
    return times.join(held, on, "left").select(*times.columns, "version_id")


def at_time(versions: DataFrame, moment: str) -> DataFrame:
    return versions.filter(F.col("imported_at") <= F.lit(moment).cast("timestamp_ntz")).orderBy(F.desc("imported_at"), "version_id").limit(1)


def validate(rows: DataFrame) -> DataFrame:
    """row and error of each fault. rows: row (from 1), fai_name, lower_limit, upper_limit, nominal."""
    name = F.trim(F.coalesce("fai_name", F.lit("")))
    low, high, mid = F.col("lower_limit"), F.col("upper_limit"), F.col("nominal")
    again = F.row_number().over(Window.partitionBy(name).orderBy("row")) > 1
    checks = [
        F.when(name == "", F.lit("empty name")), F.when((name != "") & F.col("again"), F.lit("duplicate name")),
        F.when(low > high, F.lit("lower above upper")), F.when((mid < low) | (mid > high), F.lit("nominal outside limits")),
    ]
    return rows.withColumn("again", again).select("row", F.explode(F.array_compact(F.array(*checks))).alias("error"))


def load_limits(rows: list[tuple]) -> list[tuple[str, float | None, float | None, float | None]]:
    """(name, lower, upper, nominal) from sheet rows of name, upper, nominal, lower; a heading is skipped, sentinels are no limit."""
    out = []
    for k, row in enumerate(rows):
        name = "" if row[0] is None else str(row[0]).strip().replace(" _", "_").replace("_ ", "_")
        if not name or (k == 0 and name.upper() in ("FAI", "FAI_NAME")):
            continue
        upper, nominal, lower = (_number(x) for x in (*row[1:4], None, None, None)[:3])
        out.append((name, lower, upper, nominal))
    return out


def _number(x) -> float | None:
    try:
        v = float(x)
    except (TypeError, ValueError):
        return None
    return None if v != v or abs(v) >= UNBOUNDED else v


class SpecStore:
    """The two tables as Parquet below a folder. A change writes a new copy beside the old, and then a pointer to both
    tables' copies; another store on the folder reads the newest pointer. Changes are made by one process at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.kinds = {"versions": VERSIONS, "limits": LIMITS}
        self.paths: dict[str, str] = {}
        newest = max(files.names(spark, self.folder, "current-*.json"), default=None)
        self.turn = 0
        if newest:
            self.turn = int(newest.removeprefix("current-").removesuffix(".json"))
            self.paths = json.loads(files.head(spark, f"{self.folder}/{newest}"))

    def _table(self, name: str) -> DataFrame:
        if name in self.paths:
            return self.spark.read.schema(self.kinds[name]).parquet(f"{self.folder}/{self.paths[name]}")
        return self.spark.createDataFrame([], self.kinds[name])

    @property
    def versions(self) -> DataFrame:
        return self._table("versions")

    @property
    def limits(self) -> DataFrame:
        return self._table("limits")

    def _put(self, **tables: DataFrame) -> None:
        """New copies of the named tables, and then the pointer: a reader sees all of a change or nothing."""
        paths = dict(self.paths)
        for name, df in tables.items():
            paths[name] = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{paths[name]}")
        files.put(self.spark, f"{self.folder}/current-{self.turn + 1:012d}.json", json.dumps(paths).encode())
        self.turn, self.paths = self.turn + 1, paths

    def create(self, source: str, description: str = "", at: datetime | None = None) -> str:
        version = str(uuid.uuid4())
        self._put(versions=self.versions.unionByName(self._version(version, source, description, at)))
        return version

    def _version(self, version: str, source: str, description: str, at: datetime | None) -> DataFrame:
        return self.spark.createDataFrame([(version, source, at or datetime.now(), False, description)], VERSIONS)

    def _limits(self, version: str, rows: list[tuple]) -> DataFrame:
        return self.limits.filter(F.col("version_id") != version).unionByName(self.spark.createDataFrame([(str(uuid.uuid4()), version, *r) for r in rows], LIMITS))

    def save_limits(self, version: str, rows: list[tuple]) -> int:
        self._put(limits=self._limits(version, rows))
        return len(rows)

    def activate(self, version: str) -> None:
        if self.versions.filter(F.col("version_id") == version).isEmpty():
            raise ValueError(f"no version {version}")
        self._put(versions=self.versions.withColumn("is_active", F.col("version_id") == version))

    def load(self, data: bytes, source: str, description: str = "", sheet: str = "Spec", use: bool = True, at: datetime | None = None) -> str:
        """A workbook's specification as a new version: read, checked, saved and (use) made the active one, as one change.
        Faults raise ValueError and change nothing."""
        header, rows = tables.read_sheet(data, sheet)
        limits = [(name, lower, upper, mid) for name, upper, mid, lower in ((n, *(_number(x) for x in rest)) for n, *rest in tables.spec_rows(header, rows))]
        if not limits:
            raise ValueError(f"{source}: no limits in sheet {sheet}")
        frame = self.spark.createDataFrame([(k, *r) for k, r in enumerate(limits, 1)], "row int, fai_name string, lower_limit double, upper_limit double, nominal double")
        faults = [f"row {r['row']}: {r['error']}" for r in validate(frame).orderBy("row", "error").collect()]  # a specification has some hundred rows
        if faults:
            raise ValueError(f"{source}: " + "; ".join(faults))
        version = str(uuid.uuid4())
        versions = self.versions.unionByName(self._version(version, source, description, at))
        if use:
            versions = versions.withColumn("is_active", F.col("version_id") == version)
        self._put(versions=versions, limits=self._limits(version, limits))
        return version

    def names(self, version: str) -> list[str]:
        """The dimensions that a version has limits for, in order."""
        return [r["fai_name"] for r in self.limits.filter(F.col("version_id") == version).select("fai_name").distinct().orderBy("fai_name").collect()]

    def show(self, name: str | None = None, preview: int = 10) -> dict | None:
        """The active version with its first limits by name, or one of its limits; None if there is no such thing."""
        row = self.versions.filter("is_active").orderBy(F.col("imported_at").desc_nulls_last(), "version_id").first()
        if row is None:
            return None
        limits = [r.asDict() for r in active(self.versions, self.limits).drop("version_id").collect()]  # some hundred rows
        if name is not None:
            return next((r | {"version_id": row["version_id"]} for r in limits if r["fai_name"] == name), None)
        return row.asDict() | {"fai_count": len(limits), "limits": limits[:preview]}

    def active_version(self) -> str | None:
        row = self.versions.filter("is_active").orderBy(F.col("imported_at").desc_nulls_last(), "version_id").first()
        return row["version_id"] if row else None

    def active_limits(self) -> dict[str, tuple[float | None, float | None]]:
        return {r["fai_name"]: (r["lower_limit"], r["upper_limit"]) for r in active(self.versions, self.limits).collect()}  # some hundred rows
