"""Import-time cleaning of raw rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.config import HEADER_ALIASES, METADATA, MIGRATION_FILL, PLACE, REQUIRED_METADATA
from yieldloom.functions.columns import missing, safe_float, safe_text, safe_timestamp
from yieldloom.sources import files

TEXT_COLUMNS = ("SN", "Line", "Project", "Vendor")


def canonical(header: str) -> str:
    own = header.strip().replace(" _", "_").replace("_ ", "_")
    return next((name for name, aliases in HEADER_ALIASES.items() if own in aliases), own)


def canonical_headers(headers: Iterable[str | None]) -> list[str | None]:
    """Canonical names; None where there is no header; name_1, name_2 ... for repeats."""
    seen: dict[str, int] = {}
    out: list[str | None] = []
    for h in headers:
        if h is None or not str(h).strip():
            out.append(None)
            continue
        name = canonical(str(h))
        k = seen.get(name, -1) + 1
        seen[name] = k
        out.append(f"{name}_{k}" if k else name)
    return out


def raw_schema(names: list[str]) -> T.StructType:
    """Types by name: text, time, else a number."""
    return T.StructType([T.StructField(n, T.StringType() if n in TEXT_COLUMNS else T.TimestampNTZType() if n == "Time" else T.DoubleType()) for n in names])


def normalize(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Canonical names and types of a raw table, whatever it was read from. keep: columns that stay as they are."""
    headers = canonical_headers(df.columns)
    df = df.toDF(*[h or f"__{k}" for k, h in enumerate(headers)]).select(*[F.col(f"`{h}`") for h in headers if h])
    convert = lambda f: safe_text(F.col(f"`{f.name}`")) if f.name in TEXT_COLUMNS else safe_timestamp(F.col(f"`{f.name}`")) if f.name == "Time" and not isinstance(f.dataType, T.TimestampNTZType) else F.col(f"`{f.name}`") if f.name == "Time" else safe_float(F.col(f"`{f.name}`"))
    return df.select(*[F.col(f"`{f.name}`") if f.name in keep else convert(f).alias(f.name) for f in df.schema])


def detect_dimensions(names: list[str], spec_names: list[str]) -> tuple[list[str], list[str]]:
    """(columns that the specification names, other columns), metadata left out in any case of letters."""
    known, meta = {s.strip() for s in spec_names}, {m.lower() for m in METADATA}
    own = [n for n in names if n.strip().lower() not in meta]
    return [n for n in own if n.strip() in known], [n for n in own if n.strip() not in known]


def dirty(required: Iterable[str] = REQUIRED_METADATA) -> Column:
    out = F.lit(False)
    for name in required:
        out = out | missing(F.col(name))
    return out


def inspect(df: DataFrame, by: str | None = None) -> DataFrame:
    """total, invalid_total and the missing count of each required column, in one pass; by: also for each value of a column."""
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(dirty()).alias("invalid_total"), *[F.count_if(missing(F.col(c))).alias(f"{c.lower()}_missing") for c in REQUIRED_METADATA]]
    return df.groupBy(by).agg(*counts) if by else df.agg(*counts)


def clean(df: DataFrame) -> DataFrame:
    return df.filter(~dirty())


def rewrite(df: DataFrame, target: str) -> None:
    """Write df in the place of target, which may be what df reads: it is written beside it and moved there when it is whole."""
    spark = df.sparkSession
    new = f"{target.rstrip('/')}.new-{uuid.uuid4().hex}"
    try:
        df.write.parquet(new)
    except Exception:
        files.remove(spark, new)
        raise
    files.replace(spark, new, target.rstrip("/"))


def clean_table(spark: SparkSession, path: str, target: str | None = None, dry_run: bool = False) -> dict:
    """Inspect a Parquet table and, unless dry_run, write its clean rows to another path or in its own place (a file becomes a
    folder of that name). A table without dirty rows is left as it is in its own place."""
    files.recover(spark, path)
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.parquet(path)
    row = inspect(df).first()
    per_column = {c: row[f"{c.lower()}_missing"] for c in REQUIRED_METADATA}
    target = target or path
    if not dry_run and (row["invalid_total"] or target.rstrip("/") != path.rstrip("/")):
        rewrite(clean(df), target)
    return {"path": path, "total_rows": row["total"], "removed": row["invalid_total"], "remaining": row["total"] - row["invalid_total"], "per_column": per_column, "dry_run": dry_run}


def clean_tables(spark: SparkSession, pattern: str, dry_run: bool = False) -> list[dict]:
    """clean_table in place for each table that a glob pattern names, in order."""
    return [clean_table(spark, path, dry_run=dry_run) for path in files.matching(spark, pattern)]


def totals(results: list[dict]) -> dict:
    """The sums of several tables' results."""
    per_column = {c: sum(r["per_column"][c] for r in results) for c in REQUIRED_METADATA}
    return {"files": len(results), **{k: sum(r[k] for r in results) for k in ("total_rows", "removed", "remaining")}, "per_column": per_column}


def migrate_table(spark: SparkSession, path: str, archive: str) -> str:
    """Rename a table's old columns in place, after a copy of it as it was has been put into the archive folder; the copy's path."""
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    kept = f"{archive.rstrip('/')}/{path.rstrip('/').rsplit('/', 1)[-1]}"
    if files.exists(spark, kept):
        kept += f"-{uuid.uuid4().hex}"
    spark.read.parquet(path).write.parquet(kept)
    rewrite(migrate(spark.read.parquet(path)), path)
    return kept


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all", subset=["SN", "Time"])


def drop_repeats(df: DataFrame, order: list[str]) -> DataFrame:
    """The first row, in the given order, of each (SN, Time); missing ones are equal."""
    w = Window.partitionBy("SN", "Time").orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def completeness(df: DataFrame) -> DataFrame:
    """Rows, rows with anything missing, missing counts, whether a column has any value, and some Line."""
    absent = [c for c in REQUIRED_METADATA if c not in df.columns]
    if absent:
        raise ValueError(f"no column {', '.join(absent)}")
    lost = [F.count_if(missing(F.col(c))).alias(f"{c.lower()}_missing") for c in REQUIRED_METADATA]
    line = F.min(F.when(~missing(F.col("Line")), F.col("Line"))).alias("some_line")
    out = df.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(dirty()).alias("total_invalid"), *lost, line)
    return out.withColumns({f"{c.lower()}_ok": F.col(f"{c.lower()}_missing") < F.col("scanned") for c in REQUIRED_METADATA})


def fill(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Values for columns that are missing as a whole; others stay."""
    row = completeness(df).first()
    empty = {c: v for c, v in values.items() if not row[f"{c.lower()}_ok"]}
    return df.withColumns({c: F.when(missing(F.col(c)), F.lit(v)).otherwise(F.col(c)) for c, v in empty.items()})


def migrate(df: DataFrame) -> DataFrame:
    """Old column names become new ones, as text; nulls and absent columns get the fixed fill. Doing it twice changes nothing."""
    for new, olds in (("Project", ("Yield1", "Project Code")), ("Vendor", ("Yield2", "Vendor Code")), ("Line", ("CFG",))):
        for old in olds:
            if old in df.columns:
                df = df.withColumnRenamed(old, new) if new not in df.columns else df.withColumn(new, F.coalesce(F.col(new).cast("string"), F.col(f"`{old}`").cast("string"))).drop(old)
        if new in df.columns:
            df = df.withColumn(new, F.col(new).cast("string"))
    for name, value in MIGRATION_FILL.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df


def import_rows(df: DataFrame, values: dict[str, str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The upload pipeline but for the judge: normalize, fill, drop null rows, dirty rows and repeats; one plan. Of repeats the first in
    the given order stays; by default that of the file, where the rows have their place (PLACE), which then goes; without either, any."""
    places = [c for c in PLACE if c in df.columns]
    rows = normalize(df, places)
    if values:
        rows = fill(rows, values)
    rows = clean(drop_null_rows(rows))
    by = order or places
    return (drop_repeats(rows, by) if by else rows.dropDuplicates(["SN", "Time"])).drop(*places)
