"""Defect rankings. Verdict columns are summed in one wide aggregate; only its few rows are turned into long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.config import CUTOFF_HOUR, OTHERS, RESULT
from yieldloom.functions.columns import base_name, in_order, percent, production_day, result_columns, time_of
from yieldloom.operators.filters import Filters, recorded, timed
from yieldloom.operators.latest import latest_per_unit
from yieldloom.plans.yields import ALL


def _long(df: DataFrame, names: list[str], value: str) -> DataFrame:
    """name and the struct `value` that the aggregate has for each verdict column."""
    entries = [F.struct(F.lit(base_name(c)).alias("fai_name"), F.col(f"`{c}`").alias(value)) for c in names]
    keys = [F.col(c) for c in df.columns if c not in names]
    return df.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


def _counts(columns: list[str], non_null: bool) -> list[Column]:
    total = lambda c: F.count(F.col(f"`{c}`")) if non_null else F.count(F.lit(1))
    return [F.struct(F.coalesce(F.sum(F.col(f"`{c}`").cast("bigint")), F.lit(0)).alias("ng"), total(c).alias("total")).alias(c) for c in columns]


def top(judged: DataFrame, n: int = 20, filters: Filters = ALL) -> DataFrame:
    """The n dimensions with most NG; rates are of all rows."""
    columns = result_columns(judged)
    if not columns:
        return judged.sparkSession.createDataFrame([], "fai_name string, ng_count bigint, total bigint, ng_rate_pct double")
    sums = filters.apply(judged).agg(*_counts(columns, False))
    rows = _long(sums, columns, "v").select("fai_name", F.col("v.ng").alias("ng_count"), F.col("v.total").alias("total")).filter("ng_count > 0")
    return rows.withColumn("ng_rate_pct", percent(F.col("ng_count"), F.col("total"))).orderBy(F.desc("ng_count"), "fai_name").limit(n)


def daily_trend(judged: DataFrame, names: list[str], filters: Filters = ALL) -> DataFrame:
    """By calendar day, the NG of each named dimension."""
    rows = timed(filters.apply(judged))
    sums = [F.coalesce(F.sum(F.col(f"`{n}{RESULT}`").cast("bigint")), F.lit(0)).alias(f"{n}_ng") for n in names]
    return in_order(rows.groupBy(time_of(rows).cast("date").alias("day")).agg(*sums), "day")


def _daily(rows: DataFrame, day: Column, columns: list[str], n: int) -> DataFrame:
    per = rows.groupBy(day.alias("production_day")).agg(*_counts(columns, True))
    long = _long(per, columns, "v").select("production_day", "fai_name", F.col("v.ng").alias("ng_count"), F.col("v.total").alias("total")).filter("ng_count > 0")
    ranked = long.withColumn("rank", F.row_number().over(Window.partitionBy("production_day").orderBy(F.desc("ng_count"), "fai_name")))
    best = ranked.filter(F.col("rank") <= n).withColumn("ng_rate_pct", percent(F.col("ng_count"), F.col("total")))
    return in_order(best, F.col("production_day").asc_nulls_last(), "rank")


def daily_top(judged: DataFrame, n: int = 10, filters: Filters = ALL) -> DataFrame:
    """For each production day the n dimensions with most NG; rates are of rows with a verdict."""
    rows = timed(filters.apply(judged))
    return _daily(rows, production_day(time_of(rows), filters.cutoff), result_columns(judged), n)


def daily_top_regression(judged: DataFrame, tie: list, n: int = 10, filters: Filters = ALL) -> DataFrame:
    """The same of units' last rows, on the day of their first time."""
    columns = result_columns(judged)
    return daily_top_of(latest_per_unit(recorded(filters.apply(judged)), columns, tie), n, filters.cutoff)


def daily_top_of(units: DataFrame, n: int = 10, cutoff: int = CUTOFF_HOUR) -> DataFrame:
    """daily_top_regression of units that are collapsed already."""
    return _daily(units, production_day(F.col("first_prod_time"), cutoff), result_columns(units), n)


def top_regression(judged: DataFrame, tie: list, n: int = 20, filters: Filters = ALL, exact: bool = False) -> DataFrame:
    """NG over all days, of those daily ranks up to n that there are; exact: of all."""
    days = daily_top_regression(judged, tie, 1_000_000 if exact else n, Filters(filters.project, filters.line, filters.vendor, filters.start, filters.end, CUTOFF_HOUR))
    sums = days.groupBy("fai_name").agg(F.sum("ng_count").alias("ng_count"), F.sum("total").alias("total"))
    return sums.withColumn("ng_rate_pct", percent(F.col("ng_count"), F.col("total"))).orderBy(F.desc("ng_count"), "fai_name").limit(n)


def detail(judged: DataFrame, name: str, tie: list, n: int = 100, filters: Filters = ALL) -> DataFrame:
    """The newest n rows in which a dimension is NG."""
    rows = filters.apply(judged).filter(F.col(f"`{name}{RESULT}`") == 1)
    order = [time_of(rows).desc_nulls_last(), *[F.desc(t) if isinstance(t, str) else t.desc() for t in tie]]
    return rows.orderBy(*order).limit(n).select(F.col(f"`{name}`").alias("measured"), F.col(f"`{name}{RESULT}`").alias("result"), "SN", "Time", "Line")


def date_range(judged: DataFrame) -> DataFrame:
    """The first and last production day, as text; empty if there is none."""
    day = production_day(time_of(judged))
    return judged.agg(*[F.coalesce(f(day).cast("string"), F.lit("")).alias(a) for f, a in ((F.min, "first_day"), (F.max, "last_day"))])


def with_others(ranked: DataFrame, n: int = 8) -> DataFrame:
    """The first n of a ranking, and the rest as one row."""
    order = Window.orderBy(F.desc("ng_count"), "fai_name")
    rows = ranked.withColumn("r", F.least(F.row_number().over(order), F.lit(n + 1)))
    name = F.when(F.col("r") > n, F.lit(OTHERS)).otherwise(F.col("fai_name"))
    return rows.groupBy("r", name.alias("fai_name")).agg(F.sum("ng_count").alias("ng_count")).orderBy("r").select(F.col("r").cast("int").alias("rank"), "fai_name", "ng_count")
