"""Pass-rate queries over judged rows. Each takes the judged table and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.config import CORE, CUTOFF_HOUR, OVERALL, RESULT, UNKNOWN
from yieldloom.functions.columns import in_order, percent, production_day, production_week, time_of, yield_columns
from yieldloom.operators.filters import Filters, recorded, timed
from yieldloom.operators.latest import latest_per_unit

ALL = Filters()


def summary(judged: DataFrame, filters: Filters = ALL) -> DataFrame:
    return filters.apply(judged).agg(*yield_columns())


def daily(judged: DataFrame, filters: Filters = ALL) -> DataFrame:
    rows = timed(filters.apply(judged))
    return in_order(rows.groupBy(production_day(time_of(rows), filters.cutoff).alias("production_day")).agg(*yield_columns()), "production_day")


def weekly(judged: DataFrame, filters: Filters = ALL) -> DataFrame:
    rows = timed(filters.apply(judged))
    return in_order(rows.groupBy(production_week(time_of(rows), filters.cutoff).alias("production_week")).agg(*yield_columns(with_ng=False)), "production_week")


def by_group(judged: DataFrame, column: str, filters: Filters = ALL) -> DataFrame:
    """By Line, Vendor or Project, the lowest yield first."""
    return in_order(filters.apply(judged).groupBy(column).agg(*yield_columns()), F.col("yield_pct").asc_nulls_last(), F.col(column).asc_nulls_last())


def _collapsed(judged: DataFrame, filters: Filters, tie: list, keep: list[str]) -> DataFrame:
    return latest_per_unit(recorded(filters.apply(judged)), keep, tie)


def regression_daily(judged: DataFrame, tie: list, filters: Filters = ALL) -> DataFrame:
    """Each unit once: its last verdict on the day of its first time. A unit without a readable time has a null day."""
    return daily_of(_collapsed(judged, filters, tie, [OVERALL]), filters.cutoff)


def daily_of(units: DataFrame, cutoff: int = CUTOFF_HOUR) -> DataFrame:
    """regression_daily of units that are collapsed already (see KeptUnits)."""
    day = production_day(F.col("first_prod_time"), cutoff).alias("production_day")
    return in_order(units.groupBy(day).agg(*yield_columns()), F.col("production_day").asc_nulls_last())


def multi_production(judged: DataFrame, top: int = 20) -> DataFrame:
    rows = recorded(judged)
    counts = rows.groupBy("SN").agg(F.count(F.lit(1)).alias("production_count"), F.min("Time").alias("first_time"), F.max("Time").alias("last_time"))
    return counts.filter("production_count > 1").orderBy(F.desc("production_count"), F.col("SN").asc_nulls_last()).limit(top)


def daily_by_project_line(judged: DataFrame, tie: list, regression: bool = True, filters: Filters = ALL, at_last: bool = False) -> DataFrame:
    """By day, Project and Line. Collapsed units count on the day of their first time, or at_last of their last."""
    if regression:
        rows = _collapsed(judged, filters, tie, ["Time", "Project", "Line", OVERALL])
        t = time_of(rows) if at_last else F.col("first_prod_time")
    else:
        rows = filters.apply(judged)
        t = time_of(rows)
    rows = rows.withColumn("t", t).filter("t IS NOT NULL")
    label = lambda c: F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(UNKNOWN)).otherwise(F.col(c))
    keys = [production_day(F.col("t"), filters.cutoff).alias("production_day"), label("Project").alias("project"), label("Line").alias("line")]
    total, ok, _, rate = yield_columns()
    out = rows.groupBy(*keys).agg(total, ok, rate).select("production_day", "project", "line", "total", "ok_count", (F.col("total") - F.col("ok_count")).alias("ng_count"), "yield_pct")
    return in_order(out, "production_day", "project", "line")


def duplicate_units(judged: DataFrame) -> DataFrame:
    return judged.groupBy("SN").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_sn_count"))


def regression_summary(judged: DataFrame) -> DataFrame:
    per = judged.groupBy("SN").agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.count("SN").alias("unique_sn"), F.count_if(F.col("n") > 1).alias("duplicate_sn"), F.coalesce(F.max(F.when(F.col("n") > 1, F.col("n"))), F.lit(1)).cast("bigint").alias("max_repeats"))
    return out.withColumn("duplicate_rate", F.coalesce(percent(F.col("duplicate_sn"), F.col("unique_sn")), F.lit(0.0)))


def unique_counts(judged: DataFrame) -> DataFrame:
    per = judged.groupBy("SN").agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("unique_rows"))
    gone = F.col("total_rows") - F.col("unique_rows")
    return out.select("total_rows", "unique_rows", gone.alias("removed_rows"), F.coalesce(percent(gone, F.col("total_rows")), F.lit(0.0)).alias("dedup_pct"))


def regression_rows(judged: DataFrame, tie: list, columns: str = "core", filters: Filters = ALL) -> DataFrame:
    """Each unit's last row with its first time, newest first. columns: core, minimal (no verdicts), all."""
    keep = _kept_columns(judged.columns, columns)
    return rows_of(latest_per_unit(filters.apply(judged), list(dict.fromkeys([*keep, "Time"])), tie), columns, keep)


def _kept_columns(names: list[str], columns: str) -> list[str]:
    if columns == "core":
        return [c for c in CORE if c in names]
    return [c for c in names if not c.endswith(RESULT)] if columns == "minimal" else names


def rows_of(units: DataFrame, columns: str = "core", keep: list[str] | None = None) -> DataFrame:
    """regression_rows of units that are collapsed already."""
    keep = keep or _kept_columns([c for c in units.columns if c != "first_prod_time"], columns)
    out = units.withColumn("Time", F.col("first_prod_time")).orderBy(F.col("Time").desc_nulls_last(), F.col("SN").asc_nulls_last())
    return out.select(*keep)


def ng_units(judged: DataFrame, tie: list, filters: Filters = ALL) -> DataFrame:
    """The collapsed rows whose last verdict is NG."""
    return regression_rows(judged, tie, "core", filters).filter(F.col(OVERALL) == 1)


def projects(judged: DataFrame) -> DataFrame:
    return judged.select("Project").filter("Project IS NOT NULL AND Project <> ''").distinct().orderBy("Project")


def lines_of(judged: DataFrame, project: str) -> DataFrame:
    return judged.filter(F.col("Project") == project).select("Line").filter("Line IS NOT NULL AND Line <> ''").distinct().orderBy("Line")


def dedup_stats(judged: DataFrame, tie: list) -> DataFrame:
    """Units, those whose last time is after their first, their share, and the most rows of a unit."""
    rows = latest_per_unit(judged, ["Time"], tie, seen="n")
    out = rows.agg(F.count(F.lit(1)).alias("unique_sn"), F.count_if(time_of(rows) > F.col("first_prod_time")).alias("regressed"), F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("max_occurrences"))
    return out.withColumn("regression_rate", F.coalesce(percent(F.col("regressed"), F.col("unique_sn")), F.lit(0.0)))


def totals_of(days: DataFrame) -> DataFrame:
    """One rate from rows of days."""
    out = days.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("ok_count"), F.lit(0)).alias("ok_count"))
    return out.withColumn("yield_pct", F.coalesce(percent(F.col("ok_count"), F.col("total")), F.lit(0.0)))


def ng_rate(judged: DataFrame) -> DataFrame:
    out = judged.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(OVERALL) == 1).alias("ng_count"))
    return out.withColumn("ng_rate_pct", F.coalesce(percent(F.col("ng_count"), F.col("total")), F.lit(0.0)))


def moving_average(days: DataFrame, rows: int = 7) -> DataFrame:
    """Mean yield of the last `rows` days there are, from the row that has so many. days: one row a day."""
    order = Window.orderBy("production_day")
    out = days.withColumn("__n", F.row_number().over(order)).withColumn("ma_yield_pct", F.avg("yield_pct").over(order.rowsBetween(1 - rows, 0)))
    return out.filter(F.col("__n") >= rows).select("production_day", "yield_pct", "ma_yield_pct")


def last_days(days: DataFrame, n: int = 14) -> DataFrame:
    """The last n rows, in order."""
    return days.orderBy(F.desc("production_day")).limit(n).orderBy("production_day")


def gap_filled(collapsed: DataFrame, plain: DataFrame) -> DataFrame:
    """Days of collapsed units; a day with none takes the plain day's counts, and goes if that has none either."""
    own = plain.select("production_day", *[F.col(c).alias(f"__{c}") for c in ("total", "ok_count", "yield_pct")])
    both = collapsed.join(own, "production_day", "left")
    pick = [F.when(F.col("total") == 0, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("total", "ok_count", "yield_pct")]
    return in_order(both.select("production_day", *pick).filter("total > 0"), "production_day")
