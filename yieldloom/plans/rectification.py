"""Estimate of units that repair would save: NG units all of whose NG dimensions are repairable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.config import CUTOFF_HOUR, OVERALL, SAVE_RATE
from yieldloom.functions.columns import base_name, in_order, percent, production_day, repairable, result_columns
from yieldloom.operators.filters import Filters, recorded, timed
from yieldloom.operators.latest import latest_per_unit
from yieldloom.plans.yields import ALL


def rectifiable(columns: list[str]) -> Column:
    """No NG outside the repairable dimensions, and one at least within."""
    ng = lambda cs: sum((F.when(F.col(f"`{c}`") == 1, 1).otherwise(0) for c in cs), F.lit(0))
    outside = [c for c in columns if not repairable(base_name(c))]
    return (F.col(OVERALL) == 1) & (ng(outside) == 0) & (ng(columns) > 0)


def _counts(columns: list[str]) -> list[Column]:
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return [F.count(F.lit(1)).alias("total"), count(F.col(OVERALL) == 0).alias("ok_count"), count(F.col(OVERALL) == 1).alias("ng_count"), count(rectifiable(columns)).alias("rectifiable")]


def _rates(df: DataFrame) -> DataFrame:
    saved = F.floor(F.col("rectifiable") * F.lit(SAVE_RATE)).cast("bigint")
    df = df.withColumn("saved_count", saved)
    return df.withColumns({
        "pre_yield": F.coalesce(percent(F.col("ok_count"), F.col("total")), F.lit(0.0)),
        "post_yield": F.coalesce(percent(F.col("ok_count") + F.col("saved_count"), F.col("total")), F.lit(0.0)),
    })


def stats(judged: DataFrame, tie: list, filters: Filters = ALL) -> DataFrame:
    columns = result_columns(judged)
    return stats_of(latest_per_unit(recorded(filters.apply(judged)), [OVERALL, *columns], tie))


def stats_of(units: DataFrame) -> DataFrame:
    """stats of units that are collapsed already."""
    return _rates(units.agg(*_counts(result_columns(units))))


def daily(judged: DataFrame, tie: list, filters: Filters = ALL) -> DataFrame:
    """The same by production day; what is saved is rounded down day by day."""
    columns = result_columns(judged)
    return daily_of(latest_per_unit(timed(filters.apply(judged)), [OVERALL, *columns], tie), filters.cutoff)


def daily_of(units: DataFrame, cutoff: int = CUTOFF_HOUR) -> DataFrame:
    """daily of units that are collapsed already; those without a time are on no day."""
    rows = units.filter("first_prod_time IS NOT NULL")
    days = rows.groupBy(production_day(F.col("first_prod_time"), cutoff).alias("production_day")).agg(*_counts(result_columns(units)))
    return in_order(_rates(days), "production_day")


def daily_report(yields: DataFrame, repairs: DataFrame) -> DataFrame:
    """Days with their yield and, after repair, expected OK (OK and saved), count saved and yield; days without are as they were."""
    own = repairs.select("production_day", "rectifiable", "saved_count", "post_yield")
    out = yields.join(own, "production_day", "left").fillna({"rectifiable": 0, "saved_count": 0})
    out = out.select("production_day", "total", "ok_count", "ng_count", "yield_pct", "rectifiable", (F.col("ok_count") + F.col("saved_count")).alias("expected_ok"), F.coalesce("post_yield", "yield_pct").alias("expected_yield"))
    return in_order(out, "production_day")
