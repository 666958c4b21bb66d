"""Filters of judged rows, as column predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.config import CUTOFF_HOUR
from yieldloom.functions.columns import time_of


@dataclass(frozen=True)
class Filters:
    """Empty values filter nothing. Days are calendar days, both included."""

    project: str | None = None
    line: str | None = None
    vendor: str | None = None
    start: str | None = None
    end: str | None = None
    cutoff: int = CUTOFF_HOUR

    def apply(self, df: DataFrame) -> DataFrame:
        for name, value in (("Project", self.project), ("Line", self.line), ("Vendor", self.vendor)):
            if value:
                df = df.filter(F.col(name) == F.lit(value))
        if self.start:
            df = df.filter(time_of(df) >= F.lit(self.start).cast("date").cast("timestamp_ntz"))
        if self.end:
            df = df.filter(time_of(df) < F.date_add(F.lit(self.end).cast("date"), 1).cast("timestamp_ntz"))
        return df


def timed(df: DataFrame) -> DataFrame:
    """Rows whose Time can be read."""
    return df.filter(time_of(df).isNotNull())


def recorded(df: DataFrame) -> DataFrame:
    """Rows that have a Time, readable or not."""
    return df.filter(F.col("Time").isNotNull())


def clean_defect_rows(df: DataFrame) -> DataFrame:
    """Rows with a name and a numeric rate; counts as whole numbers."""
    rate = F.col("ng_rate_pct").cast("string").try_cast("double")
    named = F.col("fai_name").isNotNull() & (F.col("fai_name") != "")
    whole = [F.coalesce(F.col(c).cast("string").try_cast("double").cast("bigint"), F.lit(0)).alias(c) for c in ("ng_count", "total")]
    return df.filter(named & rate.isNotNull()).select("fai_name", *whole, rate.alias("ng_rate_pct"))
