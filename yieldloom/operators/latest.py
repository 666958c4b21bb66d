"""Collapse of re-tested units: the last measurement, at the first production time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.functions.columns import time_of


def latest_per_unit(df: DataFrame, keep: list[str], tie: list[str | Column], first_time: str = "first_prod_time", seen: str | None = None) -> DataFrame:
    """One row for each SN (none is a group of its own): `keep` of the row with the last readable Time, and the first time.

    Only the columns asked for are shuffled, and they are combined before the shuffle. tie: what decides between equal
    times; the larger wins. seen: name for the number of rows of the unit.
    """
    order = F.struct(time_of(df).alias("t"), *[F.col(c) if isinstance(c, str) else c for c in tie])
    own = [c for c in keep if c != "SN"]
    counts = [F.count(F.lit(1)).alias(seen)] if seen else []
    last = df.groupBy("SN").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in own]), order).alias("last"), F.min(time_of(df)).alias(first_time), *counts)
    return last.select("SN", *[F.col("last").getField(c).alias(c) for c in own], first_time, *([seen] if seen else []))


def latest_rows(rows: list[tuple], sn: int = 0, time: int = 1, first: bool = False) -> list[tuple]:
    """The same for rows in memory: of equal times the first seen, in order of first appearance."""
    kept: dict = {}
    for row in rows:
        old = kept.get(row[sn])
        if old is None or (row[time] < old[time] if first else row[time] > old[time]):
            kept[row[sn]] = row
    return list(kept.values())
