"""Tabular reports and their files."""

from __future__ import annotations

import csv
import io
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.config import OVERALL
from yieldloom.functions.columns import result_columns
from yieldloom.operators.filters import Filters, recorded
from yieldloom.operators.latest import latest_per_unit
from yieldloom.plans import defects, rectification, yields
from yieldloom.sources import workbook

# Sheets and headings.
SHEETS = ("每日良率", "每日TOP不良")
YIELD_HEADINGS = ("日期", "总数", "OK", "NG", "良率(%)", "可整改", "预计OK", "整改后良率(%)")
DEFECT_HEADINGS = ("日期", "排名", "FAI", "NG数", "总数", "不良率(%)")
CSV_ENCODING = "utf-8-sig"
SHEET_ROWS = 1_048_576


def daily_tables(judged: DataFrame, tie: list, regression: bool, top: int = 10, filters: Filters = yields.ALL) -> tuple[DataFrame, DataFrame]:
    """(days with their yield, top defects of each day); collapsed units also have the repair estimate."""
    if not regression:
        return yields.daily(judged, filters), defects.daily_top(judged, top, filters)
    # One collapse for all three: Spark reuses the exchange of equal plans.
    units = latest_per_unit(recorded(filters.apply(judged)), [OVERALL, *result_columns(judged)], tie)
    days = rectification.daily_report(yields.daily_of(units, filters.cutoff), rectification.daily_of(units, filters.cutoff))
    return days, defects.daily_top_of(units, top, filters.cutoff)


def report_bytes(judged: DataFrame, tie: list, regression: bool, top: int = 10, filters: Filters = yields.ALL) -> bytes:
    """The workbook; a few rows for each day."""
    days, worst = daily_tables(judged, tie, regression, top, filters)
    first = [[*YIELD_HEADINGS[: len(days.columns)]], *[[str(r[0]), *r[1:]] for r in days.collect()]]
    second = [[*DEFECT_HEADINGS], *[[str(r["production_day"]), r["rank"], r["fai_name"], r["ng_count"], r["total"], r["ng_rate_pct"]] for r in worst.collect()]]
    return workbook.write([(SHEETS[0], first), (SHEETS[1], second)])


def _few(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them as files instead")
    return rows


def rows_bytes(df: DataFrame, sheet: str = "RegressionRawdata", most: int = SHEET_ROWS - 1) -> bytes:
    """A result as a workbook; more rows than a sheet holds are an error."""
    return workbook.write([(sheet, [df.columns, *[[*r] for r in _few(df, most)]])])


def export_report(judged: DataFrame, tie: list, folder: str, regression: bool, top: int = 10, filters: Filters = yields.ALL, stamp: str | None = None) -> str:
    """One report's workbook in a folder of the driver; its path."""
    path = Path(folder, f"{'daily_report_regression' if regression else 'daily_report'}_{stamp or f'{datetime.now():%Y%m%d_%H%M%S}'}.xlsx")
    path.write_bytes(report_bytes(judged, tie, regression, top, filters))
    return str(path)


def export_both(judged: DataFrame, tie: list, folder: str, top: int = 10) -> tuple[str, str]:
    stamp = f"{datetime.now():%Y%m%d_%H%M%S}"
    return export_report(judged, tie, folder, False, top, stamp=stamp), export_report(judged, tie, folder, True, top, stamp=stamp)


def csv_bytes(df: DataFrame, most: int = SHEET_ROWS - 1) -> bytes:
    """A result as CSV that spreadsheets read; more rows than a sheet holds are an error (see csv_files)."""
    out = io.StringIO()
    lines = csv.writer(out, lineterminator="\n")
    lines.writerows([df.columns, *_few(df, most)])
    return out.getvalue().encode(CSV_ENCODING)


def csv_files(df: DataFrame, path: str) -> None:
    """A result of any size as a folder of CSV files."""
    df.write.option("header", True).mode("overwrite").csv(path)


def trend_rows(judged: DataFrame, tie: list, filters: Filters = yields.ALL) -> DataFrame:
    """line, mode and daily figures of every line, before and after collapse, for export."""
    parts = [yields.daily_by_project_line(judged, tie, regression, filters).withColumn("mode", F.lit("regression" if regression else "normal")) for regression in (False, True)]
    sums = parts[0].unionByName(parts[1]).groupBy("line", "mode", "production_day").agg(*[F.sum(c).alias(c) for c in ("total", "ok_count", "ng_count")])
    return sums.withColumn("yield_pct", yields.percent(F.col("ok_count"), F.col("total"))).orderBy("line", "mode", "production_day")
