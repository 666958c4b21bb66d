"""Every registered query against its SQL, and edge rows by hand."""

import os
from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__ as entry
from yieldloom.operators.filters import Filters
from yieldloom.operators.latest import latest_rows
from yieldloom.plans import defects, rectification, registry, report, yields
from yieldloom.plans.facade import DashboardQueries
from yieldloom.sources import workbook

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toArrow(), duck.sql(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    key = lambda r: repr([r[c] for c in sorted(r)])
    assert sorted(map(key, got.to_pylist())) == sorted(map(key, want.to_pylist()))


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


J = "SN string, Time timestamp_ntz, Line string, Project string, Vendor string, FAI312_result int, FAI9_result int, FAIx_result string, overall_result int, n int"


def rows(spark):
    t = lambda *a: datetime(2026, 7, *a)
    return spark.createDataFrame([
        ("a", t(25, 6, 59, 59), "L1", "P", "V", 1, 0, "x", 1, 1), ("a", t(26, 7), "L1", "P", "V", 0, 0, "x", 0, 2), ("b", t(25, 7), "L1", "", None, 1, 1, "x", 1, 3), ("b", t(25, 7), "L2", "P", "V", 1, 0, "x", 1, 4),
        ("c", None, "L2", None, "V", 0, 0, "x", 0, 5), (None, t(27, 12), "L2", "P", "V", None, 0, "x", None, 6), (None, t(27, 13), "L2", "P", "V", 1, None, "x", 1, 7), ("d", t(27, 0), None, "P", "V", 0, 0, "x", 1, 8),
    ], J)


def test_days_and_collapse(spark):
    j = rows(spark)
    assert [tuple(r) for r in yields.daily(j).collect()] == [(date(2026, 7, 24), 1, 0, 1, 0.0), (date(2026, 7, 25), 2, 0, 2, 0.0), (date(2026, 7, 26), 2, 1, 1, 50.0), (date(2026, 7, 27), 2, 0, 1, 0.0)]
    assert [tuple(r) for r in yields.regression_daily(j, ["n"]).collect()] == [(date(2026, 7, 24), 1, 1, 0, 100.0), (date(2026, 7, 25), 1, 0, 1, 0.0), (date(2026, 7, 26), 1, 0, 1, 0.0), (date(2026, 7, 27), 1, 0, 1, 0.0)]
    assert tuple(yields.summary(j).first()) == (8, 2, 5, 25.0)
    assert tuple(yields.summary(j.limit(0)).first()) == (0, None, None, None)
    assert yields.duplicate_units(j).first()[0] == 3 and tuple(yields.regression_summary(j).first()) == (4, 3, 2, 75.0) and tuple(yields.unique_counts(j.limit(0)).first()) == (0, 0, 0, 0.0)
    assert [r["Line"] for r in yields.regression_rows(j, ["n"]).filter("SN = 'b'").collect()] == ["L2"]
    assert {r["project"] for r in yields.daily_by_project_line(j, ["n"], regression=False).collect()} == {"P", "未知"}


def test_defects(spark):
    j = rows(spark)
    assert [tuple(r) for r in defects.top(j).collect()] == [("FAI312", 4, 8, 50.0), ("FAI9", 1, 8, 12.5)]
    daily = {(r["production_day"].day, r["fai_name"]): (r["ng_count"], r["total"]) for r in defects.daily_top(j).collect()}
    assert daily == {(24, "FAI312"): (1, 1), (25, "FAI312"): (2, 2), (25, "FAI9"): (1, 2), (27, "FAI312"): (1, 1)}
    assert defects.top(j.select("SN", "Time", "overall_result")).count() == 0
    assert [r[1] for r in defects.with_others(defects.top(j), 1).collect()] == ["FAI312", "其他"]
    assert tuple(defects.date_range(j.limit(0)).first()) == ("", "")


def test_repair(spark):
    got = rectification.stats(rows(spark), ["n"]).first()
    assert (got["total"], got["ok_count"], got["ng_count"], got["rectifiable"], got["saved_count"]) == (4, 1, 3, 2, 1)
    assert tuple(rectification.stats(rows(spark).limit(0), ["n"]).first()) == (0, 0, 0, 0, 0, 0.0, 0.0)


def test_filters_and_facade(spark):
    j = rows(spark)
    assert Filters(line="L1", start="2026-07-25", end="2026-07-25").apply(j).count() == 2
    assert Filters(line="x' OR '1'='1").apply(j).count() == 0
    q = DashboardQueries(j, ["n"])
    assert q.get_summary("L1").first()["total"] == 3 and q.get_daily_yield(days=2).count() == 2 and q.get_regression_unique_sn_rawdata().columns == ["SN", "Time", "Line", "Project", "Vendor", "n"]
    assert q.get_regression_unique_sn_fast(full_columns=True).columns == j.columns and "overall_result" in q.get_regression_unique_sn_fast(vendor="none").columns
    assert q.get_regression_unique_sn_rawdata(vendor="none").count() == 0 and q.get_regression_unique_sn_rawdata(columns="core").columns[0] == "SN"
    assert [r[0] for r in q.get_projects().collect()] == ["P"] and [r[0] for r in q.get_lines_for_project("P").collect()] == ["L1", "L2"]
    assert q.get_rectification_stats(line="L2").first()["total"] == 2 and q.get_vendor_yield().count() == 2 and q.get_line_yield().count() == 3


def test_pure_collapse():
    data = [("a", 2, "x"), ("b", 1, "y"), ("a", 2, "z"), ("a", 3, "w"), ("b", 0, "v")]
    assert latest_rows(data) == [("a", 3, "w"), ("b", 1, "y")] and latest_rows(data, first=True) == [("a", 2, "x"), ("b", 0, "v")] and latest_rows([]) == []


def test_exports(spark, tmp_path):
    j = rows(spark)
    assert report.csv_bytes(report.trend_rows(j, ["n"])).startswith("﻿line,mode,production_day,total,ok_count,ng_count,yield_pct".encode())
    data = report.report_bytes(j, ["n"], True, top=1)
    assert [*workbook.titles(data)] == list(report.SHEETS)
    sheet = [*workbook.rows(data, report.SHEETS[0])]
    assert sheet[0] == list(report.YIELD_HEADINGS) and sheet[1] == ["2026-07-24", 1, 1, 0, 100.0, 0, 1, 100.0] and len(sheet) == 5
    assert [r[1] for r in workbook.rows(data, report.SHEETS[1])][1:] == [1, 1]
    assert len([*workbook.rows(report.report_bytes(j, ["n"], False), report.SHEETS[0])][0]) == 5
    pre, post = report.export_both(j, ["n"], str(tmp_path))
    assert {pre, post} == {str(p) for p in tmp_path.iterdir()}
    assert len([*workbook.rows(report.rows_bytes(yields.regression_rows(j, ["n"])), "RegressionRawdata")]) == 6
