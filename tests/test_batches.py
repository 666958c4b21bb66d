from datetime import datetime

import pytest
from pyspark.sql import functions as F

from yieldloom.__main__ import parser, run
from yieldloom.operators import batches, cleaning, spec_store
from yieldloom.plans import facade, report
from yieldloom.sources import files, tables, workbook

SPEC = [["FAI", "USL", "Nomial", "LSL"], ["FAI1", 5, 3, 1], ["FAI2", None, None, 0]]
CELLS = [["SN", "Time", "CFG", "Vendor", "Project", "FAI1", "FAI2"], ["a", "2026-01-02 08:00", "L1", "V", "P", 2, 1], ["a", "2026-01-02 08:00", "L1", "V", "P", 2, 1], ["b", "2026-01-02 09:00", "L1", "V", "P", 9, 1], ["c", "2026-01-02 10:00", None, "V", "P", 2, 1], [None, None, "L1", "V", "P", 2, 1]]


def workbook_of(spec=SPEC):
    return workbook.write([("Spec", spec), ("Data", CELLS)])


def test_a_store_is_read_again(spark, tmp_path):
    store = spec_store.SpecStore(spark, str(tmp_path / "s"))
    version = store.load(workbook_of(), "a.xlsx", "first", at=datetime(2026, 1, 1))
    again = spec_store.SpecStore(spark, str(tmp_path / "s"))
    assert again.active_limits() == {"FAI1": (1.0, 5.0), "FAI2": (0.0, None)} and again.active_version() == version and again.names(version) == ["FAI1", "FAI2"]
    second = again.load(workbook_of([*SPEC, ["FAI3", 2, 1, 0]]), "b.xlsx", use=False, at=datetime(2026, 1, 2))
    third = spec_store.SpecStore(spark, str(tmp_path / "s"))
    assert third.active_version() == version and len(third.names(second)) == 3
    with pytest.raises(ValueError, match="lower above upper"):
        third.load(workbook_of([*SPEC, ["FAI4", 0, None, 7]]), "bad.xlsx")
    assert spec_store.SpecStore(spark, str(tmp_path / "s")).versions.count() == 2


def test_upload_judge_and_status(spark, tmp_path):
    folder, store = str(tmp_path / "data"), spec_store.SpecStore(spark, str(tmp_path / "s"))
    store.load(workbook_of(), "a.xlsx")
    got = batches.upload_workbook(spark, workbook_of(), folder, store, batch="b1")
    assert (got["total_rows"], got["ng_count"], got["batch_id"]) == (2, 1, "b1")
    tables.write_raw(spark.read.parquet(got["raw_path"]), folder, "b2")
    with pytest.raises(Exception, match="already exists"):
        tables.write_raw(spark.read.parquet(got["raw_path"]), folder, "b2")
    assert [(r["batch_id"], r["judged"], r["ng_count"]) for r in batches.status(spark, folder)] == [("b1", True, 1), ("b2", False, None)]
    assert [r["batch_id"] for r in batches.judge_new(spark, folder, store.active_limits(), "v")] == ["b2"] and batches.judge_new(spark, folder, store.active_limits()) == []
    assert batches.judge_one(spark, folder, "b1", {"FAI1": (None, 100.0)}, "w")["ng_count"] == 0 and batches.status(spark, folder)[0]["spec_version"] == "w"
    assert [b for b, _ in tables.list_batches(spark, folder)] == ["b1", "b2"] and files.names(spark, folder, "judging_*") == []
    info = tables.batch_info(spark, got["raw_path"])
    assert (info["rows"], info["dimensions"]) == (2, 2)
    with pytest.raises(FileNotFoundError):
        batches.judge_one(spark, folder, "none", store.active_limits())
    q = facade.DashboardQueries(facade.folder_source(spark, folder), ["FAI1"])
    assert q.get_summary().first()["total"] == 4
    with pytest.raises(ValueError):
        facade.DashboardQueries()
    facade.set_default_source(facade.folder_source(spark, folder, {"Station": "Vendor"}))
    assert facade.DashboardQueries(tie=["FAI1"]).get_line_yield().count() == 1 and "Station" in facade.DashboardQueries().judged.columns
    facade.set_default_source(None)
    assert facade.query_tables(spark, "SELECT count(*) AS n FROM {j}", j=f"{folder}/judged_b1").first()["n"] == 2


def test_cleaning_in_place_keeps_the_table(spark, tmp_path):
    rows = [("s1", "V", "P", "L"), ("s2", None, "P", "L"), ("s3", "V", "P", "")]
    for name, part in (("raw_a", rows), ("raw_b", rows[:1])):
        spark.createDataFrame(part, "SN string, Vendor string, Project string, Line string").write.parquet(str(tmp_path / name))
    dry = cleaning.clean_tables(spark, str(tmp_path / "raw_*"), dry_run=True)
    assert cleaning.totals(dry) == {"files": 2, "total_rows": 4, "removed": 2, "remaining": 2, "per_column": {"Vendor": 1, "Project": 0, "Line": 1}}
    assert spark.read.parquet(str(tmp_path / "raw_a")).count() == 3
    done = cleaning.clean_tables(spark, str(tmp_path / "raw_*"))
    assert [r["removed"] for r in done] == [2, 0] and [r["SN"] for r in spark.read.parquet(str(tmp_path / "raw_a")).collect()] == ["s1"]
    assert cleaning.clean_table(spark, str(tmp_path / "raw_a"), str(tmp_path / "raw_a"))["removed"] == 0 and sorted(p.name for p in tmp_path.iterdir()) == ["raw_a", "raw_b"]
    with pytest.raises(FileNotFoundError):
        cleaning.clean_table(spark, str(tmp_path / "none"))
    df = spark.createDataFrame([(1,)], "n int")
    with pytest.raises(Exception):
        cleaning.rewrite(df.select(F.raise_error(F.lit("broken")).cast("int").alias("n")), str(tmp_path / "raw_a"))
    assert spark.read.parquet(str(tmp_path / "raw_a")).count() == 1


def test_migration_in_place_leaves_a_copy(spark, tmp_path):
    spark.createDataFrame([("x", "c")], "Yield1 string, CFG string").write.parquet(str(tmp_path / "raw_a"))
    kept = cleaning.migrate_table(spark, str(tmp_path / "raw_a"), str(tmp_path / "old"))
    assert spark.read.parquet(kept).columns == ["Yield1", "CFG"] and spark.read.parquet(str(tmp_path / "raw_a")).first().asDict() == {"Project": "x", "Line": "c", "Vendor": "LY"}
    assert cleaning.migrate_table(spark, str(tmp_path / "raw_a"), str(tmp_path / "old")) != kept


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SN,Time,CFG,FAI1\n" + "".join(f"s{i},2026-01-02,L,{i}\n" for i in range(50)))
    (tmp_path / "q.csv").write_text('SN,Time,CFG,FAI1\n"two\nlines",2026-01-02,L,1\nx,2026-01-03,L,2\n')
    info = tables.csv_info(spark, str(tmp_path / "a.csv"))
    assert info == {"encoding": "utf-8", "delimiter": ",", "header": ["SN", "Time", "Line", "FAI1"], "rows": 50}
    assert not tables._csv(spark, str(tmp_path / "a.csv"))[0].quoted_line_ends and tables._csv(spark, str(tmp_path / "q.csv"))[0].quoted_line_ends
    assert sorted(r["SN"] for r in tables.read_csv(spark, str(tmp_path / "q.csv")).collect()) == ["two\nlines", "x"]
    batch, path = tables.csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "d"))
    assert spark.read.parquet(path).count() == 50 and tables.list_batches(spark, str(tmp_path / "d")) == [(batch, path)]


def test_judged_glob_with_differing_types(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "SN string, n int").write.parquet(str(tmp_path / "judged_1"))
    spark.createDataFrame([("b", "x")], "SN string, n string").write.parquet(str(tmp_path / "judged_2"))
    assert sorted(r["n"] for r in tables.judged(spark, str(tmp_path / "judged_*")).collect()) == ["1", "x"]


def test_reports_are_bounded(spark, tmp_path):
    df = spark.range(5)
    with pytest.raises(ValueError, match="more than 4 rows"):
        report.csv_bytes(df, 4)
    with pytest.raises(ValueError, match="more than 4 rows"):
        report.rows_bytes(df, most=4)
    report.csv_files(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 5


def test_command_line(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook_of())
    do = lambda *a: run(spark, parser().parse_args([str(x) for x in a]))
    version = do("load-spec", tmp_path / "w.xlsx", tmp_path / "s")
    assert do("specs", tmp_path / "s")[0]["is_active"] and do("upload", tmp_path / "w.xlsx", tmp_path / "d", tmp_path / "s", "--batch", "x")["spec_version"] == version
    assert do("batches", tmp_path / "d")[0]["batch"] == "x" and do("batches", tmp_path / "d")[0]["bytes"] > 0 and do("status", tmp_path / "d")[0]["judged"] and do("judge", tmp_path / "d", tmp_path / "s") == []
    assert do("clean", tmp_path / "d" / "raw_*", "--dry-run")["all"]["removed"] == 0 and do("rejudge", tmp_path / "d", tmp_path / "s", "x")["ng_count"] == 1
    assert do("info", tmp_path / "d" / "raw_x")["rows"] == 2
    assert do("show-spec", tmp_path / "s")["fai_count"] == 2 and do("show-spec", tmp_path / "s", "--name", "FAI1")["upper_limit"] == 5.0 and do("show-spec", tmp_path / "s", "--name", "no") is None
    assert do("summary", tmp_path / "d") == {"total": 2, "ok_count": 1, "ng_count": 1, "yield_pct": 50.0}
    told = do("report", tmp_path / "d")
    assert [*told] == ["summary", "lines", "days", "units", "top"] and told["days"] == [{"production_day": "2026-01-02", "total": 2, "ok_count": 1, "ng_count": 1, "yield_pct": 50.0}]
    assert do("top-defects", tmp_path / "d", "--top", "5") == [{"rank": 1, "fai_name": "FAI1", "ng_count": 1, "total": 2, "ng_rate_pct": 50.0}]
    assert [(r["SN"], r["measured"], r["Time"]) for r in do("fai-detail", tmp_path / "d", "FAI1")] == [("b", 9.0, "2026-01-02 09:00:00")]
    files_ = do("export", tmp_path / "d", tmp_path / "out", "--tie", "FAI1")
    assert len(files_) == 2 and all([*workbook.titles(open(f, "rb").read())] == list(report.SHEETS) for f in files_)
    assert do("export", tmp_path / "d", tmp_path / "out", "--mode", "post")[0].split("/")[-1].startswith("daily_report_regression") and do("tasks", tmp_path / "t") == []


def test_running_yield_by_day_and_week(spark, tmp_path):
    from yieldloom.streaming.incremental import daily_yield

    t = lambda d, h: datetime(2026, 1, d, h)  # noqa: E731  the 5th is a Monday
    rows = [(t(5, 8), 0), (t(6, 6), 1), (t(6, 7), 0), (t(5, 6), 0), (t(12, 6), 0), (t(30, 8), 0)]
    spark.createDataFrame(rows, "Time timestamp, overall_result int").write.parquet(str(tmp_path / "in"))
    for week, want in ((False, {"2026-01-04": (1, 1), "2026-01-05": (2, 1), "2026-01-06": (1, 1), "2026-01-11": (1, 1), "2026-01-30": (1, 1)}), (True, {"2025-12-29": (1, 1), "2026-01-05": (4, 3), "2026-01-26": (1, 1)})):
        stream = spark.readStream.schema("Time timestamp, overall_result int").parquet(str(tmp_path / "in"))
        q = daily_yield(stream, week=week).writeStream.outputMode("complete").format("memory").queryName(f"y{int(week)}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {str(r[0]): (r["total"], r["ok_count"]) for r in spark.table(f"y{int(week)}").collect()} == want
