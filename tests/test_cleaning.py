from datetime import datetime

import pytest
from pyspark.sql import functions as F

from yieldloom.functions import columns as C
from yieldloom.operators import cleaning, spec_store
from yieldloom.operators.filters import clean_defect_rows
from yieldloom.sources import tables

TIMES = {
    "2026-07-25 10:00:01": datetime(2026, 7, 25, 10, 0, 1), "2026-07-25T10:00:01": datetime(2026, 7, 25, 10, 0, 1), "2026-07-25 10:00": datetime(2026, 7, 25, 10), "2026-07-25": datetime(2026, 7, 25),
    "2026-07-25 10:00:01.5": datetime(2026, 7, 25, 10, 0, 1, 500000), "2026/7/5 6:59:00": datetime(2026, 7, 5, 6, 59), "2026/07/15": datetime(2026, 7, 15), "03/04/2026": datetime(2026, 3, 4), "25/12/2026": datetime(2026, 12, 25),
    "45595.2904": datetime(2024, 10, 30, 6, 58, 10), "45595": datetime(2024, 10, 30), "": None, "   ": None, "not a date": None, "NaN": None, "-": None, "None": None, "n/a": None, " 2026-07-25 ": datetime(2026, 7, 25), "2026-02-30": None,
}


def test_times(spark):
    df = spark.createDataFrame([(t,) for t in TIMES] + [(None,)], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", C.safe_timestamp(F.col("t")).alias("v")).collect()}
    assert got == TIMES | {None: None}


def test_numbers_and_texts(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("#REF!",), ("=#REF!+1",), ("x",), (None,), ("1e3",)], "t string")
    assert [r[0] for r in df.select(C.safe_float(F.col("t"))).collect()] == [1.5, 2.0, None, None, None, None, 1000.0]
    assert [r[0] for r in df.select(C.safe_text(F.col("t"))).collect()] == ["1.5", " 2 ", None, None, "x", None, "1e3"]


def test_headers():
    got = cleaning.canonical_headers(["SN", "FG号", None, " ", "CFG", "FAI1 _T", "FAI1_T", "Yield2"])
    assert got == ["SN", "SN_1", None, None, "Line", "FAI1_T", "FAI1_T_1", "Vendor"]


META = [("s1", "V", "P", "L"), ("s2", None, "P", "L"), ("s3", "V", None, "L"), ("s4", "V", "P", None), ("s5", "V", "P", ""), ("s6", "V", "P", "None"), ("s7", "V", "P", "none"), ("s8", "V", "P", "  ")]


def test_dirty_rows(spark, tmp_path):
    df = spark.createDataFrame(META, "SN string, Vendor string, Project string, Line string")
    row = cleaning.inspect(df).first()
    assert tuple(row) == (8, 6, 1, 1, 4) and [r["SN"] for r in cleaning.clean(df).collect()] == ["s1", "s7"]
    df.write.parquet(str(tmp_path / "raw"))
    dry = cleaning.clean_table(spark, str(tmp_path / "raw"), str(tmp_path / "clean"), dry_run=True)
    assert dry["removed"] == 6 and dry["remaining"] == 2 and not (tmp_path / "clean").exists()
    cleaning.clean_table(spark, str(tmp_path / "raw"), str(tmp_path / "clean"))
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 2
    assert cleaning.inspect(df.limit(0)).first()["total"] == 0


def test_null_rows_repeats_and_fill(spark):
    t = datetime(2026, 1, 1)
    df = spark.createDataFrame([("a", t, 2), ("a", t, 1), (None, None, 3), (None, t, 4), ("b", None, 5), ("b", None, 6)], "SN string, Time timestamp_ntz, n int")
    assert sorted(r["n"] for r in cleaning.drop_null_rows(df).collect()) == [1, 2, 4, 5, 6]
    assert sorted(r["n"] for r in cleaning.drop_repeats(df, ["n"]).collect()) == [1, 3, 4, 5]
    meta = spark.createDataFrame([(None, "P", "L"), (" ", "P", None)], "Vendor string, Project string, Line string")
    assert {r["Vendor"] for r in cleaning.fill(meta, {"Vendor": "X", "Line": "Y"}).collect()} == {"X"}
    assert [r["Line"] for r in cleaning.fill(meta, {"Line": "Y"}).collect()] == ["L", None]
    with pytest.raises(ValueError):
        cleaning.completeness(meta.drop("Line"))


def test_migration_is_idempotent(spark):
    df = spark.createDataFrame([(1, None, "c")], "Yield1 int, Yield2 string, CFG string")
    once = cleaning.migrate(df)
    assert once.first().asDict() == {"Project": "1", "Vendor": "LY", "Line": "c"}
    assert cleaning.migrate(once).collect() == once.collect() and cleaning.migrate(spark.createDataFrame([(1,)], "x int")).first().asDict() == {"x": 1, "Project": "967E1", "Vendor": "LY"}


def test_dimensions():
    assert cleaning.detect_dimensions(["SN", "time", "FAI1 ", "FAI2"], ["FAI1", "Time"]) == (["FAI1 "], ["FAI2"])


def test_csv_and_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("序列号;测试时间;CFG;FAI1\nx;2026/1/2;L1;#REF!\ny;45595;L2;2.5\n".encode("gbk"))
    got = [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv")).orderBy("SN").collect()]
    assert got == [("x", datetime(2026, 1, 2), "L1", None), ("y", datetime(2024, 10, 30), "L2", 2.5)]
    assert tables.sniff_encoding("é".encode()[:1] + b"") in ("utf-8", "latin-1") and tables.sniff_encoding(b"\xef\xbb\xbfa") == "utf-8-sig" and tables.sniff_delimiter("a\tb\n1\t2") == "\t"
    raw = tables.rows_to_raw(spark, ["SN", None, "Time", "FAI1"], [["a", "skip", "2026-01-02", 5], ["b"]])
    assert [tuple(r) for r in raw.collect()] == [("a", datetime(2026, 1, 2), 5.0), ("b", None, None)]
    assert tables.pick_sheet(["Spec", "Rawdata"]) == "Rawdata" and tables.pick_sheet(["Spec", "x"]) == "x" and tables.pick_sheet(["Spec"]) == "Spec"
    with pytest.raises(ValueError):
        tables.pick_sheet(["a", "b"])
    assert tables.spec_rows(["FAI#", "Nominal", "TOL+", "TOL-"], [["F1", 10, 1, -2], ["F2", None, 1, 1], [None, 1, 1, 1]]) == [("F1", 11.0, 10.0, 8.0), ("F2", None, None, None)]
    assert tables.spec_rows(["FAI", "USL", "Nomial", "LSL"], [["F1 _T", 3, "2", "x"]]) == [("F1_T", 3.0, 2.0, None)]


def test_union_of_differing_batches(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([("2", 5.0)], "n string, f double")
    got = tables.union_by_name([a, b]).collect()
    assert sorted(map(str, ((r["n"], r["s"], r["f"]) for r in got))) == ["('1', 'x', None)", "('2', None, 5.0)"]
    for name, df in (("judged_b1", a), ("judged_b2", b), ("judged_b3", a)):
        df.write.parquet(str(tmp_path / name))
    paths = [str(tmp_path / f"judged_b{k}") for k in (1, 2, 3)]
    assert tables.judged(spark, *paths).count() == 3 and tables.judged(spark, paths[0], paths[2]).count() == 2
    ids = tables.batch_of(spark.read.parquet(paths[0]))
    assert ids.first()["batch_id"] == "b1"


def test_specifications(spark, tmp_path):
    store = spec_store.SpecStore(spark, str(tmp_path))
    assert store.active_limits() == {}
    old, new = store.create("a.xlsx", at=datetime(2026, 1, 1)), store.create("b.xlsx", "second", datetime(2026, 2, 1))
    rows = spec_store.load_limits([("FAI", "USL", "Nom", "LSL"), ("F1", 2, 1, 0), ("F2", 999999, None, -1e6), (None, 1, 1, 1), ("F3 _T",)])
    assert rows == [("F1", 0.0, 2.0, 1.0), ("F2", None, None, None), ("F3_T", None, None, None)]
    assert store.save_limits(new, rows) == 3 and store.save_limits(new, rows[:2]) == 2
    store.activate(old)
    store.activate(new)
    assert store.active_limits() == {"F1": (0.0, 2.0), "F2": (None, None)}
    assert [(r["version_id"], r["fai_count"], r["is_active"]) for r in spec_store.versions_with_counts(store.versions, store.limits).collect()] == [(new, 2, True), (old, 0, False)]
    with pytest.raises(ValueError):
        store.activate("none")
    assert spec_store.at_time(store.versions, "2026-01-15 00:00:00").first()["version_id"] == old
    times = spark.createDataFrame([(datetime(2025, 1, 1),), (datetime(2026, 1, 1),), (datetime(2026, 1, 31),), (datetime(2026, 2, 1),), (datetime(2026, 2, 1, 5),), (None,)], "t timestamp_ntz")
    assert [r["version_id"] for r in spec_store.at_times(store.versions, times, "t").orderBy(F.col("t").asc_nulls_last()).collect()] == [None, old, old, new, new, None]
    faults = spark.createDataFrame([(1, "A", 1.0, 2.0, 1.5), (2, " ", 1.0, 2.0, None), (3, "A ", 3.0, 2.0, 9.0)], "row int, fai_name string, lower_limit double, upper_limit double, nominal double")
    assert sorted(map(tuple, spec_store.validate(faults).collect())) == [(2, "empty name"), (3, "duplicate name"), (3, "lower above upper"), (3, "nominal outside limits")]


def test_defect_rows_are_cleaned(spark):
    df = spark.createDataFrame([("F1", "3", "10", "30.0"), (None, "1", "1", "1"), ("", "1", "1", "1"), ("F2", "x", "5", "bad"), ("F3", None, "5", "0.5")], "fai_name string, ng_count string, total string, ng_rate_pct string")
    assert sorted(map(tuple, clean_defect_rows(df).collect())) == [("F1", 3, 10, 30.0), ("F3", 0, 5, 0.5)]


def test_workbooks(spark):
    from yieldloom.sources import workbook

    cells = [["SN", None, "检测时间", "CFG", "FAI1"], ["a<&>", "skip", 45595.2904, "L", "#REF!"], [None, None, "2026-01-02", None, 2], ["b"], [True, 1.5]]
    data = workbook.write([("Spec", [["FAI", "USL"]]), ("Data", cells)])
    assert [r + [None] * (5 - len(r)) for r in workbook.rows(data, "Data")] == [r + [None] * (5 - len(r)) for r in cells]
    got = [tuple(r) for r in tables.import_workbook(spark, data).collect()]
    assert got[:3] == [("a<&>", datetime(2024, 10, 30, 6, 58, 10), "L", None), (None, datetime(2026, 1, 2), None, 2.0), ("b", None, None, None)]
    assert workbook._column(701) == "ZZ" and workbook._place("AA10") == 26


def test_versions_at_times(spark):
    import bisect
    import random
    from datetime import timedelta

    rnd, start = random.Random(3), datetime(2025, 1, 1)
    moments = sorted(start + timedelta(seconds=rnd.randrange(40 * 86400)) for _ in range(3000)) + [start + timedelta(days=9, seconds=k) for k in range(2000)]
    versions = spark.createDataFrame([(f"v{k:05d}", m) for k, m in enumerate(moments)] + [("none", None)], "version_id string, imported_at timestamp_ntz")
    asked = [start + timedelta(seconds=rnd.randrange(-86400, 45 * 86400)) for _ in range(4000)] + moments[:50] + [None, None]
    times = spark.createDataFrame([(k, a) for k, a in enumerate(asked)], "k int, t timestamp_ntz")
    newest = {}
    for k, m in enumerate(moments):
        newest[m] = max(newest.get(m, ""), f"v{k:05d}")
    known = sorted(newest)
    want = [None if a is None or a < known[0] else newest[known[bisect.bisect_right(known, a) - 1]] for a in asked]
    for grain in ("hour", "day", "minute"):
        got = spec_store.at_times(versions, times, "t", grain)
        assert [r["version_id"] for r in got.orderBy("k").collect()] == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
