import math
import random
from datetime import datetime

import pytest

from yieldloom.operators import judge as J


def test_match_prefers_exact_names_then_swaps_suffixes():
    m = J.match(["SN", "A_T", "B", "C_z", "time", "D"], {"A_Z": (0, 1), " B": (0, 1), "C_t": (0, 1), "Time": (0, 1), "D_Z": (0, 1), "E": (0, 1)})
    assert m.columns == {"A_Z": "A_T", " B": "B", "C_t": "C_z"} and m.unmatched == ("Time", "D_Z", "E")


def test_bounds():
    inf = math.inf
    assert J.bounds(None, None) == J.bounds(-999999, 999999) == J.bounds(float("nan"), float("nan")) == (-inf, inf)
    assert J.bounds(999999, -999999) == (-inf, -999999) and J.bounds(1, 2) == (1.0, 2.0)


ROWS = [("a", 1.0, 5.0, "2"), ("b", 2.0, None, "x"), ("c", 2.0001, float("nan"), None), ("d", None, float("inf"), "-7"), ("e", 0.9999, float("-inf"), "1e3")]


@pytest.mark.parametrize("wide", [40, 0])
def test_verdicts(spark, monkeypatch, wide):
    monkeypatch.setattr(J, "WIDE", wide)
    df = spark.createDataFrame(ROWS, "SN string, F1 double, F2_T double, F3 string")
    out = J.judge(df, {"F1": (1, 2), "F2_Z": (None, 100.0), "F3": (0, 10), "F4": (1, 2)}, "v1", "now")
    assert out.columns == ["SN", "F1", "F2_T", "F3", "F1_result", "F2_T_result", "F3_result", "overall_result", "judged_at", "spec_version"]
    got = {r["SN"]: tuple(r[4:8]) for r in out.collect()}
    assert got == {"a": (0, 0, 0, 0), "b": (0, 0, 0, 0), "c": (1, 0, 0, 1), "d": (0, 1, 1, 1), "e": (1, 0, 1, 1)}
    assert dict(out.dtypes)["F1_result"] == "tinyint"


def test_unbounded_dimensions_are_not_judged(spark):
    df = spark.createDataFrame([("a", 5.0)], "SN string, F1 double")
    out = J.judge(df, {"F1": (-999999, 999999)}, "v")
    assert "F1_result" not in out.columns and out.first()["overall_result"] == 0


def test_errors(spark):
    df = spark.createDataFrame([("a", 5.0)], "SN string, F1 double")
    for limits in ({}, {"X": (1, 2)}):
        with pytest.raises(ValueError):
            J.judge(df, limits)


def test_wide_and_narrow_agree(spark, monkeypatch):
    rng = random.Random(2)
    names = [f"F{k}" for k in range(12)]
    rows = [(str(i), *[rng.choice([None, float("nan"), rng.uniform(-5, 5)]) for _ in names]) for i in range(200)]
    df = spark.createDataFrame(rows, "SN string, " + ", ".join(f"{n} double" for n in names))
    limits = {n: (rng.uniform(-4, 0), rng.choice([None, rng.uniform(0, 4)])) for n in names}
    plain = J.judge(df, limits, "v", "t").drop(*names).collect()
    monkeypatch.setattr(J, "WIDE", 0)
    assert sorted(map(str, J.judge(df, limits, "v", "t").drop(*names).collect())) == sorted(map(str, plain))


def test_batch_summary(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "SN string, F1 double, F2 double, F3 string").withColumnRenamed("F3", "Line")
    got = J.judge_batch(df, {"F1": (1, 2), "F2": (-999999, 999999), "F9": (0, 1)}, str(tmp_path / "out"), "v1")
    assert (got["total_rows"], got["ng_count"], got["ok_count"], got["yield_rate"]) == (5, 2, 3, 0.6)
    assert (got["matched"], got["judged"], got["skipped"], got["unmatched"]) == (2, 1, 1, 1)
    assert spark.read.parquet(got["output_path"]).count() == 5


def test_streamed_batches_are_judged_once(spark, tmp_path):
    from yieldloom.streaming.incremental import judge_new, merge_latest

    df = spark.createDataFrame([("a", 5.0), ("b", 1.0)], "SN string, F1 double")
    raw, out, mark = (str(tmp_path / x) for x in ("raw", "judged", "mark"))
    for k in (1, 2):
        df.write.mode("append").parquet(raw)
        for _ in range(2):
            judge_new(spark, raw, out, mark, df.schema, {"F1": (0, 2)}).awaitTermination()
        assert spark.read.parquet(out).count() == 2 * k
    t = [datetime(2026, 1, d) for d in (1, 2, 3)]
    state = spark.createDataFrame([("a", t[1], t[1], 1)], "SN string, first_time timestamp, Time timestamp, overall_result int")
    batch = spark.createDataFrame([("a", t[2], 0), ("a", t[0], 1), ("b", t[0], 0)], "SN string, Time timestamp, overall_result int")
    assert sorted(map(tuple, merge_latest(state, batch, ["overall_result"]).collect())) == [("a", t[0], t[2], 0), ("b", t[0], t[0], 0)]
