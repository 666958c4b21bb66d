import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from yieldloom.operators.kept import KeptUnits, update_all
from yieldloom.operators.latest import latest_per_unit
from yieldloom.plans import defects, rectification, yields
from yieldloom.sources import tables
from yieldloom.streaming.incremental import keep_daily, kept_daily, unit_changes

SCHEMA = "SN string, Time timestamp_ntz, event_id long, FAI312_result int, FAI1_result int, overall_result int, Line string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def measured(seed, n=240):
    """Units tested up to many times over some days; some without a time, some without a number."""
    rnd, start = random.Random(seed), datetime(2026, 1, 1)
    rows = []
    for k in range(n):
        a, b = rnd.randrange(2), rnd.randrange(2)
        t = None if rnd.random() < 0.05 else start + timedelta(hours=rnd.randrange(150))
        rows.append((None if rnd.random() < 0.04 else f"u{rnd.randrange(60)}", t, k, a, b, None if rnd.random() < 0.03 else max(a, b), rnd.choice("XY")))
    return rows


def same(a, b):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_gives_the_collapsed_days(spark, tmp_path, rocks, seed):
    rows = measured(seed)
    random.Random(seed + 9).shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keep_daily(stream(), str(tmp_path / "out"), str(tmp_path / "c"), ["event_id"]).awaitTermination()
    whole = spark.createDataFrame(rows, SCHEMA)
    same(kept_daily(spark, str(tmp_path / "out")), yields.regression_daily(whole, ["event_id"]))
    more = [(f"u{k}", datetime(2025, 12, 31, 8), 1000 + k, 1, 0, 1, "X") for k in range(5)] + [("u1", datetime(2026, 2, 1), 2000, 0, 0, 0, "X")]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    keep_daily(stream(), str(tmp_path / "out"), str(tmp_path / "c"), ["event_id"]).awaitTermination()  # goes on where it ended
    same(kept_daily(spark, str(tmp_path / "out")), yields.regression_daily(spark.createDataFrame(rows + more, SCHEMA), ["event_id"]))


def test_changes_add_up_to_the_last_rows(spark, tmp_path, rocks):
    rows = measured(5, 120)
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = unit_changes(stream, ["overall_result", "Line"], ["Line", "event_id"]).writeStream.outputMode("update").format("memory").queryName("changes").trigger(availableNow=True).start()
    q.awaitTermination()
    left = spark.table("changes").groupBy("SN", "first_us", "overall_result", "Line").agg(F.sum("change").alias("n")).filter("n <> 0")
    whole = spark.createDataFrame(rows, SCHEMA).filter("Time IS NOT NULL")
    want = latest_per_unit(whole, ["overall_result", "Line"], ["Line", "event_id"]).select("SN", F.unix_micros(F.col("first_prod_time").cast("timestamp")).alias("first_us"), "overall_result", "Line", F.lit(1).cast("long").alias("n"))
    same(left, want)
    with pytest.raises(TypeError):
        unit_changes(stream.withColumn("x", F.lit(1.5)), ["Line"], ["x"])


def test_kept_units_answer_like_all_rows(spark, tmp_path):
    rows = measured(7, 400)
    parts = [rows[k::4] for k in range(4)]
    units = KeptUnits(spark, str(tmp_path / "k"), ["event_id"], buckets=8)
    with pytest.raises(FileNotFoundError):
        units.rows()
    for k in (2, 0, 3, 1):
        assert units.update(f"b{k}", spark.createDataFrame(parts[k], SCHEMA))
    assert not units.update("b0", spark.createDataFrame(parts[0], SCHEMA)) and units.batches == ["b0", "b1", "b2", "b3"]
    whole = spark.createDataFrame(rows, SCHEMA)
    again = KeptUnits(spark, str(tmp_path / "k"), ["event_id"])
    same(again.daily(), yields.regression_daily(whole, ["event_id"]))
    same(again.daily_top(2), defects.daily_top_regression(whole, ["event_id"], 2))
    same(again.repair(), rectification.stats(whole, ["event_id"]))
    same(again.daily_repair(), rectification.daily(whole, ["event_id"]))
    same(again.unit_rows("core"), yields.regression_rows(whole, ["event_id"], "core"))
    same(again.unit_rows("all"), yields.regression_rows(whole, ["event_id"], "all"))


def test_nothing_is_shuffled_by_unit(spark, tmp_path):
    units = KeptUnits(spark, str(tmp_path / "k"), ["event_id"], buckets=8)
    units.update("a", spark.createDataFrame(measured(1), SCHEMA))
    for df in (units.daily(), units.daily_top(), units.repair(), units.daily_repair()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(SN" not in plan and "hashpartitioning(__unit" not in plan
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        entry = units.tables.entry("units")
        new = latest_per_unit(spark.createDataFrame(measured(2), SCHEMA), SCHEMA.replace(" string", "").split(", ")[:0] or ["Time", "event_id"], ["event_id"]).withColumn("__unit", F.col("SN"))
        plan = units._merged(units._table(entry), new)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(n_key") == 1 and "hashpartitioning(o_key" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_batches_with_other_columns(spark, tmp_path):
    units = KeptUnits(spark, str(tmp_path / "k"), ["event_id"], buckets=4)
    first, later = datetime(2026, 1, 1, 8), datetime(2026, 1, 2, 8)
    tables.TableSet(spark, str(tmp_path / "d")).write("judged_a", spark.createDataFrame([("x", first, 1, 1), ("y", first, 2, 0)], "SN string, Time timestamp_ntz, event_id long, FAI1_result int"))
    tables.TableSet(spark, str(tmp_path / "d")).write("judged_b", spark.createDataFrame([("x", later, 3, 0)], "SN string, Time timestamp_ntz, event_id long, FAI2_result int"))
    assert update_all(units, str(tmp_path / "d")) == ["a", "b"] and update_all(units, str(tmp_path / "d")) == []
    assert {r["SN"]: (r["first_prod_time"], r["FAI1_result"], r["FAI2_result"]) for r in units.rows().collect()} == {"x": (first, None, 0), "y": (first, 0, None)}


def test_state_is_kept_by_parts_of_units(spark, tmp_path):
    """However many units there are, a micro-batch makes a call for each part, not for each unit; a checkpoint keeps their number."""
    rows = [(None if k % 50 == 0 else f'u"{k % 300}', datetime(2026, 1, 1) + timedelta(hours=k % 90), k, 0, 0, k % 2, "X") for k in range(900)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = keep_daily(stream(), str(tmp_path / "out"), str(tmp_path / "c"), ["event_id"], parts=8)
    query.awaitTermination()
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]] == [8, 8, 8]
    same(kept_daily(spark, str(tmp_path / "out")), yields.regression_daily(spark.createDataFrame(rows, SCHEMA), ["event_id"]))
    spark.createDataFrame(rows[:1], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="8 parts, not in 9"):
        keep_daily(stream(), str(tmp_path / "out"), str(tmp_path / "c"), ["event_id"], parts=9).awaitTermination()
