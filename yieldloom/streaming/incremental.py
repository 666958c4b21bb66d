"""Incremental judging of new batches, and re-tests that replace earlier results."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from yieldloom.config import CUTOFF_HOUR, OVERALL
from yieldloom.functions.columns import in_order, percent
from yieldloom.operators.judge import Limits, judge
from yieldloom.sources.tableset import TableSet


def judge_new(spark: SparkSession, raw: str, judged: str, checkpoint: str, schema: T.StructType, limits: Limits, spec_version: str = "") -> StreamingQuery:
    """Judge the files of `raw` that the checkpoint hasn't seen, append to `judged`, and end."""
    rows = spark.readStream.schema(schema).parquet(raw)
    return judge(rows, limits, spec_version).writeStream.format("parquet").option("path", judged).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_yield(rows: DataFrame, cutoff: int = 7, late: str = "2 days", week: bool = False) -> DataFrame:
    """A running count by production day (or week, from its Monday); each ends as soon as the watermark passes it. Time must be a
    timestamp."""
    # Windows are counted from a Thursday, the first day of 1970.
    window = F.window("Time", "7 days", startTime=f"{4 * 24 + cutoff} hours") if week else F.window("Time", "1 day", startTime=f"{cutoff} hours")
    days = rows.withWatermark("Time", late).groupBy(window)
    ok = F.sum(F.when(F.col("overall_result") == 0, 1).otherwise(0)).alias("ok_count")
    return days.agg(F.count(F.lit(1)).alias("total"), ok).select(F.col("window.start").cast("date").alias("production_week" if week else "production_day"), "total", "ok_count")


#: Parts that units are dealt to by a hash of SN; the state of a part is one value.
PARTS = 1024
_COLUMNS = ["unit", "first_us", "place", "kept"]


def _merge(parts: int):
    """The function of a part's new rows and state. The state holds, of each of the part's units, the first time, and of its last row the
    order and the kept columns, as JSON. Says what changes: the old state with -1, the new one with 1."""
    kinds = pa.schema([(c, pa.int64() if c == "first_us" else pa.large_string()) for c in _COLUMNS])

    def run(key, rows: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        units, before = {}, {}
        if state.exists:
            made, packed = state.get
            if made != parts:
                raise ValueError(f"the checkpoint's units are in {made} parts, not in {parts}")
            unit, *rest = (c.to_pylist() for c in pa.ipc.open_stream(packed).read_all().columns)
            units = dict(zip(unit, zip(*rest, strict=True), strict=True))
        for batch in rows:
            for unit, t, place, kept in zip(*[batch[c].tolist() for c in _COLUMNS], strict=True):
                now = units.get(unit)
                before.setdefault(unit, now)
                units[unit] = (t, place, kept) if now is None else (min(now[0], t), *((place, kept) if place > now[1] else now[1:]))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kinds, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(pa.table([list(units), *map(list, zip(*units.values(), strict=True))], schema=kinds))
        state.update((parts, sink.getvalue().to_pybytes()))
        changes = []
        for unit, old in before.items():
            now = units[unit]
            if old is None or (old[0], old[2]) != (now[0], now[2]):
                changes += [(unit, u[0], u[2], sign) for u, sign in ((old, -1), (now, 1)) if u]
        yield pd.DataFrame(changes, columns=["unit", "first_us", "kept", "change"]).astype({"first_us": "int64", "change": "int32"})

    return run


def _micros(t: Column) -> Column:
    """A wall-clock time as microseconds, whatever the session's zone."""
    whole = (F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(t)) * 3600 + F.minute(t) * 60
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def _sortable(c: Column, kind: T.DataType) -> Column:
    """A whole number, time or text as text whose order is the column's own; nulls are first."""
    if isinstance(kind, T.IntegralType):
        text = F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")
    elif isinstance(kind, T.StringType):
        text = F.concat(F.hex(c.cast("binary")), F.lit(" "))
    else:
        raise TypeError(f"a tie must be a whole number or text, not {kind.simpleString()}")
    return F.coalesce(F.concat(F.lit("1"), text), F.lit("0"))


def unit_changes(rows: DataFrame, keep: list[str], tie: list[str], parts: int = PARTS) -> DataFrame:
    """A stream of judged rows as changes of collapsed units: SN, first_us (microseconds), the kept columns, and change: -1 withdraws
    what was said of the unit before, 1 says what holds now. Re-tests may come however late and in any order: of each unit the state
    store holds its first time, and the order and kept columns of its last row. tie: whole numbers or text. parts: of the units' state; a
    micro-batch reads and writes those that its units are in, and a checkpoint keeps their number. Needs the RocksDB state store."""
    t = F.col("Time").cast("timestamp_ntz")
    place = F.concat(_sortable(_micros(t), T.LongType()), *[_sortable(F.col(c), rows.schema[c].dataType) for c in tie])
    kept = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in keep])
    unit = T.StructType([T.StructField("SN", rows.schema["SN"].dataType)])
    own = rows.filter("Time IS NOT NULL").select(F.to_json(F.struct("SN")).alias("unit"), _micros(t).alias("first_us"), place.alias("place"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in keep])).alias("kept"))
    dealt = own.withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(parts)).cast("int"))
    changes = dealt.groupBy("part").applyInPandasWithState(_merge(parts), "unit string, first_us long, kept string, change int", "parts int, units binary", "update", GroupStateTimeout.NoTimeout)
    return changes.select(F.from_json("unit", unit)["SN"].alias("SN"), "first_us", F.from_json("kept", kept).alias("kept"), "change").select("SN", "first_us", "kept.*", "change")


def keep_daily(rows: DataFrame, folder: str, checkpoint: str, tie: list[str], name: str = "days", cutoff: int = CUTOFF_HOUR, parts: int = PARTS) -> StreamingQuery:
    """Keep the daily yield of collapsed units (regression_daily) of a stream: each micro-batch's changes are summed by day and verdict and
    added to a small table, in one commit with the batch's number, so a batch that runs twice counts once. Ends when all is read."""

    def add(changes: DataFrame, batch: int) -> None:
        days = TableSet(changes.sparkSession, folder)
        before = days.entry(name)
        if before and before["batch"] >= batch and before["checkpoint"] == checkpoint:
            return
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((F.col("first_us") - cutoff * 3_600_000_000) / 86_400_000_000).cast("int"))
        new = changes.groupBy(day.alias("production_day"), OVERALL).agg(F.sum("change").alias("units"))
        sums = days.read(name).unionByName(new) if before else new
        sums = sums.groupBy("production_day", OVERALL).agg(F.sum("units").alias("units")).filter("units <> 0")
        days.write(name, sums.coalesce(1), batch=batch, checkpoint=checkpoint)

    changes = unit_changes(rows, [OVERALL], tie, parts)
    with _rocks(rows.sparkSession):
        return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start within the block keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def kept_daily(spark: SparkSession, folder: str, name: str = "days") -> DataFrame:
    """The table that keep_daily keeps, with its rates."""
    units = lambda c: F.coalesce(F.sum(F.when(c, F.col("units")).otherwise(0)), F.lit(0))
    total, ok, ng = F.sum("units"), units(F.col(OVERALL) == 0), units(F.col(OVERALL) == 1)
    days = TableSet(spark, folder).read(name).groupBy("production_day")
    return in_order(days.agg(total.alias("total"), ok.alias("ok_count"), ng.alias("ng_count"), percent(ok, total).alias("yield_pct")), F.col("production_day").asc_nulls_last())


def merge_latest(state: DataFrame, batch: DataFrame, tie: list[str]) -> DataFrame:
    """One row for each SN: first_time, and the row with the last Time, of what was known and what came. For foreachBatch.
    tie: the columns that decide between equal times; the larger wins."""
    own = [c for c in batch.columns if c not in ("SN", "first_time")]
    new = batch.select("SN", F.col("Time").alias("first_time"), *own)
    both = state.select(*new.columns).unionByName(new)
    last = both.groupBy("SN").agg(F.min("first_time").alias("first_time"), F.max_by(F.struct(*own), F.struct("Time", *tie)).alias("last"))
    return last.select("SN", "first_time", "last.*")
