"""The driver's tables as raw and judged rows, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from yieldloom.operators.judge import judge

EVENT_LIMITS = {"FAI312": (5.0, 450.0), "FAI313": (3.0, 95.0), "FAI001": (-999999.0, 2000.0), "FAI002": (-999999.0, 999999.0)}
ITEM_LIMITS = {"FAI312_Z": (2.0, 49.0), "FAI313": (1000.0, 100000.0), "FAI001": (-999999.0, 0.09), "FAI002": (0.01, 999999.0)}
EVENT_TIE = ["event_id"]
ITEM_TIE = ["k1", "k2", "FAI312_T", "FAI313", "FAI001", "FAI002", "Line", "Vendor", "k3"]
JUDGED_AT = "2026-01-01T00:00:00+00:00"


#: The two large tables' columns; with them no job has to read footers before a query is planned.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "concat_ws('-', user_id, event_id % 20) AS SN",
        "CASE WHEN event_id % 97 <> 0 THEN ts END AS Time",
        "event_type AS Line",
        "concat('P', user_id % 3) AS Project",
        "CASE WHEN user_id % 2 = 0 THEN 'LY' ELSE 'LK' END AS Vendor",
        "CASE WHEN event_id % 11 <> 0 THEN value END AS FAI312",
        "CAST(get_json_object(props, '$.k') AS DOUBLE) AS FAI313",
        "value * (event_id % 7) AS FAI001",
        "value AS FAI002",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(raw_events(spark, sf_dir), EVENT_LIMITS, "v1", JUDGED_AT)


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_partkey AS STRING) AS SN", "l_shipdate AS Time", "l_returnflag AS Line", "'P' AS Project", "l_linestatus AS Vendor",
        "l_quantity AS FAI312_T", "l_extendedprice AS FAI313", "l_discount AS FAI001", "l_tax AS FAI002", "l_orderkey AS k1", "l_linenumber AS k2", "l_suppkey AS k3",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(raw_items(spark, sf_dir), ITEM_LIMITS, "v1", JUDGED_AT)


def _verdict(column: str, low: float | None, high: float | None) -> str:
    tests = [f"{column} >= {low}" if low is not None else "", f"{column} <= {high}" if high is not None else ""]
    return f"CAST(CASE WHEN {column} IS NULL OR isnan({column}) OR ({' AND '.join(t for t in tests if t)}) THEN 0 ELSE 1 END AS TINYINT) AS {column}_result"


EVENTS_SQL = f"""raw AS (SELECT event_id, CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 20 AS VARCHAR) AS SN, CASE WHEN event_id % 97 <> 0 THEN ts END AS Time, event_type AS Line,
  'P' || CAST(user_id % 3 AS VARCHAR) AS Project, CASE WHEN user_id % 2 = 0 THEN 'LY' ELSE 'LK' END AS Vendor, CASE WHEN event_id % 11 <> 0 THEN value END AS FAI312,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS FAI313, value * (event_id % 7) AS FAI001, value AS FAI002 FROM events),
v AS (SELECT *, {_verdict("FAI312", 5, 450)}, {_verdict("FAI313", 3, 95)}, {_verdict("FAI001", None, 2000)} FROM raw),
J AS (SELECT *, greatest(FAI312_result, FAI313_result, FAI001_result) AS overall_result, '{JUDGED_AT}' AS judged_at, 'v1' AS spec_version FROM v)"""
#: Units' last rows among those with a Time.
LATEST_SQL = """L AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY SN ORDER BY Time DESC, event_id DESC) AS rn, min(Time) OVER (PARTITION BY SN) AS first_prod_time FROM J WHERE Time IS NOT NULL) WHERE rn = 1)"""
ITEMS_SQL = f"""raw AS (SELECT CAST(l_partkey AS VARCHAR) AS SN, l_shipdate AS Time, l_returnflag AS Line, 'P' AS Project, l_linestatus AS Vendor, l_quantity AS FAI312_T, l_extendedprice AS FAI313, l_discount AS FAI001, l_tax AS FAI002, l_orderkey AS k1, l_linenumber AS k2, l_suppkey AS k3 FROM lineitem),
v AS (SELECT *, {_verdict("FAI312_T", 2, 49)}, {_verdict("FAI313", 1000, 100000)}, {_verdict("FAI001", None, 0.09)}, {_verdict("FAI002", 0.01, None)} FROM raw),
J AS (SELECT *, greatest(FAI312_T_result, FAI313_result, FAI001_result, FAI002_result) AS overall_result FROM v)"""
