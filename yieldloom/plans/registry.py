"""Every query by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.functions import columns as C
from yieldloom.operators import batches, cleaning, filters, spec_store
from yieldloom.operators.filters import Filters
from yieldloom.operators.judge import judge
from yieldloom.operators.kept import KeptUnits
from yieldloom.plans import defects, rectification, report, views, yields
from yieldloom.plans.views import EVENT_TIE, EVENTS_SQL, ITEM_TIE, ITEMS_SQL, LATEST_SQL
from yieldloom.sources import files, tables
from yieldloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

YIELD = "count(*) AS total, CAST(coalesce(sum(CASE WHEN overall_result = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS ok_count, CAST(coalesce(sum(CASE WHEN overall_result = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS ng_count, round(sum(CASE WHEN overall_result = 0 THEN 1 ELSE 0 END) * 100.0 / count(*), 2) AS yield_pct"
YIELD3 = YIELD.replace("CAST(coalesce(sum(CASE WHEN overall_result = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS ng_count, ", "")
DAY = "CAST(Time - INTERVAL 7 HOUR AS DATE)"
FIRST_DAY = "CAST(first_prod_time - INTERVAL 7 HOUR AS DATE)"
RECT = """count(*) AS total, CAST(sum(CASE WHEN overall_result = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ok_count, CAST(sum(CASE WHEN overall_result = 1 THEN 1 ELSE 0 END) AS BIGINT) AS ng_count,
 CAST(sum(CASE WHEN overall_result = 1 AND FAI001_result = 0 AND FAI312_result + FAI313_result > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rectifiable"""
RATES = "CAST(floor(rectifiable * 0.86::DOUBLE) AS BIGINT) AS saved_count, round(ok_count * 100.0 / total, 2) AS pre_yield, round((ok_count + CAST(floor(rectifiable * 0.86::DOUBLE) AS BIGINT)) * 100.0 / total, 2) AS post_yield"


def unpivot(source: str, day: str, non_null: bool) -> str:
    """Long form of the three verdict columns, summed."""
    names = ("FAI312", "FAI313", "FAI001")
    total = "count(r)" if non_null else "count(*)"
    group = "GROUP BY 1, 2" if day else "GROUP BY 1"
    keys = f"{day} AS production_day, " if day else ""
    branches = " UNION ALL ".join(f"SELECT *, '{n}' AS fai_name, {n}_result AS r FROM {source}" for n in names)
    return f"SELECT {keys}fai_name, CAST(sum(r) AS BIGINT) AS ng_count, {total} AS total FROM ({branches}) {group} HAVING sum(r) > 0"


def events_sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([EVENTS_SQL, *more])} {body}"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def on_events(name: str, body: str, f: Callable[[DataFrame], DataFrame], *more: str) -> None:
    query(name, events_sql(body, *more))(lambda spark, sf: f(views.events(spark, sf)))


# --- judge
on_events("j_judge_events", "SELECT event_id, SN, Time, Line, Project, Vendor, FAI312, FAI313, FAI001, FAI002, FAI312_result, FAI313_result, FAI001_result, overall_result, judged_at, spec_version FROM J", lambda j: j)
query("j_judge_items", f"WITH {ITEMS_SQL} SELECT SN, Time, Line, FAI312_T_result, FAI313_result, FAI001_result, FAI002_result, overall_result, k1, k2 FROM J")(lambda s, d: views.items(s, d).select("SN", "Time", "Line", "FAI312_T_result", "FAI313_result", "FAI001_result", "FAI002_result", "overall_result", "k1", "k2"))
query("j_batch_summary", f"WITH {ITEMS_SQL} SELECT count(*) AS total_rows, CAST(sum(overall_result) AS BIGINT) AS ng_count, count(*) - CAST(sum(overall_result) AS BIGINT) AS ok_count, round((count(*) - sum(overall_result)) * 1.0 / count(*), 4) AS yield_rate FROM J")(
    lambda s, d: views.items(s, d).agg(F.count(F.lit(1)).alias("total_rows"), F.sum(F.col("overall_result").cast("bigint")).alias("ng_count")).select("total_rows", "ng_count", (F.col("total_rows") - F.col("ng_count")).alias("ok_count"), C.round2((F.col("total_rows") - F.col("ng_count")) / F.col("total_rows"), 4).alias("yield_rate"))
)

#: More dimensions than plain columns are made for: the batches of numpy judge them.
WIDE_COLUMNS = 60


def _wide_limits() -> dict[str, tuple[float | None, float | None]]:
    """A lower limit, an upper one, both or none, in turn."""
    return {f"FAI{k:03d}": ((float(k), None), (None, 400.0 - k), (5.0 + k, 300.0), (None, None))[k % 4] for k in range(1, WIDE_COLUMNS + 1)}


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    measured = [F.when((F.col("event_id") + k) % 13 != 0, F.col("value") * (1 + k % 3)).alias(f"FAI{k:03d}") for k in range(1, WIDE_COLUMNS + 1)]
    out = judge(e.select("event_id", F.col("user_id").cast("string").alias("SN"), *measured), _wide_limits(), "w", views.JUDGED_AT)
    return out.select("event_id", "SN", *[c for c in out.columns if c.endswith("_result")])


def _wide_sql() -> str:
    verdicts = []
    for name, (low, high) in _wide_limits().items():
        k = int(name[3:])
        v = f"(CASE WHEN (event_id + {k}) % 13 <> 0 THEN value * {1 + k % 3} END)"
        tests = [f"{v} >= {low}" if low is not None else "", f"{v} <= {high}" if high is not None else ""]
        if any(tests):
            verdicts.append(f"CAST(CASE WHEN {v} IS NULL OR isnan({v}) OR ({' AND '.join(t for t in tests if t)}) THEN 0 ELSE 1 END AS TINYINT) AS {name}_result")
    names = ", ".join(v.rsplit(" ", 1)[1] for v in verdicts)
    return f"SELECT *, greatest({names}) AS overall_result FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS SN, {', '.join(verdicts)} FROM events)"


query("j_judge_wide", _wide_sql())(_wide)

# --- yields
on_events("a01_summary", f"SELECT {YIELD} FROM J", yields.summary)
on_events("a01_summary_line", f"SELECT {YIELD} FROM J WHERE Line = 'click'", lambda j: yields.summary(j, Filters(line="click")))
on_events("a02_daily", f"SELECT {DAY} AS production_day, {YIELD} FROM J WHERE Time IS NOT NULL GROUP BY 1", yields.daily)
on_events("a03_weekly", f"SELECT CAST(date_trunc('week', Time - INTERVAL 7 HOUR) AS DATE) AS production_week, {YIELD3} FROM J WHERE Time IS NOT NULL GROUP BY 1", yields.weekly)
on_events("a04_line", f"SELECT Line, {YIELD} FROM J GROUP BY 1", lambda j: yields.by_group(j, "Line"))
on_events("a05_vendor", f"SELECT Vendor, {YIELD} FROM J GROUP BY 1", lambda j: yields.by_group(j, "Vendor"))
on_events("a06_regression_daily", f"SELECT {FIRST_DAY} AS production_day, {YIELD} FROM L GROUP BY 1", lambda j: yields.regression_daily(j, EVENT_TIE), LATEST_SQL)
query("a06_regression_daily_items", f"WITH {ITEMS_SQL}, L AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY SN ORDER BY Time DESC, k1 DESC, k2 DESC, FAI312_T DESC, FAI313 DESC, FAI001 DESC, FAI002 DESC, Line DESC, Vendor DESC, k3 DESC) AS rn, min(Time) OVER (PARTITION BY SN) AS first_prod_time FROM J) WHERE rn = 1) SELECT {FIRST_DAY} AS production_day, {YIELD} FROM L GROUP BY 1")(
    lambda s, d: yields.regression_daily(views.items(s, d), ITEM_TIE)
)
on_events("a07_multi_production", "SELECT SN, count(*) AS production_count, min(Time) AS first_time, max(Time) AS last_time FROM J WHERE Time IS NOT NULL GROUP BY SN HAVING count(*) > 1 ORDER BY production_count DESC, SN LIMIT 20", yields.multi_production)
_BY_LINE = "count(*) AS total, CAST(sum(CASE WHEN overall_result = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ok_count, count(*) - CAST(sum(CASE WHEN overall_result = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ng_count, round(sum(CASE WHEN overall_result = 0 THEN 1 ELSE 0 END) * 100.0 / count(*), 2) AS yield_pct"
on_events("a08_daily_project_line", f"SELECT {FIRST_DAY} AS production_day, Project AS project, Line AS line, {_BY_LINE} FROM L GROUP BY 1, 2, 3", lambda j: yields.daily_by_project_line(j, EVENT_TIE), LATEST_SQL)
on_events("a08_daily_project_line_normal", f"SELECT {DAY} AS production_day, Project AS project, Line AS line, {_BY_LINE} FROM J WHERE Time IS NOT NULL GROUP BY 1, 2, 3", lambda j: yields.daily_by_project_line(j, EVENT_TIE, regression=False))
on_events("a08_daily_project_line_last", f"SELECT {DAY} AS production_day, Project AS project, Line AS line, {_BY_LINE} FROM L GROUP BY 1, 2, 3", lambda j: yields.daily_by_project_line(j, EVENT_TIE, at_last=True), LATEST_SQL)
on_events("a09_duplicate_units", "SELECT count(*) AS duplicate_sn_count FROM (SELECT SN FROM J GROUP BY SN HAVING count(*) > 1)", yields.duplicate_units)
on_events("a10_regression_summary", "SELECT count(SN) AS unique_sn, count(*) FILTER (n > 1) AS duplicate_sn, coalesce(max(n) FILTER (n > 1), 1) AS max_repeats, round(count(*) FILTER (n > 1) * 100.0 / count(SN), 2) AS duplicate_rate FROM (SELECT SN, count(*) AS n FROM J GROUP BY SN)", yields.regression_summary)
on_events("a11_unique_counts", "SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_rows, CAST(sum(n) - count(*) AS BIGINT) AS removed_rows, round((sum(n) - count(*)) * 100.0 / sum(n), 2) AS dedup_pct FROM (SELECT SN, count(*) AS n FROM J GROUP BY SN)", yields.unique_counts)
on_events("a24_projects", "SELECT DISTINCT Project FROM J WHERE Project <> ''", yields.projects)
on_events("a24_lines", "SELECT DISTINCT Line FROM J WHERE Project = 'P1' AND Line <> ''", lambda j: yields.lines_of(j, "P1"))
on_events("a25_dedup_stats", "SELECT count(*) AS unique_sn, count(*) FILTER (Time > f) AS regressed, max(n) AS max_occurrences, round(count(*) FILTER (Time > f) * 100.0 / count(*), 2) AS regression_rate FROM (SELECT *, row_number() OVER (PARTITION BY SN ORDER BY Time DESC NULLS LAST, event_id DESC) AS rn, min(Time) OVER (PARTITION BY SN) AS f, count(*) OVER (PARTITION BY SN) AS n FROM J) WHERE rn = 1", lambda j: yields.dedup_stats(j, EVENT_TIE))
on_events("a27_kpi", "SELECT count(*) AS total, CAST(sum(1 - overall_result) AS BIGINT) AS ok_count, round(sum(1 - overall_result) * 100.0 / count(*), 2) AS yield_pct FROM L", lambda j: yields.totals_of(yields.regression_daily(j, EVENT_TIE)), LATEST_SQL)
on_events("a29_ng_rate", "SELECT count(*) AS total, CAST(sum(overall_result) AS BIGINT) AS ng_count, round(sum(overall_result) * 100.0 / count(*), 2) AS ng_rate_pct FROM J", yields.ng_rate)
on_events("w5_moving_average", f"SELECT production_day, yield_pct, ma AS ma_yield_pct FROM (SELECT *, row_number() OVER (ORDER BY production_day) AS n, avg(yield_pct) OVER (ORDER BY production_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma FROM (SELECT {DAY} AS production_day, {YIELD} FROM J WHERE Time IS NOT NULL GROUP BY 1)) WHERE n >= 7".replace("ma AS ma_yield_pct", "round(ma, 6) AS ma_yield_pct"), lambda j: yields.moving_average(yields.daily(j)).withColumn("ma_yield_pct", C.round2(F.col("ma_yield_pct"), 6)))
on_events("f13_last_days", f"SELECT * FROM (SELECT {DAY} AS production_day, {YIELD} FROM J WHERE Time IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 14)", lambda j: yields.last_days(yields.daily(j)))
on_events("f2_date_range", f"SELECT {YIELD} FROM J WHERE Time >= TIMESTAMP '2024-01-05' AND Time < TIMESTAMP '2024-01-12'", lambda j: yields.summary(j, Filters(start="2024-01-05", end="2024-01-11")))
on_events("jn3_gap_filled", f"SELECT {FIRST_DAY} AS production_day, count(*) AS total, CAST(sum(1 - overall_result) AS BIGINT) AS ok_count, round(sum(1 - overall_result) * 100.0 / count(*), 2) AS yield_pct FROM L GROUP BY 1", lambda j: yields.gap_filled(yields.regression_daily(j, EVENT_TIE), yields.daily(j)), LATEST_SQL)



def _zero_days(days: DataFrame, column: str, every: int) -> DataFrame:
    """Days as if every so many had no collapsed unit at all (and, with two, no plain one either)."""
    off = F.day("production_day") % every == 0
    return days.withColumns({c: F.when(off, F.lit(0).cast(days.schema[c].dataType)).otherwise(F.col(c)) for c in ("total", "ok_count", column)})


on_events("jn3_zero_days", f"""SELECT production_day, CASE WHEN z THEN p_total ELSE total END AS total, CASE WHEN z THEN p_ok ELSE ok_count END AS ok_count, CASE WHEN z THEN p_pct ELSE yield_pct END AS yield_pct FROM
 (SELECT *, day(production_day) % 3 = 0 AS z FROM (SELECT {FIRST_DAY} AS production_day, {YIELD} FROM L GROUP BY 1)) LEFT JOIN
 (SELECT production_day, CASE WHEN day(production_day) % 6 = 0 THEN 0 ELSE total END AS p_total, CASE WHEN day(production_day) % 6 = 0 THEN 0 ELSE ok_count END AS p_ok, yield_pct AS p_pct FROM (SELECT {DAY} AS production_day, {YIELD} FROM J WHERE Time IS NOT NULL GROUP BY 1)) USING (production_day)
 WHERE CASE WHEN z THEN p_total ELSE total END > 0""", lambda j: yields.gap_filled(_zero_days(yields.regression_daily(j, EVENT_TIE), "yield_pct", 3), _zero_days(yields.daily(j), "yield_pct", 6)), LATEST_SQL)

# --- units' rows
_CORE = "SN, Line, first_prod_time AS Time, Project, Vendor, overall_result"
_EVERY = LATEST_SQL.replace(" WHERE Time IS NOT NULL", "").replace("Time DESC,", "Time DESC NULLS LAST,")
on_events("r1_units_core", f"SELECT {_CORE} FROM L", lambda j: yields.regression_rows(j, EVENT_TIE), _EVERY)
on_events("r1_units_minimal", "SELECT event_id, SN, first_prod_time AS Time, Line, Project, Vendor, FAI312, FAI313, FAI001, FAI002, judged_at, spec_version FROM L", lambda j: yields.regression_rows(j, EVENT_TIE, "minimal"), _EVERY)
on_events("r1_units_vendor", f"SELECT {_CORE} FROM L", lambda j: yields.regression_rows(j, EVENT_TIE, "core", Filters(vendor="LY", start="2024-01-03", end="2024-01-20")), LATEST_SQL.replace("Time IS NOT NULL", "Vendor = 'LY' AND Time >= TIMESTAMP '2024-01-03' AND Time < TIMESTAMP '2024-01-21'"))
on_events("a20_ng_units", f"SELECT {_CORE} FROM L WHERE overall_result = 1", lambda j: yields.ng_units(j, EVENT_TIE), _EVERY)

# --- defects
on_events("a12_top_defects", f"SELECT *, round(ng_count * 100.0 / total, 2) AS ng_rate_pct FROM ({unpivot('J', '', False)}) ORDER BY ng_count DESC, fai_name LIMIT 20", defects.top)
on_events("a13_top_defects_dates", f"SELECT *, round(ng_count * 100.0 / total, 2) AS ng_rate_pct FROM ({unpivot('D', '', False)})", lambda j: defects.top(j, 20, Filters(start="2024-01-05", end="2024-01-11")), "D AS (SELECT * FROM J WHERE Time >= TIMESTAMP '2024-01-05' AND Time < TIMESTAMP '2024-01-12')")
on_events("a14_daily_trend", "SELECT CAST(Time AS DATE) AS day, CAST(sum(FAI312_result) AS BIGINT) AS FAI312_ng, CAST(sum(FAI001_result) AS BIGINT) AS FAI001_ng FROM J WHERE Time IS NOT NULL GROUP BY 1", lambda j: defects.daily_trend(j, ["FAI312", "FAI001"]))
_RANKED = "SELECT * EXCLUDE (rank), CAST(rank AS INTEGER) AS rank, round(ng_count * 100.0 / total, 2) AS ng_rate_pct FROM (SELECT *, row_number() OVER (PARTITION BY production_day ORDER BY ng_count DESC, fai_name) AS rank FROM ({})) WHERE rank <= {}"
on_events("a15_daily_top", _RANKED.format(unpivot("T", DAY, True), 2), lambda j: defects.daily_top(j, 2), "T AS (SELECT * FROM J WHERE Time IS NOT NULL)")
on_events("a16_daily_top_regression", _RANKED.format(unpivot("L", FIRST_DAY, True), 2), lambda j: defects.daily_top_regression(j, EVENT_TIE, 2), LATEST_SQL)
on_events("a17_top_regression", f"SELECT fai_name, CAST(sum(ng_count) AS BIGINT) AS ng_count, CAST(sum(total) AS BIGINT) AS total, round(sum(ng_count) * 100.0 / sum(total), 2) AS ng_rate_pct FROM ({_RANKED.format(unpivot('L', FIRST_DAY, True), 2)}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2", lambda j: defects.top_regression(j, EVENT_TIE, 2), LATEST_SQL)
on_events("a18_detail", "SELECT FAI312 AS measured, FAI312_result AS result, SN, Time, Line FROM J WHERE FAI312_result = 1 ORDER BY Time DESC NULLS LAST, event_id DESC LIMIT 100", lambda j: defects.detail(j, "FAI312", EVENT_TIE))
on_events("a19_date_range", f"SELECT coalesce(CAST(min({DAY}) AS VARCHAR), '') AS first_day, coalesce(CAST(max({DAY}) AS VARCHAR), '') AS last_day FROM J", defects.date_range)
on_events("a28_others", f"SELECT CAST(CASE WHEN r > 2 THEN 3 ELSE r END AS INTEGER) AS rank, CASE WHEN r > 2 THEN '其他' ELSE fai_name END AS fai_name, CAST(sum(ng_count) AS BIGINT) AS ng_count FROM (SELECT *, row_number() OVER (ORDER BY ng_count DESC, fai_name) AS r FROM ({unpivot('J', '', False)})) GROUP BY 1, 2", lambda j: defects.with_others(defects.top(j), 2))

# --- repair
on_events("a21_rectification", f"SELECT *, {RATES} FROM (SELECT {RECT} FROM L)", lambda j: rectification.stats(j, EVENT_TIE), LATEST_SQL)
on_events("a22_daily_rectification", f"SELECT *, {RATES} FROM (SELECT {FIRST_DAY} AS production_day, {RECT} FROM L GROUP BY 1)", lambda j: rectification.daily(j, EVENT_TIE), LATEST_SQL)
on_events("a30_daily_report", f"SELECT production_day, total, ok_count, ng_count, round(ok_count * 100.0 / total, 2) AS yield_pct, rectifiable, ok_count + saved_count AS expected_ok, post_yield AS expected_yield FROM (SELECT *, {RATES} FROM (SELECT {FIRST_DAY} AS production_day, {RECT} FROM L GROUP BY 1))", lambda j: report.daily_tables(j, EVENT_TIE, True)[0], LATEST_SQL)
on_events("k6_trend_rows", f"SELECT Line AS line, 'normal' AS mode, {DAY} AS production_day, {_BY_LINE} FROM J WHERE Time IS NOT NULL GROUP BY 1, 2, 3 UNION ALL SELECT Line, 'regression', {FIRST_DAY}, {_BY_LINE} FROM L GROUP BY 1, 2, 3", lambda j: report.trend_rows(j, EVENT_TIE), LATEST_SQL)


# --- import and cleaning
def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as import cells: times in eight forms, numbers with faults."""
    k = F.col("event_id") % 9
    form = lambda pattern: F.date_format("ts", pattern)
    serial = (F.unix_seconds(F.col("ts").cast("timestamp")) + 25569 * 86400) / F.lit(86400.0)
    cell = (
        F.when(k == 0, form("yyyy-MM-dd HH:mm:ss")).when(k == 1, form("yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, form("yyyy-MM-dd HH:mm")).when(k == 3, form("yyyy/MM/dd HH:mm:ss")).when(k == 4, form("yyyy/M/d"))
        .when(k == 5, form("MM/dd/yyyy HH:mm:ss")).when(k == 6, F.lit(" N/A ")).when(k == 7, serial.cast("string")).otherwise(F.lit("not a date"))
    )
    n = F.col("event_id") % 5
    number = F.when(n == 0, F.lit("#REF!")).when(n == 1, F.lit("x1")).otherwise(F.concat(F.lit(" "), F.round("value", 2).cast("string")))
    return views.table(spark, sf_dir, "events").select("event_id", cell.alias("cell"), number.alias("number"))


@query("c1_c2_import_cells", """SELECT event_id, CASE event_id % 9 WHEN 2 THEN date_trunc('minute', ts) WHEN 4 THEN date_trunc('day', ts) WHEN 6 THEN NULL WHEN 8 THEN NULL ELSE date_trunc('second', ts) END AS time,
 CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE round(value, 2) END AS number FROM events""")
def import_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("event_id", C.safe_timestamp(F.col("cell")).alias("time"), C.safe_float(F.col("number")).alias("number"))


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with missing metadata of each kind."""
    e = views.raw_events(spark, sf_dir).select("event_id", "SN", "Time", "Line", "Project", "Vendor", "FAI312")
    hole = lambda c, k: F.when(F.col("event_id") % k == 0, None).when(F.col("event_id") % k == 1, " ").when(F.col("event_id") % k == 2, "None").when(F.col("event_id") % k == 3, "none").otherwise(F.col(c)).alias(c)
    return e.select("event_id", F.when(F.col("event_id") % 41 != 0, F.col("SN")).alias("SN"), F.when(F.col("event_id") % 82 != 0, F.col("Time")).alias("Time"), hole("Line", 31), hole("Project", 37), hole("Vendor", 43), "FAI312")


def _hole(c: str, k: int) -> str:
    return f"CASE event_id % {k} WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'None' WHEN 3 THEN 'none' ELSE {c} END AS {c}"


_DIRTY_SQL = f"X AS (SELECT event_id, CASE WHEN event_id % 41 <> 0 THEN SN END AS SN, CASE WHEN event_id % 82 <> 0 THEN Time END AS Time, {_hole('Line', 31)}, {_hole('Project', 37)}, {_hole('Vendor', 43)}, FAI312 FROM raw)"
_LOST = lambda c: f"({c} IS NULL OR trim({c}) IN ('', 'None'))"
_ANY = " OR ".join(map(_LOST, ("Vendor", "Project", "Line")))
_COUNTS = f"count(*) FILTER ({_ANY}) AS invalid, count(*) FILTER ({_LOST('Vendor')}) AS vendor_missing, count(*) FILTER ({_LOST('Project')}) AS project_missing, count(*) FILTER ({_LOST('Line')}) AS line_missing"


def on_dirty(name: str, body: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, events_sql(body, _DIRTY_SQL))(lambda spark, sf: f(_dirty(spark, sf)))


on_dirty("c6_c9_clean", f"SELECT event_id, SN, Time, Line, Project, Vendor, FAI312 FROM X WHERE NOT ({_ANY})", cleaning.clean)
on_dirty("c8_inspect", f"SELECT count(*) AS total, {_COUNTS.replace('AS invalid,', 'AS invalid_total,')} FROM X", cleaning.inspect)
on_dirty("c10_inspect_batches", f"SELECT event_id % 4 AS batch, count(*) AS total, {_COUNTS.replace('AS invalid,', 'AS invalid_total,')} FROM X GROUP BY 1", lambda x: cleaning.inspect(x.withColumn("batch", F.col("event_id") % 4), "batch"))
on_dirty("c11_null_rows", "SELECT event_id, SN, Time FROM X WHERE SN IS NOT NULL OR Time IS NOT NULL", lambda x: cleaning.drop_null_rows(x).select("event_id", "SN", "Time"))
on_dirty("c12_repeats", "SELECT event_id, SN, D FROM (SELECT *, CAST(Time AS DATE) AS D, row_number() OVER (PARTITION BY SN, CAST(Time AS DATE) ORDER BY event_id) AS n FROM X) WHERE n = 1", lambda x: cleaning.drop_repeats(x.withColumn("Time", F.col("Time").cast("date")), ["event_id"]).select("event_id", "SN", F.col("Time").alias("D")))
on_dirty("c13_completeness", f"SELECT count(*) AS scanned, {_COUNTS.replace('AS invalid,', 'AS total_invalid,')}, min(CASE WHEN NOT {_LOST('Line')} THEN Line END) AS some_line, count(*) FILTER ({_LOST('Vendor')}) < count(*) AS vendor_ok, count(*) FILTER ({_LOST('Project')}) < count(*) AS project_ok, count(*) FILTER ({_LOST('Line')}) < count(*) AS line_ok FROM X", cleaning.completeness)
on_dirty("c14_fill", "SELECT event_id, Line, Project, 'V9' AS Vendor FROM X", lambda x: cleaning.fill(x.withColumn("Vendor", F.lit(None).cast("string")), {"Vendor": "V9", "Line": "L9"}).select("event_id", "Line", "Project", "Vendor"))
on_dirty("c15_migrate", "SELECT event_id, SN, Time, coalesce(Project, '967E1') AS Project, coalesce(Vendor, 'LY') AS Vendor, Line, FAI312 FROM X", lambda x: cleaning.migrate(x.withColumnsRenamed({"Project": "Yield1", "Vendor": "Vendor Code", "Line": "CFG"})).select("event_id", "SN", "Time", "Project", "Vendor", "Line", "FAI312"))
on_dirty("c16_import", f"SELECT event_id::DOUBLE AS event_id, SN, Line, Project, Vendor, FAI312 FROM (SELECT *, row_number() OVER (PARTITION BY SN, Time ORDER BY event_id) AS n FROM X WHERE (SN IS NOT NULL OR Time IS NOT NULL) AND NOT ({_ANY})) WHERE n = 1", lambda x: cleaning.import_rows(x.withColumnsRenamed({"SN": "序列号", "Time": "测试时间", "Line": "CFG", "Vendor": "供应商"}), order=["event_id"]).select("event_id", "SN", "Line", "Project", "Vendor", "FAI312"))
query("f12_clean_defect_rows", "SELECT fai_name, ng_count, total, ng_rate_pct FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '' ELSE event_type END AS fai_name, event_id AS ng_count, event_id + 1 AS total, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS ng_rate_pct FROM events) WHERE fai_name <> '' AND ng_rate_pct IS NOT NULL")(
    lambda s, d: filters.clean_defect_rows(views.table(s, d, "events").select(F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 7 == 1, "").otherwise(F.col("event_type")).alias("fai_name"), F.col("event_id").alias("ng_count"), (F.col("event_id") + 1).alias("total"), F.when(F.col("event_id") % 5 == 0, "bad").otherwise(F.col("value").cast("string")).alias("ng_rate_pct")))
)


# --- sources
def _batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    e = views.raw_events(spark, sf_dir)
    first = e.filter("event_id % 2 = 0").select("event_id", "SN", "FAI312", F.lit("b0").alias("batch_id"))
    return [first, e.filter("event_id % 2 = 1").select("event_id", "SN", F.col("FAI313").cast("string").alias("FAI312"), "FAI001", F.lit("b1").alias("batch_id"))]


query("s1_union_by_name", events_sql("SELECT event_id, SN, try_cast(CASE WHEN event_id % 2 = 0 THEN FAI312 ELSE FAI313 END AS DOUBLE) AS FAI312, CASE WHEN event_id % 2 = 1 THEN FAI001 END AS FAI001 FROM raw"))(
    lambda s, d: tables.union_by_name(_batches(s, d)).select("event_id", "SN", F.col("FAI312").try_cast("double").alias("FAI312"), "FAI001")
)
query("s17_unjudged", "SELECT DISTINCT event_type AS batch_id FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_id < 2)")(
    lambda s, d: tables.unjudged(views.table(s, d, "events").withColumnRenamed("event_type", "batch_id"), views.table(s, d, "events").filter("event_id < 2").withColumnRenamed("event_type", "batch_id"))
)
# Above, the batches of the first two events stand for those that are judged.
query("s5_s6_row_count", "SELECT count(*) AS n, CAST(greatest(1, ceil(count(*) / 25000.0)) AS BIGINT) AS chunks FROM lineitem")(
    lambda s, d: views.table(s, d, "lineitem").agg(F.count(F.lit(1)).alias("n")).select("n", F.greatest(F.lit(1), F.ceil(F.col("n") / 25000)).cast("bigint").alias("chunks"))
)


def _csv_files(spark: SparkSession, sf_dir: str) -> str:
    """Events as a folder of CSV files; a fiftieth have line ends, quotes and commas within a field."""
    path = files.new_path(spark, "csv")
    sn = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit('two\nlines, "'), F.col("event_id").cast("string"), F.lit('"\n'))).otherwise(F.concat(F.lit("s"), F.col("event_id").cast("string")))
    cells = views.table(spark, sf_dir, "events").select(sn.alias("SN"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Time"), F.col("event_type").alias("CFG"), F.col("value").alias("FAI312"))
    cells.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


query("s11_csv", """SELECT CASE WHEN event_id % 50 = 0 THEN 'two' || chr(10) || 'lines, "' || CAST(event_id AS VARCHAR) || '"' || chr(10) ELSE 's' || CAST(event_id AS VARCHAR) END AS SN,
 date_trunc('second', ts) AS Time, event_type AS Line, value AS FAI312 FROM events""")(lambda s, d: tables.read_csv(s, _csv_files(s, d)))


# --- batches in a folder of their own, from import to judge
def _store(spark: SparkSession, limits: dict) -> spec_store.SpecStore:
    store = spec_store.SpecStore(spark, files.new_path(spark, "specs"))
    version = store.create("limits")
    store.save_limits(version, [(name, low, high, None) for name, (low, high) in limits.items()])
    store.activate(version)
    return store


def _upload_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.new_path(spark, "batches")
    cells = _dirty(spark, sf_dir).withColumns({"CFG": F.col("Line"), "event_id": F.col("event_id")}).drop("Line")
    batches.upload(spark, cells, folder, _store(spark, {"FAI312": (5.0, 450.0)}), batch="all", order=["event_id"])
    return tables.read_batch(spark, folder, "all", "judged").select("event_id", "SN", "Line", "FAI312", "FAI312_result", "overall_result")


query("c16_upload_judge", events_sql(f"SELECT event_id::DOUBLE AS event_id, SN, Line, FAI312, v AS FAI312_result, v AS overall_result FROM (SELECT *, CAST(CASE WHEN FAI312 IS NULL OR isnan(FAI312) OR FAI312 BETWEEN 5 AND 450 THEN 0 ELSE 1 END AS TINYINT) AS v, row_number() OVER (PARTITION BY SN, Time ORDER BY event_id) AS n FROM X WHERE (SN IS NOT NULL OR Time IS NOT NULL) AND NOT ({_ANY})) WHERE n = 1", _DIRTY_SQL))(_upload_judge)


def _judge_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four raw batches, the first of which has been judged by an older version; the others are judged by ranges of their files."""
    folder, raw = files.new_path(spark, "batches"), views.raw_events(spark, sf_dir).select("event_id", "SN", "Time", "FAI312", "FAI313")
    for k in range(4):
        tables.write_raw(raw.filter(F.col("event_id") % 4 == k), folder, f"b{k}")
    batches.judge_one(spark, folder, "b0", {"FAI312": (None, 100.0)}, "old")
    batches.judge_new(spark, folder, {"FAI312": (5.0, 450.0), "FAI313": (3.0, 95.0)}, "v1")
    judged = tables.judged_of(spark, folder).groupBy(F.concat(F.lit("b"), (F.col("event_id") % 4).cast("string")).alias("batch_id"), "spec_version")
    ng = lambda c: F.sum(F.col(c).cast("bigint")).alias(c)
    return judged.agg(F.count(F.lit(1)).alias("total"), ng("overall_result"), ng("FAI312_result"), ng("FAI313_result"))


query("j12_judge_new", events_sql("""SELECT 'b' || CAST(event_id % 4 AS VARCHAR) AS batch_id, CASE WHEN event_id % 4 = 0 THEN 'old' ELSE 'v1' END AS spec_version, count(*) AS total,
 CAST(sum(CASE WHEN event_id % 4 = 0 THEN CAST(coalesce(FAI312 > 100, false) AS INTEGER) ELSE greatest(FAI312_result, FAI313_result) END) AS BIGINT) AS overall_result,
 CAST(sum(CASE WHEN event_id % 4 = 0 THEN CAST(coalesce(FAI312 > 100, false) AS INTEGER) ELSE FAI312_result END) AS BIGINT) AS FAI312_result, CAST(sum(CASE WHEN event_id % 4 <> 0 THEN FAI313_result END) AS BIGINT) AS FAI313_result FROM J GROUP BY 1, 2"""))(_judge_new)


def _kept_units(spark: SparkSession, sf_dir: str) -> KeptUnits:
    """Events in three batches that come out of order."""
    units, judged = KeptUnits(spark, files.new_path(spark, "kept"), EVENT_TIE), views.events(spark, sf_dir)
    for k in (2, 0, 1):
        units.update(f"b{k}", judged.filter(F.col("event_id") % 3 == k))
    return units


query("st_late_units", events_sql("SELECT SN, Line, first_prod_time AS Time, Project, Vendor, overall_result FROM L", LATEST_SQL.replace(" WHERE Time IS NOT NULL", "").replace("Time DESC,", "Time DESC NULLS LAST,")))(lambda s, d: _kept_units(s, d).unit_rows())


def _signed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of three micro-batches that all days are spread over."""
    source, out = files.new_path(spark, "stream"), files.new_path(spark, "days")
    own = views.events(spark, sf_dir).select("SN", "Time", "event_id", "overall_result")
    for k in (2, 0, 1):
        own.filter(F.col("event_id") % 3 == k).write.parquet(f"{source}/p{k}")
    third = -(-len(spark.read.schema(own.schema).parquet(f"{source}/p*").inputFiles()) // 3)
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", third).parquet(f"{source}/p*")
    incremental.keep_daily(stream, out, f"{out}/checkpoint", EVENT_TIE).awaitTermination()
    return incremental.kept_daily(spark, out)


on_events("st_daily_signed", f"SELECT {FIRST_DAY} AS production_day, {YIELD} FROM L GROUP BY 1", lambda j: j, LATEST_SQL)
_QUERIES["st_daily_signed"] = _signed_days


# --- specifications, from suppliers and parts
def _store_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version for each region with a limit for each of its nations, saved twice; the last but one by name is the active one."""
    store = spec_store.SpecStore(spark, files.new_path(spark, "specs"))
    regions = {r["r_name"]: r["r_regionkey"] for r in views.table(spark, sf_dir, "region").orderBy("r_name").collect()}  # five rows
    nations = views.table(spark, sf_dir, "nation").collect()  # 25 rows
    made = {name: store.create(name) for name in regions}
    for name, key in regions.items():
        own = [(n["n_name"], float(n["n_nationkey"]), float(n["n_nationkey"] + 10), None) for n in nations if n["n_regionkey"] == key]
        store.save_limits(made[name], own[:1])
        store.save_limits(made[name], own)
    for name in sorted(regions)[-2:][::-1]:
        store.activate(made[name])
    again = spec_store.SpecStore(spark, store.folder)
    sums = again.limits.groupBy("version_id").agg(F.sum("lower_limit").alias("lower"), F.sum("upper_limit").alias("upper"))
    return spec_store.versions_with_counts(again.versions, again.limits).join(sums, "version_id", "left").select("source_file", "is_active", "fai_count", "lower", "upper")


query("p1_p4_store", """SELECT r_name AS source_file, r_name = (SELECT r_name FROM region ORDER BY r_name DESC LIMIT 1 OFFSET 1) AS is_active, count(n_name) AS fai_count,
 sum(n_nationkey::DOUBLE) AS lower, sum(n_nationkey::DOUBLE + 10) AS upper FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")(_store_of_regions)
def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = views.table(spark, sf_dir, "nation")
    v = nation.select(F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("version_id"), F.col("n_name").alias("source_file"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("n_nationkey").cast("int"), hours=F.col("n_regionkey").cast("int"))).alias("imported_at"), (F.col("n_nationkey") % 4 == 1).alias("is_active"), F.lit("").alias("description"))
    # Every fifth nation stands for a version without limits, which p5_versions must count as none.
    supplier = views.table(spark, sf_dir, "supplier").filter("s_nationkey % 5 <> 0")
    lim = supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("v"), F.col("s_nationkey").cast("string")).alias("version_id"), F.concat(F.lit("FAI"), F.col("s_suppkey").cast("string")).alias("fai_name"), F.lit(-1.0).alias("lower_limit"), F.col("s_acctbal").cast("double").alias("upper_limit"), F.lit(0.0).alias("nominal"))
    return v, lim


_SPEC_SQL = """V AS (SELECT 'v' || CAST(n_nationkey AS VARCHAR) AS version_id, n_name AS source_file, TIMESTAMP '2024-01-01' + to_days(CAST(n_nationkey AS INTEGER)) + to_hours(n_regionkey) AS imported_at, n_nationkey % 4 = 1 AS is_active, '' AS description FROM nation),
LIM AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, 'v' || CAST(s_nationkey AS VARCHAR) AS version_id, 'FAI' || CAST(s_suppkey AS VARCHAR) AS fai_name, CAST(-1 AS DOUBLE) AS lower_limit, CAST(s_acctbal AS DOUBLE) AS upper_limit, CAST(0 AS DOUBLE) AS nominal FROM supplier WHERE s_nationkey % 5 <> 0)"""
query("p5_versions", f"WITH {_SPEC_SQL} SELECT V.*, count(LIM.id) AS fai_count FROM V LEFT JOIN LIM USING (version_id) GROUP BY ALL")(lambda s, d: spec_store.versions_with_counts(*_versions(s, d)))
query("p3_active", f"WITH {_SPEC_SQL} SELECT LIM.version_id, fai_name, lower_limit, upper_limit, nominal FROM LIM JOIN (SELECT version_id FROM V WHERE is_active ORDER BY imported_at DESC, version_id LIMIT 1) USING (version_id)")(lambda s, d: spec_store.active(*_versions(s, d)))
query("p6_versions_at_times", f"WITH {_SPEC_SQL} SELECT event_id, ts, version_id FROM events ASOF LEFT JOIN V ON ts >= imported_at")(lambda s, d: spec_store.at_times(_versions(s, d)[0], views.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts")), "ts"))
query("p6_version_at_time", f"WITH {_SPEC_SQL} SELECT * FROM V WHERE imported_at <= TIMESTAMP '2024-01-09 12:00:00' ORDER BY imported_at DESC LIMIT 1")(lambda s, d: spec_store.at_time(_versions(s, d)[0], "2024-01-09 12:00:00"))


@query("p7_validate", """WITH R AS (SELECT l_orderkey * 10 + l_linenumber AS row, CASE WHEN l_partkey % 50 = 0 THEN ' ' ELSE 'F' || CAST(l_partkey AS VARCHAR) END AS fai_name, l_discount AS lower_limit, l_tax AS upper_limit, CASE WHEN l_linenumber = 1 THEN NULL ELSE 0.05 END AS nominal FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax)),
A AS (SELECT *, row_number() OVER (PARTITION BY trim(fai_name) ORDER BY row) > 1 AS again FROM R)
SELECT row, 'empty name' AS error FROM A WHERE trim(fai_name) = '' UNION ALL SELECT row, 'duplicate name' FROM A WHERE trim(fai_name) <> '' AND again
UNION ALL SELECT row, 'lower above upper' FROM A WHERE lower_limit > upper_limit UNION ALL SELECT row, 'nominal outside limits' FROM A WHERE nominal < lower_limit OR nominal > upper_limit""")
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_discount", "l_tax")).alias("m"))
    part = F.col("m.l_partkey")
    rows = first.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.when(part % 50 == 0, " ").otherwise(F.concat(F.lit("F"), part.cast("string"))).alias("fai_name"), F.col("m.l_discount").alias("lower_limit"), F.col("m.l_tax").alias("upper_limit"), F.when(F.col("l_linenumber") != 1, F.lit(0.05)).alias("nominal"))
    return spec_store.validate(rows)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
