"""Column expressions: times, numbers, missing values, yields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.config import CUTOFF_HOUR, OVERALL, REPAIRABLE, RESULT

# The forms of a time, tried in this order.
TIME_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")
NO_TIME = ("", "none", "null", "nan", "n/a", "-")


def parse_time(c: Column, kind: T.DataType | None = None) -> Column:
    """A stored time as TIMESTAMP_NTZ; text may have slashes, what isn't a time is null."""
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return c.cast("timestamp_ntz")
    text = c.cast("string")
    return F.coalesce(text.try_cast("timestamp_ntz"), F.translate(text, "/", "-").try_cast("timestamp_ntz"))


def time_of(df: DataFrame, name: str = "Time") -> Column:
    return parse_time(F.col(name), df.schema[name].dataType)


def safe_timestamp(c: Column) -> Column:
    """Text of an import cell as a wall-clock time: the forms in order, else a spreadsheet's day number without its fraction of a second."""
    text = F.trim(c.cast("string"))
    forms = [F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(_lenient(f)))).cast("timestamp_ntz") for f in TIME_FORMS]
    serial = text.try_cast("double")
    seconds = F.floor(serial * 86400 + 1e-6).cast("bigint")
    by_serial = F.when(~F.isnan(serial) & (F.abs(serial) < 2_900_000), F.lit("1899-12-30 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))
    return F.when(F.lower(text).isin(*NO_TIME), None).otherwise(F.coalesce(*forms, by_serial))


def _lenient(form: str) -> str:
    """One-digit months, days and hours count too."""
    return re.sub(r"MM|dd|HH", lambda m: m[0][0], form).replace("mm", "m").replace("ss.", "s.").replace("ss", "s").replace(".SSSSSS", "[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]")


def _shape(form: str) -> str:
    parts = {"yyyy": r"\d{4}", "MM": r"\d{1,2}", "dd": r"\d{1,2}", "HH": r"\d{1,2}", "mm": r"\d{1,2}", "ss": r"\d{1,2}", ".SSSSSS": r"\.\d{1,6}", "'T'": "T"}
    return "^" + re.sub("yyyy|MM|dd|HH|mm|ss|\\.SSSSSS|'T'", lambda m: parts[m[0]], form) + "$"


def safe_float(c: Column) -> Column:
    """A number, or null for a formula error or what isn't one."""
    text = c.cast("string")
    return F.when(text.contains("#REF!"), None).otherwise(F.trim(text).try_cast("double"))


def safe_text(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.contains("#REF!"), None).otherwise(text)


def missing(c: Column) -> Column:
    """Null, blank or the word None, written so."""
    return c.isNull() | F.trim(c.cast("string")).isin("", "None")


def round2(c: Column, digits: int = 2) -> Column:
    """Half away from zero on the double itself, for values of at least 0."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5).cast("double") / scale


def percent(part: Column, whole: Column) -> Column:
    return round2(part * F.lit(100.0) / F.nullif(whole, F.lit(0)))


def yield_columns(with_ng: bool = True) -> list[Column]:
    """total, ok_count, ng_count and yield_pct; a null verdict counts in total alone."""
    total, ok, ng = F.count(F.lit(1)), F.sum(F.when(F.col(OVERALL) == 0, 1).otherwise(0)), F.sum(F.when(F.col(OVERALL) == 1, 1).otherwise(0))
    return [total.alias("total"), ok.alias("ok_count"), *([ng.alias("ng_count")] if with_ng else []), percent(ok, total).alias("yield_pct")]


def production_day(t: Column, cutoff: int = CUTOFF_HOUR) -> Column:
    return (t - F.make_dt_interval(hours=F.lit(cutoff))).cast("date")


def production_week(t: Column, cutoff: int = CUTOFF_HOUR) -> Column:
    """The Monday of the production day's week."""
    return F.date_trunc("week", production_day(t, cutoff)).cast("date")


def in_order(few: DataFrame, *by: str | Column) -> DataFrame:
    """Rows of days or other small groups, sorted in one task: their number doesn't grow with the input, and a global sort would
    run an extra job to sample its ranges."""
    return few.repartition(1).sortWithinPartitions(*by)


#: Characters that a display shows of days, times and names.
SHOWN = {"production_day": 10, "Time": 19, "first_time": 19, "last_time": 19, "fai_name": 35, "SN": 30}


def displayed(df: DataFrame, rows: int | None = None, widths: dict[str, int] | None = None) -> DataFrame:
    """The first rows of a result, for a display: its long columns as text cut to their widths. rows: nothing for all."""
    widths = SHOWN if widths is None else widths
    text = lambda c: F.substring(F.col(f"`{c}`").cast("string"), 1, widths[c]).alias(c)
    shown = df.select(*[text(c) if c in widths else F.col(f"`{c}`") for c in df.columns])
    return shown if rows is None else shown.limit(rows)


def base_name(result: str) -> str:
    return result.removesuffix(RESULT)


def result_columns(df: DataFrame) -> list[str]:
    """Numeric verdict columns of single dimensions, in the table's order."""
    return [f.name for f in df.schema if f.name.endswith(RESULT) and f.name != OVERALL and isinstance(f.dataType, T.NumericType)]


def repairable(name: str) -> bool:
    m = re.match(r"FAI\d+", name)
    return bool(m) and m[0] in REPAIRABLE
