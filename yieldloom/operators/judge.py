"""The judge: measured values against limits.

A value is NG if it is a number outside [lower, upper]; null and NaN are OK. A dimension without any limit is not judged.
Up to WIDE dimensions verdicts are plain columns; beyond, one Arrow batch at a time goes through numpy, as a plan of many
hundred conditions is slow to make and to run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.config import METADATA, OVERALL, RESULT, UNBOUNDED

WIDE = 40
_SWAPS = (("_Z", "_T"), ("_T", "_Z"), ("_z", "_t"), ("_t", "_z"))
Limits = dict[str, tuple[float | None, float | None]]


@dataclass(frozen=True)
class Match:
    """columns: data column by limit name."""

    columns: dict[str, str]
    unmatched: tuple[str, ...]


def match(names: list[str], limits: Limits) -> Match:
    """Exact names first; else the other of the paired suffixes. Metadata never match."""
    data, meta, found, lost = set(names), {m.lower() for m in METADATA}, {}, []
    for name in limits:
        own = name.strip()
        tries = [own, *(own.removesuffix(a) + b for a, b in _SWAPS if own.endswith(a))]
        hit = next((t for t in tries if t in data and t.lower() not in meta), None)
        if hit is None:
            lost.append(name)
        else:
            found[name] = hit
    return Match(found, tuple(lost))


def bounds(lower: float | None, upper: float | None) -> tuple[float, float]:
    """Missing and sentinel limits are infinite; an upper one of minus the sentinel is a real limit."""
    low = -math.inf if lower is None or math.isnan(lower) or abs(lower) == UNBOUNDED else float(lower)
    high = math.inf if upper is None or math.isnan(upper) or upper == UNBOUNDED else float(upper)
    return low, high


def judged_columns(df: DataFrame, limits: Limits) -> dict[str, tuple[float, float]]:
    """Bounds by data column, of those that have any; the first limit of a column holds."""
    out: dict[str, tuple[float, float]] = {}
    for name, column in match(df.columns, limits).columns.items():
        pair = bounds(*limits[name])
        if pair != (-math.inf, math.inf):
            out.setdefault(column, pair)
    return out


def judge(df: DataFrame, limits: Limits, spec_version: str = "", judged_at: str | None = None) -> DataFrame:
    """df with a verdict column for each judged dimension, overall_result, judged_at and spec_version."""
    if not limits:
        raise ValueError("the specification has no limits")
    columns = judged_columns(df, limits)
    if not match(df.columns, limits).columns:
        raise ValueError("no limit matches a column")
    at = judged_at or datetime.now(UTC).isoformat()
    out = _wide(df, columns) if len(columns) > WIDE else _narrow(df, columns)
    return out.withColumns({"judged_at": F.lit(at), "spec_version": F.lit(spec_version)})


def _narrow(df: DataFrame, columns: dict[str, tuple[float, float]]) -> DataFrame:
    verdicts = {}
    for name, (low, high) in columns.items():
        v = F.col(f"`{name}`")
        v = v.cast("double") if isinstance(df.schema[name].dataType, T.NumericType) else v.try_cast("double")
        verdicts[name + RESULT] = F.when(v.isNull() | F.isnan(v) | ((v >= low) & (v <= high)), 0).otherwise(1).cast("tinyint")
    out = df.withColumns(verdicts) if verdicts else df
    any_ng = [F.col(f"`{c}`") for c in verdicts]
    return out.withColumn(OVERALL, F.greatest(*any_ng) if len(any_ng) > 1 else any_ng[0] if any_ng else F.lit(0).cast("tinyint"))


def _wide(df: DataFrame, columns: dict[str, tuple[float, float]]) -> DataFrame:
    schema = T.StructType([*df.schema, *[T.StructField(c + RESULT, T.ByteType()) for c in columns], T.StructField(OVERALL, T.ByteType())])
    numeric = df.select("*", *[F.col(f"`{c}`").try_cast("double").alias(f"__{k}") for k, c in enumerate(columns) if not isinstance(df.schema[c].dataType, T.NumericType)])
    source = [c if isinstance(df.schema[c].dataType, T.NumericType) else f"__{k}" for k, c in enumerate(columns)]
    kept, limits = df.columns, list(columns.values())

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ng, verdicts = np.zeros(batch.num_rows, bool), []
            for name, (low, high) in zip(source, limits, strict=True):
                v = batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)
                bad = (v < low) | (v > high)  # never true of NaN, which nulls become
                ng |= bad
                verdicts.append(pa.array(bad.astype(np.int8)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *verdicts, pa.array(ng.astype(np.int8))], schema.fieldNames())

    return numeric.mapInArrow(run, schema)


def judge_batch(df: DataFrame, limits: Limits, path: str, spec_version: str = "", judged_at: str | None = None) -> dict:
    """Judge and write in one pass; counts come from the same pass."""
    found, at = match(df.columns, limits), judged_at or datetime.now(UTC).isoformat()
    seen = Observation("judged")
    out = judge(df, limits, spec_version, at).observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.col(OVERALL).cast("bigint")).alias("ng"))
    out.write.mode("overwrite").option("compression", "snappy").parquet(path)
    rows, ng = seen.get["rows"] or 0, seen.get["ng"] or 0
    judged = judged_columns(df, limits)
    return {
        "total_rows": rows, "ng_count": ng, "ok_count": rows - ng, "yield_rate": round((rows - ng) / rows, 4) if rows else 0.0, "spec_version": spec_version, "judged_at": at,
        "matched": len(found.columns), "judged": len(judged), "skipped": len(set(found.columns.values())) - len(judged), "unmatched": len(found.unmatched), "output_path": path,
    }
