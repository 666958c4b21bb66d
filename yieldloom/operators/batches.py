"""Batches in folders: upload, judging of those that aren't judged yet, and their state.

A batch is judged by ranges of its files, one Spark job each. What a finished range has written and counted is noted beside it, so a
run that breaks off goes on with the other ranges; the note also says what was judged, and of another raw table, other limits or
another split nothing is taken over. The judged table appears when all ranges are done, in the place of an earlier one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.config import OVERALL
from yieldloom.operators.cleaning import import_rows
from yieldloom.operators.judge import Limits, judge_batch
from yieldloom.operators.spec_store import SpecStore
from yieldloom.sources import files, tables
from yieldloom.sources.tableset import TableSet

#: Bytes of raw files that one job judges, one file at least.
SPLIT_BYTES = 256 << 30


def ranges_of(raw: list[tuple[str, int, int]], split: int) -> list[list[str]]:
    """Files in order, cut where the next one would take a range above so many bytes."""
    out: list[list[str]] = []
    size = 0
    for path, length, _ in raw:
        if not out or size + length > split:
            out.append([])
            size = 0
        out[-1].append(path)
        size += length
    return out


class _Progress:
    """Notes of a batch's finished ranges, in a folder that goes when the batch is done."""

    def __init__(self, spark: SparkSession, folder: str, batch: str, key: dict):
        self.spark, self.folder = spark, f"{folder}/versions/judging_{batch}"
        noted = f"{self.folder}/plan.json"
        self.plan = json.loads(files.whole(spark, noted)) if files.exists(spark, noted) else None
        if self.plan is None or self.plan["key"] != key:  # of something else, or of a run that died before it began
            if self.plan:
                files.remove(spark, f"{folder}/{self.plan['out']}")
            files.remove(spark, self.folder)
            self.plan = {"key": key, "out": f"versions/judged_{batch}-{hashlib.sha256(json.dumps([key, str(datetime.now(UTC))]).encode()).hexdigest()[:16]}", "judged_at": datetime.now(UTC).isoformat()}
            if not files.publish(spark, noted, json.dumps(self.plan).encode()):
                raise RuntimeError(f"batch {batch} is being judged by another process")

    def done(self) -> dict[int, dict]:
        return {int(n[6:-5]): json.loads(files.whole(self.spark, f"{self.folder}/{n}")) for n in files.names(self.spark, self.folder, "range-*.json")}

    def note(self, k: int, counts: dict) -> None:
        files.publish(self.spark, f"{self.folder}/range-{k:06d}.json", json.dumps(counts).encode())


def judge_one(spark: SparkSession, folder: str, batch: str, limits: Limits, spec_version: str = "", resume: bool = True, split: int = SPLIT_BYTES, progress: Callable[[int, int], None] | None = None) -> dict:
    """Judge a raw batch, again if it was judged before: its judged table is replaced when the new one is whole. resume: go on where a
    run of the same raw files, limits, version and split broke off. progress: called with the ranges done and all of them. A batch is judged by
    one process at a time."""
    folder = folder.rstrip("/")
    path = dict(tables.list_batches(spark, folder)).get(batch)
    if path is None:
        raise FileNotFoundError(f"no raw batch {batch} in {folder}")
    set_, name = TableSet(spark, folder), f"judged_{batch}"
    before = set_.entry(name)
    raw = files.listing(spark, path)
    key = {"raw": hashlib.sha256(json.dumps(raw).encode()).hexdigest(), "limits": hashlib.sha256(json.dumps(sorted(limits.items())).encode()).hexdigest(), "spec_version": spec_version, "split": split}
    if not resume:
        files.remove(spark, f"{folder}/versions/judging_{batch}")
    noted = _Progress(spark, folder, batch, key)
    ranges = ranges_of(raw, split) or [[path]]
    schema, done, out = spark.read.parquet(path).schema, noted.done(), {}
    found = len(done)
    for k, own in enumerate(ranges):
        if progress:
            progress(k, len(ranges))
        part = f"{folder}/{noted.plan['out']}/{k:06d}"
        if k not in done:
            files.remove(spark, part)  # what a run has left that died while it wrote the range
            out = judge_batch(spark.read.schema(schema).parquet(*own), limits, part, spec_version, noted.plan["judged_at"])
            done[k] = out
            noted.note(k, out)
    if progress:
        progress(len(ranges), len(ranges))
    rows, ng = sum(d["total_rows"] for d in done.values()), sum(d["ng_count"] for d in done.values())
    counts = {"total_rows": rows, "ng_count": ng, "ok_count": rows - ng, "yield_rate": round((rows - ng) / rows, 4) if rows else 0.0}
    paths = [f"{noted.plan['out']}/{k:06d}" for k in range(len(ranges))]
    set_.commit({name: {"paths": paths, "rows": rows, "ng_count": ng, "spec_version": spec_version}}, {name: before})
    files.remove(spark, noted.folder)
    return done[0] | counts | {"batch_id": batch, "output_path": f"{folder}/{paths[0]}", "output_paths": [f"{folder}/{p}" for p in paths], "ranges": len(ranges), "resumed": found}


def judge_new(spark: SparkSession, folder: str, limits: Limits, spec_version: str = "", **how) -> list[dict]:
    """Judge each raw batch that has no judged table, in order."""
    done = {b for b, _ in tables.list_batches(spark, folder, "judged")}
    return [judge_one(spark, folder, b, limits, spec_version, **how) for b, _ in tables.list_batches(spark, folder) if b not in done]


def status(spark: SparkSession, folder: str) -> list[dict]:
    """batch_id, raw rows, whether it is judged, its NG rows and the version it was judged by, of each raw batch. Tables whose counts no
    manifest has are counted by one job for all raw and one for all judged ones."""
    set_, out = TableSet(spark, folder), []
    raw, judged = dict(tables.list_batches(spark, folder)), dict(tables.list_batches(spark, folder, "judged"))
    known = {b: e for b in judged if (e := set_.entry(f"judged_{b}")) and "rows" in e}
    count = lambda own, *aggs: {r["b"]: r for r in spark.read.option("mergeSchema", len(own) > 1).parquet(*own.values()).groupBy(_folder_of(own).alias("b")).agg(*aggs).collect()} if own else {}  # noqa: E731  a row for each batch
    rows = count({b: p for b, p in raw.items() if b not in known}, F.count(F.lit(1)).alias("n"))
    seen = count({b: p for b, p in judged.items() if b not in known}, F.sum(F.col(OVERALL).cast("bigint")).alias("ng"), F.max("spec_version").alias("v"))
    for batch in raw:
        row = {"batch_id": batch, "rows": known[batch]["rows"] if batch in known else rows[batch]["n"] if batch in rows else 0, "judged": batch in judged, "ng_count": None, "spec_version": None}
        if batch in known:
            row |= {"ng_count": known[batch]["ng_count"], "spec_version": known[batch]["spec_version"]}
        elif row["judged"]:
            row |= {"ng_count": seen[batch]["ng"] or 0 if batch in seen else 0, "spec_version": seen[batch]["v"] if batch in seen else None}
        out.append(row)
    return out


def _folder_of(paths: dict[str, str]):
    """The batch that a row's file belongs to."""
    file = F.col("_metadata.file_path")
    out = F.lit(None).cast("string")
    for batch, path in paths.items():
        end = "/" + "/".join(path.rstrip("/").rsplit("/", 2)[-2:])
        out = F.when(file.contains(end + "/") | file.endswith(end), batch).otherwise(out)
    return out


def upload(spark: SparkSession, rows: DataFrame, folder: str, store: SpecStore, values: dict[str, str] | None = None, batch: str | None = None, order: list[str] | None = None) -> dict:
    """Cells of a sheet to a judged batch: names and types, fill of absent metadata, null rows, dirty rows, repeats (the first in the
    sheet stays, where rows have their place), the raw batch, and the judge by the store's active version."""
    batch, path = tables.write_raw(import_rows(rows, values, order), folder, batch)
    return judge_one(spark, folder, batch, store.active_limits(), store.active_version() or "") | {"raw_path": path}


def upload_workbook(spark: SparkSession, data: bytes, folder: str, store: SpecStore, values: dict[str, str] | None = None, batch: str | None = None, sheet: str | None = None) -> dict:
    return upload(spark, tables.import_workbook(spark, data, sheet, places=True), folder, store, values, batch)


def upload_csv(spark: SparkSession, path: str, folder: str, store: SpecStore, values: dict[str, str] | None = None, batch: str | None = None) -> dict:
    return upload(spark, tables.read_csv(spark, path, places=True), folder, store, values, batch)
