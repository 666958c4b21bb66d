"""Command line: python -m yieldloom COMMAND ..."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="yieldloom", description="Batches of measurements: import, clean, judge, specifications.")
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str, help_: str, *arguments: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=help_)
        for a in arguments:
            c.add_argument(a)
        return c

    add("import-csv", "a CSV file as a new raw batch", "file", "folder").add_argument("--batch")
    c = add("upload", "a workbook as a new raw and judged batch", "file", "folder", "store")
    c.add_argument("--batch")
    add("batches", "raw batches of a folder", "folder")
    add("info", "rows and columns of a batch", "path")
    add("clean", "remove dirty rows of the tables that a pattern names", "pattern").add_argument("--dry-run", action="store_true")
    add("migrate", "rename old columns, after a copy", "path", "archive")
    add("judge", "judge batches that aren't judged yet", "folder", "store")
    add("rejudge", "judge a batch again", "folder", "store", "batch")
    add("status", "which batches are judged", "folder")
    c = add("load-spec", "a workbook's specification as a new version", "file", "store")
    c.add_argument("--description", default="")
    c.add_argument("--keep", action="store_true", help="leave the active version as it is")
    add("specs", "all versions", "store")
    add("activate", "make a version the active one", "store", "version")
    add("show-spec", "the active version, or one of its limits", "store").add_argument("--name")
    add("tasks", "long tasks and how far they are", "folder")
    add("summary", "totals of all judged batches", "folder")
    add("report", "totals, lines, last days, units and the worst dimensions", "folder")
    add("top-defects", "the dimensions with most NG", "folder").add_argument("--top", type=int, default=20)
    c = add("fai-detail", "the newest NG rows of a dimension", "folder", "name")
    c.add_argument("--top", type=int, default=50)
    c = add("export", "daily report workbooks into a folder", "folder", "output")
    c.add_argument("--top", type=int, default=10)
    c.add_argument("--mode", choices=["pre", "post", "both"], default="both")
    for c in commands.choices.values():
        c.add_argument("--tie", action="append", default=[], help="a column that decides between equal times of a unit")
    return out


def run(spark: SparkSession, a: argparse.Namespace):
    """What the command returns, as lists and dicts."""
    from yieldloom.functions.columns import displayed
    from yieldloom.operators import batches, cleaning
    from yieldloom.operators.progress import Tasks
    from yieldloom.operators.spec_store import SpecStore, versions_with_counts
    from yieldloom.plans import facade, report
    from yieldloom.sources import tables

    store = SpecStore(spark, a.store) if "store" in a else None
    match a.command:
        case "import-csv":
            return tables.csv_to_parquet(spark, a.file, a.folder, a.batch)
        case "upload":
            return batches.upload_workbook(spark, Path(a.file).read_bytes(), a.folder, store, batch=a.batch)
        case "batches":
            return [{"batch": b, **{k: v for k, v in tables.batch_info(spark, p).items() if k in ("path", "rows", "bytes", "changed")}} for b, p in tables.list_batches(spark, a.folder)]
        case "info":
            return tables.batch_info(spark, a.path)
        case "clean":
            results = cleaning.clean_tables(spark, a.pattern, a.dry_run)
            return {"tables": results, "all": cleaning.totals(results)}
        case "migrate":
            return cleaning.migrate_table(spark, a.path, a.archive)
        case "judge":
            return batches.judge_new(spark, a.folder, store.active_limits(), store.active_version() or "")
        case "rejudge":
            return batches.judge_one(spark, a.folder, a.batch, store.active_limits(), store.active_version() or "")
        case "status":
            return batches.status(spark, a.folder)
        case "load-spec":
            return store.load(Path(a.file).read_bytes(), a.file, a.description, use=not a.keep)
        case "specs":
            return [r.asDict() for r in versions_with_counts(store.versions, store.limits).collect()]
        case "activate":
            return store.activate(a.version)
        case "show-spec":
            return store.show(a.name)
        case "tasks":
            return Tasks(spark, a.folder).list()
    q = facade.DashboardQueries(facade.folder_source(spark, a.folder), a.tie)
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  each a few rows
    match a.command:
        case "summary":
            return rows(q.get_summary())[0]
        case "report":
            return {name: rows(df) for name, df in q.report().items()}
        case "top-defects":
            return [{"rank": k, **r} for k, r in enumerate(rows(displayed(q.get_top_defects(a.top))), 1)]
        case "fai-detail":
            return rows(displayed(q.get_fai_defect_detail(a.name, a.top), 20))
        case "export":
            modes = {"pre": [False], "post": [True], "both": [False, True]}[a.mode]
            Path(a.output).mkdir(parents=True, exist_ok=True)
            return [report.export_report(q.judged, a.tie, a.output, regression, a.top) for regression in modes]


if __name__ == "__main__":
    arguments = parser().parse_args()
    print(json.dumps(run(SparkSession.builder.appName("yieldloom").getOrCreate(), arguments), default=str, ensure_ascii=False, indent=1))
