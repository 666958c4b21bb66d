"""Secret scans over a content-addressed ledger.

Every version of every text is addressed by the SHA-256 of its bytes. The ledger holds which rule versions each blob was
scanned with and what they found. A scan reads one text for each blob that lacks a rule version, applies only the rules
that it lacks, and appends to the ledger; findings are then joined to all paths (doc_ids) that have the blob.

Defined results: a null text is the empty one; rows that repeat a doc_id, or have none, each get their own row; texts
without a finding have empty spans; an empty table yields no row; further columns are ignored. Positions are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.llm.common import exists, materialize, release, scratch, slices, text_of


class Rule(NamedTuple):
    """A match counts if its group (0: all of it) has `least` characters or more."""

    kind: str
    version: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules.
BASE = [
    Rule("assign", "1", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", "1", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "1", r"[0-9a-f]+", 0, 16),
]
#: What the scan adds.
MORE = [
    Rule("private_key", "1", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", "1", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("forge_token", "1", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", "1", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("maps_key", "1", r"AIza[A-Za-z0-9_-]+", 0, 39),
]
RULES = [*BASE, *MORE]

LEDGER = "blob string, rules array<string>, findings array<struct<rule:string,kind:string,start:int,end:int>>"
_FOUND = pa.list_(pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _screen(rule: Rule) -> str:
    """An RE2 pattern that finds every text with a match that counts: one class repeated may be asked for at full length."""
    # Case-blind matching is for ASCII letters only; RE2 also folds two other letters, which a screen may.
    pattern = rule.pattern
    if rule.group == 0 and rule.least and (m := re.fullmatch(r"(\[[^\]]+\])\+", pattern)):
        pattern = f"{m[1]}{{{rule.least}}}"
    return ("(?i)" if rule.any_case else "") + pattern


def spans(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; those too short are dropped after they have taken their characters."""
    compiled = re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def pending(paths: DataFrame, ledger: DataFrame | None, rules: list[Rule]) -> DataFrame:
    """blob, doc_id (of one row that has it) and todo (rule versions that the ledger lacks for it)."""
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    every = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", every)
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").withColumn("todo", todo).filter(F.size("todo") > 0).drop("seen")


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger in a folder; nothing if there is none yet."""
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else None


def update(docs: DataFrame, path: str, rules: list[Rule] = RULES) -> DataFrame:
    """Scan what the ledger in a folder lacks, and append it there; the paths of docs."""
    spark = docs.sparkSession
    with scratch(spark):
        paths, new = scan(docs, read_ledger(spark, path), rules)
        paths = materialize(paths, "paths", outlive=True)
        new.write.mode("append").parquet(path)
    release(spark)
    return paths


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths: doc_id and blob of every row; new ledger rows). The ledger's next state is the old one and these."""
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    paths = materialize(rows.select("doc_id", "blob"), "paths")
    todo = pending(paths, ledger, rules).select(F.col("doc_id").alias("d"), F.col("blob").alias("b"), "todo")
    # Spread by doc_id, not by blob: a text with many copies is read at one of them.
    todo = todo.hint("shuffle_hash")
    due = rows.join(todo, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("blob") == F.col("b"))).select("blob", "todo", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, asked = part.column("text"), part.column("todo").to_pylist()
                found: list[list] = [[] for _ in asked]
                for rule in rules:
                    hits = pc.match_substring_regex(texts, _screen(rule))
                    for i in pc.indices_nonzero(hits).to_pylist():
                        if rule.name in asked[i]:
                            found[i] += [(rule.name, rule.kind, a, b) for a, b in spans(texts[i].as_py(), rule)]
                made = [[dict(zip(("rule", "kind", "start", "end"), x, strict=True)) for x in f] for f in found]
                yield pa.RecordBatch.from_arrays([part.column("blob"), part.column("todo"), pa.array(made, _FOUND)], ["blob", "rules", "findings"])

    return paths, materialize(due.mapInArrow(run, LEDGER).dropDuplicates(["blob"]), "ledger")


def findings(paths: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, blob and findings (kind, start, end; by start, then in the order of the rules) of every path."""
    order = F.array(*[F.lit(r.name) for r in rules])
    own = F.transform(F.filter(F.flatten(F.collect_list("findings")), lambda f: F.array_contains(order, f["rule"])), lambda f: F.struct(f["start"].alias("start"), F.array_position(order, f["rule"]).alias("place"), f["kind"].alias("kind"), f["end"].alias("end")))
    some = ledger.filter(F.size("findings") > 0)  # a row for each run that found something in the blob
    # Written first: the join then has plain exchanges on both sides, of which Spark splits those of much-copied blobs.
    by_blob = materialize(some.groupBy("blob").agg(F.array_sort(own).alias("findings")), "by-blob")
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("findings", F.array().cast("array<struct<start:int,place:bigint,kind:string,end:int>>")).alias("findings"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, spans and hash as columns of their own."""
    base = F.filter("findings", lambda f: f["kind"].isin(*[r.kind for r in BASE]))
    joined = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
