"""Named Parquet tables of a folder, each replaced as a whole or not at all.

Data are written to folders that nobody changes afterwards. Which folders make up which table is said by manifests, small files
numbered from 1; the newest holds. A change writes its data first and then the next manifest, which appears whole or not at all and
only if there is none of its number: of two writers the second reads again, and goes on if its own table is as it was. A writer that
dies leaves data that no manifest names; sweep() removes them. Readers look at a manifest once and then at folders that stay.

A table folder that no manifest has ever named counts as a table of its name, if it is a file or its writer has ended.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from yieldloom.sources import files


class Conflict(RuntimeError):
    """Another process has changed the table in the meantime."""


class TableSet:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _manifests(self) -> list[str]:
        return files.names(self.spark, f"{self.folder}/_tables", "*.json")

    def state(self) -> tuple[int, dict[str, dict]]:
        """(number of the newest manifest, its tables by name)."""
        newest = max(self._manifests(), default=None)
        if newest is None:
            return 0, {}
        return int(newest.removesuffix(".json")), json.loads(files.whole(self.spark, f"{self.folder}/_tables/{newest}"))

    def _found(self, pattern: str) -> list[str]:
        """Tables that stand there without a manifest."""
        ended = lambda n: n.endswith(".parquet") or files.exists(self.spark, f"{self.folder}/{n}/_SUCCESS")
        return [n for n in files.names(self.spark, self.folder, pattern) if ended(n)]

    def names(self, prefix: str = "") -> list[str]:
        """Tables whose names begin so, in order."""
        known = self.state()[1]
        own = [n for n, entry in known.items() if n.startswith(prefix) and entry["paths"]]
        return sorted({*own, *(n for n in self._found(f"{prefix}*") if prefix and n not in known)})

    def paths(self, name: str) -> list[str]:
        """Where a table's data are; nothing if there is no such table."""
        entry = self.state()[1].get(name)
        if entry is not None:
            return [p if ":/" in p or p.startswith("/") else f"{self.folder}/{p}" for p in entry["paths"]]
        return [f"{self.folder}/{name}"] if self._found(name) else []

    def entry(self, name: str) -> dict | None:
        return self.state()[1].get(name)

    def read(self, name: str) -> DataFrame:
        paths = self.paths(name)
        if not paths:
            raise FileNotFoundError(f"no table {name} in {self.folder}")
        return self.spark.read.parquet(*paths)

    def new_folder(self, name: str) -> str:
        """A folder that nothing is in, relative to the set's."""
        return name if not files.exists(self.spark, f"{self.folder}/{name}") else f"versions/{name}-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame, new: bool = False, **more) -> str:
        """A table's rows from now on; its path. new: that there is one already is an error. more: kept beside it in the manifest."""
        before = self.entry(name)
        if new and self.paths(name):
            raise FileExistsError(f"table {name} already exists in {self.folder}")
        path = self.new_folder(name)
        df.write.option("compression", "snappy").parquet(f"{self.folder}/{path}")
        self.commit({name: {"paths": [path], **more}}, {name: before})
        return f"{self.folder}/{path}"

    def commit(self, tables: dict[str, dict], before: dict[str, dict | None]) -> int:
        """Make these the tables of their names, all or none; the manifest's number. before: what they replace; another entry by now is a
        Conflict. Changes of other tables do no harm."""
        return self.change(lambda now: now | tables, before)

    def drop(self, name: str) -> int:
        return self.commit({name: {"paths": []}}, {name: self.entry(name)})

    def change(self, make: Callable[[dict], dict], before: dict[str, dict | None]) -> int:
        while True:
            turn, now = self.state()
            for name, entry in before.items():
                if now.get(name) != entry:
                    raise Conflict(f"{name} in {self.folder} was changed by another process")
            if files.publish(self.spark, f"{self.folder}/_tables/{turn + 1:012d}.json", json.dumps(make(now)).encode()):
                return turn + 1

    def sweep(self, keep: int = 2, age: float = 86_400) -> list[str]:
        """Remove manifests but the newest ones, and data folders that none of these names and that are older than so many seconds: what
        was replaced, and what writers left that died. Paths of what was removed."""
        every = sorted(self._manifests())
        kept = every[-keep:]
        named = {p for m in kept for entry in json.loads(files.whole(self.spark, f"{self.folder}/_tables/{m}")).values() for p in entry["paths"]}
        inside = {f"versions/{n}" for n in files.names(self.spark, f"{self.folder}/versions", "*")}
        ever = {n for m in kept for n in json.loads(files.whole(self.spark, f"{self.folder}/_tables/{m}"))}
        first = {n for n in files.names(self.spark, self.folder, "*") if n in ever or (n.startswith(("raw_", "judged_")) and n not in self._found(n))}
        gone = [p for p in sorted(inside | first) if not any(q == p or q.startswith(f"{p}/") for q in named) and time.time() - files.changed(self.spark, f"{self.folder}/{p}") >= age]
        for p in gone:
            files.remove(self.spark, f"{self.folder}/{p}")
        for m in every[:-keep]:
            files.remove(self.spark, f"{self.folder}/_tables/{m}")
        return gone
