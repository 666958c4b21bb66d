"""Long tasks by name: how far they are and how long they may still take."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from yieldloom.sources import files


class Tasks:
    """One small file for each task in a folder that others may read at the same time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _put(self, row: dict) -> None:
        files.put(self.spark, f"{self.folder}/{row['task_id']}.json", json.dumps(row).encode(), over=True)

    def get(self, task: str) -> dict:
        return json.loads(files.whole(self.spark, f"{self.folder}/{task}.json"))

    def start(self, name: str, total: int = 100) -> str:
        now = time.time()
        task = f"{name}-{uuid.uuid4().hex[:8]}"
        self._put({"task_id": task, "name": name, "state": "running", "done": 0, "total": total, "percent": 0.0, "started": now, "updated": now, "left_s": None, "error": None})
        return task

    def update(self, task: str, done: float) -> dict:
        """The time left is what the rest takes at the rate so far."""
        row, now = self.get(task), time.time()
        share = min(1.0, done / row["total"]) if row["total"] else 1.0
        left = (now - row["started"]) / share * (1 - share) if share else None
        row |= {"done": done, "percent": round(100 * share, 1), "updated": now, "left_s": left}
        self._put(row)
        return row

    def complete(self, task: str) -> None:
        row = self.get(task)
        self._put(row | {"state": "completed", "done": row["total"], "percent": 100.0, "updated": time.time(), "left_s": 0.0})

    def fail(self, task: str, error: str) -> None:
        self._put(self.get(task) | {"state": "failed", "error": error, "updated": time.time(), "left_s": None})

    def list(self) -> list[dict]:
        """All tasks, those last changed first."""
        rows = [self.get(n.removesuffix(".json")) for n in files.names(self.spark, self.folder, "*.json")]
        return sorted(rows, key=lambda r: -r["updated"])


@contextmanager
def followed(tasks: Tasks, name: str, every: float = 0.5) -> Iterator[str]:
    """A task that is as far as the Spark tasks of the jobs that this thread starts within the block: of the stages known so far, the share
    that has ended. It never goes back. Other threads' jobs don't count."""
    context = tasks.spark.sparkContext
    task, group, over = tasks.start(name), f"{name}-{uuid.uuid4().hex}", threading.Event()
    tracker, most = context.statusTracker(), 0.0

    def look() -> None:
        nonlocal most
        while not over.wait(every):
            jobs = [j for k in tracker.getJobIdsForGroup(group) if (j := tracker.getJobInfo(k))]
            stages = {s: info for j in jobs for s in j.stageIds if (info := tracker.getStageInfo(s))}
            total = sum(s.numTasks for s in stages.values())
            if total:
                most = max(most, min(99.0, 100 * sum(s.numCompletedTasks for s in stages.values()) / total))
                tasks.update(task, most)

    before = context.getLocalProperty("spark.jobGroup.id"), context.getLocalProperty("spark.job.description")
    context.setJobGroup(group, name)
    watch = threading.Thread(target=look, daemon=True)
    watch.start()
    try:
        yield task
    except BaseException as e:
        over.set()
        watch.join()
        tasks.fail(task, repr(e))
        raise
    else:
        over.set()
        watch.join()
        tasks.complete(task)
    finally:
        context.setLocalProperty("spark.jobGroup.id", before[0])
        context.setLocalProperty("spark.job.description", before[1])
