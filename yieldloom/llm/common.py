"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.sources.files import exists, new_path, remove, shared_dir  # noqa: F401  the operators take them from here

BATCH_BYTES = 8 << 20


#: Folders of the scratch() blocks that are open, the innermost last.
_open: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What materialize() writes within the block is deleted at its end, but for what is asked to outlive it."""
    _open.append(new_path(spark, "scratch"))
    try:
        yield
    finally:
        drop_path(spark, _open.pop())


def materialize(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there and a lost executor costs nothing."""
    folders = _open[:-1] if outlive else _open
    path = f"{folders[-1]}/{name}-{uuid.uuid4().hex}" if folders else new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system once nothing reads it."""
    remove(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that have ended; else they stay until the driver happens to collect its
    garbage, which small plans rarely make it do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_hash(share: float, *columns) -> Column:
    """About that share of all rows, chosen by a hash of the columns. Filtered by it, a sample of a known size comes to the driver
    with few rows more, however many tasks there are; an ordered limit alone would bring the limit from each task."""
    return F.pmod(F.xxhash64(*columns, F.lit("sample")), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES from now on, as each worker and its executor hold some; a smaller bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if now.isdigit() and not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def text_of(df: DataFrame, *keep: str) -> DataFrame:
    """The named columns and text, where a null text is the empty one."""
    small_batches(df.sparkSession)
    return df.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that none of their names can clash with an operator's own."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]).alias("held"))


def restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """What was held(), under its names and in its order."""
    others = [c for c in columns if c not in ("doc_id", "text")]
    back = {c: F.col(f"held.c{k}").alias(c) for k, c in enumerate(others)} | {c: F.col(c) for c in ("doc_id", "text")}
    return rows.select(*[back[c] for c in columns])


def slices(batch, column: str, limit: int = 6 << 20):
    """Cut an Arrow batch so that each part holds about `limit` bytes of the column, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    trim()


def trim() -> None:
    """Give memory that a worker no longer uses back to the machine; else each keeps the most it has ever needed."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass
