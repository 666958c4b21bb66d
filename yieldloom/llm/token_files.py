"""Token-ID output: patched frame-of-reference files in ascending doc_id order, and their reader.

Rows are dealt by ranges of (doc_id, a hash of the text), so repeats of one doc_id, or rows without any, spread over tasks.
A file holds FILE_SEGMENTS segments at most. The place of a document is found by sums of segments within their file, and of
files; no task sees all segments.

Defined results: a null text is the empty one and yields the end id alone; a null doc_id sorts first; rows that repeat a
doc_id each keep their own entry, in the order of their texts' hashes; an empty table yields no segment; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yieldloom.llm import bpe, pfor
from yieldloom.llm.common import materialize, shuffle_partitions, slices, text_of

#: Ids after which a segment ends; the largest piece that a task holds.
SEGMENT_IDS = 2 << 20
#: Segments of a file, which a reader holds whole: some 100 MB.
FILE_SEGMENTS = 24


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every text, add end_id, and write the ids by doc_id. Each file holds a range of doc_ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with bpe.encoder(tokenizer) as enc:
            names, counts, parts, held = [], [], [], 0
            for batch in batches:
                for part in slices(batch, "text", 4 << 20):
                    flat, starts = enc.encode_ended(part.column("text"), end_id)
                    names += part.column("doc_id").to_pylist()
                    counts.append(np.diff(starts))
                    parts.append(flat)
                    held += len(flat)
                    if held >= SEGMENT_IDS:
                        yield pa.record_batch([pa.array([pfor.encode(names, np.concatenate(counts), np.concatenate(parts))], pa.binary())], ["segment"])
                        names, counts, parts, held = [], [], [], 0
            if names:
                yield pa.record_batch([pa.array([pfor.encode(names, np.concatenate(counts), np.concatenate(parts))], pa.binary())], ["segment"])

    spark = docs.sparkSession
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    # The text writer puts a value's bytes as they are, on any file system that Spark knows, and commits whole tasks.
    segments = rows.mapInArrow(encode, "segment binary").select(F.col("segment").cast("string").alias("value"))
    segments.write.option("lineSep", pfor.END).option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document: file, segment, doc_id, local (its place in the segment), n_tokens, ids (little-endian unsigned
    32-bit)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for k, (doc_ids, lengths, ids) in enumerate(pfor.segments(memoryview(content.as_buffer()))):
                    ends = np.cumsum(lengths)
                    raw, size = ids.astype("<u4", copy=False), len(doc_ids)
                    for a in range(0, size, 2000):
                        b = min(size, a + 2000)
                        cut = np.concatenate([[ends[a] - lengths[a]], ends[a:b]])
                        data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(((cut - cut[0]) * 4).astype(np.int32)), pa.py_buffer(raw[cut[0] : cut[-1]])])
                        yield pa.record_batch([pa.array([name.as_py()] * (b - a)), pa.array([k] * (b - a), pa.int32()), pa.array(doc_ids[a:b], pa.int64()), pa.array(cut[:-1]), pa.array(lengths[a:b]), data], ["file", "segment", "doc_id", "local", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "file string, segment int, doc_id long, local long, n_tokens long, ids binary")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    rows = materialize(read(spark, path).select("file", "segment", "doc_id", "local", "n_tokens", F.crc32("ids").alias("ids_crc32")), "tokens")
    # Files follow one another by the numbers of their task and of the file within it, and segments within a file.
    number = lambda pattern: F.regexp_extract(F.element_at(F.split("file", "/"), -1), pattern, 1).cast("int")
    sums = rows.groupBy("file", "segment").agg(F.sum("n_tokens").alias("n"))
    within = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    files = sums.groupBy("file").agg(F.sum("n").alias("n")).select("file", "n", number(r"part-(\d+)").alias("task"), number(r"-c(\d+)").alias("k"))
    # A row for each file of some hundred MB.
    before = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("task", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    bases = sums.withColumn("base", F.coalesce(F.sum("n").over(within), F.lit(0))).join(before, "file").select("file", "segment", (F.col("base") + F.col("before")).alias("base"))
    return rows.join(bases, ["file", "segment"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
