"""SimHash near-duplicates by segment popcounts.

A fingerprint is mapped to the vector of bit counts of its 16 segments of 4 bits. The Manhattan distance of two such
vectors is never above the Hamming distance of their fingerprints, so a range join over the unit grid of the vectors finds
every link: two vectors at a distance of at most 2 both lie within 1 of some grid point, hence each fingerprint goes to its
own point and those next to it, equal points meet, and bits are compared exactly. A grid point at which more than
CROWD fingerprints meet is refined to segments of one bit, where the Manhattan distance is the Hamming distance: there at
most 65 fingerprints can meet, all within 2 bits of each other, so a star joins them and no pairs are made.

Defined results: a null or blank text has fingerprint zero, linked like any other; all rows with a null doc_id keep their
rows and do not name a component (one made only of them has a null id); rows that repeat a doc_id each keep theirs; an
empty table yields no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.llm import graph, words
from yieldloom.llm.common import held, materialize, release, restored, scratch, slices, text_of

#: Fingerprints at a grid point beyond which it is refined.
CROWD = 48
_ONES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, the bits that are set in over half its hashes. Byte counters run over at most 255 hashes."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    first = np.cumsum(n) - n
    runs = -(-n // 255)
    run_first = np.cumsum(runs) - runs
    starts = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(run_first, runs))
    for j in range(8):
        lanes = (hashes >> np.uint64(j)) & _ONES
        sums = np.add.reduceat(lanes, starts).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        sums = np.add.reduceat(sums, run_first, axis=0)
        for i in range(8):
            out[some] |= (2 * sums[:, i] > n).astype(np.uint64) << np.uint64(8 * i + j)
    return out


def fingerprints_of(texts: pa.Array, shingle: int, seed: int = 42) -> np.ndarray:
    w = words.words(texts)
    first, last, counts = words.shingles(w, shingle)
    return majority(words.xxh64(w.data, w.starts[first], w.ends[last], seed), counts)


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints_of(part.column("text"), shingle).view(np.int64))], ["doc_id", "fp"])

    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, fp long")


def _counts4(fp: Column) -> Column:
    """The bit counts of the sixteen 4-bit segments, each in 4 bits of a long."""
    return sum((F.shiftrightunsigned(fp, n).bitwiseAND(F.lit(0x1111111111111111)) for n in range(1, 4)), fp.bitwiseAND(F.lit(0x1111111111111111)))


def grid_points(fps: DataFrame) -> DataFrame:
    """point, fp: the vector of bit counts and its neighbours at Manhattan distance 1."""
    steps = F.array(*[F.lit(1 << (4 * i)).cast("long") for i in range(16)])
    own = fps.withColumn("v", _counts4(F.col("fp")))
    up = F.transform(steps, lambda s: F.col("v") + s)
    down = F.transform(F.filter(steps, lambda s: F.col("v").bitwiseAND(s * F.lit(7)) != 0), lambda s: F.col("v") - s)
    return own.select(F.explode(F.concat(F.array("v"), up, down)).alias("point"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """a, b: edges that connect exactly what links at 2 or fewer differing bits connect. fps: distinct, without nulls."""
    points = grid_points(fps)
    crowds = materialize(points.groupBy("point").agg(F.count("*").alias("n")).filter("n > 1"), "points")
    a = points.join(crowds.filter(F.col("n") <= CROWD), "point", "left_semi")
    b = a.select("point", F.col("fp").alias("b"))
    a = a.select("point", F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    found = a.join(b, (a["point"] == b["point"]) & (F.col("a") < F.col("b")) & near).select("a", "b")
    crowded = points.join(crowds.filter(F.col("n") > CROWD), "point", "left_semi").select("fp").distinct()
    bits = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    cells = crowded.select("fp", F.explode(F.transform(bits, lambda s: F.col("fp").bitwiseXOR(s))).alias("cell"))
    # 65 fingerprints at most are within one bit of a cell.
    stars = cells.groupBy("cell").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    stars = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a < b")
    return found.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach, itself included)."""
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    with scratch(docs.sparkSession):
        classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
        roots = graph.components(links(classes.select("fp")))
        named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        named = materialize(named, "named", outlive=True)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The documents, with all their columns, that stay: of each group that links at a Jaccard similarity of at least 0.8 connect
    (see jaccard) one row, of those with the smallest doc_id; a row without an id stays only if its group has none."""
    from yieldloom.llm import jaccard

    with scratch(docs.sparkSession):
        # Of one doc_id, other texts may belong to other groups: a row is named by its id and text.
        rows = jaccard.groups(docs, shingle).groupBy("root", "doc_id", "t").agg(F.count("*").alias("k"))
        least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "k")).alias("m"))
        stays = materialize(least.select(F.col("m.doc_id").alias("__stay"), F.col("m.t").alias("__t"), "m.k"), "stays", outlive=True)
    release(docs.sparkSession)
    repeated, stays = stays.filter("k > 1").drop("k"), stays.drop("k")
    rows = held(docs)
    key = F.col("__stay").eqNullSafe(F.col("doc_id").cast("long")) & (F.col("__t") == F.xxhash64(F.coalesce("text", F.lit(""))))
    if repeated.isEmpty():
        return restored(rows.join(stays.hint("shuffle_hash"), key, "left_semi"), docs.columns)
    once = stays.join(repeated.select(F.col("__stay").alias("i"), F.col("__t").alias("j")), F.col("__stay").eqNullSafe(F.col("i")) & (F.col("__t") == F.col("j")), "left_anti")
    kept = rows.join(once.hint("shuffle_hash"), key, "left_semi")
    again = rows.join(repeated, key, "left_semi").withColumn("__text", F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return restored(kept.unionByName(again), docs.columns)
