"""Approximate nearest neighbours by inner product, with an adaptive dimension scan of probed lists.

Vectors get one more dimension, so that all have the longest one's length: then the largest inner product with a query is
the least distance. A random rotation spreads the information evenly over dimensions. k-means lists are fitted on a bounded
sample; every vector is put into a list, and large lists are cut into blocks. Each block is scanned by blocks of columns:
from the distance over the dimensions seen so far, a hypothesis test drops candidates that cannot beat the twentieth best
with high confidence. What remains at the end is scored exactly, in double precision, on the vectors as given.

How many lists a query probes is set on the sample, so that RECALL of true neighbours there are in probed lists, and more
where the lists hold too few candidates.

Defined results: vectors that are null, zero, or hold null or non-finite components, vectors of another than the most
usual dimension, and rows without a vec_id take no part; of rows that repeat a vec_id the one with the least vector (by its
first component, and so on) takes part; fewer candidates than asked are all returned; an empty table yields no row; further
columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.llm.common import by_hash, materialize

#: Rows on which lists and probes are fitted.
SAMPLE = 6000
#: Share of the sample's true neighbours that probed lists must hold.
RECALL = 0.985
#: Vectors of a block and queries that meet them at once.
BLOCK, QUERIES = 4096, 8192
#: Columns of a step of the scan, and the test's width: candidates fail at EPSILON / sqrt(dimensions seen) above the bound.
COLUMNS, EPSILON = 16, 2.1
MOST_LISTS = 4096


class Index(NamedTuple):
    rotation: np.ndarray
    centroids: np.ndarray
    longest: float
    probes: int


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def lengthened(x: np.ndarray, index: Index) -> np.ndarray:
    """Candidates as rotated points of one length."""
    rest = np.sqrt(np.maximum(0, index.longest**2 - (x * x).sum(axis=1)))
    return (np.hstack([x, rest[:, None]]) / index.longest @ index.rotation).astype(np.float32)


def asked(q: np.ndarray, index: Index) -> np.ndarray:
    """Queries as rotated points of that length; their own length doesn't change an order."""
    q = q / np.sqrt((q * q).sum(axis=1))[:, None]
    return (np.hstack([q, np.zeros((len(q), 1))]) @ index.rotation).astype(np.float32)


def fit(sample: np.ndarray, longest: float, lists: int, k: int) -> Index:
    rng, dim = np.random.default_rng(17), sample.shape[1] + 1
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    index = Index(rotation, np.zeros((1, dim), np.float32), longest, 1)
    x = lengthened(sample, index)
    centroids = np.unique(x, axis=0)
    centroids = centroids[rng.permutation(len(centroids))[:lists]]
    for _ in range(12):
        own = (x @ centroids.T - (centroids**2).sum(axis=1) / 2).argmax(axis=1)
        sums, sizes = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))
        np.add.at(sums, own, x)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    index = index._replace(centroids=centroids)
    own = _nearest_lists(x, centroids)[:, 0]
    rows = rng.permutation(len(x))[:400]
    q = asked(sample[rows], index)
    near = q @ x.T
    near[np.arange(len(rows)), rows] = -np.inf
    best = np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((len(rows), 0), int)
    rank = np.argsort(_nearest_lists(q, centroids), axis=1)
    found = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel())
    probes = int(found[min(len(found) - 1, int(RECALL * len(found)))]) + 1 if len(found) else 1
    return index._replace(probes=probes)


def _nearest_lists(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argsort(-(x @ centroids.T - (centroids**2).sum(axis=1) / 2), axis=1, kind="stable")


def scan(points: np.ndarray, ids: np.ndarray, given: np.ndarray, query: np.ndarray, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(vec_ids, inner products) of the k best of a block for one query."""
    dim, left = points.shape[1], np.flatnonzero(ids != own)
    head = left[: max(4 * k, 64)]
    bound = np.inf
    if len(left) > len(head):
        bound = np.partition(((points[head] - query) ** 2).sum(axis=1), k - 1)[k - 1]
    total = np.zeros(len(left), np.float32)
    for a in range(0, dim, COLUMNS):
        b = min(dim, a + COLUMNS)
        total += ((points[left, a:b] - query[a:b]) ** 2).sum(axis=1)
        stays = total * (dim / b) <= bound * (1 + EPSILON / np.sqrt(b)) ** 2 + 1e-5 if b < dim else total <= bound + 1e-5
        left, total = left[stays], total[stays]
    if len(left) > k:
        left = left[total <= np.partition(total, k - 1)[k - 1] + 1e-5]
    # Each row is summed by itself, so equal vectors have equal scores.
    score = np.array([]) if not len(left) else (given[left] * q).sum(axis=1)
    order = np.lexsort((ids[left], -score))
    names, first = np.unique(ids[left][order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[left][order], score[order]


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each row that is_query (a condition on vec_id) holds for."""
    e = F.col("embedding")
    good = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False)) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(good)
    usual = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))).alias("square")).orderBy(F.desc("n"), "dim").first()
    out = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return vectors.sparkSession.createDataFrame([], out)
    dim = usual["dim"]
    rows = rows.filter(F.size("embedding") == dim)
    again = rows.groupBy("vec_id").agg(F.count("*").alias("k")).filter("k > 1").select("vec_id")
    again = materialize(again, "repeated")
    if not again.isEmpty():
        one = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        rows = materialize(rows.join(again, "vec_id", "left_anti").unionByName(one), "distinct")
    n, asked_for = rows.agg(F.count("*"), F.count_if(is_query)).first()
    picked = rows.filter(by_hash(2 * SAMPLE / n, "vec_id")).orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(SAMPLE)  # SAMPLE rows at most
    index = fit(_vectors(picked.toArrow().column("embedding"), dim), float(np.sqrt(usual["square"])), max(1, min(MOST_LISTS, round(np.sqrt(n) / 8))), k)

    # Vectors travel as they are stored; all sums are of doubles.
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    narrow = pa.float32() if kind == "float" else pa.float64()

    def place(batches):
        for batch in batches:
            x = _vectors(batch.column("embedding"), dim)
            points = lengthened(x, index)
            lists = _nearest_lists(points, index.centroids)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding").cast(pa.list_(narrow)), pa.array(lists, pa.int32())], ["vec_id", "embedding", "list"])

    placed = materialize(rows.mapInArrow(place, f"vec_id long, embedding array<{kind}>, list int"), "vectors")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row for each list
        sizes[r["list"]] = r["n"]
    blocks = np.maximum(1, -(-sizes // BLOCK))
    queries = placed.filter(is_query)

    def probe(batches):
        for batch in batches:
            order = _nearest_lists(asked(_vectors(batch.column("embedding"), dim), index), index.centroids)
            reached = np.cumsum(sizes[order], axis=1) - sizes[order]  # candidates in the lists before
            wanted = ((np.arange(order.shape[1]) < index.probes) | (reached < 2 * k + 1)) & (sizes[order] > 0)
            row, col = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(row)), batch.column("embedding").take(pa.array(row)), pa.array(order[row, col], pa.int32())], ["query_id", "query", "list"])

    probed = queries.select("vec_id", "embedding").mapInArrow(probe, f"query_id long, query array<{kind}>, list int")
    share = max(1, -(-asked_for * index.probes // len(index.centroids) // QUERIES))
    block_of = F.array(*[F.lit(int(b)) for b in blocks])[F.col("list")]
    probed = probed.select("*", F.pmod(F.xxhash64("query_id"), F.lit(share)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), block_of - 1)).alias("block"))
    held = placed.select("*", F.pmod(F.xxhash64("vec_id", F.lit(3)), block_of).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(share - 1))).alias("part"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[], [], []]
        if left.num_rows and right.num_rows:
            given, ids = _vectors(left.column("embedding"), dim), left.column("vec_id").to_numpy()
            points, q = lengthened(given, index), _vectors(right.column("query"), dim)
            for own, vector, point in zip(right.column("query_id").to_pylist(), q, asked(q, index), strict=True):
                names, scores = scan(points, ids, given, point, own, vector, k)
                found[0].append(np.full(len(names), own))
                found[1].append(names)
                found[2].append(scores)
        cat = [np.concatenate(f) if f else np.array([]) for f in found]
        return pa.table({"query_id": pa.array(cat[0], pa.int64()), "vec_id": pa.array(cat[1], pa.int64()), "score": pa.array(cat[2], pa.float64())})

    keys = ["list", "block", "part"]
    met = held.groupBy(*keys).cogroup(probed.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
