"""Benchmark decontamination by greedy string tiling.

Tokens are runs between ASCII blanks and punctuation, A-Z lower-cased. A document and a benchmark item that share enough
seeds (hashes of LEAST consecutive tokens) for the coverage asked are tiled: the longest common runs are marked again and
again, and the share of the item's tokens in tiles of LEAST tokens or more is its coverage. Order doesn't matter, so a
passage whose parts were moved is caught. As each tile consists of seeds, tokens outside seeds are left out beforehand.

A document that shares enough also has one of an item's rarer seeds: the most usual ones, which cover fewer tokens than are asked for,
are not looked for, so a passage that all items and texts have makes no pairs. Up to SEEDS seeds the benchmark goes to every task; a
larger one is joined by seed, then texts to the pairs found.

Defined results: null and empty texts and items of fewer than LEAST tokens match nothing; a null doc_id or item_id is
reported as null; repeated rows are each reported; empty tables give no row; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.llm import words
from yieldloom.llm.common import held, materialize, restored, slices, text_of
from yieldloom.llm.tiling import tile

#: Tokens of a seed, and of the shortest tile.
LEAST = 5
#: Share of an item's tokens that must be in tiles.
COVERAGE = 0.5
#: Seeds of the benchmark, as counted before, up to which every task gets all of it (16 bytes each, and its tokens).
SEEDS = 1 << 20
_MIX = [np.uint64(x) for x in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
RESULT = "doc_id long, item_id long, coverage double, tokens int, tiles array<struct<doc_token:int,item_token:int,length:int>>"
_TILES = pa.list_(pa.struct([("doc_token", pa.int32()), ("item_token", pa.int32()), ("length", pa.int32())]))


def _seeds(h: np.ndarray) -> np.ndarray:
    out = np.zeros(max(0, len(h) - LEAST + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(LEAST):
            part = h[k : k + len(out)]
            out += (part ^ (part >> np.uint64(29))) * _MIX[k]
    return out


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, first token of each text, seed at each token; the last four of a text have none of use)."""
    w = words.words(texts, punctuation=True)
    h = words.xxh64(w.data, w.starts, w.ends)
    seeds = np.zeros(len(h), np.uint64)
    seeds[: max(0, len(h) - LEAST + 1)] = _seeds(h)
    return h, w.firsts, seeds


def _usable(firsts: np.ndarray, size: int) -> np.ndarray:
    """Whether a whole seed starts at each token."""
    good = np.ones(size, bool)
    for k in range(1, LEAST):
        ends = np.maximum(firsts[1:] - k, firsts[:-1])
        good[ends[ends < firsts[1:]]] = False
    return good


class Benchmark(NamedTuple):
    ids: list
    items: list[np.ndarray]  # token hashes
    seeds: np.ndarray  # ascending; of each item the rarest that it must share one of
    of: np.ndarray  # the item of each seed

    @staticmethod
    def of_rows(ids: list, texts: pa.Array, coverage: float) -> Benchmark:
        h, firsts, seeds = tokens(texts)
        good = _usable(firsts, len(h))
        of, at = np.repeat(np.arange(len(ids)), np.diff(firsts))[good], (np.arange(len(h)) - np.repeat(firsts[:-1], np.diff(firsts)))[good]
        pairs = np.unique(np.stack([seeds[good].view(np.int64), of], axis=1), axis=0) if len(of) else np.zeros((0, 2), np.int64)
        names, items = np.unique(pairs[:, 0], return_counts=True)  # in how many items each seed is
        usual = items[np.searchsorted(names, seeds[good].view(np.int64))] if len(of) else np.zeros(0, np.int64)
        order = np.lexsort((at, seeds[good], -usual, of))
        rare, sizes = Rare(coverage), np.diff(firsts)
        keep = order[[rare.keeps(i, int(sizes[i]), s, [p]) for i, s, p in zip(of[order].tolist(), seeds[good][order].tolist(), at[order].tolist(), strict=True)]] if len(of) else order
        own = np.unique(np.stack([seeds[good][keep], of[keep].astype(np.uint64)], axis=1), axis=0)
        return Benchmark(ids, [h[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)], own[:, 0], own[:, 1].astype(np.int64))


class Rare:
    """Tiles lie within the tokens that shared seeds cover. So of an item's seeds, the most usual first, those that together cover fewer
    tokens than are asked for need not be looked for: a document that has enough has one of the others, too."""

    def __init__(self, coverage: float):
        self.coverage, self.item, self.last, self.covered, self.full = coverage, None, None, set(), False

    def keeps(self, item, size: int, seed: int, places: list[int]) -> bool:
        """Whether a seed of an item of so many tokens is looked for. Seeds come item by item, the most usual first, with their places."""
        if self.item != (item, size):
            self.item, self.last, self.covered, self.full = (item, size), None, set(), False
        if self.full and seed != self.last:
            return True
        self.last = seed
        for p in places:
            self.covered.update(range(p, p + LEAST))
        self.full = len(self.covered) >= self.coverage * size
        return self.full


def _cover(doc: np.ndarray, seeds: np.ndarray, bench: Benchmark, items: list[int], coverage: float):
    """(item, coverage, tiles) of those items that a document covers. doc: its token hashes, seeds: its seeds."""
    for item in items:
        wanted = bench.items[item]
        own = np.unique(_seeds(wanted))
        at = np.flatnonzero(np.isin(seeds, own))
        within = np.zeros(len(doc) + LEAST, bool)
        for k in range(LEAST):
            within[at + k] = True
        places = np.flatnonzero(within[: len(doc)])
        runs = np.flatnonzero(np.diff(places, prepend=-2) > 1)
        text, where = [], []
        for a, b in zip(runs, [*runs[1:], len(places)], strict=True):  # a token of no text keeps runs apart
            text += [-1 - int(a), *doc[places[a:b]].tolist()]
            where += [-1, *places[a:b].tolist()]
        tiles = [(where[d], i, k) for d, i, k in tile(text, wanted.tolist(), LEAST)]
        share = sum(t[2] for t in tiles) / len(wanted)
        if share >= coverage:
            yield item, share, tiles


def _reach(item: np.ndarray, known: np.ndarray) -> int:
    """Tokens of an item that lie in seeds which are among the known ones (ascending): tiles can't cover more."""
    own = _seeds(item)
    if not len(known) or not len(own):
        return 0
    shared = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)
    within = np.zeros(len(item), bool)
    for k in range(LEAST):
        within[shared + k] = True
    return int(within.sum())


def _rows(found: list[tuple]) -> pa.RecordBatch:
    docs, items, shares, sizes, tiles = zip(*found, strict=True) if found else ([], [], [], [], [])
    made = [[{"doc_token": int(d), "item_token": int(i), "length": int(k)} for d, i, k in t] for t in tiles]
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(shares, pa.float64()), pa.array(sizes, pa.int32()), pa.array(made, _TILES)], ["doc_id", "item_id", "coverage", "tokens", "tiles"])


def _everywhere(docs: DataFrame, bench: Benchmark, coverage: float) -> DataFrame:
    """Every task holds the benchmark."""
    table = np.zeros(1 << 22, bool)
    table[bench.seeds >> np.uint64(42)] = True
    packed = np.packbits(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(packed).astype(bool)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                h, firsts, seeds = tokens(part.column("text"))
                at = np.flatnonzero(maybe[seeds >> np.uint64(42)] & _usable(firsts, len(h)))
                lo, hi = (np.searchsorted(bench.seeds, seeds[at], side=side) for side in ("left", "right"))
                at, lo, hi = at[lo < hi], lo[lo < hi], hi[lo < hi]
                some: dict[int, set] = defaultdict(set)
                docs_at = np.searchsorted(firsts, at, side="right") - 1
                for d, a, b in {*zip(docs_at.tolist(), lo.tolist(), hi.tolist(), strict=True)}:
                    some[d].update(bench.of[a:b].tolist())
                names, found = part.column("doc_id"), []
                for d, candidates in sorted(some.items()):
                    a, b = firsts[d], firsts[d + 1]
                    own = seeds[a:b].copy()
                    own[max(0, b - a - LEAST + 1) :] = 0
                    known = np.unique(own[: max(0, b - a - LEAST + 1)])
                    items = [i for i in sorted(candidates) if _reach(bench.items[i], known) >= coverage * len(bench.items[i])]
                    found += [(names[d].as_py(), bench.ids[i], share, len(bench.items[i]), tiles) for i, share, tiles in _cover(h[a:b], own, bench, items, coverage)]
                yield _rows(found)

    return docs.mapInArrow(run, RESULT)


def _by_seed(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """Seeds are joined, and texts to the pairs that share enough."""

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                h, firsts, s = tokens(part.column("text"))
                good = _usable(firsts, len(h))
                for name, a, b in zip(part.column("doc_id").to_pylist(), firsts[:-1], firsts[1:], strict=True):
                    own = np.unique(s[a:b][good[a:b]]).view(np.int64)
                    for k in range(0, len(own), 1 << 16):
                        cut = own[k : k + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(cut), pa.int64()), pa.array(cut)], ["doc_id", "seed"])

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                h, firsts, s = tokens(part.column("text"))
                good = _usable(firsts, len(h))
                for name, a, b in zip(part.column("item_id").to_pylist(), firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                    at = np.flatnonzero(good[a:b])
                    own = s[a:b][at].view(np.int64)
                    for k in range(0, len(own), 1 << 16):
                        cut, n = own[k : k + (1 << 16)], len(own[k : k + (1 << 16)])
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), pa.array(cut), pa.array(np.full(n, b - a)), pa.array(at[k : k + n])], ["item_id", "seed", "size", "place"])

    def looked_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = Rare(coverage)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("item_id", "size", "seed", "place")), strict=True)
            yield batch.select(["item_id", "size", "seed"]).filter(pa.array([rare.keeps(i, n, s, [p]) for i, n, s, p in rows], pa.bool_()))

    right = materialize(benchmark.mapInArrow(item_seeds, "item_id long, seed long, size long, place long"), "item-seeds")
    names = right.groupBy("seed").agg(F.count_distinct("item_id").alias("items"))
    left = materialize(docs.mapInArrow(doc_seeds, "doc_id long, seed long").join(names.select("seed"), "seed", "left_semi"), "doc-seeds")
    # How many pairs a seed would make; one that no document has makes none and needn't be looked for either.
    usual = names.join(left.groupBy("seed").agg(F.count("*").alias("docs")), "seed").select("seed", (F.col("items") * F.col("docs")).alias("pairs"))
    order = ["item_id", "size", F.desc("pairs"), "seed", "place"]
    rare = right.join(usual, "seed").repartition("item_id", "size").sortWithinPartitions(*order).select("item_id", "size", "seed", "place")
    rare = rare.mapInArrow(looked_for, "item_id long, size long, seed long").distinct()
    pairs = materialize(left.join(rare, "seed").select("doc_id", "item_id").distinct(), "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                item, _, _ = tokens(pa.array([row["item"]]))
                h, firsts, s = tokens(pa.array([row["text"]]))
                s[~_usable(firsts, len(h))] = 0
                if len(item) >= LEAST and _reach(item, np.unique(s)) >= coverage * len(item):
                    bench = Benchmark([row["item_id"]], [item], s[:0], firsts[:0])
                    found += [(row["doc_id"], row["item_id"], share, len(item), tiles) for _, share, tiles in _cover(h, s, bench, [0], coverage)]
            yield _rows(found)

    with_items = pairs.withColumnRenamed("item_id", "i").join(benchmark.withColumnRenamed("text", "item"), F.col("i").eqNullSafe(F.col("item_id"))).drop("i")
    rows = with_items.withColumnRenamed("doc_id", "d").join(docs, F.col("d").eqNullSafe(F.col("doc_id"))).select("doc_id", "text", "item_id", "item")
    return rows.mapInArrow(run, RESULT)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, tokens (of the item) and tiles of each document and item with enough of it covered."""
    docs = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    benchmark = text_of(benchmark, F.col("item_id").cast("long").alias("item_id"))
    size = benchmark.agg(F.sum(F.size(F.split("text", r"[\s\p{Punct}]+"))).alias("n")).first()["n"] or 0
    if size > SEEDS:
        return _by_seed(docs, benchmark, coverage)
    rows = benchmark.toArrow()
    return _everywhere(docs, Benchmark.of_rows(rows.column("item_id").to_pylist(), rows.column("text").combine_chunks(), coverage), coverage)


def without_rows(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows whose own text covers no item, whatever their doc_id is; all their columns."""
    row = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    bad = contaminated(docs.select(row.alias("doc_id"), "text"), benchmark, coverage).select(F.col("doc_id").alias("__bad")).distinct()
    return restored(held(docs).join(materialize(bad, "contaminated"), row == F.col("__bad"), "left_anti"), docs.columns)


def without(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that cover no item; all their columns. Rows with a null doc_id are kept."""
    # Written first, so that its size is known when the join is planned.
    bad = materialize(contaminated(docs, benchmark, coverage).select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    return restored(held(docs).join(bad, F.col("doc_id").cast("long") == F.col("__bad"), "left_anti"), docs.columns)
