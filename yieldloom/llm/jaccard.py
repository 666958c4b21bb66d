"""Groups of near-duplicates: SimHash candidates by segment popcounts, completed by MinHash bands, all verified exactly.

Texts are linked if the sets of their shingles (XXH64 of lower-cased words) have a Jaccard similarity of at least 0.8. Equal
sets are one class, and classes are compared, not texts.

Candidates come in two ways. First, fingerprints that the popcount grid of simhash.links connects (at most 2 of 64 bits).
A similarity of 0.8 is about 10 bits, where bit counts no longer tell pairs apart, so secondly classes meet that share a band
(BAND minima of their shingles under as many orders). BANDS bands miss a pair of similarity 0.8 with a probability of
(1 - 0.8 ** BAND) ** BANDS, about 3 in a million, and a closer one far less often.

No band's group makes pairs of all with all: in each all are compared with one picked class; then what isn't connected yet is
paired in groups of up to CROWD classes, and compared with another pick in larger ones, until a round links nothing.

These only link early what is easily found; an exact pass finds the rest, whatever bands and picks have missed. A set's shingles
are put in one order for all sets, and similar sets share one of their first fifth (and one more). At the first that they share,
at places i and j of n and m, what may be common is at most min(n - i, m - j), which must reach 4/9 (n + m); so one of both is within
its first ninth. All pairs of unconnected classes that meet so are compared, in groups of any size, dealt to tasks by blocks. The order
puts shingles that are frequent in an eighth of the texts last: it says how many pairs meet, not which of the similar ones do.

Most of those pairs are not similar, and whole sets would have to travel to tell so. So sketches are compared first, a
thirty-second to a sixteenth of a set: a bit for each value of the last digits of a shingle, the parity of how many shingles
have it. Where two sketches differ, a shingle is in one set only, so as many as there are such bits; 0.8 allows (n + m) / 9. No
similar pair is lost by it, and sets are made and compared only of pairs that sketches leave open.

Defined results: null and blank texts are the empty set, linked with each other only; an empty table yields no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.llm import graph, simhash, words
from yieldloom.llm.common import materialize, release, scratch, slices, text_of

#: Minima of a band, and bands of a text.
BAND, BANDS = 4, 24
#: Classes of a band's group up to which those that aren't connected are paired.
CROWD = 64
#: One of how many texts is looked at for frequent shingles, and bits of the map of them by hash.
SHARE, MAP_BITS = 8, 23
_ORDERS = np.random.default_rng(5).integers(1, 1 << 63, BAND * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of the texts, repeats included; how many each text has)."""
    w = words.words(texts)
    first, last, counts = words.shingles(w, shingle)
    return words.xxh64(w.data, w.starts[first], w.ends[last]), counts


def _sets(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    of = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.searchsorted(of[new], np.arange(len(counts) + 1))


def sets_of(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, ascending; where each text's begin, and the end)."""
    return _sets(*shingles_of(texts, shingle))


def _names(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    with np.errstate(over="ignore"):
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(29)), dtype=np.uint64)])
        return (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


def bands_of(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of the minima of each band, for sets that aren't empty: sets x BANDS."""
    out = np.empty((len(bounds) - 1, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(bounds) - 1, np.uint64(band + 1))
            for order in _ORDERS[band * BAND : (band + 1) * BAND]:
                low = np.minimum.reduceat(h * order, bounds[:-1])
                key = (key ^ (low >> np.uint64(29)) ^ low) * np.uint64(0xC2B2AE3D27D4EB4F)
                key ^= key >> np.uint64(32)
            out[:, band] = key
    return out.view(np.int64)


def _frequent(docs: DataFrame, shingle: int) -> np.ndarray:
    """A map of shingles by the last MAP_BITS bits: those that more than CROWD texts seem to have, by a share of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                h, bounds = sets_of(part.column("text"), shingle)
                t = np.repeat(part.column("t").to_numpy(), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t)], ["h", "t"])

    found = docs.select("t", "text").filter(F.pmod("t", F.lit(SHARE)) == 0).mapInArrow(run, "h long, t long")
    many = found.groupBy("h").agg(F.count("*").alias("k"), F.min("t").alias("low"), F.max("t").alias("high")).filter((F.col("k") > max(1, CROWD // SHARE)) & (F.col("low") < F.col("high")))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    slots = many.groupBy(F.expr(f"shiftright(h & {(1 << MAP_BITS) - 1}L, 6)").alias("slot")).agg(F.bit_or(bit).alias("bits")).collect()  # 2^17 rows at most
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[[r["slot"] for r in slots]] = [r["bits"] for r in slots]
    return out.view(np.uint64)


def prefixes_of(h: np.ndarray, bounds: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first shingles of each set in the common order, as many as similar sets must share one of; how many each set has)."""
    n = np.diff(bounds)
    slot = (h & np.uint64((1 << MAP_BITS) - 1)) >> np.uint64(6)
    usual = (frequent[slot.astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)
    h = h[np.lexsort((h, usual, np.repeat(np.arange(len(n)), n)))]
    take = np.where(n > 0, n // 5 + 1, 0)
    return h[np.repeat(bounds[:-1] - (np.cumsum(take) - take), take) + np.arange(take.sum())], take


def sketches_of(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the sketches of sets: words of parities of their shingles by last digits; how many words each has, a power of two)."""
    n = np.diff(bounds)
    size = np.int64(1) << np.ceil(np.log2(np.maximum(n, 32) / 32)).astype(np.int64)
    word = ((h >> np.uint64(6)) & np.repeat(size - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(np.cumsum(size) - size, n)
    out = np.zeros(size.sum(), np.uint64)
    np.bitwise_xor.at(out, word, np.uint64(1) << (h & np.uint64(63)))
    return out, size


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles only one of two sets has, at least, by their sketches; the longer one is folded."""
    k = min(len(x), len(y))
    differ = np.bitwise_xor.reduce(x.reshape(-1, k)) ^ np.bitwise_xor.reduce(y.reshape(-1, k))
    return int(np.bitwise_count(differ.view(np.uint64)).sum())  # of a signed number it would count the bits of its amount


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _described(docs: DataFrame, shingle: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, t (a hash of the text), cls (the name of its set), n (the set's size), fp (the fingerprint), bands, prefix and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                h, counts = shingles_of(part.column("text"), shingle)
                fp = simhash.majority(h, counts).view(np.int64)
                h, bounds = _sets(h, counts)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                made = bands_of(h, np.append(bounds[:-1][some], len(h))) if len(some) else np.zeros((0, BANDS), np.int64)
                lists = [_lists(made.ravel(), np.where(n > 0, BANDS, 0)), _lists(*prefixes_of(h, bounds, frequent)), _lists(*sketches_of(h, bounds))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(_names(h, bounds)), pa.array(n), pa.array(fp), *lists], ["doc_id", "t", "cls", "n", "fp", "bands", "prefix", "sketch"])

    return docs.mapInArrow(run, "doc_id long, t long, cls long, n long, fp long, bands array<long>, prefix array<long>, sketch array<long>")


def _with(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs with x and y, which are s of a and of b."""
    return pairs.join(of.select(F.col("cls").alias("a"), F.col("s").alias("x")), "a").join(of.select(F.col("cls").alias("b"), F.col("s").alias("y")), "b")


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b of those pairs (of sets of together `sizes` shingles) that may be similar by their sketches."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [apart(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(9 * np.array(least, np.int64) <= batch.column("sizes").to_numpy()))

    return _with(pairs, sketches).select("a", "b", "sizes", "x", "y").mapInArrow(compare, "a long, b long")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of those pairs whose sets are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(9 * both >= 4 * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with(pairs, sets).select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """a, b of classes whose fingerprints the popcount grid connects: the first class of a fingerprint stands for it."""
    some = classes.filter("n > 0")
    first = materialize(some.groupBy("fp").agg(F.min("cls").alias("first")), "fingerprints")
    same = some.select("fp", "cls").join(first, "fp").filter("cls != first").select(F.col("first").alias("a"), F.col("cls").alias("b"))
    near = simhash.links(first.select("fp"))
    near = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def _long_enough(n: Column, m: Column) -> Column:
    return 9 * F.least(n, m) >= 4 * (n + m)


def _prefix_places(classes: DataFrame) -> DataFrame:
    """h, cls, n, i: prefix shingles that several classes have, one of them within its first ninth."""
    places = classes.select("cls", "n", F.posexplode("prefix").alias("i", "h"))
    group = Window.partitionBy("h")
    counted = places.select("*", F.count("*").over(group).alias("k"), F.max(9 * F.col("i") <= F.col("n")).over(group).alias("early"))
    return counted.filter("k > 1 AND early").select("h", "cls", "n", "i")


def _prefix_pairs(places: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b and sizes (of both sets together) of all unconnected classes that may be similar."""
    now = places.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    now = materialize(now, "now")
    early = 9 * F.col("i") <= F.col("n")
    open_ = now.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / CROWD).cast("int").alias("blocks")).filter("low < high").select("h", "blocks")
    now = now.join(open_, "h")
    x = now.filter(early).select("h", F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("block"), *[F.col(c).alias(f"x_{c}") for c in ("cls", "n", "i", "root")])
    y = now.select("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), early.alias("early"), *[F.col(c).alias(f"y_{c}") for c in ("cls", "n", "i", "root")])
    need = 4 * (F.col("x_n") + F.col("y_n"))
    fits = (9 * (F.col("x_n") - F.col("x_i")) >= need) & (9 * (F.col("y_n") - F.col("y_i")) >= need)
    met = x.join(y, ["h", "block"]).filter((F.col("x_root") != F.col("y_root")) & (~F.col("early") | (F.col("x_cls") < F.col("y_cls"))) & fits)
    met = met.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b"), (F.col("x_n") + F.col("y_n")).alias("sizes"), *[F.when(F.col("x_cls") < F.col("y_cls"), F.col(f"{p}_n") - F.col(f"{p}_i")).otherwise(F.col(f"{q}_n") - F.col(f"{q}_i")).alias(f"{p}_left") for p, q in (("x", "y"), ("y", "x"))])
    # What a pair shares up to its last common shingle here, and what is left behind it.
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("k"), F.min("x_left").alias("u"), F.min("y_left").alias("v"), F.first("sizes").alias("sizes"))
    return pairs.filter(9 * (F.col("k") + F.least("u", "v") - 1) >= 4 * F.col("sizes")).select("a", "b", "sizes")


def groups(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, t (xxhash64 of the text, a null one as empty) and root (the same for all texts that links connect) of each row."""
    docs = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("t", F.xxhash64("text"))
    with scratch(docs.sparkSession):
        described = materialize(_described(docs, shingle, _frequent(docs, shingle)), "described")
        firsts = [F.first(c).alias(c) for c in ("fp", "bands", "prefix", "sketch")]
        classes = materialize(described.groupBy("cls", "n").agg(F.min(F.struct("doc_id", "t")).alias("row"), *firsts), "classes", outlive=True)
        rows = materialize(described.select("doc_id", "t", "cls"), "rows", outlive=True)
    release(docs.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # repeated rows meet in a task, and if one of them should not, its set is only compared twice
        for batch in batches:
            names = batch.column("cls").to_pylist()
            new = [name not in seen and not seen.add(name) for name in names]
            for part in slices(batch.filter(pa.array(new, pa.bool_())), "text", 1 << 20):
                h, bounds = sets_of(part.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))], ["cls", "s"])

    def sets_for(wanted: DataFrame) -> DataFrame:
        """The sets of classes, from one text of each."""
        texts = materialize(classes.select("cls", F.col("row.doc_id").alias("__id"), F.col("row.t").alias("__t")).join(wanted.distinct(), "cls", "left_semi"), "wanted")
        key = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t"))
        found = docs.join(texts.hint("shuffle_hash"), key).select("cls", "text")
        out = materialize(found.mapInArrow(sets, "cls long, s array<long>"), "sets")
        release(docs.sparkSession)
        return out

    ends = lambda pairs: pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))

    with scratch(docs.sparkSession):  # nothing of this is needed by the exact pass but the links
        pairs = materialize(_fingerprint_pairs(classes), "pairs")

        places = classes.select("cls", "n", F.explode("bands").alias("h"))
        shared = places.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h")
        met = materialize(places.join(shared.hint("shuffle_hash"), "h", "left_semi"), "met")
        own = sets_for(met.select("cls").unionByName(ends(pairs)))

        links = materialize(_similar(pairs, own), "links")
        k, grown = 0, True
        while grown:
            roots = graph.components(links)
            now = met.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
            now = materialize(now, "now")
            pick = F.min(F.struct(F.xxhash64("cls", F.lit(k)), "cls", "n", "root")).alias("it")
            open_ = now.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"), pick).filter("low < high").drop("low", "high")
            open_ = materialize(open_ if k < 2 else open_.filter(F.col("size") > CROWD), "open")
            if open_.isEmpty():
                break
            star = open_ if k != 1 else open_.filter(F.col("size") > CROWD)
            chosen = now.join(star.select("h", "it"), "h").filter((F.col("root") != F.col("it.root")) & _long_enough(F.col("n"), F.col("it.n")))
            pairs = chosen.select(F.least("cls", "it.cls").alias("a"), F.greatest("cls", "it.cls").alias("b"))
            if k == 1:
                few = now.join(open_.filter(F.col("size") <= CROWD).select("h"), "h", "left_semi")
                other = few.select("h", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("root").alias("r"))
                pairs = pairs.unionByName(few.join(other, "h").filter((F.col("cls") < F.col("b")) & (F.col("root") != F.col("r")) & _long_enough(F.col("n"), F.col("m"))).select(F.col("cls").alias("a"), "b"))
            more = materialize(_similar(materialize(pairs.distinct(), "pairs"), own), "links")
            grown = k < 1 or not more.isEmpty()
            links = materialize(links.unionByName(more), "links")
            k += 1
        links = materialize(links.distinct(), "linked", outlive=True)
    release(docs.sparkSession)

    places = materialize(_prefix_places(classes), "places")
    release(docs.sparkSession)
    rest = materialize(_prefix_pairs(places, graph.components(links)), "pairs")
    release(docs.sparkSession)
    rest = materialize(_likely(rest, classes.select("cls", F.col("sketch").alias("s"))), "likely")
    release(docs.sparkSession)
    if not rest.isEmpty():
        links = links.unionByName(materialize(_similar(rest, sets_for(ends(rest))), "links"))
    roots = graph.components(links).withColumnRenamed("node", "cls")
    return rows.select("doc_id", "t", "cls").join(roots, "cls", "left").select("doc_id", "t", F.coalesce("root", "cls").alias("root"))
