"""Best-fit packing of token pieces into sequences, improved by swaps between underfull sequences.

Only the lengths of pieces matter to a packing, and there are at most `limit` of them. So a plan is made over counts by
length, as bin patterns with the number of bins that have each: best fit by descending length, then local search. The pieces
of SHARD_TASKS input splits (some hundred thousand and more) are planned together in one task, which costs less than one
sequence for each shard beside a common plan; neither the driver nor any task holds a plan that grows with the input.
Each task numbers its pieces by length; a shard's plan is cut into runs of those numbers by task, and each task's pieces
meet only their own runs, so no task ever holds all pieces of one length.

Defined results: a null text is the empty one (a piece that is the end id alone); null and repeated doc_ids are packed
row by row; an empty table yields no row; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.llm import bpe
from yieldloom.llm.common import materialize, slices, text_of

#: The emptiest patterns from which a pass of the local search moves documents away; all underfull ones once these can't move.
SOURCES = 300
#: Tasks, of an input split each, whose pieces are packed together.
SHARD_TASKS = 64
RUN = "part int, length int, first long, sequence long, offset long"
PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary, part int, nth long"

Pattern = tuple[int, ...]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int, with_ids: bool = False) -> DataFrame:
    """Each document's ids and end id; longer ones cut into pieces of `limit`, of which the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(limit + 1, np.int64), TaskContext.get().partitionId()
        with bpe.encoder(tokenizer) as enc:
            for batch in batches:
                for part in slices(batch, "text", 4 << 20):
                    flat, starts = enc.encode_ended(part.column("text"), end_id)
                    rows = []
                    for doc, a, b in zip(part.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                        at, k = a, 0
                        while at < b:
                            to = at + ((b - at) % limit or limit)
                            ids = flat[at:to].astype("<u4")
                            rows.append((doc, k, at - a, to - at, bpe.crc(ids), ids.tobytes() if with_ids else None, task, int(seen[to - at])))
                            seen[to - at] += 1
                            at, k = to, k + 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(cut, PIECE)


_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
_NAMES = [x.split()[0] for x in PIECE.split(", ")]


def best_fit(counts: dict[int, int], limit: int) -> Counter[Pattern]:
    """Best fit by descending length, many equal bins at a time: a pattern is the descending lengths in a bin."""
    bins: dict[int, Counter[Pattern]] = defaultdict(Counter)
    open_: list[int] = []  # free room for which there are bins, ascending

    def put(pattern: Pattern, n: int) -> None:
        free = limit - sum(pattern)
        if not bins[free] and free not in open_:
            insort(open_, free)
        bins[free][pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(open_, length)
            free, own = (open_[k], bins[open_[k]]) if k < len(open_) else (limit, Counter({(): left}))
            pattern, n = next(iter(own.items()))
            each = min(free // length, left)
            take = min(n, left // each)
            if free < limit:
                own[pattern] -= take
                if not own[pattern]:
                    del own[pattern]
                if not own:
                    open_.pop(k)
            put(pattern + (length,) * each, take)
            left -= take * each
    return sum(bins.values(), Counter())


def _out(pattern: Pattern) -> dict[int, Pattern]:
    """What can leave a bin at once, by its length: nothing, one or two documents."""
    found: dict[int, Pattern] = {0: ()}
    for x in set(pattern):
        found[x] = (x,)
    for x in set(combinations(pattern, 2)):
        found.setdefault(sum(x), x)
    return found


def _less(pattern: Pattern, gone: Pattern, come: Pattern) -> Pattern:
    rest = list(pattern)
    for x in gone:
        rest.remove(x)
    return tuple(sorted([*rest, *come], reverse=True))


def _moves(under: list[Pattern], limit: int, sources: int) -> list[tuple[Pattern, Pattern, Pattern, Pattern]]:
    """(source, what leaves it, target, what leaves that) for the `sources` emptiest patterns, emptiest first: of all swaps with a fuller
    bin, the one that brings it most. under: patterns from the fullest to the emptiest."""
    room, where, outs = np.full(limit + 1, -1), np.full(limit + 1, -1), []
    found = []
    for k, source in enumerate(under):
        outs.append(_out(source))
        best, move = 0, None
        if k >= len(under) - sources:
            for x, leaves in outs[k].items():
                gain = x - np.arange(x)  # by what the target gives back; no more than it has room for
                fits = np.flatnonzero(gain <= room[:x])
                if len(fits) and gain[fits[0]] > best:
                    best, move = int(gain[fits[0]]), (leaves, int(where[fits[0]]), int(fits[0]))
        if move:
            leaves, t, back = move
            found.append((source, leaves, under[t], outs[t][back]))
        free = limit - sum(source)  # at least that of all before it
        for s in outs[k]:
            room[s], where[s] = free, k
    return found[::-1]


def local_search(bins: Counter[Pattern], limit: int) -> Counter[Pattern]:
    """Move or swap one or two documents for none, one or two between underfull bins; the emptier bin loses, so the sum of
    squared fills grows with each swap. A bin that has lost all its documents is gone. The search ends when no swap is left,
    or at the fewest bins that could hold the sum of lengths."""
    least = -(-sum(sum(p) * n for p, n in bins.items()) // limit)
    bins = Counter(bins)
    while bins.total() > least:
        under = sorted((p for p in bins if sum(p) < limit), key=lambda p: (-sum(p), p))
        moves = _moves(under, limit, SOURCES) or _moves(under, limit, len(under))
        if not moves:
            break
        for source, leaves, target, back in moves:
            n = min(bins[source], bins[target])  # patterns that an earlier swap used up are met again in the next round
            if not n:
                continue
            for p, q in ((source, _less(source, leaves, back)), (target, _less(target, back, leaves))):
                bins[p] -= n
                if not bins[p]:
                    del bins[p]
                if q:
                    bins[q] += n
    return bins


def plan(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset) of each run of places; the next rank is in the next sequence."""
    bins = local_search(best_fit(counts, limit), limit)
    runs, sequence, ranks = [], 0, Counter()
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in pattern:
            runs.append((length, ranks[length], sequence, offset))
            ranks[length] += n
            offset += length
        sequence += n
    return runs


def _runs_of_parts(counts: pa.Table, limit: int) -> pa.Table:
    """The plan of one shard, cut at the ends of its tasks' pieces. counts: part, length, n; at most SHARD_TASKS x limit rows."""
    part, length, n = (counts.column(c).to_numpy().astype(np.int64) for c in ("part", "length", "n"))
    order = np.lexsort((part, length))
    part, length, n = part[order], length[order], n[order]
    before = np.cumsum(n) - n
    base = before - before[np.searchsorted(length, length)]  # rank of a task's first piece among the shard's of that length
    lengths, first = np.unique(length, return_index=True)
    totals = dict(zip(lengths.tolist(), np.add.reduceat(n, first).tolist(), strict=True))
    runs = np.array(sorted(plan(totals, limit)), np.int64).reshape(-1, 4)
    keys, tasks = (runs[:, 0] << 44) + runs[:, 1], (length << 44) + base
    starts = np.union1d(keys, tasks)
    run, task = np.searchsorted(keys, starts, side="right") - 1, np.searchsorted(tasks, starts, side="right") - 1
    first = starts - tasks[task]
    sequence = runs[run, 2] + starts - keys[run] + (int(part[0]) // SHARD_TASKS << 40)
    columns = [part[task], length[task], first, sequence, runs[run, 3]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], RUN.replace(",", "").split()[::2])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, limit: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): where each piece stands."""
    cut = materialize(pieces(docs, tokenizer, end_id, limit, with_ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n")).withColumn("shard", F.expr(f"part div {SHARD_TASKS}"))
    runs = materialize(counts.groupBy("shard").applyInArrow(lambda rows: _runs_of_parts(rows, limit), RUN), "runs")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(rows: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by([("length", "ascending"), ("first", "ascending")])
        keys = (own.column("length").to_numpy().astype(np.int64) << 44) + own.column("first").to_numpy()
        at = (rows.column("length").to_numpy().astype(np.int64) << 44) + rows.column("nth").to_numpy()
        run = np.searchsorted(keys, at, side="right") - 1
        sequence, offset = own.column("sequence").to_numpy()[run] + at - keys[run], own.column("offset").to_numpy()[run]
        columns = [c.cast(pa.int64()) if k == "length" else c for k, c in ((k, rows.column(k)) for k in kept)]
        return pa.table([*columns, pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    schema = f"doc_id long, piece int, start long, length long, ids_crc32 long, {'ids binary, ' * with_ids}sequence_id long, offset long"
    return cut.groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(place, schema)
