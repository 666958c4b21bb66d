"""Words of many texts at once, as ranges of one byte buffer, and XXH64 of ranges; all with numpy.

A word is a longest run without ASCII white space (0x20, 0x09-0x0D). A-Z are lower-cased, other bytes stay.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Also ASCII punctuation.
_APART = _SPACE.copy()
_APART[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


class Words(NamedTuple):
    """data: the words with one blank after each. Word k is data[starts[k]:ends[k]]; text i has words firsts[i] to firsts[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray


def words(texts: pa.Array, lower: bool = True, punctuation: bool = False) -> Words:
    """punctuation: whether ASCII punctuation parts words too."""
    blank = pa.scalar(" ", pa.large_string())
    ended = pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(""), pa.scalar("", pa.large_string()), blank)
    if isinstance(ended, pa.ChunkedArray):
        ended = ended.combine_chunks()
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    raw = np.frombuffer(ended.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    space = (_APART if punctuation else _SPACE)[raw]
    keep = ~space
    keep[1:] |= ~space[:-1]
    data, gap = (_LOWER[raw] if lower else raw)[keep], space[keep]
    if not data.flags.writeable:
        data = data.copy()
    data[gap] = 32
    ends = np.flatnonzero(gap)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    closing = np.cumsum(space & keep)
    at = offsets - offsets[0]
    firsts = np.where(at > 0, closing[np.maximum(at, 1) - 1] if len(closing) else 0, 0)
    return Words(data, starts, ends, firsts)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def _wide(data: np.ndarray, kind: str) -> np.ndarray:
    """The little-endian number that starts at each byte."""
    size = np.dtype(kind).itemsize
    return np.ndarray((len(data) - size + 1,), kind, data, strides=(1,))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each range, unsigned. Ranges of one length go together."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    w8, w4 = _wide(data, "<u8"), _wide(data, "<u4")
    sizes = (ends - starts).astype(np.int64)
    order = np.argsort(sizes.astype(np.uint16) if len(sizes) and sizes.max() < 65536 else sizes, kind="stable")
    bounds = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for a, b in zip(bounds, [*bounds[1:], len(order)], strict=False):
            rows = order[a:b]
            at, n = starts[rows], int(sizes[rows[0]])
            left, k = n, 0
            if n >= 32:
                one = np.full(len(at), np.uint64(seed))
                acc = [one + _P1 + _P2, one + _P2, one.copy(), one - _P1]
                while left >= 32:
                    acc = [_round(x, w8[at + (k + 8 * i)]) for i, x in enumerate(acc)]
                    k, left = k + 32, left - 32
                h = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
                for x in acc:
                    h = (h ^ _round(np.zeros_like(x), x)) * _P1 + _P4
            else:
                h = np.full(len(at), np.uint64(seed) + _P5)
            h = h + np.uint64(n)
            while left >= 8:
                h = _turn(h ^ _round(np.zeros_like(h), w8[at + k]), 27) * _P1 + _P4
                k, left = k + 8, left - 8
            if left >= 4:
                h = _turn(h ^ (w4[at + k].astype(np.uint64) * _P1), 23) * _P2 + _P3
                k, left = k + 4, left - 4
            for _ in range(left):
                h = _turn(h ^ (data[at + k].astype(np.uint64) * _P5), 11) * _P1
                k += 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, last words, counts by text) of all shingles; a text of fewer words has one of all its words, an empty one none."""
    counts = np.diff(w.firsts)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    base = np.cumsum(made) - made
    first = np.repeat(w.firsts[:-1] - base, made) + np.arange(made.sum())
    return first, first + np.repeat(np.minimum(counts, size) - 1, made), made
