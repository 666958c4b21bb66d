"""Hashed byte n-grams of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Buckets of hashed n-grams of one to three bytes.
BUCKETS = 1 << 14
#: Bytes looked at together.
STEP = 1 << 16
#: ASCII letters in lower case; other ASCII as a blank; bytes of other letters as they are.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(folded bytes of all texts, two blanks after each; where each text ends)."""
    blank = pa.scalar("  ", pa.large_string())
    ended = pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(""), pa.scalar("", pa.large_string()), blank)
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    return _FOLD[np.frombuffer(ended.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]], offsets[1:] - offsets[0]


def _grams(raw: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, three buckets each) of the bytes from start to end that aren't blank."""
    part = raw[start : end + 2].astype(np.uint32)
    at = np.flatnonzero(part[: end - start] != 32)
    at = at[at + 2 < len(part)]
    one, two = part[at], part[at + 1]
    before = raw[np.maximum(at + start - 1, 0)].astype(np.uint32)
    pair = one * np.uint32(257) + two + np.uint32(1000)
    three = pair * np.uint32(2654435761) + part[at + 2] * np.uint32(40503)
    lead = np.where(before == 32, pair * np.uint32(2246822519) + np.uint32(77), pair * np.uint32(3266489917) + before)
    out = np.empty((len(at), 3), np.uint32)
    out[:, 0] = pair * np.uint32(2654435761) >> np.uint32(18)
    out[:, 1] = (three ^ (three >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(18)
    out[:, 2] = (lead ^ (lead >> np.uint32(13))) * np.uint32(2654435761) >> np.uint32(18)
    return at + start, out


def frequencies(texts: pa.Array) -> np.ndarray:
    """Bucket shares of each text, one row each."""
    raw, ends = _folded(texts)
    out, start = np.zeros((len(ends), BUCKETS), np.float32), 0
    for i, end in enumerate(ends):
        counts, n = np.zeros(BUCKETS), 0
        for k in range(start, end, STEP):
            _, buckets = _grams(raw, k, min(end, k + STEP))
            counts += np.bincount(buckets.ravel(), minlength=BUCKETS)
            n += buckets.size
        out[i] = counts / max(n, 1)
        start = end
    return out


def weigh(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """frequencies(texts) @ weights without the wide rows; weights has a row for each bucket. Works by STEP bytes at a time."""
    raw, ends = _folded(texts)
    out, n = np.zeros((len(ends), weights.shape[1]), np.float64), np.zeros(len(ends), np.int64)
    for k in range(0, len(raw), STEP):
        at, buckets = _grams(raw, k, min(len(raw), k + STEP))
        if not len(at):
            continue
        sums = weights[buckets[:, 0]]
        sums += weights[buckets[:, 1]]
        sums += weights[buckets[:, 2]]
        of = np.searchsorted(ends, at, side="right")
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        out[of[cuts]] += np.add.reduceat(sums, cuts, axis=0)
        n[of[cuts]] += np.diff(np.append(cuts, len(of)))
    return out / np.maximum(3 * n, 1)[:, None]
