"""Patched frame-of-reference segments: the byte format of token files.

A segment is: header, document table, block index, block payloads, trailer. A block holds BLOCK ids (the last is filled
up with its minimum): each id less the block's minimum, packed at a width that covers PERCENTILE of them, then the
positions (uint16) and full differences (uint32) of those that need more bits. The index holds each block's start,
minimum, width and count of exceptions, so a reader can fetch any block alone. All numbers are little-endian. The
trailer is the crc32 of what stands before it and then END, which is also what ends each record of the file that holds it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1024
PERCENTILE = 90
MAGIC = b"YLPF"
END = "YLPFEND\n"
_HEAD = struct.Struct("<4sIQQQQ")  # magic, block size, documents, ids, blocks, bytes of the segment up to the trailer
_INDEX = np.dtype([("at", "<u8"), ("low", "<u4"), ("width", "u1"), ("odd", "<u2")])
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u8")])


def _widths(diff: np.ndarray) -> np.ndarray:
    """The bits of the PERCENTILE-th difference of each block."""
    k = min(diff.shape[1] - 1, diff.shape[1] * PERCENTILE // 100)
    return np.ceil(np.log2(np.partition(diff, k, axis=1)[:, k].astype(np.float64) + 1)).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values, each under 2**width, as rows of 64-bit words; 64 values take `width` words."""
    groups = values.reshape(-1, 64).astype(np.uint64)
    words = np.zeros((len(groups), width), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        words[:, word] |= groups[:, k] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= groups[:, k] >> np.uint64(64 - shift)
    return words.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int, size: int) -> np.ndarray:
    groups = words.reshape(-1, width)
    values, mask = np.empty((len(groups), 64), np.uint64), np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        x = groups[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (groups[:, word + 1] << np.uint64(64 - shift))
        values[:, k] = x & mask
    return values.reshape(-1, size)


def encode(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment without END. doc_ids may hold None; lengths are those of each document's ids."""
    docs = np.zeros(len(doc_ids), _DOC)
    docs["doc_id"] = [0 if d is None else d for d in doc_ids]
    docs["null"] = [d is None for d in doc_ids]
    docs["n"] = lengths
    blocks = -(-len(ids) // BLOCK)
    index, payload = np.zeros(blocks, _INDEX), b""
    if blocks:
        values = np.full(blocks * BLOCK, ids[(blocks - 1) * BLOCK :].min(), np.uint32)
        values[: len(ids)] = ids
        values = values.reshape(blocks, BLOCK)
        low = values.min(axis=1)
        diff = values - low[:, None]
        width = _widths(diff)
        odd = diff >> width[:, None].astype(np.uint32).clip(0, 31) > 0
        odd[width == 32] = False
        counts = odd.sum(axis=1)
        sizes = width.astype(np.int64) * (BLOCK // 8) + counts * 6
        at = np.cumsum(sizes) - sizes
        index["at"], index["low"], index["width"], index["odd"] = at, low, width, counts
        out = np.zeros(int(sizes.sum()), np.uint8)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w:
                packed = _pack(np.where(odd[rows], 0, diff[rows]), int(w)).astype("<u8").view(np.uint8)
                for r, row in zip(rows, packed, strict=True):
                    out[at[r] : at[r] + len(row)] = row
        for r in np.flatnonzero(counts):
            where = np.flatnonzero(odd[r])
            tail = where.astype("<u2").tobytes() + diff[r][where].astype("<u4").tobytes()
            out[at[r] + int(width[r]) * (BLOCK // 8) : at[r] + sizes[r]] = np.frombuffer(tail, np.uint8)
        payload = out.tobytes()
    size = _HEAD.size + docs.nbytes + index.nbytes + len(payload)
    body = _HEAD.pack(MAGIC, BLOCK, len(docs), len(ids), blocks, size) + docs.tobytes() + index.tobytes() + payload
    return body + struct.pack("<I", zlib.crc32(body))


def segments(data: bytes):
    """(doc_ids, lengths, ids) of each segment of a file."""
    at, view, end = 0, memoryview(data), END.encode()
    while at < len(data):
        magic, block, n_docs, n_ids, blocks, size = _HEAD.unpack_from(view, at)
        if magic != MAGIC or zlib.crc32(view[at : at + size]) != struct.unpack_from("<I", view, at + size)[0] or view[at + size + 4 : at + size + 4 + len(end)] != end:
            raise ValueError(f"damaged token segment at byte {at}")
        docs = np.frombuffer(view, _DOC, n_docs, at + _HEAD.size)
        index = np.frombuffer(view, _INDEX, blocks, at + _HEAD.size + docs.nbytes)
        start = at + _HEAD.size + docs.nbytes + index.nbytes
        yield [None if x["null"] else int(x["doc_id"]) for x in docs], docs["n"].astype(np.int64), _decode(view, start, index, block)[:n_ids]
        at += size + 4 + len(end)


def _decode(view: memoryview, start: int, index: np.ndarray, block: int) -> np.ndarray:
    values = np.zeros((len(index), block), np.uint32)
    for w in np.unique(index["width"]):
        rows = np.flatnonzero(index["width"] == w)
        if w:
            words = np.stack([np.frombuffer(view, "<u8", block * int(w) // 64, start + int(a)) for a in index["at"][rows]])
            values[rows] = _unpack(words, int(w), block).astype(np.uint32)
    for r in np.flatnonzero(index["odd"]):
        n, at = int(index["odd"][r]), start + int(index["at"][r]) + int(index["width"][r]) * block // 8
        values[r][np.frombuffer(view, "<u2", n, at)] = np.frombuffer(view, "<u4", n, at + 2 * n)
    return (values + index["low"][:, None]).reshape(-1)
