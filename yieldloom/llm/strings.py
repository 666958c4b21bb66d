"""Gap-weighted subsequence kernel of short strings, for many strings and landmarks at once."""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

#: Letters of a subsequence, and the weight of each letter it spans.
ORDER, DECAY = 3, 0.6
#: Longer strings are scored by windows of this length, half of which overlaps.
WINDOW = 16


def codes(strings: list[str], width: int, filler: int) -> np.ndarray:
    if all(len(s) == width for s in strings):
        return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32).reshape(-1, width)
    out = np.full((len(strings), width), filler, np.int32)
    for i, s in enumerate(strings):
        out[i, : len(s)] = [*map(ord, s)]
    return out


def _kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left: strings x letters, all of one length; right: strings x others x letters (1 string there: the same for all)."""
    n, (_, others, width) = left.shape, right.shape
    decay = np.array([[DECAY ** (t - s) if t >= s else 0 for t in range(width)] for s in range(width)], np.float32)
    held = [np.ones((n[0], others, width + 1), np.float32)] + [np.zeros((n[0], others, width + 1), np.float32) for _ in range(ORDER - 1)]
    total, ones = np.zeros((n[0], others), np.float32), np.ones(width, np.float32)
    for s in range(n[1]):
        same = (left[:, s, None, None] == right).astype(np.float32) * np.float32(DECAY**2)
        met = [(same * h[:, :, :-1]).reshape(-1, width) for h in held]
        total += (met[-1] @ ones).reshape(total.shape)
        new = [np.float32(DECAY) * held[i][:, :, 1:] + (met[i - 1] @ decay).reshape(same.shape) for i in range(1, ORDER)]
        for i, x in enumerate(new, 1):
            held[i][:, :, 1:] = x
    return total


class Landmarks:
    """Strings prepared for similarities(): the kernel with one of them is a sum over its subsequences of ORDER letters, so a
    string's subsequences are looked up among those of all landmarks. Most have none in common and cost no more than that."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        letters = sorted({c for s in strings for c in s})
        self.size = len(letters) + 1  # 0 stands for all letters that no landmark has
        self.letter = {ord(c): i + 1 for i, c in enumerate(letters)}
        sums: dict[int, dict[int, float]] = {}
        for k, s in enumerate(strings):
            code = self._codes(np.array([[self.letter[ord(c)] for c in s]]))[0]
            for c, w in zip(code.tolist(), _spans(len(s))[1].tolist(), strict=True):
                own = sums.setdefault(c, {})
                own[k] = own.get(k, 0.0) + w
        self.row = np.zeros(self.size**ORDER, np.int32)
        self.weights = np.zeros((len(sums) + 1, len(strings)), np.float32)
        for i, (code, own) in enumerate(sums.items(), 1):
            self.row[code] = i
            self.weights[i, [*own]] = [*own.values()]
        self.own = np.array([float(_kernel(codes([s], len(s), -1), codes([s], len(s), -1)[None])[0, 0]) for s in strings], np.float32)

    def _codes(self, letters: np.ndarray) -> np.ndarray:
        places, _ = _spans(letters.shape[1])
        out = letters[:, places[0]]
        for at in places[1:]:
            out = out * self.size + letters[:, at]
        return out

    def kernels(self, left: np.ndarray) -> np.ndarray:
        """left: strings x letters, all of one length."""
        out = np.zeros((len(left), len(self.strings)), np.float32)
        distinct, at = np.unique(left, return_inverse=True)
        mapped = np.array([self.letter.get(int(c), 0) for c in distinct], np.int64)[at.reshape(left.shape)]
        rows = self.row[self._codes(mapped)]
        which, place = np.nonzero(rows)
        if len(which):
            first = np.flatnonzero(np.diff(which, prepend=-1))
            out[which[first]] = np.add.reduceat(self.weights[rows[which, place]] * _spans(left.shape[1])[1][place, None], first, axis=0)
        return out


@functools.cache
def _spans(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of all subsequences of ORDER letters among n, one row for each letter; DECAY to the letters they span)."""
    places = np.array([*combinations(range(n), ORDER)], np.int64).reshape(-1, ORDER).T
    return places, (np.float32(DECAY) ** (places[-1] - places[0] + 1)).astype(np.float32)


def similarities(strings: list[str], landmarks: Landmarks) -> np.ndarray:
    """Squared normalised kernel (0 to 1) of each string, of at most WINDOW letters, with each landmark."""
    out = np.zeros((len(strings), len(landmarks.strings)), np.float32)
    sizes = np.array([len(s) for s in strings])
    for size in np.unique(sizes[sizes >= ORDER]):
        rows = np.flatnonzero(sizes == size)
        step = max(64, 100_000 // len(_spans(int(size))[1]))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            left = codes([strings[i] for i in part], int(size), -1)
            kernel = landmarks.kernels(left)
            some = np.flatnonzero(kernel.any(axis=1))
            if len(some):
                norm = np.maximum(_kernel(left[some], left[some][:, None, :])[:, :1] * landmarks.own[None], 1e-30)
                out[part[some]] = kernel[some] ** 2 / norm
    return out


def windows(string: str) -> list[str]:
    if len(string) <= WINDOW:
        return [string]
    step = WINDOW // 2
    return [string[k : k + WINDOW] for k in range(0, len(string) - step, step)]
