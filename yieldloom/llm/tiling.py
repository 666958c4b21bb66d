"""Greedy string tiling of two token sequences by running Karp-Rabin."""

from __future__ import annotations

from collections import defaultdict

_MOD, _BASE = (1 << 61) - 1, 1_000_003


def _windows(tokens: list[int], free: list[bool], size: int):
    """(position, rolling hash) of each window of unmarked tokens."""
    top, h, run = pow(_BASE, size, _MOD), 0, 0
    for i, t in enumerate(tokens):
        if not free[i]:
            h = run = 0
            continue
        h, run = (h * _BASE + t) % _MOD, run + 1
        if run > size:
            h = (h - tokens[i - size] * top) % _MOD
        if run >= size:
            yield i - size + 1, h


def tile(text: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """(place in text, place in item, length) of tiles of at least `least` tokens, longest first found first marked.

    No token is in two tiles, so coverage counts each token of the item once, in whatever order the text has its parts.
    """
    free_text, free_item, tiles = [True] * len(text), [True] * len(item), []
    size = max(least, min(len(text), len(item), 4 * least))
    while True:
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        table = defaultdict(list)
        for i, h in _windows(item, free_item, size):
            table[h].append(i)
        longest = 0
        for d, h in _windows(text, free_text, size):
            for i in table.get(h, ()):
                if d and i and free_text[d - 1] and free_item[i - 1] and text[d - 1] == item[i - 1]:
                    continue  # part of the match that begins one earlier
                k = 0
                while d + k < len(text) and i + k < len(item) and text[d + k] == item[i + k] and free_text[d + k] and free_item[i + k]:
                    k += 1
                if k >= size:
                    found[k].append((d, i))
                    longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        for k in sorted(found, reverse=True):
            for d, i in found[k]:
                if all(free_text[d : d + k]) and all(free_item[i : i + k]):
                    free_text[d : d + k] = free_item[i : i + k] = [False] * k
                    tiles.append((d, i, k))
        if longest:
            continue  # what marks have cut may still hold matches of this size
        if size == least:
            return tiles
        size = max(least, size // 2)
