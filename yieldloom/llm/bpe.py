"""Token ids of whole texts, equal to those of the tokenizers library, with each distinct word encoded once.

A text is cut before blanks and line ends, where no pre-token of the two kinds of vocabulary known here can span the cut.
Arrow finds the distinct chunks of a batch and parts words from line ends and final marks; only words not met before go to
the library. With a vocabulary whose normalizer or pre-tokenizer is of another kind, whole texts go to the library.
"""

from __future__ import annotations

import gc
import json
import re
import string
import threading
import time
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers; beyond it, only those of the last slice of texts. It bounds its memory.
CACHE_WORDS = 250_000

#: White space of any kind, for RE2.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_WORD = rf"\A ?{_LETTERS}\z"
#: A run of these after a word is one pre-token.
_MARKS = string.punctuation
IDLE_SECONDS = 4
_encoders: dict[str, "Encoder"] = {}
_lock, _users, _last = threading.Lock(), 0, [0.0]

# The normalizers and pre-tokenizers whose pre-tokens never span a cut.
_BYTE_KIND = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_WORD_KIND = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else the next code point from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in visible}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


def _kind(path: str) -> str:
    """byte, word, or nothing for a vocabulary whose texts can't be cut in this way."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = spec.get("normalizer"), spec.get("pre_tokenizer")
    plain = spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")
    for t in spec.get("added_tokens") or []:  # they are found before texts are cut into pre-tokens
        plain = plain and not (re.search(r"\s", t["content"]) or re.fullmatch(rf"(?:{_LETTERS})?[{re.escape(_MARKS)}]*", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"])
    return ("byte" if parts == _BYTE_KIND else "word" if parts == _WORD_KIND else "") if plain else ""


class _Known:
    """Id lists in one growing array. Entry 0 is the empty list."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n, self.ids = 1, 0

    def add(self, names: list[str], lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        new = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
        while self.n + len(names) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.ids + len(new) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.starts[self.n : self.n + len(names)] = self.ids + np.cumsum(sizes) - sizes
        self.lengths[self.n : self.n + len(names)] = sizes
        self.flat[self.ids : self.ids + len(new)] = new
        self.at.update(zip(names, range(self.n, self.n + len(names)), strict=True))
        self.n, self.ids = self.n + len(names), self.ids + len(new)

    def only(self, names: list[str]) -> None:
        """Forget all but these."""
        old, entries = self.at, np.array([self.at[x] for x in names], np.int64)
        flat, sizes = _gather(self.flat, self.starts, self.lengths, entries)
        del old
        ends = np.cumsum(sizes).tolist()
        ids = flat.tolist()
        self.__init__()
        self.add(names, [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the lists of the entries one after another, their lengths), by steps that bound what is held besides."""
    sizes = lengths[entries]
    out, at = np.empty(int(sizes.sum()), np.uint32), 0
    for k in range(0, len(entries), 1 << 18):
        n = sizes[k : k + (1 << 18)]
        ends = np.cumsum(n)
        total = int(ends[-1])
        places = np.repeat(starts[entries[k : k + (1 << 18)]] - (ends - n), n)
        places += np.arange(total)
        np.take(flat, places, out=out[at : at + total])
        at += total
    return out, sizes


class Encoder:
    """encode() gives the ids of many texts as one flat array and the place where each text starts."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = _kind(path)
        added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = rf"{_WS}(?:{added})|(?:{added}){_WS}" if added else None
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.spelled = {c: "".join(self.letters[b] for b in chr(c).encode()) for c in range(128, 256)}
        self.known = _Known()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _lists(self, names: list[str], plain: list[bool]) -> list[list[int]]:
        tokenize, spelled = self.model.tokenize, self.spelled
        return [[t.id for t in tokenize(x)] if p else self._whole(x[1:]) if x[0] == "\0" else [t.id for t in tokenize(x.translate(spelled))] for x, p in zip(names, plain, strict=True)]

    def _entries(self, names: list[str], plain: np.ndarray) -> np.ndarray:
        """The entry of each name as in _chunks; unknown ones are encoded. plain: of those that the model spells as they are."""
        out = np.fromiter(map(self.known.at.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(out < 0)
        for k in range(0, len(new), 1 << 14):
            part = new[k : k + (1 << 14)]
            fresh = [names[i] for i in part.tolist()]
            out[part] = np.arange(self.known.n, self.known.n + len(fresh))
            self.known.add(fresh, self._lists(fresh, plain[part].tolist()))
        return out

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct chunks one after another, how many each has)."""
        size = lambda x: pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
        truth = lambda x: x.to_numpy(zero_copy_only=False)
        body = chunks if self.kind == "word" else pc.utf8_ltrim(chunks, characters="\n")
        word = pc.utf8_rtrim(body, characters=_MARKS)
        tail, lead = size(body) - size(word), size(chunks) - size(body)
        simple = truth(pc.match_substring_regex(word, _WORD)) & (lead <= 1)
        ascii_ = truth(pc.string_is_ascii(word)) & simple
        # A word is named as its vocabulary spells it; what isn't a word has a mark before it that no chunk holds.
        word = pc.utf8_lower(word) if self.kind == "word" else pc.replace_substring(word, " ", self.letters[32])
        other = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), chunks, pa.scalar("", pa.large_string()))
        names = pc.if_else(pa.array(simple), word, other).dictionary_encode()
        places = names.indices.to_numpy()
        distinct = names.dictionary.to_numpy(zero_copy_only=False).tolist()
        plain = np.zeros(len(distinct), bool)
        plain[places] = ascii_
        if len(self.known.at) > CACHE_WORDS:
            self.known.only([x for x in distinct if x in self.known.at])
        own = self._entries(distinct, plain)[places]
        newline = self._entries([self.letters[10]], np.ones(1, bool))[0] if self.kind == "byte" else 0
        ended = np.zeros(len(chunks), np.int64)
        marked = np.flatnonzero(simple & (tail > 0))
        if len(marked):
            ends = [c[-n:] for c, n in zip(chunks.take(pa.array(marked)).to_numpy(zero_copy_only=False), tail[marked].tolist(), strict=True)]
            runs = {x: i for i, x in enumerate(dict.fromkeys(ends))}
            ended[marked] = self._entries([*runs], np.ones(len(runs), bool))[[runs[x] for x in ends]]
        entries = np.stack([np.where(simple & (lead == 1), newline, 0), own, ended], axis=1)
        flat, sizes = _gather(self.known.flat, self.known.starts, self.known.lengths, entries.ravel())
        return flat, sizes.reshape(-1, 3).sum(axis=1)

    def _split(self, texts: pa.Array):
        if self.kind == "word":
            return pc.ascii_split_whitespace(texts)
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n"), "\0")

    def _uneasy(self, texts: pa.Array) -> np.ndarray:
        """Texts in which a cut could change the ids: long or final runs of white space, also beside an added token, which the library
        takes out first, or the mark of a cut."""
        if not self.kind:
            return np.ones(len(texts), bool)
        found = pc.match_substring(texts, "\0")
        if self.kind == "byte":
            found = pc.or_(found, pc.match_substring_regex(texts, rf"{_WS}{{3}}|{_WS}{{2}}\z"))
        if self.added:
            found = pc.or_(found, pc.match_substring_regex(texts, self.added))
        return found.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        uneasy = self._uneasy(texts)
        whole = {int(i): self._whole(texts[int(i)].as_py()) for i in np.flatnonzero(uneasy)}
        if whole:
            texts = pc.if_else(pa.array(uneasy), pa.scalar("", pa.large_string()), texts)
        lists = self._split(texts)
        ends = lists.offsets.to_numpy().astype(np.int64)
        chunks = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        del lists
        ends = ends - ends[0]
        of, places = self._chunks(chunks.dictionary) if len(chunks.dictionary) else (np.zeros(1, np.uint32), np.zeros(0, np.int64)), chunks.indices.to_numpy()
        flat, sizes = _gather(of[0], np.cumsum(of[1]) - of[1], of[1], places)
        starts = np.concatenate([[0], np.cumsum(sizes)])[ends]
        if whole:
            parts = [np.asarray(whole[i], np.uint32) if i in whole else flat[starts[i] : starts[i + 1]] for i in range(len(starts) - 1)]
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
            flat = np.concatenate(parts) if parts else flat
        return flat, starts

    def encode_ended(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with the id `end` after each text."""
        flat, starts = self.encode(texts)
        return np.insert(flat, starts[1:], np.uint32(end)), starts + np.arange(len(starts))


@contextmanager
def encoder(path: str) -> Iterator[Encoder]:
    """The worker's encoder for a vocabulary; its tasks share what it remembers. A worker that has had no such task for
    IDLE_SECONDS forgets all, as idle workers stay alive beside those of later stages."""
    global _users
    with _lock:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        found, _users = _encoders[path], _users + 1
    try:
        yield found
    finally:
        with _lock:
            _users -= 1
            timer = threading.Timer(IDLE_SECONDS, _forget, [time.monotonic()])
            timer.daemon = True
            _last[0] = time.monotonic()
            timer.start()


def _forget(since: float) -> None:
    with _lock:
        if _users or _last[0] > since + 1:
            return
        _encoders.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
