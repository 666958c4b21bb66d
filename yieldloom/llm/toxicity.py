"""Toxicity by a subsequence string-kernel support vector machine.

A text is as toxic as its few most toxic units: words, lower-cased, without marks inside them, or runs of three or more single
letters put together. A unit's value is a linear function of its subsequence-kernel similarities to a few landmark strings
(Nyström features), so units with gaps or inserted letters stay near the insults they hide. Labels are of whole texts:
training starts from each toxic text's most telling unit and alternates between fitting the machine and choosing, in each
toxic text, the unit of highest value (units of clean texts are all negative). A text counts as toxic if its highest value reaches one limit or its second highest
another, lower one; the limits are chosen by values that machines of other parts of the sample give.

Learning reads a bounded sample: SAMPLE labelled rows of each class of at most SAMPLE_CHARS characters, first by a hash.

Defined results: a null or unit-less text scores as one with nothing toxic; rows without a doc_id are scored, count as not
held out and are not learned from; several labels of one doc_id count as toxic if one does; null labels are ignored;
without both classes every score is 0; an empty table yields no row; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.llm import strings
from yieldloom.llm.common import by_hash, slices, text_of
from yieldloom.llm.language import held_out

SAMPLE, SAMPLE_CHARS = 1000, 20_000
LANDMARKS = 40
#: Toxic texts that have a piece at least, and what its log-likelihood ratio must have above that of chance.
LEAST, MARGIN = 3, 2.0
#: Times as usual in toxic texts as in clean ones, at least, must a landmark be.
PRECISION = 25
NEGATIVES, RIDGE = 8000, 2e-4
#: Times that the machine is fitted and units are chosen again.
ROUNDS = 4
#: A text's score is of so many of its units, those of highest value; values below FLOOR count as that.
TOP, FLOOR, SLOPE = 2, -1.0, 4.0
#: Parts at most that the sample is cut into to learn the limits (fewer, larger ones of a large sample), and how many times a share of toxic texts missed a share of clean ones costs.
FOLDS, COST = 4, 14
#: Units that a worker remembers before it starts anew.
CACHE_UNITS = 500_000
#: What parts chunks, in learning as in scoring: ASCII white space.
_BLANK = "[\t-\r ]"
_SPELLED = rf"(?:^|{_BLANK})\pL(?:{_BLANK}+\pL){{2,}}(?:{_BLANK}|$)"
_RUN = re.compile(rf"(?<![^\t-\r ])[^\W\d_](?:{_BLANK}+[^\W\d_]){{2,}}(?![^\t-\r ])")
#: Values of units by model, for all tasks of a worker.
_known: dict[bytes, dict[str, float]] = {}


class Model(NamedTuple):
    """limits: of the highest, second and so on of a text's values. The score is 0.7 where one of them reaches its limit."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    limits: np.ndarray


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(the unit of each chunk, where each text's chunks begin and the end, the distinct units). A unit is a chunk's letters and
    digits between ^ and $, so that a kernel sees the ends; it is empty for a chunk without any."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    ends = lists.offsets.to_numpy().astype(np.int64)
    found = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    inner = pc.replace_substring_regex(pc.utf8_lower(found.dictionary), r"[^\p{L}\p{N}]+", "").dictionary_encode()
    return inner.indices.to_numpy()[found.indices.to_numpy()], ends - ends[0], [f"^{x}$" if x else "" for x in inner.dictionary.to_pylist()]


def spelled(text: str) -> list[str]:
    """Runs of single letters, put together."""
    return [f"^{''.join(m[0].split()).lower()}$" for m in _RUN.finditer(text)]


def units_of(texts: pa.Array) -> list[list[str]]:
    """The distinct units of each text, runs of single letters included."""
    of, ends, names = units(texts)
    runs = {i: spelled(texts[i].as_py()) for i in pc.indices_nonzero(pc.match_substring_regex(texts, _SPELLED)).to_pylist()}
    return [sorted({u for u in (names[k] for k in np.unique(of[a:b])) if u} | set(runs.get(i, ()))) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]


def values(model: Model, units: list[str], marks: strings.Landmarks | None = None) -> np.ndarray:
    """A unit's value: the highest of its windows."""
    parts = [strings.windows(u) for u in units]
    flat = strings.similarities([p for ps in parts for p in ps], strings.Landmarks(model.landmarks) if marks is None else marks) @ model.weights + model.bias
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    return np.maximum.reduceat(flat, starts) if len(units) else np.zeros(0)


_SIZES = (4, 5, 6, 7, 8, 10)


class _Grams(NamedTuple):
    """All pieces of strings: a hash of each, the string that it is of, and where it is in all of them put together."""

    hashes: np.ndarray
    of: np.ndarray
    places: np.ndarray
    sizes: np.ndarray


def _grams(names: list[str]) -> _Grams:
    code = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(names)), np.fromiter(map(len, names), np.int64, len(names)))
    rolling, found = np.zeros(len(code), np.uint64), []
    for n in range(1, min(max(_SIZES), len(code)) + 1):
        rolling = rolling[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(1)
        if n in _SIZES:
            at = np.flatnonzero(of[: len(rolling)] == of[n - 1 :])
            found.append((rolling[at] ^ np.uint64(n), of[at], at, np.full(len(at), n)))
    return _Grams(*(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 4)))


class _Lists:
    """Lists of numbers of different lengths, in one array."""

    def __init__(self, of: np.ndarray, items: np.ndarray, n: int):
        """of: the list of each item, ascending."""
        self.items, self.starts = items, np.searchsorted(of, np.arange(n + 1))

    def joined(self, rows: np.ndarray) -> np.ndarray:
        """The items of these lists, one after another."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        return self.items[np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def distinct(self, rows: np.ndarray) -> np.ndarray:
        return np.unique(self.joined(rows))


def _told(names: list[str], hashes: np.ndarray) -> _Lists:
    """Which of the pieces with these hashes (ascending) each string has."""
    grams = _grams(names)
    at = np.minimum(np.searchsorted(hashes, grams.hashes), max(0, len(hashes) - 1))
    same = np.flatnonzero(hashes[at] == grams.hashes) if len(hashes) else np.zeros(0, np.int64)
    pairs = np.unique(grams.of[same] * max(1, len(hashes)) + at[same])
    return _Lists(pairs // max(1, len(hashes)), pairs % max(1, len(hashes)), len(names))


def _surprise(k: np.ndarray, s: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Log-likelihood ratio of a piece that k toxic and s clean texts have; 0 unless it is more usual in toxic ones."""
    share = toxic / (toxic + clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (k * np.log(k / ((k + s) * share)) + np.where(s > 0, s * np.log(s / ((k + s) * (1 - share))), 0))
    return np.where(k * clean > 2 * s * toxic, g, 0)


def _landmarks(toxic: list[list[str]], clean: list[list[str]]) -> tuple[list[str], dict[str, float]]:
    """Strings that tell toxic texts from clean ones, and how telling each piece is. The most telling piece is chosen again
    and again, each time without the units that hold one chosen before, so no landmark says what others have said.
    A piece tells something if its log-likelihood ratio is beyond what the best of so many pieces would have by chance."""
    least = max(LEAST, len(toxic) // 100)
    names = sorted({u for us in toxic for u in us})
    index = {u: i for i, u in enumerate(names)}
    texts = [np.array([index[u] for u in us], np.int64) for us in toxic]
    usual = np.bincount(np.concatenate(texts), minlength=len(names))
    grams = _grams(names)
    # A piece is in no more texts than its units are.
    hashes, first, which = np.unique(grams.hashes, return_index=True, return_inverse=True)
    often = np.bincount(which, weights=usual[grams.of], minlength=len(hashes)) >= least
    hashes, first = hashes[often], first[often]
    whole = "".join(names)
    pieces = [whole[p : p + n] for p, n in zip(grams.places[first].tolist(), grams.sizes[first].tolist(), strict=True)]
    del grams, which
    parts = _told(names, hashes)
    left, has = texts, [parts.distinct(us) for us in texts]
    k = np.zeros(len(pieces))
    for ps in has:
        k[ps] += 1
    others = sorted({u for us in clean for u in us})
    index = {u: i for i, u in enumerate(others)}
    known, s = _told(others, hashes), np.zeros(len(pieces))
    for us in clean:
        s[known.distinct(np.array([index[u] for u in us], np.int64))] += 1
    enough = k >= least
    surprise = 2 * np.log(max(2, int(enough.sum()))) + MARGIN
    gains = np.where(enough, _surprise(k, s, len(toxic), len(clean)), 0)
    telling = {pieces[i]: float(gains[i]) for i in np.flatnonzero(gains > surprise).tolist()}
    rare = enough & (PRECISION * s * len(toxic) <= k * len(clean))
    rank = np.argsort(np.argsort(np.array(pieces or [""])))  # among equals the longest, then the first by name
    length, chosen = np.array([len(p) for p in pieces]), []
    while pieces and len(chosen) < LANDMARKS:
        gain = np.where(rare, _surprise(k, s, len(toxic), len(clean)), 0)
        best = int(np.lexsort((rank, -length, -gain))[0])
        if gain[best] <= surprise:
            break
        chosen.append(pieces[best])
        for i, ps in enumerate(has):
            at = int(np.searchsorted(ps, best))
            if at < len(ps) and ps[at] == best:
                left[i] = np.array([u for u in left[i].tolist() if best not in parts.items[parts.starts[u] : parts.starts[u + 1]]], np.int64)
                has[i] = parts.distinct(left[i])
                k[np.setdiff1d(ps, has[i], assume_unique=True)] -= 1
    return chosen, telling


def _svm(z: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared hinge loss with a small ridge, by accelerated gradient descent."""
    x = np.hstack([z, np.ones((len(z), 1))]).astype(np.float64)
    own = own / own.sum()
    rate = 1 / (2 * np.linalg.norm((x * own[:, None]).T @ x, 2) + RIDGE)
    w = p = np.zeros(x.shape[1])
    for k in range(600):
        slack = np.maximum(0, 1 - y * (x @ p))
        new = p + rate * (2 * x.T @ (own * y * slack) - RIDGE * np.append(p[:-1], 0))
        p, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


class _Machine(NamedTuple):
    landmarks: list[str]
    weights: np.ndarray
    bias: float
    value: dict[str, float]


def _machine(toxic: list[list[str]], clean: list[list[str]]) -> _Machine | None:
    """The value of units, and of all units of these texts."""
    marks, telling = _landmarks(toxic, clean)
    if not marks:
        return None
    prepared = strings.Landmarks(marks)
    basis = strings.similarities(marks, prepared).astype(np.float64)
    high, turn = np.linalg.eigh((basis + basis.T) / 2)
    root = turn[:, high > 1e-3] / np.sqrt(high[high > 1e-3])

    names = sorted({u for us in [*toxic, *clean] for u in us})
    index = {u: i for i, u in enumerate(names)}
    parts = [strings.windows(u) for u in names]
    sims = strings.similarities([w for ps in parts for w in ps], prepared)
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    # The window with the strongest landmark stands for a unit.
    order = np.lexsort((sims.max(axis=1), np.repeat(np.arange(len(names)), np.diff([*starts, len(sims)]))))
    sims = sims[order[np.append(starts[1:], len(sims)) - 1]]
    own = [np.array([index[u] for u in us]) for us in toxic]
    tell, grams = np.zeros(len(names)), _grams([*telling])
    whole = np.flatnonzero(grams.sizes == np.fromiter(map(len, telling), np.int64, len(telling))[grams.of])  # a piece's hash of itself
    order = np.argsort(grams.hashes[whole])
    said, gains = _told(names, grams.hashes[whole][order]), np.fromiter(telling.values(), float, len(telling))[grams.of[whole]][order]
    np.maximum.at(tell, np.repeat(np.arange(len(names)), np.diff(said.starts)), gains[said.items])
    seen = np.zeros(len(names), int)
    for us in clean:
        seen[[index[u] for u in us]] += 1
    usual = np.zeros(len(names), int)
    for us in own:
        usual[us] += 1
    bad = np.flatnonzero(seen)
    frequent = bad[np.argsort(-seen[bad], kind="stable")][: NEGATIVES // 2]
    # Besides a witness of each toxic text, units that only toxic texts have and that have a telling piece are positive.
    plain = np.flatnonzero((seen == 0) & (tell > 0))
    witness, value = np.array([us[tell[us].argmax()] for us in own]), tell
    # What a clean text has of highest value counts as much as what any other has, however usual the unit is.
    others, nearest = [np.array([index[u] for u in us]) for us in clean], np.zeros(len(names))
    for _ in range(ROUNDS):
        for us in others:
            nearest[us[value[us].argmax()]] += 1
        hard = bad[np.argsort(-value[bad], kind="stable")][: NEGATIVES // 2]
        negative = np.union1d(np.union1d(frequent, hard), np.flatnonzero(nearest))
        positive = np.concatenate([witness, plain])
        rows = np.concatenate([positive, negative])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.concatenate([np.ones(len(witness)) / len(witness), usual[plain] / max(1, usual[plain].sum()), 1 / len(negative) + 2 * nearest[negative] / nearest.sum()])
        w, b = _svm(sims[rows] @ root, y, weight)
        value = sims @ (root @ w) + b
        new = np.array([us[value[us].argmax()] for us in own])
        witness = new
    return _Machine(marks, (root @ w).astype(np.float32), b, dict(zip(names, value.tolist(), strict=True)))


def _top(values: list[float]) -> np.ndarray:
    """The highest values of a text's units, the highest first."""
    out = np.full(TOP, FLOOR)
    best = sorted(values, reverse=True)[:TOP]
    out[: len(best)] = np.maximum(best, FLOOR)
    return out


def _threshold(z: np.ndarray, y: np.ndarray, all_: np.ndarray) -> float:
    """Where most toxic texts are above and few clean ones are: a share of clean texts costs COST times that of toxic texts; shares are
    of all texts. In the middle between the two texts that it parts; in a wide gap at 1, where the machine wants toxic units to be,
    or as near to it as the lower text lets it."""
    order = np.argsort(-z, kind="stable")
    gain = np.cumsum(np.where(y[order] > 0, 1 / all_.sum(), -COST / (len(all_) - all_.sum())))
    gain[:-1][z[order][:-1] == z[order][1:]] = -np.inf
    best = int(gain.argmax())
    if gain[best] <= 0 or z[order[best]] <= FLOOR:
        return float(max(z.max(), 1.0)) + 1
    high, low = float(z[order[best]]), float(z[order[min(best + 1, len(z) - 1)]])
    return min((low + high) / 2, max(1.0, low + (high - low) / 10))


def fit(toxic: list[list[str]], clean: list[list[str]]) -> Model | None:
    """toxic, clean: the units of each text. How values become a score is learned from texts that the machine hasn't seen: each of
    some parts of the texts is valued by a machine of the others."""
    toxic, clean = [us for us in toxic if us], [us for us in clean if us]
    if not toxic or not clean:
        return None
    own = _machine(toxic, clean)
    if own is None:
        return None
    tops, y, folds = [], [], min(FOLDS, max(2, 400 // len(toxic)))
    for fold in range(folds if folds > 2 else 1):  # half of a large sample tells enough
        rest = [[us for k, us in enumerate(part) if k % folds != fold] for part in (toxic, clean)]
        seen = _machine(*rest) if all(rest) else None
        for label, part in ((1.0, toxic[fold::folds]), (0.0, clean[fold::folds])):
            new = sorted({u for us in part for u in us})
            known = dict(zip(new, values(Model(seen.landmarks, seen.weights, seen.bias, np.zeros(TOP)), new).tolist(), strict=True)) if seen else {}
            tops += [_top([known.get(u, FLOOR) for u in us]) for us in part]
            y += [label] * len(part)
    x, y, limits = np.array(tops), np.array(y), []
    left = np.ones(len(y), bool)
    for k in range(TOP):  # one unit of a high value is enough, or two of a lower one
        limits.append(_threshold(x[left, k], y[left], y) if left.any() else np.inf)
        left &= x[:, k] < limits[k]
    return Model(own.landmarks, own.weights, own.bias, np.array(limits))


def learn(docs: DataFrame, labels: DataFrame, usable: Column) -> Model | None:
    """usable: a condition on doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mixed = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    counts = {r["toxic"]: r["n"] for r in known.filter("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    picks = [known.filter((F.col("toxic") == k) & by_hash(2 * SAMPLE / counts.get(k, 1), "doc_id")).orderBy(mixed, "doc_id").limit(SAMPLE) for k in (0, 1)]
    chosen = picks[0].unionByName(picks[1])  # 2 x SAMPLE rows at most
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(chosen), "doc_id").filter(F.char_length("text") <= SAMPLE_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(units_of(batch.column("text")), pa.list_(pa.string()))], ["doc_id", "toxic", "units"])

    got = rows.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, units array<string>").toArrow().sort_by("doc_id")
    by: dict[int, list] = {0: [], 1: []}
    for toxic, units in zip(got.column("toxic").to_pylist(), got.column("units").to_pylist(), strict=True):
        by[int(toxic == 1)].append(units)
    return fit(by[1], by[0])


def text_scores(model: Model, marks: strings.Landmarks, text: pa.Array, of: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """of, ends: as units() gives them; value: of each distinct unit."""
    # Few units are above the floor: of these, the distinct ones of each text, the highest first.
    hot = np.flatnonzero(value[of] > FLOOR)
    row = np.searchsorted(ends, hot, side="right") - 1
    pairs = np.unique(row * max(1, len(value)) + of[hot])
    row, unit = pairs // max(1, len(value)), pairs % max(1, len(value))
    order = np.lexsort((-value[unit], row))
    row, unit = row[order], unit[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    top = np.full((len(text), TOP), FLOOR)
    some = place < TOP
    top[row[some], place[some]] = value[unit[some]]
    for i in pc.indices_nonzero(pc.match_substring_regex(text, _SPELLED)).to_pylist():
        if runs := sorted({u for u in spelled(text[i].as_py())}):
            top[i] = _top([*top[i].tolist(), *values(model, runs, marks).tolist()])
    above = (top - model.limits).max(axis=1)
    return 1 / (1 + np.exp(-np.clip(SLOPE * above + np.log(0.7 / 0.3), -30, 30)))


def rate(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score of docs' doc_id, held_out and text."""
    if model is None:
        return docs.select("doc_id", "held_out", F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = model.weights.tobytes() + repr(model.landmarks).encode()
        if token not in _known:
            _known.clear()
        known, marks = _known.setdefault(token, {}), strings.Landmarks(model.landmarks)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                text = part.column("text")
                of, ends, names = units(text)
                if len(known) > CACHE_UNITS:
                    known.clear()
                new = [u for u in names if u not in known and len(u) >= strings.ORDER]
                known.update(zip(new, values(model, new, marks).tolist(), strict=True))
                score = text_scores(model, marks, text, of, ends, np.array([known.get(u, FLOOR) for u in names] or [FLOOR]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double")


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted. Learns from labels of rows that are not held out."""
    model = learn(docs, labels, ~held_out(3, 1))
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("held_out", held_out(3, 1))
    return rate(rows, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
