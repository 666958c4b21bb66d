"""Language identification by error-correcting output codes.

Each language has a codeword of bits; a linear classifier over hashed byte n-grams predicts each bit. A text's language is
the one whose codeword has the least loss, each bit's loss weighted by how well its classifier does on that language.
A text is ambiguous if the second language's loss is close to the first's.

Learning reads a bounded sample: about SAMPLE labelled rows, spread evenly over languages and chosen by a hash of doc_id.

Defined results: a text that is null or has no letter is `und` with score 0 and not ambiguous; rows with a null doc_id are
predicted, count as not held out and are never learned from; a null lang is never learned; without a labelled row every
text is `und`; repeated rows are each predicted; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.llm import ngrams
from yieldloom.llm.common import slices, small_batches, text_of

SAMPLE = 1600
EPOCHS = 300
#: Of the two best languages' shares of belief; below it a text is ambiguous.
MARGIN = 0.02
UNDETERMINED = "und"


class Model(NamedTuple):
    langs: list[str]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to 1
    sharpness: float


def codewords(n: int) -> np.ndarray:
    """Up to six languages: every way to part them in two. More: the random code, of some tried, with the largest least distance."""
    if n <= 6:
        bits = [[1 if k == 0 or (cut >> (k - 1)) & 1 else -1 for k in range(n)] for cut in range(2 ** (n - 1) - 1)]
        return np.array(bits, np.float64).reshape(-1, n).T
    rng, width, best = np.random.default_rng(8), int(np.ceil(10 * np.log2(n))), (-1, None)
    for _ in range(60):
        codes = rng.choice([-1.0, 1.0], (n, width))
        codes = codes[:, np.abs(codes.sum(axis=0)) < n]
        least = min((int((codes[i] != codes[j]).sum()) for i in range(n) for j in range(i)), default=0)
        if least > best[0]:
            best = (least, codes)
    return best[1]


def _logistic(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias for each column of y (-1 or 1) by accelerated gradient descent; own: each row's weight."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    pw, pb, rate = w.copy(), b.copy(), 0.5 / max(1e-9, float(np.einsum("ij,ij->i", x, x).mean()))
    for k in range(EPOCHS):
        z = x @ pw + pb
        g = (own[:, None] * y / (1 + np.exp(np.clip(y * z, -30, 30)))).astype(np.float32)
        nw, nb = pw + rate * (x.T @ g) - 1e-5 * rate * pw, pb + g.sum(axis=0) * min(rate, 1.0)
        m = k / (k + 3)
        pw, pb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def sample(docs: DataFrame, usable: Column, size: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, scaled bucket shares) of about `size` rows, as many of each language where there are."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return [], np.zeros((0, ngrams.BUCKETS), np.float32)
    each = size / len(counts)
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])[F.col("lang")]

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for i in range(part.num_rows):
                    row = ngrams.frequencies(part.column("text").slice(i, 1))[0]
                    at = np.flatnonzero(row)
                    yield pa.RecordBatch.from_arrays([part.column("lang").slice(i, 1), pa.array([at.astype(np.int32)]), pa.array([row[at]])], ["lang", "at", "share"])

    # A row is at most BUCKETS numbers, however long its text.
    got = text_of(rows.filter(share < limit), "lang").mapInArrow(shares, "lang string, at array<int>, share array<float>").toArrow()
    x = np.zeros((got.num_rows, ngrams.BUCKETS), np.float32)
    for row, at, values in zip(x, got.column("at"), got.column("share"), strict=True):
        row[np.asarray(at.values)] = np.asarray(values.values)
    x *= np.sqrt(ngrams.BUCKETS)
    return got.column("lang").to_pylist(), x


def fit(names: list[str], x: np.ndarray) -> Model:
    langs = sorted(set(names))
    if len(langs) < 2:
        return Model(langs, np.ones((len(langs), 1)), np.zeros((ngrams.BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones((len(langs), 1)), 1.0)
    codes = codewords(len(langs))
    of = np.array([langs.index(n) for n in names])
    own = 1 / np.bincount(of)[of] / len(langs)
    w, b = _logistic(x, codes[of], own)
    right = (x @ w + b) * codes[of]
    trust = np.stack([(right[of == k] > 0).mean(axis=0) for k in range(len(langs))]) + 1e-3
    trust /= trust.sum(axis=1, keepdims=True)
    return Model(langs, codes, np.ascontiguousarray(w * np.sqrt(ngrams.BUCKETS), np.float32), b, trust, 4.0)


def learn(docs: DataFrame, usable: Column, size: int = SAMPLE) -> Model:
    return fit(*sample(docs, usable, size))


def decode(model: Model, margins: np.ndarray) -> np.ndarray:
    """Each language's share of belief, from the weighted loss of its codeword."""
    loss = np.stack([(np.logaddexp(0, -margins * code) * own).sum(axis=1) for code, own in zip(model.codes, model.trust, strict=True)], axis=1)
    belief = np.exp(-model.sharpness * (loss - loss.min(axis=1, keepdims=True)))
    return belief / belief.sum(axis=1, keepdims=True)


def classify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of `keep`, lang_pred, score (0 to 1) and ambiguous."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    names = [f.name for f in docs.schema if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*model.langs, UNDETERMINED], object)
        for batch in batches:
            for part in slices(batch, "__text"):
                text = part.column("__text")
                letters = pc.match_substring_regex(text, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
                if not model.langs:
                    best, score, unsure = np.full(part.num_rows, -1), np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                else:
                    belief = decode(model, ngrams.weigh(text, model.weights) + model.bias)
                    best = np.where(letters, belief.argmax(axis=1), -1)
                    top = -np.sort(-belief, axis=1)
                    score = np.where(letters, top[:, 0], 0.0)
                    unsure = letters & (len(model.langs) > 1) & (top[:, 0] - (top[:, 1] if top.shape[1] > 1 else 0) < MARGIN)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(langs[best], pa.string()), pa.array(score), pa.array(unsure)], [*names, "lang_pred", "score", "ambiguous"])

    return docs.select(*names, F.col("text").alias("__text")).mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) has that remainder; a null doc_id has none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous. Learns from rows that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out(5, 0))
    model = learn(docs, ~F.col("held_out"))
    return classify(docs, model, ["doc_id", "held_out"])


def accepted(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that have a language: neither `und` nor ambiguous. If no language could be
    learned, those with a letter."""
    model = learn(docs, ~held_out(5, 0))

    small_batches(docs.sparkSession)

    # Only the text goes to Python, and a flag comes back.
    @F.arrow_udf("boolean")
    def good(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            found = pc.match_substring_regex(text, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            if len(model.langs) > 1:
                top = -np.sort(-decode(model, ngrams.weigh(text, model.weights) + model.bias), axis=1)
                found = found & (top[:, 0] - top[:, 1] >= MARGIN)
            yield pa.array(found)

    return docs.filter(good("text"))
