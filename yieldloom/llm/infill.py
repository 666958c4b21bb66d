"""Fill-in-the-middle transformation: a document's text as prefix, suffix and middle behind markers, in one of two orders.

A task's texts are cut together, on the UTF-8 bytes of an Arrow batch: bytes are looked up as white space or not; a token ends where
a byte that isn't white space is followed by one that is, and at the end of a text; running sums of these ends, less the sum at the
text's own beginning, number the tokens of each text; a binary search in the sums gives both cuts of all texts at once. Prefix,
middle and suffix are then three neighbouring strings over the same bytes, which Arrow takes and joins without a loop over rows.

What is drawn at random comes from the SHA-256 of seed and doc_id, so a task that runs again gives the same rows, whatever the
partitioning. Nothing is shuffled.

Defined results: a null text is the empty one, which stays plain with no token; a text that has a marker stays plain, so that a
transformed text has three markers and can be taken apart; a null doc_id is written as no digits; rows that repeat a doc_id are
drawn alike; of one very long text about nine bytes a byte are held at once; an empty table yields no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import slices, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_ANY = "<P>|<S>|<M>"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

ORACLE_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, array_to_string(list_slice(w, 1, a), '') AS p, array_to_string(list_slice(w, a + 1, b), '') AS m, array_to_string(list_slice(w, b + 1, n), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256 FROM p"""


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the texts' bytes, n + 1 places where they begin and end)."""
    large = texts.cast(pa.large_string())
    at = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    return np.frombuffer(large.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _sums(mask: np.ndarray) -> np.ndarray:
    """Running sums, a zero before them."""
    out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def transform_batch(texts: pa.Array, draws: np.ndarray, rate: int, suffix_first: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of texts without nulls; draws: four unsigned numbers a text."""
    data, at = _bytes(texts)
    space = _SPACE[data]
    ends = ~space
    ends[:-1] &= space[1:]
    ends[at[1:][at[1:] > at[:-1]] - 1] = True
    sums = _sums(ends)
    n = (sums[at[1:]] - sums[at[:-1]]).astype(np.int64)
    marked = pc.match_substring_regex(texts, _ANY).to_numpy(zero_copy_only=False)
    plain = (at[1:] == at[:-1]) | marked | (draws[:, 2] % 100 >= rate)
    first = ~plain & (draws[:, 3] % 100 < suffix_first)
    units = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    units[plain] = 0  # a plain text is all suffix
    cut = np.searchsorted(sums, (sums[at[:-1]][:, None] + units).astype(sums.dtype))  # the first place with so many ends before it
    cut = np.where(units == 0, at[:-1][:, None], cut)
    chars = _sums((data & 0xC0) != 0x80)
    counts = (chars[cut] - chars[np.column_stack([at[:-1], cut[:, 0]])]).astype(np.int64)

    places = np.append(np.column_stack([at[:-1], cut]).ravel(), at[-1])
    parts = pa.Array.from_buffers(pa.large_string(), 3 * len(texts), [None, pa.py_buffer(np.ascontiguousarray(places, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    row = 3 * np.arange(len(texts))
    part = lambda k: parts.take(pa.array(row + k))
    marks = lambda a, b: pc.if_else(pa.array(plain), "", pc.if_else(pa.array(first), a, b)).cast(pa.large_string())
    output = pc.binary_join_element_wise(marks(SUFFIX, PREFIX), part(2 * first), marks(PREFIX, SUFFIX), part(2 * ~first), marks(MIDDLE, MIDDLE), part(1), pa.scalar("", pa.large_string()))
    form = pc.if_else(pa.array(plain), "plain", pc.if_else(pa.array(first), "spm", "psm"))
    return [pa.array(n), form, *(pa.array(counts[:, k], mask=plain) for k in (0, 1)), output.cast(pa.string())]


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output of every row. rate: how many texts of a hundred
    are transformed; suffix_first: how many of a hundred of these begin with the suffix."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"), *[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                draws = np.column_stack([part.column(f"h{k}").to_numpy() for k in range(4)])
                made = transform_batch(part.column("text"), draws, rate, suffix_first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of."""
    part = lambda k: F.element_at(F.split(output, _ANY), k)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """Hashes instead of the outputs."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))
