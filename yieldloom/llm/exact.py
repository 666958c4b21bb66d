"""Exact dedup by merging sorted digest runs along a tree. DataFrame functions only.

Texts are equal when they are identical after every ASCII white-space character (0x20, 0x09-0x0D) is deleted. Each input
partition makes a run: its texts' digests, sorted, each with its best row (most code points, then smallest doc_id) and its number
of rows. In binomial rounds groups of 2^BITS neighbouring runs exchange rows by group and digest; what meets is sorted, merged and
verified: rows become one only if their 64-bit digest, SHA-256 and normalised length all agree. After log(runs) / BITS rounds one
group is left, whose rows name each digest's best row. The names then go down the same tree, from a group to the groups it was made
of, and at last to the rows of each run. Texts never leave their partition.

Nothing depends on how often a text repeats: a digest has one row in each run and at most 2^BITS rows meet at a key, up or down.
Every round is written to the shared folder, so a lost executor costs one round's tasks at most.

Defined results: a null text is the empty one, and all texts without a character left are equal; a null doc_id comes after all others
and is a keep_id only where a whole group has none; of rows that are equal in length and doc_id the smallest 64-bit hash of the
original text stays, of fully equal rows one; rows that repeat a doc_id are rows of their own; an empty table yields no row; further
columns are ignored by groups() and passed by survivors(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import held, materialize, restored, scratch

#: A round merges 2^BITS runs.
BITS = 4
_SPACE = " \t\n\x0b\x0c\r"
_KEY = ["h", "sha", "size"]

ORACLE_SQL = r"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place FROM t
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r"""


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _SPACE, "")


def digests(docs: DataFrame) -> DataFrame:
    """A row for each document, without its text: doc_id, run, place (of the row, unlike any other's), the digest and what ranks it."""
    text, norm = F.coalesce(F.col("text"), F.lit("")), F.col("norm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), normalised(F.col("text")).alias("norm"))
    best = F.struct((-F.char_length("text")).alias("short"), F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("raw"), F.monotonically_increasing_id().alias("place"))
    return rows.select(F.spark_partition_id().cast("long").alias("run"), F.xxhash64(norm).alias("h"), F.unhex(F.sha2(norm, 256)).alias("sha"), F.char_length(norm).alias("size"), best.alias("best"))


def merged(runs: DataFrame, bits: int) -> DataFrame:
    """One round: 2^bits runs become one. Equal digests become one row, the best with the sum of rows."""
    out = runs.groupBy(F.shiftright("run", bits).alias("run"), *_KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return out.sortWithinPartitions("run", *_KEY)


def named(lower: DataFrame, upper: DataFrame, bits: int) -> DataFrame:
    """The lower runs' digests with the best row and number of rows that the merged runs have for them."""
    up = upper.select(F.col("run").alias("up"), *[F.col(c).alias(f"up_{c}") for c in (*_KEY, "best", "n")])
    on = (F.shiftright("run", bits) == F.col("up")) & (F.col("h") == F.col("up_h")) & (F.col("sha") == F.col("up_sha")) & (F.col("size") == F.col("up_size"))
    own = [c for c in lower.columns if c not in ("best", "n")]
    return lower.join(up, on).select(*own, *([F.col("best").alias("own")] if "n" not in lower.columns else []), F.col("up_best").alias("best"), F.col("up_n").alias("n"))


def _resolved(docs: DataFrame, bits: int) -> DataFrame:
    """Each row (own) with its digest, the row that stays (best) and its group's size (n)."""
    rows = materialize(digests(docs), "digests", outlive=True)
    levels = [materialize(merged(rows.withColumn("n", F.lit(1).cast("long")), 0), "run", outlive=True)]
    last = levels[0].agg(F.max("run")).first()[0] or 0
    while last:
        levels.append(materialize(merged(levels[-1], bits), "run", outlive=True))
        last >>= bits
    while len(levels) > 1:
        upper = levels.pop()
        levels.append(named(levels.pop(), upper, bits))
    return named(rows, levels[0], 0)


def groups(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    kept = F.col("own.place") == F.col("best.place")
    return _resolved(docs, bits).select(F.col("own.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def survivors(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows alike in doc_id and text any one of them."""
    with scratch(docs.sparkSession):
        rows = _resolved(docs, bits)
        same = (F.col("own.raw") == F.col("best.raw")) & F.col("own.doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("own.short") == F.col("best.short"))
        stays = rows.filter(same).groupBy(F.col("best.doc_id").alias("i"), F.col("best.raw").alias("w"), F.col("sha").alias("s")).agg(F.count("*").alias("k"))
        stays = materialize(stays, "stays", outlive=True)
    mine = held(docs)
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("i")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("w")) & (F.unhex(F.sha2(normalised(F.col("text")), 256)) == F.col("s"))
    once = mine.join(stays.filter("k = 1"), on, "left_semi")
    again = mine.join(stays.filter("k > 1"), on).dropDuplicates(["i", "w", "s"])
    return restored(once.unionByName(again.select(*once.columns)), docs.columns)
