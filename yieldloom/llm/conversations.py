"""Repair of conversations whose turns are blank, repeated, broken off or out of order.

A conversation is repaired by the cheapest edits after which its role initials are `(s?(ua)+)?`: Keep (0), Rerole to user or
assistant (3), Delete (4, the only edit of a blank or repeated row), Insert of an empty user or assistant turn (3, anywhere); a row
that breaks off costs 3 more unless it is deleted.

The search goes by cost layers, as approximate matching with bit vectors does: for each turn a word has, for each cost from the
least upwards, a set of four bits, the grammar's states (nothing yet, s, u, a) from which the rows from there on can be accepted at
that cost. A row changes the word by shifts: Delete moves all sets by four layers, Keep moves the bits of the states that the row's
initial leads on from, Rerole does the same for u and a three layers up, Insert once more on the result. Costs of the states never lie
far apart, so a word needs few layers above its least one; the number of different words is small and each step between two of them
is made once. The first layer at the first row that has the state "nothing yet" is the cost. From there the words are traced
forwards, taking at each row the least of D, I, K and R that stays on the cost: the least audit. Words run from the last row to the
first for that reason, and are kept at the ends of blocks alone; a block's own are made again when the trace comes to it.

On Spark: rows alike in all columns are counted first; a row is a repetition if the least turn of its conversation, role and text
is another. Rows then are sorted by ranges of (conversation, turn), so a conversation of any length is spread, and
become a byte each, in blocks of BLOCK rows. What meets in one task for a conversation are these bytes, as many as its audit has
letters. Last, texts run past their audit in order, one batch at a time: a SHA-256 cannot be taken in parts, so this pass alone needs a
conversation's texts in one task, and holds none of them.

Defined results: a null role or text is one space; null turns come first and count in no gap; rows of one turn are ordered by role,
then by the SHA-256 of their text; a role's initial is its first character as it is, and no role but those beginning with s, u or a
can be kept; rows with a null conv_id are one conversation; very long texts are read whole; conversations without any row have no
faults; an empty table yields no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import materialize, slices, small_batches

#: Rows of a block.
BLOCK = 4096
_SPACE = " \t\n\x0b\x0c\r"

# States, and classes of a role by its initial: 0 is nothing yet, or another initial.
_S, _U, _A = 1, 2, 3
_NAMES = {_U: "user", _A: "assistant"}
# A row's byte: its class and what is wrong with it.
_TRUNCATED, _GONE, _BLANK = 4, 8, 16
_EVERY = int("1" * 32, 16)  # the lowest state of each of 32 layers
_END = 0b1001


def _before(word: int, kind: int) -> int:
    """The states from which a row of a class leads to those of word, in the same layers."""
    at = (word >> kind) & _EVERY
    return at if kind == _S else at | at << _S | at << _A if kind == _U else at << _U if kind == _A else 0


def _lead(state: int, kind: int) -> int | None:
    """The state after a row of a class, if it may follow."""
    return kind if (state, kind) in ((0, _S), (0, _U), (_S, _U), (_A, _U), (_U, _A)) else None


def _settled(word: int) -> tuple[int, int]:
    """(the word with two inserts before it, each state in its least layer only and the least layer first; layers that it moved by)."""
    for _ in range(2):
        word |= (_before(word, _U) | _before(word, _A)) << 12
    out, seen, layer, moved = 0, 0, 0, None
    while seen != 15:
        new = word >> 4 * layer & 15 & ~seen
        if new:
            moved = layer if moved is None else moved
            out, seen = out | new << 4 * (layer - moved), seen | new
        layer += 1
    return out, moved


@cache
def _step(word: int, row: int) -> tuple[int, int]:
    """The word before a row, and the layers that its least layer is above that of the word after it."""
    made = word << 16
    if not row & _GONE:
        more = 3 if row & _TRUNCATED else 0
        made |= _before(word, row & 3) << 4 * more | (_before(word, _U) | _before(word, _A)) << 4 * (3 + more)
    return _settled(made)


@cache
def _costs(word: int) -> list[int]:
    """The layer of each state."""
    return [next(c for c in range(32) if word >> (4 * c + state) & 1) for state in range(4)]


@cache
def _edit(word: int, after: int, moved: int, row: int, state: int) -> tuple[str, int]:
    """The least letter that stays on the cost, and the state that it leads to."""
    here, there = _costs(word), [c - moved for c in _costs(after)]
    left, next_ = here[state], _A if state == _U else _U
    if there[state] + 4 == left:
        return "D", state
    if here[next_] + 3 == left:
        return "I", next_
    more, kept = 3 if row & _TRUNCATED else 0, _lead(state, row & 3)
    if not row & _GONE:
        if kept is not None and there[kept] + more == left:
            return "K", kept
        if there[next_] + 3 + more == left:
            return "R", next_
    raise AssertionError("no edit stays on the cost")


def solve(blocks: list[bytes]) -> tuple[int, str]:
    """(least cost, least audit) of a conversation; blocks: its rows' bytes in order."""
    word, total = _settled(_END)
    ends = []
    for block in reversed(blocks):
        ends.append(word)
        for row in reversed(block):
            word, moved = _step(word, row & 15)
            total += moved
    cost, state, audit = total + _costs(word)[0], 0, []
    for block in blocks:
        after, words = ends.pop(), []
        for row in reversed(block):
            before, moved = _step(after, row & 15)
            words.append((before, after, moved))
            after = before
        for row in block:
            before, after, moved = words.pop()
            letter = "I"
            while letter == "I":
                letter, state = _edit(before, after, moved, row & 15, state)
                audit.append(letter)
    while state in (_S, _U):
        state = _A if state == _U else _U
        audit.append("I")
    return cost, "".join(audit)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows of which, by the CRC-32 of conv_id:turn, some are dropped, emptied, robbed of their marks,
    repeated or given to the user."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate, text = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20, word("text")
    text = F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = rows.filter(fate != 0).select("conv_id", "turn", F.when(fate == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    return out.drop("again")


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]


def _counted(rows: DataFrame) -> DataFrame:
    """Rows alike in all columns as one, with their number: conv_id, turn, role, text, copies, sha (of the text)."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role"), word("text"))
    return own.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _coded(counted: DataFrame) -> DataFrame:
    """Rows without their text: conv_id, turn, role, sha, copies and code."""
    bare = F.translate("text", _SPACE, "")
    rows = counted.select("conv_id", "turn", "role", "sha", "copies", (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"))
    # One key of the conversation, role and text; the role's length keeps them apart.
    same = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.when(F.col("conv_id").isNull(), "-").otherwise("+"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.hex("sha")).cast("binary"), 256)
    rows = rows.withColumn("same", F.unhex(same)).withColumn("place", F.struct(F.col("turn").isNotNull().alias("some"), "turn"))
    first = rows.groupBy("same").agg(F.min("place").alias("first"))
    rows = rows.join(first, "same")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", _S).when(initial == "u", _U).when(initial == "a", _A).otherwise(0)
    seen = ~F.col("place").eqNullSafe(F.col("first"))
    fault = F.when(F.col("blank"), _GONE + _BLANK).when(seen, _GONE).when(~F.col("ended"), _TRUNCATED).otherwise(0)
    return rows.select("conv_id", "turn", "role", "sha", "copies", (kind + fault).cast("int").alias("code"))


def _blocks(batches: Iterable[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks: the place of the first row, all rows' bytes, and the turns that they have."""
    names = ["conv_id", "turn", "role", "sha", "piece", "codes", "low", "high", "turns"]
    made: list[list] = []
    now: list | None = None

    def table(kind) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array([bytes(r[k]) if k == 5 else r[k] for r in made], t) for k, t in enumerate(kinds)], names)
        made.clear()
        return out

    kind = None
    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, turn, role, sha, copies, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "sha", "copies", "code")), strict=True):
            if now is None or now[0] != conv or len(now[5]) >= size:
                if now is not None:
                    made.append(now)
                now = [conv, turn, role, sha, 0, bytearray(), turn, turn, int(turn is not None)]
            elif turn != now[7]:
                now[6] = turn if now[6] is None else now[6]
                now[7], now[8] = turn, now[8] + 1
            now[5].append(code)
            again = code if code & _BLANK else code & 3 | _GONE
            left = copies - 1
            while left:
                if len(now[5]) >= size:
                    made.append(now)
                    now = [conv, turn, role, sha, now[4] + 1, bytearray(), turn, turn, int(turn is not None)]
                    if len(made) >= 256:
                        yield table(kind)
                some = min(left, size - len(now[5]))
                now[5] += bytes([again]) * some
                left -= some
        if len(made) >= 256:
            yield table(kind)
    if now is not None:
        made.append(now)
        yield table(kind)


_LEGAL = np.array([(_S, _U), (_U, _A), (_A, _U)]) @ [4, 1]


def _audit(blocks: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost and audit; blocks: (codes, low, high, turns) in order."""
    codes = np.frombuffer(b"".join(b[0] for b in blocks), np.uint8)
    low, high, turns = None, None, 0
    for _, first, last, n in blocks:
        if first is not None:
            low = first if low is None else low
            turns += n - (first == high)
            high = last
    kinds = codes & 3
    illegal = int((~np.isin(kinds[:-1] * 4 + kinds[1:], _LEGAL)).sum())
    blank = int((codes & _BLANK > 0).sum())
    gone = int((codes & _GONE > 0).sum())
    cost, audit = solve([b[0] for b in blocks])
    return 0 if low is None else high - low + 1 - turns, blank, gone - blank, int((codes & _TRUNCATED > 0).sum()), illegal, cost, audit


_FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _audits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, blocks, kind = None, [], None  # own: the conversation at hand, in a tuple

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["conv_id", *_FOUND_NAMES])

    for batch in batches:
        kind, done = batch.column("conv_id").type, []
        for conv, *block in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "codes", "low", "high", "turns")), strict=True):
            if own != (conv,):
                if own:
                    done.append((*own, *_audit(blocks)))
                own, blocks = (conv,), []
            blocks.append(tuple(block))
        if done:
            yield table(done)
    if own:
        yield table([(*own, *_audit(blocks))])


def _kind(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def _solved(counted: DataFrame, conversations: DataFrame, block: int) -> DataFrame:
    rows = materialize(_coded(counted), "coded", outlive=True)
    blocks = rows.repartitionByRange(*_order()).sortWithinPartitions(*_order()).mapInArrow(lambda batches: _blocks(batches, block), f"conv_id {_kind(counted)}, turn long, role string, sha binary, piece int, codes binary, low long, high long, turns long")
    none = conversations.select(F.col("conv_id").cast(counted.schema["conv_id"].dataType).alias("conv_id")).distinct().withColumn("codes", F.lit(b""))
    every = blocks.unionByName(none, allowMissingColumns=True)
    # A block without rows may stand anywhere among those of its conversation.
    return every.repartition("conv_id").sortWithinPartitions(*_order(), "piece").mapInArrow(_audits, f"conv_id {_kind(counted)}, {_FOUND}")


def audits(rows: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps (turns that are missing), blank, duplicate, truncated, illegal, cost and audit of each conversation, those
    included that only the other table has."""
    small_batches(rows.sparkSession)
    counted = materialize(_counted(rows), "turns", outlive=True)
    return _solved(counted, counted if conversations is None else conversations, block)


class _Rows:
    """Repaired rows as they are."""

    schema = "place long, role string, text string"

    def __init__(self) -> None:
        self.place = 0

    def add(self, role: str, text: str) -> tuple:
        self.place += 1
        return self.place, role, text

    def end(self, found: tuple) -> tuple | None:
        return None


class _Hash:
    """Faults, audit and the hash of the repaired rows."""

    schema = f"{_FOUND}, repaired_sha256 string"

    def __init__(self) -> None:
        self.hash, self.between = hashlib.sha256(), b""

    def add(self, role: str, text: str) -> None:
        self.hash.update(self.between + f"{role}:{text}".encode())
        self.between = b"\n"

    def end(self, found: tuple) -> tuple:
        return *found, self.hash.hexdigest()


def _applied(output: type) -> Callable:
    """Streams each conversation's audit and then its rows, in order, through an output."""
    names = ["conv_id", *[c.split()[0] for c in output.schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found, out, at, state, kind = None, (), None, 0, 0, None
        made: list[tuple] = []

        def add(role: str, text: str) -> None:
            if (row := out.add(role, text)) is not None:
                made.append((*own, *row))

        def inserts() -> None:
            nonlocal at, state
            while at < len(found[-1]) and found[-1][at] == "I":
                at, state = at + 1, _A if state == _U else _U
                add(_NAMES[state], "")

        def end() -> None:
            if own:
                inserts()
                if (row := out.end(found)) is not None:
                    made.append((*own, *row))

        def table() -> pa.RecordBatch:
            kinds = [kind, *[pa.string() if " string" in c else pa.int64() for c in output.schema.split(", ")]]
            done = pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate(kinds)], names)
            made.clear()
            return done

        for batch in batches:
            kind = batch.column("conv_id").type
            for part in slices(batch, "text", 4 << 20):
                first = part.column("row").to_pylist()
                heads = iter([*zip(*(part.column(c).filter(pc.invert(part.column("row"))).to_pylist() for c in _FOUND_NAMES), strict=True)])
                for conv, row, role, text, copies in zip(part.column("conv_id").to_pylist(), first, *(part.column(c).to_pylist() for c in ("role", "text", "copies")), strict=True):
                    if not row:
                        end()
                        own, found, out, at, state = (conv,), next(heads), output(), 0, 0
                        continue
                    for _ in range(copies):
                        inserts()
                        letter, at = found[-1][at], at + 1
                        if letter == "K":
                            state = {"s": _S, "u": _U, "a": _A}[role[0]]
                            add(role, text)
                        elif letter == "R":
                            state = _A if state == _U else _U
                            add(_NAMES[state], text)
                if made:
                    yield table()
        end()
        if made:
            yield table()

    return run


def _through(rows: DataFrame, conversations: DataFrame | None, output: type, block: int) -> DataFrame:
    small_batches(rows.sparkSession)
    counted = materialize(_counted(rows), "turns", outlive=True)
    found = _solved(counted, counted if conversations is None else conversations, block)
    both = counted.withColumn("row", F.lit(True)).unionByName(found.withColumn("row", F.lit(False)), allowMissingColumns=True)
    by = _order()
    return both.repartition("conv_id").sortWithinPartitions(by[0], "row", *by[1:]).mapInArrow(_applied(output), f"conv_id {_kind(counted)}, {output.schema}")


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, place (from 1), role and text of the repaired conversations."""
    return _through(rows, None, _Rows, block)


def digest(rows: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """audits() with repaired_sha256, of the repaired rows as role:text on a line each."""
    return _through(rows, conversations, _Hash, block)
