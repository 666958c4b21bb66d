import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from yieldloom.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
LEAD = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(rows):
    """rows: (initial, gone, truncated). (cost, least audit) by trying every edit at every row."""

    @cache
    def best(k, state, inserts):
        ways = [(0, "")] if k == len(rows) and state in ("", "a") else []
        if inserts < 3:
            for x in "ua":
                if (state, x) in LEAD:
                    c, rest = best(k, x, inserts + 1)
                    ways.append((c + 3, "I" + rest))
        if k < len(rows):
            initial, gone, truncated = rows[k]
            c, rest = best(k + 1, state, 0)
            ways.append((c + 4, "D" + rest))
            if not gone:
                for letter, x, price in (("K", initial, 0), ("R", "u", 3), ("R", "a", 3)):
                    if (state, x) in LEAD:
                        c, rest = best(k + 1, LEAD[state, x], 0)
                        ways.append((c + price + 3 * truncated, letter + rest))
        return min(ways, default=(10**9, ""))

    for k in range(len(rows), 0, -100):  # else long ones recurse too deep
        for state in ("", "s", "u", "a"):
            best(k, state, 0)
    return best(0, "", 0)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        fate, role, text = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20, word(role), word(text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def plain(rows, ids):
    out = []
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        cost, audit = cheapest(tuple((i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)))
        lines, left, last = [], list(zip(own, initials, strict=True)), ""
        for letter in audit:
            (_, _, role, text), i = left.pop(0) if letter != "I" else ((0, 0, "", ""), "")
            if letter != "D":
                last = i if letter == "K" else "a" if last == "u" else "u"
                lines.append(f"{role if letter == 'K' else 'user' if last == 'u' else 'assistant'}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))  # noqa: B905
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def check(spark, rows, parts=3, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = conversations.digest(conversations.damage(df), df, **how)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(damaged(rows), {r[0] for r in rows}), key=key)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans()), max_size=12), st.integers(1, 5))
def test_layers_find_the_cheapest_least_audit(rows, size):
    code = [{"s": 1, "u": 2, "a": 3, "x": 0}[i] | (8 if gone else 4 * truncated) for i, gone, truncated in rows]
    blocks = [bytes(code[k : k + size]) for k in range(0, len(code), size)]
    assert conversations.solve(blocks) == cheapest(tuple((i, gone, truncated and not gone) for i, gone, truncated in rows))


def test_few_words_for_many_rows():
    rnd = random.Random(1)
    rows = bytes(rnd.choice([1, 2, 3, 0]) | rnd.choice([0, 4, 8]) for _ in range(100_000))
    blocks = [rows[k : k + 4096] for k in range(0, len(rows), 4096)]
    cost, audit = conversations.solve(blocks)
    assert (cost, audit) == conversations.solve([rows])
    assert len([x for x in audit if x != "I"]) == len(rows)
    assert conversations._step.cache_info().currsize < 2000


def some(seed, convs, longest=9):
    rnd = random.Random(seed)
    out = []
    for conv in range(convs):
        for turn in range(rnd.randrange(longest)):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            out.append((conv, rnd.choice([turn, turn, turn, None, turn // 2]), role, rnd.choice(["Hi there.", "Yes!", "no end", " \t", "", None, "Yes!", f"Turn {turn}?", "é 日本.\n"])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_equal_brute_force(spark, seed):
    rows = some(seed, 120)
    rows += [(None, None, None, None), (None, 3, "user", "x"), (-5, 0, "user", "Only."), *rows[:40]]
    check(spark, rows, 5)


def test_one_conversation_of_many_blocks(spark):
    rnd = random.Random(4)
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"text {t}" + rnd.choice([".", "", "!"])) for t in range(300)]
    rows += [(7, 50, "user", "same again.")] * 70 + [(7, None, "system", "Be kind.")] * 5 + [(8, 1, "user", "Hi.")]
    check(spark, rows, 4, block=16)


def test_blocks_join_turns_and_copies():
    import pyarrow as pa

    rows = [(1, None, 2), (1, 0, 2), (1, 0, 3), (1, 4, 2), (1, 4, 3)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(["user"] * 5), pa.array([b""] * 5, pa.binary()), pa.array([1, 1, 9000, 1, 1], pa.int64()), pa.array([r[2] for r in rows], pa.int32())],
        ["conv_id", "turn", "role", "sha", "copies", "code"],
    )
    made = [r for b in conversations._blocks([batch]) for r in b.to_pylist()]
    codes = b"".join(r["codes"] for r in made)
    assert all(len(r["codes"]) <= conversations.BLOCK for r in made)
    assert codes == bytes([2, 2, 3]) + bytes([11]) * 8999 + bytes([2, 3])
    gaps, blank, duplicate, truncated, *_ = conversations._audit([(r["codes"], r["low"], r["high"], r["turns"]) for r in made])
    assert (gaps, blank, duplicate, truncated) == (3, 0, 8999, 0)


def test_repaired_rows_and_clashing_columns(spark):
    rows = [(1, 0, "user", "Hello.", "c"), (1, 1, "user", "And you?", "c"), (1, 2, "user", "", "c"), (2, 0, "assistant", "I begin.", "c")]
    df = spark.createDataFrame(rows, f"{SCHEMA}, code string")
    got = sorted(map(tuple, conversations.repaired(df).collect()))
    assert got == [(1, 1, "user", "Hello."), (1, 2, "assistant", "And you?"), (2, 1, "user", ""), (2, 2, "assistant", "I begin.")]
    assert sorted((r["conv_id"], r["audit"], r["cost"]) for r in conversations.audits(df).collect()) == [(1, "KRD", 7), (2, "IK", 3)]


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.digest(conversations.damage(df), df).count() == 0
    assert conversations.repaired(df).count() == 0
