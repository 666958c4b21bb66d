import hashlib
import random
import re

import pytest

from yieldloom.llm import exact

SCHEMA = "doc_id long, text string, sha string, run int"


def plain(rows):
    """rows: (doc_id, text). Multiset of (doc_id, keep_id, group_size, kept, sha); of rows alike one is kept."""
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for k, n in enumerate(norm):
        groups.setdefault(n, []).append(k)
    out = []
    for n, ks in groups.items():
        best = min(ks, key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0))
        sha = hashlib.sha256(n.encode()).hexdigest()
        out += [(rows[k][0], rows[best][0], len(ks), k == best, sha) for k in ks]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def texts(seed, n):
    rnd = random.Random(seed)
    base = ["", None, " \t", "ab", "a b", "a\x0bb ", " ab", "日本 語", "日本語", "x" * 5000, "é\r\n", "é", "\x1c"]
    return [(k, rnd.choice(base) if rnd.random() < 0.7 else f"t{rnd.randrange(9)} {' ' * rnd.randrange(3)}") for k in range(n)]


@pytest.mark.parametrize("parts,bits", [(1, 4), (7, 1), (40, 2), (40, 4)])
def test_groups_equal_brute_force(spark, parts, bits):
    rows = texts(parts, 400)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert order(map(tuple, exact.groups(df, bits).collect())) == order(plain(rows))


def test_one_text_in_a_third_of_all_rows(spark):
    rows = [(k, "same  text" if k % 3 else f"own {k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    got = exact.groups(df)
    assert order(map(tuple, got.collect())) == order(plain(rows))


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "a b", "q", 1), (None, "ab", "q", 2), (3, "a  b", None, 3), (3, "a  b", "r", 4), (2, "ab", "r", 5), (None, None, "n", 6), (None, None, "n", 7), (9, "z", "s", 8), (9, "z z", "s", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert order(map(tuple, exact.groups(df).collect())) == order(plain([r[:2] for r in rows]))
    kept = exact.survivors(df)
    assert kept.columns == df.columns
    assert order((r[0], r[1]) for r in kept.collect()) == order([(3, "a  b"), (None, None), (9, "z"), (9, "z z")])


def test_survivors_are_the_kept_rows(spark):
    rows = texts(5, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert order((r[0],) for r in exact.survivors(df).collect()) == order((r[0],) for r in plain(rows) if r[3])


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact.groups(df).count() == 0
    assert exact.survivors(df).count() == 0


def test_main_path_has_no_python_workers(spark):
    plan = exact.groups(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)
