import numpy as np
from pyspark.sql import functions as F

from yieldloom.llm import nearest


def brute(rows, k):
    out = {}
    for i, q in rows.items():
        if i % 20 == 0:
            scored = sorted((-float((np.array(x, float) * np.array(q, float)).sum()), j) for j, x in rows.items() if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def run(spark, rows, extra=(), k=20):
    df = spark.createDataFrame([(int(i), [float(v) for v in x], 1.0) for i, x in rows.items()] + list(extra), "vec_id long, embedding array<float>, score double")
    got = {}
    for r in nearest.search(df, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    rows = {i: rng.normal(size=24).astype(np.float32) * (0.5 + (i % 7)) for i in range(3000)}
    rows |= {3000 + i: rows[5] for i in range(500)}  # many equal vectors
    odd = [(9001, None, 1.0), (9002, [0.0] * 24, 1.0), (9003, [float("nan")] * 24, 1.0), (9020, [None] * 24, 1.0), (9005, [1.0], 1.0), (None, [1.0] * 24, 1.0), (40, [float(v) for v in rows[40]], 1.0), (5, [float(v) for v in rows[5]], 1.0)]
    got, want = run(spark, rows, odd), brute(rows, 20)
    assert got.keys() == want.keys()
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    assert all(len(g) == 20 and g == sorted(g, key=lambda x: (-x[1], x[0])) for g in got.values())
    for i, g in got.items():
        assert all(s == float((rows[j].astype(float) * rows[i].astype(float)).sum()) for j, s in g)


def test_few_candidates_are_all_returned(spark):
    rows = {i: [1.0, i / 10] for i in range(8)}
    assert {i: [j for j, _ in g] for i, g in run(spark, rows).items()} == {0: [1, 2, 3, 4, 5, 6, 7]}
    assert run(spark, {20: [1.0, 2.0]}) == {} and run(spark, {}) == {}
    assert run(spark, {20: [1.0, 2.0], 3: [1.0, 2.0], 1: [1.0, 2.0]})[20] == [(1, 5.0), (3, 5.0)]


def test_a_repeated_id_takes_part_once(spark):
    rows = [(0, [1.0, 0.0], 1.0), (1, [0.5, 0.0], 1.0), (1, [0.25, 9.0], 1.0), (0, [2.0, 1.0], 1.0), (2, [3.0, 0.0], 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = [tuple(r) for r in nearest.search(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 3.0), (0, 2, 1, 0.25)]
