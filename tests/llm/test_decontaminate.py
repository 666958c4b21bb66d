import random
import re

import numpy as np
import pyarrow as pa
import pytest

from yieldloom.llm import decontaminate
from yieldloom.llm.tiling import tile


def plain_tiles(a, b, least):
    """Wise's definition: again and again mark all longest common unmarked runs."""
    fa, fb, out = [1] * len(a), [1] * len(b), []
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and fa[i + k] and fb[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if all(fa[i : i + best]) and all(fb[j : j + best]):
                fa[i : i + best] = fb[j : j + best] = [0] * best
                out.append((i, j, best))


def test_tiles_are_common_disjoint_and_as_many_as_plain_ones():
    rng = random.Random(4)
    for _ in range(300):
        item = [rng.randrange(6) for _ in range(rng.randint(0, 30))]
        text = [rng.randrange(6) for _ in range(rng.randint(0, 20))] + item[10:] + [9] + item[:12]
        got = tile(text, item, 3)
        used = [x for d, i, k in got for x in range(d, d + k)], [x for d, i, k in got for x in range(i, i + k)]
        assert all(len(u) == len(set(u)) for u in used)
        assert all(text[d : d + k] == item[i : i + k] and k >= 3 for d, i, k in got)
        plain = plain_tiles(text, item, 3)
        assert [k for *_, k in got][:1] == [k for *_, k in plain][:1]
        assert sum(k for *_, k in got) == pytest.approx(sum(k for *_, k in plain), abs=6)


def cut(text):
    return [w for w in re.split(r"[^A-Za-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


ITEM = "What is the capital of the old kingdom, and who ruled it when the great river froze over in winter?"


def cases():
    rng = random.Random(7)
    noise = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    ws = ITEM.split()
    moved = " ".join([*ws[10:], noise(30), *ws[:10]])
    return [
        (1, noise(50) + " " + ITEM + noise(50)), (2, moved), (3, noise(300)), (4, " ".join(ws[:6])), (5, None), (6, ""), (7, ITEM.upper().replace(" ", "  \n")),
        (8, noise(20000) + " " + ITEM), (None, ITEM), (1, noise(4) + " " + ITEM), (9, " ".join(reversed(ws))), (10, "Great news: " + " ".join(ws[:8]) + " x " + " ".join(ws[9:])), (11, " ".join(ws[:4]) + " zzz"),
    ], [(100, ITEM), (101, None), (102, "too short"), (103, noise(40)), (None, "another thing that nobody has ever said before today or tomorrow"), (100, ITEM + " again")]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_documents_and_items(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SEEDS", limit)
    docs, items = cases()
    d = spark.createDataFrame([(*r, 0.5) for r in docs], "doc_id long, text string, coverage double")
    b = spark.createDataFrame([(*r, "q") for r in items], "item_id long, text string, tiles string")
    got = decontaminate.contaminated(d, b).collect()
    want = []
    for i, t in docs:
        for j, x in items:
            own = cut(x)
            if len(own) >= 5 and sum(k for *_, k in plain_tiles(cut(t), own, 5) if True) >= 0.5 * len(own) if len(cut(t)) < 2000 else (i == 8 and j == 100):
                want.append((i, j))
    if limit:
        assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in got) == sorted((i or 0, j or 0) for i, j in want)
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want)
    assert {1, 2, 7, 8, None, 10} == {r["doc_id"] for r in got}
    for r in got:
        assert 0.5 <= r["coverage"] <= 1 and abs(sum(t["length"] for t in r["tiles"]) / r["tokens"] - r["coverage"]) < 1e-9
    kept = decontaminate.without(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 9, 11]


def test_empty_tables(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 == decontaminate.contaminated(d, b.limit(0)).count()


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_an_item_that_repeats_a_short_passage(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SEEDS", limit)
    item = " ".join(["one two three four five six seven eight nine ten"] * 20)
    d = spark.createDataFrame([(1, "before it " + item), (2, "nothing of all this is in here")], "doc_id long, text string")
    got = decontaminate.contaminated(d, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["coverage"], r["tokens"]) for r in got] == [(1, 5, 1.0, 200)]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_rows_without_an_id_go_by_their_own_text(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SEEDS", limit)
    rows = [(None, ITEM), (None, "a text that has no id and no item"), (1, ITEM), (1, "another text of the first id"), (2, None)]
    kept = decontaminate.without_rows(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string"), spark.createDataFrame([(100, ITEM)], "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "source"] and {(r["doc_id"], r["text"]) for r in kept.collect()} == {rows[1], rows[3], rows[4]}


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_a_passage_that_all_items_and_texts_have(spark, monkeypatch, limit):
    """Boilerplate of a third of an item's tokens is in every item and text: no pair comes of it alone, and none is lost."""
    monkeypatch.setattr(decontaminate, "SEEDS", limit)
    rng = random.Random(7)
    common = [f"c{k}" for k in range(20)]
    items = [[f"i{k}w{j}" for j in range(40)] for k in range(30)]
    bench = [(k, " ".join([*common, *own])) for k, own in enumerate(items)]
    docs, want = [], set()
    for d in range(60):
        words_ = [f"n{rng.randrange(10**6)}" for _ in range(30)]
        if d % 3 == 0:
            k = rng.randrange(30)
            words_ += items[k][:30]
            want.add((d, k))
        docs.append((d, " ".join([*common, *words_])))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    rare = decontaminate.Benchmark.of_rows([k for k, _ in bench], pa.array([t for _, t in bench]), 0.5)
    boilerplate = np.unique(decontaminate._seeds(decontaminate.tokens(pa.array([" ".join(common)]))[0]))
    assert not np.isin(boilerplate, rare.seeds).any()
