import random
import re

import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from yieldloom.llm import graph, simhash, words


def plain(text, size):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shs = [" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aBÉ \t\n\x0b x\x1c日"), max_size=80)), max_size=5), st.integers(1, 5))
def test_fingerprints_equal_the_plain_ones(texts, size):
    got = simhash.fingerprints_of(pa.array(texts, pa.string()), size)
    assert got.tolist() == [plain(t, size) for t in texts]


def test_long_words_and_many_shingles():
    text = " ".join(random.Random(3).choices(["a", "b" * 40, "c" * 100, "dé"], k=3000))
    assert simhash.fingerprints_of(pa.array([text, ""]), 3).tolist() == [plain(text, 3), 0]


def closure(ids, linked):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


def test_links_connect_what_brute_force_connects(spark, monkeypatch):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for base in list(fps)[:5]:
        for _ in range(60):  # a crowd
            fps.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps |= {0, 1, 3, 7, 2**64 - 1, 2**63, 2**63 + 1}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    want = closure(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    for crowd in (48, 3):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        roots = {r["node"]: r["root"] for r in graph.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
        assert {x: roots.get(x, x) for x in signed} == want


def test_near_duplicates(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [(5, base, 1), (3, base.upper(), 2), (9, None, 3), (8, "", 4), (7, " \n", 5), (1, "one", 6), (None, "one", 7), (None, "two words", 8), (3, base, 9), (2, base + " again", 10)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp long"), 3).collect()
    fps = {i: plain(t, 3) for i, t, _ in rows if i is not None}
    want = closure(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["fingerprint"]) == (want[r["doc_id"]], f"{fps[r['doc_id']]:016x}")
    assert sorted((r["component_id"] or 0) for r in got if r["doc_id"] is None) == [0, 1]


def test_no_documents(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


def test_words_ranges():
    w = words.words(pa.array([" A b\n", None, "", "cD"]))
    assert w.firsts.tolist() == [0, 2, 2, 2, 3] and [bytes(w.data[a:b]) for a, b in zip(w.starts, w.ends)] == [b"a", b"b", b"cd"]
