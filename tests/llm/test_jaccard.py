import random

import numpy as np

from yieldloom.llm import jaccard, simhash


def shingles(text, size=5):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} or ({tuple(ws)} if ws else set())


def similar(x, y):
    a, b = shingles(x), shingles(y)
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def texts():
    """Copies with scattered edits, of similarities from 0.6 to 1, many texts with one passage, and many near copies of one."""
    rng = random.Random(6)
    noise = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    out, passage = [None, "", " \n", "one two", "One  two"], noise(40)
    for k in range(30):
        base = noise(rng.randint(5, 200))
        out.append(" ".join(base))
        for edits in (1, 2, 3, 4, 5):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    out += [" ".join(passage + noise(rng.randint(5, 60))) for _ in range(60)]
    base = noise(120)
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(120)] = copy[rng.randrange(120)] = "zz"
        out.append(" ".join(copy))
    return out


def test_groups_are_those_of_brute_force(spark, monkeypatch):
    rows = list(enumerate(texts()))
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in rows:
        for j, b in rows[:i]:
            if similar(a, b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd in (64, 8):
        monkeypatch.setattr(jaccard, "CROWD", crowd)
        kept = simhash.representatives(docs).collect()
        assert sorted(r["doc_id"] for r in kept) == sorted({top(i) for i, _ in rows})


def test_a_copy_of_similarity_above_eight_tenths_goes(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(9000)}" for _ in range(150)]
    copy = [*base]
    copy[40], copy[90] = "x", "y"
    rows = [(1, " ".join(base)), (2, " ".join(copy))]
    assert similar(rows[0][1], rows[1][1]) and [r["doc_id"] for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [1]


def test_rows_stay_by_their_own_group(spark):
    """A group of null ids alone keeps no null row of others, and a repeated id keeps no text whose group has a smaller id."""
    a, b, c = "a b c d e f", "only null rows have this text here", "the text of the third group is this one"
    rows = [(1, a), (None, a), (None, b), (None, b), (2, c), (3, c), (3, "quite another text than that one"), (3, "quite another text than that one")]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (None, b), (2, c), rows[-1]], key=str)


def test_recall_between_080_and_085(spark):
    """Pairs barely similar enough, where the bands are least sure: all are linked, and none below 0.8."""
    rng = random.Random(11)
    rows, want = [], []
    while len(want) < 200:
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(80, 300))]
        copy = list(base)
        for _ in range(rng.randint(1, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        a, b = shingles(" ".join(base)), shingles(" ".join(copy))
        share = len(a & b) / len(a | b)
        if 0.78 <= share < 0.8 or 0.8 <= share <= 0.85:
            k = len(rows)
            rows += [(k, " ".join(base)), (k + 1, " ".join(copy))]
            if share >= 0.8:
                want.append(k)
    got = {}
    for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["root"], []).append(r["doc_id"])
    assert sorted(min(ids) for ids in got.values() if len(ids) > 1) == want and max(map(len, got.values())) == 2


def test_what_bands_and_picks_miss_is_found_exactly(spark, monkeypatch):
    """With bands that link nothing all groups are those of brute force: near copies, barely similar ones, and crowds that share a passage."""
    rng = random.Random(12)
    rows, crowd = list(enumerate(texts())), [f"p{k}" for k in range(60)]
    rows += [(1000 + k, " ".join(crowd + [f"q{rng.randrange(10**6)}" for _ in range(rng.randint(6, 14))])) for k in range(150)]
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for i, a in sets:
        for j, b in sets:
            if j < i and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    unlike = lambda h, bounds: (np.add.reduceat(h, bounds[:-1])[:, None] + np.arange(jaccard.BANDS, dtype=np.uint64)).view(np.int64)
    monkeypatch.setattr(jaccard, "bands_of", unlike)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (64, 4):
        monkeypatch.setattr(jaccard, "CROWD", limit)
        assert sorted(r["doc_id"] for r in simhash.representatives(docs).collect()) == sorted({top(i) for i, _ in rows})


def test_sketches_never_overstate():
    """Whatever the sizes, what sketches tell apart is at most what differs, and equal sets are not apart; most of random sets is seen."""
    rng = np.random.default_rng(13)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (0, 1, 5, 31, 32, 33, 64, 65, 300, 1000, 5000)]
    sets += [np.unique(np.concatenate([s[: len(s) * k // 10], sets[8]])) for s in sets for k in (1, 9)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    words, size = jaccard.sketches_of(np.concatenate(sets), bounds)
    ends = np.cumsum(size)
    sketch = [words[e - k : e].view(np.int64) for e, k in zip(ends, size, strict=True)]  # signed, as they come from a table
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert jaccard.apart(sketch[i], sketch[j]) <= len(np.setxor1d(x, y, assume_unique=True)) and (i != j or not jaccard.apart(sketch[i], sketch[j]))
    assert jaccard.apart(sketch[8], sketch[9]) > 300
    one, none = np.array([1 << 63], np.uint64).view(np.int64), np.zeros(1, np.int64)
    assert jaccard.apart(one, none) == 1 and jaccard.apart(~none, none) == 64


def test_sets_are_compared_only_of_what_sketches_leave_open(spark, monkeypatch):
    """Texts of one passage, far from similar: they meet in the exact pass by their many shared shingles, but none of their sets are made and sent."""
    rng = random.Random(14)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(passage + [f"q{rng.randrange(10**9)}" for _ in range(45)])) for k in range(40)]
    met, compared, pairs_of, similar_of = [], [], jaccard._prefix_pairs, jaccard._similar
    monkeypatch.setattr(jaccard, "_prefix_pairs", lambda *a: (met.append((pairs := pairs_of(*a)).count()), pairs)[1])
    monkeypatch.setattr(jaccard, "_similar", lambda pairs, sets: (compared.append(pairs.count()), similar_of(pairs, sets))[1])
    monkeypatch.setattr(jaccard, "bands_of", lambda h, bounds: (np.add.reduceat(h, bounds[:-1])[:, None] + np.arange(jaccard.BANDS, dtype=np.uint64)).view(np.int64))
    assert simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).count() == 40
    assert met[0] > 100 and sum(compared) == 0
