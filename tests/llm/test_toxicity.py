import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from yieldloom.llm import strings, toxicity


def plain(a, b):
    """The kernel by its definition: over all common subsequences, the decay to the power of the spans."""
    total = 0.0
    for i in itertools.combinations(range(len(a)), strings.ORDER):
        for j in itertools.combinations(range(len(b)), strings.ORDER):
            if [a[x] for x in i] == [b[x] for x in j]:
                total += strings.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_equals_its_definition():
    rng = random.Random(1)
    left = ["".join(rng.choices("abcé", k=rng.randint(0, 8))) for _ in range(40)]
    marks = ["abca", "cab", "éabcab", "bbb"]
    got = strings.similarities(left, strings.Landmarks(marks))
    for i, a in enumerate(left):
        for j, b in enumerate(marks):
            want = plain(a, b) ** 2 / (plain(a, a) * plain(b, b)) if len(a) >= strings.ORDER else 0
            assert abs(got[i, j] - want) < 1e-4


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeioutnrsld", k=rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 60))
        toxic = i % 4 == 0
        if toxic:
            bad = rng.choice(["grobnik", "flumpf", "zwackel"])
            form = rng.randrange(4)
            bad = bad if form < 2 else bad[:3] + "x" + bad[3:] if form == 2 else ".".join(bad)
            text[rng.randrange(len(text))] = bad
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_texts(spark):
    rows = corpus(900, 3)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(2000, "say f l u m p f now", "x", 0.5), (2001, None, "x", 0.5), (2002, "", "x", 0.5), (2003, "§ 12", "x", 0.5), (None, "grobnik here", "x", 0.5), (0, rows[1][1], "x", 0.5), (2004, "le la le " * 60000 + "zwackel", "x", 0.5), (2005, "f" * 500, "x", 0.5)], "doc_id long, text string, held_out string, score double")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(5, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    crc = {r[0]: r[1] == 1 for r in docs.select("doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3).collect()}
    assert all(r["held_out"] == bool(crc[r["doc_id"]]) for r in got)
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    truth = {i: t for i, _, t in rows}
    held = [i for i in truth if i and by[i]["held_out"]]
    assert np.mean([by[i]["predicted"] == truth[i] for i in held]) > 0.98
    assert by[2000]["predicted"] == 1 and by[2004]["predicted"] == 1
    assert not any(by[i]["predicted"] for i in (2001, 2002, 2003, 2005))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_learning_and_scoring_see_the_same_units():
    import pyarrow as pa

    texts = ["aa bb C-c", "say f l u m p f now", "x y z", "", "Ä.b_c  d\te", "- ."]
    of, ends, names = toxicity.units(pa.array(texts))
    each = [sorted({names[k] for k in of[a:b] if names[k]} | set(toxicity.spelled(t))) for t, a, b in zip(texts, ends[:-1], ends[1:])]
    assert toxicity.units_of(pa.array(texts)) == each and "^aabb$" in each[0] and "^cc$" in each[0] and each[4] == ["^d$", "^e$", "^äbc$"]


def test_few_labels_are_enough_for_plain_insults():
    rng = random.Random(9)
    words = ["".join(rng.choices("aeioutnrsld", k=rng.randint(2, 9))) for _ in range(900)]
    clean = [[f"^{w}$" for w in rng.sample(words, 40)] for _ in range(250)]
    toxic = [[f"^{w}$" for w in rng.sample(words, 40)] + [f"^{rng.choice(['grobnik', 'flumpf', 'zwackel'])}$"] for _ in range(30)]
    model = toxicity.fit(toxic, clean)
    assert len(model.landmarks) >= 3
    rate = lambda u: 0.7 + toxicity.values(model, [u])[0] - model.limits[0]  # noqa: E731  0.7 at the limit, as the score has it
    assert all(rate(u) >= 0.7 for u in ("^grobnik$", "^flumpf$", "^zwackel$", "^grobnnik$")) and max(rate(f"^{w}$") for w in words) < 0.7


def plain_score(model, text):
    """A text's score from the kernel's definition: units by a regular expression, the highest distinct ones, their limits."""
    import re

    words = [re.sub(r"[\W_]+", "", w.lower()) for w in re.split("[\t-\r ]+", text or "")]
    runs = ["".join(m[0].split()).lower() for m in re.finditer(r"(?<!\S)[^\W\d_](?:\s+[^\W\d_]){2,}(?!\S)", text or "")]
    values = []
    for u in {f"^{w}$" for w in [*words, *runs] if w}:
        parts = strings.windows(u)
        best = max(sum(w * plain(p, m) ** 2 / (plain(p, p) * plain(m, m)) for w, m in zip(model.weights, model.landmarks, strict=True)) + model.bias for p in parts) if len(u) >= strings.ORDER else toxicity.FLOOR
        values.append(max(best, toxicity.FLOOR))
    top = (sorted(values, reverse=True) + [toxicity.FLOOR] * toxicity.TOP)[: toxicity.TOP]
    above = max(v - t for v, t in zip(top, model.limits, strict=True))
    return 1 / (1 + np.exp(-toxicity.SLOPE * above) * 0.3 / 0.7)


def test_scores_equal_the_plain_ones(spark):
    rows = corpus(300, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"), F.lit(True))
    texts = [t for _, t, _ in rows[:12]] + ["", None, "g r o b n i k and x", "flumxpf", "flumpf zwackel flumpf", "!!", "a.b.c z-w-a-c-k-e-l"]
    got = toxicity.rate(spark.createDataFrame([(i, False, t or "") for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string"), model).collect()
    for r in got:
        assert abs(r["score"] - plain_score(model, texts[r["doc_id"]])) < 1e-3, texts[r["doc_id"]]


def test_one_high_value_or_two_lower_ones():
    model = toxicity.Model([], np.zeros(0), 0.0, np.array([0.8, 0.2]))
    import pyarrow as pa

    texts = pa.array(["a b", "a a", "c d", "", "b"])
    of, ends, names = toxicity.units(texts)
    value = np.array([{"^a$": 0.5, "^b$": 0.3, "^c$": 0.9, "^d$": -0.9}.get(n, toxicity.FLOOR) for n in names])
    got = toxicity.text_scores(model, None, texts, of, ends, value) >= 0.7
    assert got.tolist() == [True, False, True, False, False]  # a unit that repeats counts once


def test_threshold_parts_texts():
    z, y = np.array([3.0, 2.9, 2.8, 0.1, -0.5, -1.0]), np.array([1.0, 1.0, 1.0, 0.0, 0.0, 0.0])
    assert toxicity._threshold(z, y, y) == 1.0
    assert toxicity._threshold(-z, y, y) > 1
