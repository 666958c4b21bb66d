import random
import re

from pyspark.sql import functions as F

from yieldloom.llm import lines


def plain(rows):
    """(doc_id, kept text) by comparing each line with all earlier ones."""
    order = sorted({(i if i is not None else 10**9, t) for i, t in rows if t is not None}, key=lambda x: x[0])
    earlier, kept = [], {}
    for i, t in order:
        stay = []
        for line in t.split("\n"):
            w = [x for x in re.split("[ \t\r\f\v]", line) if x]
            if not w or not any(near(w, e) for e in earlier):
                stay.append(line)
            if w:
                earlier.append(w)
        kept[i, t] = "\n".join(stay)
    return kept


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, line string, n_dropped int")
    got = lines.deduplicate(docs).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or 10**9, r["text"] or "") for r in got) == sorted((i or 10**9, "" if t is None else want[i if i is not None else 10**9, t]) for i, t in rows)
    return got


def test_random_lines(spark):
    rng = random.Random(11)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(4)) for _ in range(rng.randint(1, 12))] for _ in range(40)]
    rows = []
    for i in range(1, 121):
        text = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k, kind = rng.randrange(len(w) + 1), rng.randrange(3)
                w[k : k + (kind < 2)] = [rng.choice("xyz")] * (kind > 0)
            text.append(rng.choice([" ", "  ", "\t"]).join(w))
        rows.append((i, "\n".join(text)))
    check(spark, rows)


def test_odd_rows(spark):
    line = "one two three four five six"
    rows = [(3, line), (1, line + "\n\n" + line), (2, None), (4, ""), (None, line + " seven"), (5, "\n\n"), (6, "a\nb\na"), (3, line), (7, "word " * 3000), (8, "word " * 2999 + "x word"), (9, "word " * 3000 + "more"), (10, "one two three four five sixx\r\nfive six seven eight")]
    got = {r["doc_id"]: r for r in check(spark, rows)}
    assert (got[1]["text"], got[1]["n_lines"], got[1]["n_dropped"]) == (line + "\n", 3, 1)
    assert got[2]["text"] is None and got[2]["n_lines"] == 0 and got[3]["text"] == "" and got[6]["text"] == "a\nb" and got[8]["text"] == "" and got[9]["text"] == ""


def test_a_crowd_with_one_skeleton(spark):
    rows = [(i, f"all of this text is the same but for number {i}") for i in range(1, 400)]
    got = check(spark, rows)
    assert sum(1 for r in got if r["text"]) == 1


def test_empty_table(spark):
    assert lines.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_that_collide_hide_no_partner(spark, monkeypatch):
    """With three bits of the first hash nearly all variants meet; the second keeps them apart."""
    real = lines._hash
    monkeypatch.setattr(lines, "_hash", lambda k, place: real(k, place).bitwiseAND(F.lit(7)) if k == 0 else real(k, place))
    rng = random.Random(4)
    base = [[rng.choice("abcdefgh") for _ in range(9)] for _ in range(12)]
    rows = []
    for i in range(1, 60):
        w = list(rng.choice(base))
        w[rng.randrange(9)] = rng.choice("xyz")
        rows.append((i, " ".join(w)))
    check(spark, rows)
