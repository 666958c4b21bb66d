import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from yieldloom.llm import infill


def plain(doc_id, text, seed=42, rate=50, suffix_first=80):
    """(n, form, prefix_chars, middle_chars, output) by the rules, one text at a time."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    if text == "" or re.search("<P>|<S>|<M>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def draws(ids):
    digests = [hashlib.sha256(f"42:{i}".encode()).hexdigest() for i in ids]
    return np.array([[int(d[8 * k : 8 * k + 8], 16) for k in range(4)] for d in digests], np.int64).reshape(-1, 4)


TEXT = st.text(alphabet=st.sampled_from("ab \t\n\x0b\x1cé日😀<P>SM"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**9), TEXT), min_size=1, max_size=8), st.sampled_from([0, 50, 100]), st.sampled_from([0, 80, 100]))
def test_batches_equal_the_plain_form(rows, rate, first):
    texts = pa.array([t for _, t in rows], pa.string())
    got = infill.transform_batch(texts, draws([i for i, _ in rows]), rate, first)
    assert [*zip(*(c.to_pylist() for c in got), strict=True)] == [plain(i, t, 42, rate, first) for i, t in rows]


def test_sliced_batches():
    texts = pa.array(["x y", "a b c", "", "d  e \n"])
    got = infill.transform_batch(texts.slice(1, 3), draws([1, 2, 3]), 100, 50)
    assert [*zip(*(c.to_pylist() for c in got), strict=True)] == [plain(i, t, 42, 100, 50) for i, t in ((1, "a b c"), (2, ""), (3, "d  e \n"))]


def test_rows_of_a_table(spark):
    texts = [None, "", " ", "one", " a b\tc \n", "has <P> it", "<<S>", "é 日本 😀", "w " * 200_000, "a<", "<P", "x<S y> z<M"]
    rows = [(k, texts[k % len(texts)], "s", 1) for k in range(240)] + [(None, "null id a b c", "s", 1), (7, "again", "s", 1), (7, "again", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    made = infill.transform(docs, rate=90, suffix_first=50)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(((i, *plain(i, t, 42, 90, 50)) for i, t, *_ in rows), key=key)
    back = made.select(infill.restored(made["form"], made["output"]).alias("t")).collect()
    assert sorted(r["t"] for r in back) == sorted(t or "" for _, t, *_ in rows)


def test_digest_hashes_output_and_text(spark):
    rows = [(k, f"text {k} of  some words\n") for k in range(60)]
    got = infill.digest(infill.transform(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(tuple, got)) == sorted((i, *plain(i, t)[:4], sha(plain(i, t)[4]), sha(t)) for i, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_no_rows(spark):
    assert infill.digest(infill.transform(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
