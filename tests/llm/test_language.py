import pyarrow as pa
import numpy as np
from pyspark.sql import functions as F

from yieldloom.llm import language, ngrams

WORDS = {"en": "the of and to in that is was with for", "de": "der die und nicht auf ist ein schön für größer", "fr": "le la les été où que des une avec élève", "es": "el los que por señor niño más está una con"}


def texts(n):
    rng = np.random.default_rng(2)
    return [(i, " ".join(rng.choice(WORDS[lang].split(), 8 + i % 30)).capitalize() + ".", lang) for i, lang in enumerate(sorted(WORDS) * n)]


def test_weights_are_summed_over_each_text(monkeypatch):
    monkeypatch.setattr(ngrams, "STEP", 1000)
    t = pa.array(["Abc d", None, "", "7 -", "é" * 70000, "xyz"])
    w = np.random.default_rng(0).normal(size=(ngrams.BUCKETS, 3)).astype(np.float32)
    assert np.allclose(ngrams.weigh(t, w), ngrams.frequencies(t) @ w, atol=1e-3)


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 4, 6, 20):
        c = language.codewords(n)
        assert c.shape[0] == n and min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= max(1, 2 ** (n - 2) if n <= 6 else c.shape[1] // 5)


def test_languages_of_held_out_texts(spark):
    rows = [*texts(60), (1000, None, "en"), (1001, "12 - 34!", "de"), (1002, "", None), (None, "der die und nicht", "de"), (5, "der die und nicht", "de"), (1003, "nicht " * 50000, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (5, None)}
    crcs = {r["doc_id"]: r["c"] for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).alias("c")).collect()}
    assert all(by[i]["lang_pred"] == lang and by[i]["held_out"] == (crcs[i] == 0) for i, _, lang in rows[:240] if i in by)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert [r["lang_pred"] for r in got if r["doc_id"] is None] == ["de"] and not any(r["held_out"] for r in got if r["doc_id"] is None)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language.identify(docs).collect()] == ["und"]
    assert language.identify(docs.limit(0)).count() == 0


def test_one_language(spark):
    docs = spark.createDataFrame([(i, "hello there", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(docs).collect()} == {"en"}
