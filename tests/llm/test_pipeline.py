import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain_text(lang, rng, n):
    words = {"en": "the of and to in that is was with for river stone cloud paper".split(), "de": "der die und nicht auf ist ein schön für größer Haus Baum".split()}[lang]
    return " ".join(rng.choice(words) + (str(rng.randrange(300)) if rng.random() < 0.5 else "") for _ in range(n))


def test_stages_one_by_one(spark, tmp_path):
    rng = random.Random(4)
    item = plain_text("en", rng, 30)
    rows = [(i, "\n".join(plain_text(lang, rng, 12) for _ in range(3)), lang, "s", 0) for i, lang in enumerate(["en", "de"] * 30)]
    body = rows[0][1].split("\n")
    rows += [(100, rows[2][1], "en", "s", 0), (101, "\n".join([body[0], "something quite new of the river is here to stay", body[1]]), "en", "s", 0), (102, "12 34 !!", "en", "s", 0), (103, None, "en", "s", 0), (104, plain_text("en", rng, 20) + " " + item, "en", "s", 0), (105, "", "de", "s", 0), (60, rows[4][1], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert name == "pack" or docs.columns == columns
        seen[name] = docs = spark.createDataFrame(docs.toArrow()) if docs.count() else docs
    ids = {name: sorted(r["doc_id"] for r in df.select("doc_id").distinct().collect()) for name, df in seen.items()}
    assert ids["language"] == [*range(61), 100, 101, 104]
    texts = {r["doc_id"]: r for r in seen["line_dedup"].collect()}
    assert texts[100]["text"] == "" == texts[60]["text"] and texts[101]["text"] == "something quite new of the river is here to stay"
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values()) and texts[1]["text"] == rows[1][1]
    assert ids["near_dedup"] == [*range(61), 101, 104]  # 60 and 100 are both empty now
    assert ids["decontaminate"] == [*range(61), 101] == ids["pack"]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, got.drop("sequence_id", "offset").collect())) == sorted(map(str, seen["pack"].drop("sequence_id", "offset").collect()))


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_null_ids_in_near_dedup(spark):
    from yieldloom.llm import simhash

    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text than that one"), (2, "a b c d e f"), (None, "only null rows have this text here"), (None, "only null rows have this text here"), (None, "a b c d e f")]
    got = simhash.representatives(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, __x int")).collect()
    texts = [(r["doc_id"], r["text"]) for r in got]
    assert texts.count((1, "a b c d e f")) == 1 and (1, "quite another text than that one") in texts and (2, "a b c d e f") not in texts
    assert texts.count((None, "only null rows have this text here")) == 1


def random_documents(seed):
    """Rows with null and repeated ids and rows, equal and near lines and texts, benchmark passages, and clashing columns."""
    rng = random.Random(seed)
    line = lambda: plain_text("en", rng, rng.randint(3, 14))
    items = [plain_text("en", rng, 25) for _ in range(3)]
    texts = ["\n".join(line() for _ in range(rng.randint(1, 6))) for _ in range(40)]
    for t in texts[:12]:
        ws = t.split(" ")
        ws[rng.randrange(len(ws))] = "changed"
        texts += [t, " ".join(ws), t + "\n" + line()]
    texts += [items[0], line() + " " + items[1] + "\n" + line(), " ".join(items[2].split()[:8]), None, "", " \n\t", "12 !"]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts, 1)]
    rows += [rows[0], rows[0], (3, texts[20]), (None, texts[21]), (None, texts[21]), (5, None)]
    rng.shuffle(rows)
    return [(d, t, "en", f"s{k % 3}", len(t or ""), k, f"x{k}", -k) for k, (d, t) in enumerate(rows)], [(k, t) for k, t in enumerate(items)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_dropped int, `a.b` string, __t long"


@pytest.mark.parametrize("seed", [1, 2])
def test_stages_against_brute_force(spark, tmp_path, seed):
    from collections import Counter

    from tests.llm.test_decontaminate import cut, plain_tiles
    from tests.llm.test_jaccard import similar
    from tests.llm.test_lines import plain

    rows, items = random_documents(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    do = lambda name: [tuple(r) for r in stages[name](spark, docs, str(tmp_path)).collect()]
    by = lambda r: str(r)

    # Without two languages to learn, every text with a letter is accepted.
    assert sorted(do("language"), key=by) == sorted((r for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=by)

    # Texts of one doc_id that differ are ordered by a hash, so only ids with one text are compared.
    several = {d for d in {r[0] for r in rows} if len({r[1] for r in rows if r[0] == d}) > 1}
    single = [r for r in rows if r[0] not in several]
    docs = spark.createDataFrame(single, SCHEMA)
    kept = plain([(r[0], r[1]) for r in single])
    want = []
    for r in single:
        t = None if r[1] is None else kept[r[0] if r[0] is not None else 10**9, r[1]]
        want.append((r[0], t, *r[2:4], None if t is None else len(t), *r[5:]))
    assert sorted(do("line_dedup"), key=by) == sorted(want, key=by)

    docs, root = spark.createDataFrame(rows, SCHEMA), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    blank = [not (r[1] or "").split() for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if blank[i] and blank[j] or not (blank[i] or blank[j]) and similar(rows[i][1], rows[j][1]):
                root[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r)
    got = do("near_dedup")
    assert len(got) == len(groups) and set(got) <= set(rows)
    of = {r: top(i) for i, r in enumerate(rows)}
    assert len({of[r] for r in got}) == len(groups)
    for r in got:
        ids = [x[0] for x in groups[of[r]] if x[0] is not None]
        assert r[0] == (min(ids) if ids else None)

    def contaminated(text):
        words = cut(text)
        return any(sum(k for *_, k in plain_tiles(words, cut(t), 5)) >= 0.5 * len(cut(t)) for _, t in items)

    assert sorted(do("decontaminate"), key=by) == sorted((r for r in rows if not contaminated(r[1])), key=by)

    from tokenizers import Tokenizer

    from yieldloom.llm.queries import vocabulary

    tokenizer, packed = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), do("pack")
    sizes = Counter((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    assert Counter((p[0], p[3]) for p in packed) == sizes  # no text is longer than a sequence here
    assert len({p[5] for p in packed}) == -(-sum(p[3] for p in packed) // 2048)
    for s in {p[5] for p in packed}:
        own = sorted((p[6], p[3]) for p in packed if p[5] == s)
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
