import gzip
import hashlib
import random
from base64 import b32encode

import pytest

from yieldloom.llm import warc
from yieldloom.llm.common import new_path

HTML = ["<p>é</p>", "", None, "<p>é</p>", "a\r\n\r\nWARC/1.1\r\nb", "long " * 100000, "<p>é</p>", "", "other"]


def table(spark):
    rows = [(10 - i, f"https://www.Example.org:80/p{i % 3}?q#f", h, "x") for i, h in enumerate(HTML)]
    return rows + [(20, None, "other", "y"), (None, "nonsense", "only here", "z"), (None, "http://a.b/\r\nc", "other", "z"), (10, "https://www.example.org/p0", "<p>é</p>", "again")]


@pytest.mark.parametrize("least", [0, 6])
def test_pages_come_back(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "FILE_BYTES", 300)
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    monkeypatch.setattr(warc, "RUN_LINES", 3)
    rows = table(spark)
    path = new_path(spark, "w")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"), path, least)
    got = warc.digest(spark, path).collect()
    first = {}
    for p, _, h, _ in rows:
        h = h or ""
        if p is not None and len(h.encode()) >= least:
            first[h] = min(p, first.get(h, p))
    want = []
    for p, _, h, _ in rows:
        h = (h or "").encode()
        ref = first.get(h.decode())
        again = ref is not None and ref != p
        want.append((p, len(h), b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", ref if again else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    lines = sorted(warc.index(warc.read(spark, path)).collect(), key=lambda r: (r["range"], r["place"]))
    keys = [(r["url_key"], r["date"], r["page_id"] is None, r["page_id"] or 0) for r in lines]
    assert keys == sorted(keys) and len(keys) == len(rows)
    for r in lines:  # each capture can be read alone
        with open(r["file"].removeprefix("file:"), "rb") as f:
            f.seek(r["position"])
            (_, fields, _), = warc.records(gzip.decompress(f.read(r["size"])))
        assert fields["warc-target-uri"] == r["url"] and fields["warc-payload-digest"] == "sha1:" + r["digest"]
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, path).collect() if r["payload"] is not None and r["page_id"]}
    assert all(payloads[p] == (h or "") for p, _, h, _ in rows if p in payloads)


def test_empty_table(spark):
    path = new_path(spark, "w")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.digest(spark, path).count() == 0


def test_losers_merge_runs():
    rng = random.Random(0)
    for k in range(0, 12):
        runs = [sorted(rng.choices(range(50), k=rng.randrange(20))) for _ in range(k)]
        assert list(warc.Losers([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("HTTPS://www.Example.org:80/P?x=1#frag") == "org,example)/p?x=1" and warc.url_key("http://a.b") == "b,a)/" and warc.url_key("") == ""


def test_damage_is_noticed():
    with pytest.raises(ValueError, match="no WARC"):
        list(warc.records(b"junk\r\n\r\n"))


def test_a_long_merge_holds_few_blocks(spark, monkeypatch):
    """Blocks of runs that hardly overlap: the tree never holds more than those at one place."""
    most, add = [0], warc.Losers.add

    def seen(self, run):
        add(self, run)
        most[0] = max(most[0], self.k)

    monkeypatch.setattr(warc.Losers, "add", seen)
    runs = [[((k * 100 + i,), None) for i in range(150)] for k in range(40)]
    blocks = sorted(run[a : a + 10] for run in runs for a in range(0, 150, 10))
    assert [x[0][0] for x in warc.merged(iter(blocks))] == sorted(k * 100 + i for k in range(40) for i in range(150))
    assert 1 < most[0] <= 5


def test_ranges_follow_one_another(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h{rng.randrange(30)}.org/{rng.randrange(50)}", f"page {i}") for i in range(3000)]
    path = new_path(spark, "w")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7), path)
    lines = sorted(warc.index(warc.read(spark, path)).collect(), key=lambda r: (r["range"], r["place"]))
    keys = [(r["url_key"], r["date"], r["page_id"]) for r in lines]
    assert keys == sorted(keys) and sorted(k[2] for k in keys) == [*range(3000)] and len({r["range"] for r in lines}) > 1


def test_many_files_are_few_runs_over_long_ranges(spark):
    """Fifty files and many shuffle partitions: a task's files make one run, and a range has a thousand lines at least, so a run's
    part of it is a block of hundreds here."""
    rng = random.Random(5)
    rows = [(i, f"http://h{rng.randrange(300)}.org/{rng.randrange(50)}", f"page {i}") for i in range(20_000)]
    path = new_path(spark, "w")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(50), path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        lines = warc.index(warc.read(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(lines) == 20_000 and len({r["range"] for r in lines}) == 20 and len({r["file"] for r in lines}) >= 50
    ordered = sorted(lines, key=lambda r: (r["range"], r["place"]))
    keys = [(r["url_key"], r["date"], r["page_id"]) for r in ordered]
    assert keys == sorted(keys)


def test_runs_are_added_while_merging():
    rng, tree, left, got = random.Random(2), warc.Losers(), [], []
    for step in range(400):
        if rng.random() < 0.2:
            run = sorted(rng.randrange(step * 10, step * 10 + 500) for _ in range(rng.randrange(9)))
            tree.add(run)
            left += run
        elif tree.k:
            assert tree.first() == min(left)
            got.append(tree.take())
            left.remove(got[-1])
    assert sorted(left) == list(tree)
