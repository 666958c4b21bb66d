import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from yieldloom.sources import csv_ranges, tables


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from('a",\n'), max_size=30))
def test_line_states_equal_one_walk_over_all(text):
    """The state after each line, against a machine that goes letter by letter."""
    state, want = "start", []
    for ch in text:
        if ch == "\n":
            want.append(state == "in")
            state = state if state == "in" else "start"
        elif state == "start":
            state = "in" if ch == '"' else "start" if ch == "," else "plain"
        elif state == "plain":
            state = "start" if ch == "," else "plain"
        elif state == "in":
            state = "quote" if ch == '"' else "in"
        else:  # after a quote within a field
            state = "in" if ch == '"' else "start" if ch == "," else "plain"
    got, within = [], False
    for line in text.split("\n")[:-1]:
        within = csv_ranges.ends_within(line, within, ",")
        got.append(within)
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", '"', '"",', 'x,"', '","', 'b","c']), max_size=4), min_size=1, max_size=8))
def test_marks_name_the_open_record(ranges):
    """Ranges of lines: what is known of each alone gives the state and the open record at each one's beginning."""
    answers, start = [], 0
    within, owner, want = False, -1, {}
    for lines in ranges:
        want[start] = owner if within else -1
        after0, after1, back = False, True, False
        for line in lines:
            after0, after1 = (csv_ranges.ends_within(line, s, ",") for s in (after0, after1))
            back |= not after1
            was, within = within, csv_ranges.ends_within(line, within, ",")
            owner = start if within and not was else owner
        if any('"' in x for x in lines):
            answers.append((start, after0, after1, back))
        start += 10
    found = csv_ranges.marks(answers)
    assert {s: found.at(s) for s in want} == want
    assert found.last == (owner if within else -1)


def read(spark, path, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found, header, _ = tables._csv(spark, str(path))
        rows = sorted(found.cells.collect(), key=lambda r: r[-3:])
        return found, header, [tuple(x or "" for x in r[:-3]) for r in rows], found.cells.rdd.getNumPartitions(), found.broken()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def plain(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return rows[0], [tuple(r) for r in rows[1:] if len(r) == len(rows[0])], sum(len(r) != len(rows[0]) for r in rows)


def test_quoted_line_ends_after_many_plain_rows(spark, tmp_path):
    body = "".join(f"s{k},2026-01-02,L{k % 3},{k}.5\n" for k in range(4000)) + "".join(f'"two\nlines {k}",2026-01-02,"L ""q"", {k}",{k}\n' for k in range(100))
    (tmp_path / "a.csv").write_text("SN,Time,CFG,FAI1\n" + body)
    found, header, rows, tasks, broken = read(spark, tmp_path / "a.csv", 20_000)
    assert found.quoted_line_ends and tasks > 4 and broken == 0
    assert (header, rows, 0) == plain("SN,Time,CFG,FAI1\n" + body)
    raw = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert raw.count() == 4100 and raw.filter("SN LIKE '%\n%'").count() == 100 and raw.columns == ["SN", "Time", "Line", "FAI1"]


@pytest.mark.parametrize("seed", [0, 1, 5])
def test_any_cells_over_any_ranges(spark, tmp_path, seed):
    rnd = random.Random(seed)
    cells = ["", "x", "1.5", "a,b", 'say "hi"', "two\nlines", "three\n\nlines\n", 'quote"\n"at ends"', "\r\n", "日本", "z" * 300]
    out = io.StringIO(newline="")
    write = csv.writer(out, lineterminator="\r\n" if seed % 2 else "\n", quoting=csv.QUOTE_ALL if seed == 5 else csv.QUOTE_MINIMAL)
    write.writerow(["SN", "Time", "head, with comma"])
    for k in range(60):
        write.writerow([f"s{k}", *rnd.choices(cells, k=2 if rnd.random() < 0.95 else 3)])
    (tmp_path / "a.csv").write_bytes(out.getvalue().encode("utf-8-sig" if seed % 3 else "utf-8"))
    for split in (150, 1 << 20):
        found, header, rows, _, broken = read(spark, tmp_path / "a.csv", split)
        assert (header, rows, broken) == plain(out.getvalue())
        assert found.quoted_line_ends


def test_plain_files_stay_with_sparks_reader(spark, tmp_path):
    text = 'SN,Time,n\na,5" pipe,1\n"b, c",t,2\nshort,row\nlong,row,3,4\n\nd,e,5\n'
    (tmp_path / "a.csv").write_text(text)
    found, _, rows, _, broken = read(spark, tmp_path / "a.csv", 16)
    assert not found.quoted_line_ends and "MapInArrow" not in found.cells._jdf.queryExecution().toString()
    assert rows == [("a", '5" pipe', "1"), ("b, c", "t", "2"), ("d", "e", "5")] and broken == 2 == tables.csv_broken(spark, str(tmp_path / "a.csv"))
    assert found.cells.count() == 3


def test_bytes_of_another_encoding_after_the_beginning(spark, tmp_path):
    text = "SN,Time,n\n" + "a,b,1\n" * 20_000 + '线体|,"第 1\n行",2\n'
    (tmp_path / "a.csv").write_bytes(text.encode("gbk"))
    found, _, rows, _, _ = read(spark, tmp_path / "a.csv", 30_000)
    assert found.encoding == "gbk" and rows[-1] == ("线体|", "第 1\n行", "2") and len(rows) == 20_001


def test_a_field_that_never_ends_is_broken(spark, tmp_path):
    (tmp_path / "a.csv").write_text('SN,Time,n\na,b,1\n"open,b,2\nc,d,3\n')
    for split in (10, 1 << 20):
        assert read(spark, tmp_path / "a.csv", split)[2] == [("a", "b", "1")]


def test_empty_and_heading_alone(spark, tmp_path):
    for text, header in (("", []), ("SN,Time\n", ["SN", "Time"]), ('"SN\nx",Time\n', ["SN\nx", "Time"])):
        (tmp_path / "a.csv").write_text(text)
        found, got, rows, _, _ = read(spark, tmp_path / "a.csv", 8)
        assert (got, rows) == (header, [])
        assert tables.read_csv(spark, str(tmp_path / "a.csv")).count() == 0


def test_a_folder_of_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    want = []
    for k in range(4):
        body = "".join(f'"s{k}\n{i}",t,{i}\n' if (i + k) % 3 else f"s{i},t,{i}\n" for i in range(20 * k + 5))
        (tmp_path / "d" / f"p{k}.csv").write_text("SN,Time,n\n" + body + ('"open,t,1\n' if k == 2 else ""))
        want += plain("SN,Time,n\n" + body)[1]
    (tmp_path / "d" / "_SUCCESS").write_text("")
    for split in (60, 1 << 20):
        assert read(spark, tmp_path / "d", split)[2] == want
