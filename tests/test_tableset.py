import threading

import pytest
from pyspark.sql import functions as F

from yieldloom.operators import batches, cleaning
from yieldloom.operators.progress import Tasks, followed
from yieldloom.sources import files, tables
from yieldloom.sources.tableset import Conflict, TableSet

LIMITS = {"FAI1": (1.0, 5.0), "FAI2": (0.0, None)}


class Died(BaseException):
    """Stands for the end of the process: nothing of the library catches it."""


def dying(monkeypatch, step, *names):
    """The library's process ends as it comes to its step-th use of the file system by one of these functions."""
    count = [0]
    for name in names:
        real = getattr(files, name)

        def use(*a, real=real, **k):
            count[0] += 1
            if count[0] == step:
                raise Died
            return real(*a, **k)

        monkeypatch.setattr(files, name, use)
    return count


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n int")


def values(df):
    return sorted(r["n"] for r in df.collect())


def test_a_table_is_replaced_as_a_whole(spark, tmp_path):
    tables_ = TableSet(spark, str(tmp_path))
    first = tables_.write("raw_a", numbers(spark, 1, 2), rows=2)
    old = tables_.read("raw_a")
    with pytest.raises(FileExistsError):
        tables_.write("raw_a", numbers(spark, 3), new=True)
    second = tables_.write("raw_a", old.withColumn("n", F.col("n") + 10))  # reads what it replaces
    assert first != second and values(tables_.read("raw_a")) == [11, 12] and values(old) == [1, 2]
    assert tables_.names("raw_") == ["raw_a"] and tables_.names("judged_") == []
    tables_.drop("raw_a")
    assert tables_.names("raw_") == [] and tables_.paths("raw_a") == []
    with pytest.raises(FileNotFoundError):
        tables_.read("raw_a")


def test_two_writers(spark, tmp_path):
    one, two = TableSet(spark, str(tmp_path)), TableSet(spark, str(tmp_path))
    one.write("raw_a", numbers(spark, 1))
    before = two.entry("raw_a")
    one.write("raw_b", numbers(spark, 2))
    two.commit({"raw_a": {"paths": before["paths"], "note": "x"}}, {"raw_a": before})  # another table's change does no harm
    with pytest.raises(Conflict):
        one.commit({"raw_a": {"paths": []}}, {"raw_a": before})
    assert one.names("raw_") == ["raw_a", "raw_b"]


def test_of_many_that_publish_one_number_one_wins(spark, tmp_path):
    folder, won = str(tmp_path / "m"), []
    files.put(spark, f"{folder}/x", b"")
    work = [threading.Thread(target=lambda k=k: won.append(files.publish(spark, f"{folder}/1.json", str(k).encode()))) for k in range(8)]
    [t.start() for t in work]
    [t.join() for t in work]
    assert sorted(won) == [False] * 7 + [True] and len(files.whole(spark, f"{folder}/1.json")) == 1
    counts = TableSet(spark, str(tmp_path))
    add = lambda k: counts.change(lambda now: now | {f"t{k}": {"paths": ["p"]}}, {})
    work = [threading.Thread(target=add, args=(k,)) for k in range(6)]
    [t.start() for t in work]
    [t.join() for t in work]
    assert counts.state() == (6, {f"t{k}": {"paths": ["p"]} for k in range(6)})


@pytest.mark.parametrize("step", range(1, 4))
def test_a_writer_that_dies_leaves_the_table(spark, tmp_path, monkeypatch, step):
    tables_ = TableSet(spark, str(tmp_path))
    tables_.write("raw_a", numbers(spark, 1))
    with monkeypatch.context() as m:
        m.setattr(files, "remove", lambda *a: None)
        count = dying(m, step, "publish", "names", "whole")
        with pytest.raises(Died):
            while count[0] < step:
                tables_.write("raw_a", numbers(spark, 2))
    assert values(tables_.read("raw_a")) in ([1], [2])
    tables_.write("raw_a", numbers(spark, 3))
    assert values(tables_.read("raw_a")) == [3]
    tables_.sweep(keep=1, age=0)
    assert values(tables_.read("raw_a")) == [3] and len(files.names(spark, str(tmp_path), "raw_*")) + len(files.names(spark, f"{tmp_path}/versions", "*")) == 1


def test_a_raw_table_that_was_never_whole_is_no_batch(spark, tmp_path):
    files.put(spark, f"{tmp_path}/raw_dead/part-0.parquet", b"half")
    numbers(spark, 1).write.parquet(str(tmp_path / "raw_b"))
    assert tables.list_batches(spark, str(tmp_path)) == [("b", f"{tmp_path}/raw_b")]
    tables.write_raw(numbers(spark, 5), str(tmp_path), "dead")
    assert [b for b, _ in tables.list_batches(spark, str(tmp_path))] == ["b", "dead"] and values(tables.read_batch(spark, str(tmp_path), "dead")) == [5]


@pytest.mark.parametrize("step", range(1, 9))
def test_a_move_that_breaks_off_is_ended(spark, tmp_path, monkeypatch, step):
    target = str(tmp_path / "t")
    numbers(spark, 1).write.parquet(target)
    with monkeypatch.context() as m:
        count = dying(m, step, "exists", "publish", "remove", "head")
        try:
            cleaning.rewrite(numbers(spark, 2), target)
        except Died:
            pass
        else:
            assert count[0] < step
    files.recover(spark, target)
    assert values(spark.read.parquet(target)) in ([1], [2])
    cleaning.rewrite(numbers(spark, 3), target)
    assert values(spark.read.parquet(target)) == [3]


def test_between_the_two_renames(spark, tmp_path):
    """The old table is aside and the new one not yet there: what a process leaves that dies just then."""
    numbers(spark, 2).write.parquet(str(tmp_path / "new"))
    numbers(spark, 1).write.parquet(str(tmp_path / "new-old"))
    files.publish(spark, files._moves(str(tmp_path / "t")), b'{"new": "%s"}' % str(tmp_path / "new").encode())
    files.recover(spark, str(tmp_path / "t"))
    assert values(spark.read.parquet(str(tmp_path / "t"))) == [2] and sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["t"]


def measured(spark, n, parts):
    rows = [(f"s{k}", k % 9 * 1.0, k % 4 - 1.0) for k in range(n)]
    return spark.createDataFrame(rows, "SN string, FAI1 double, FAI2 double").repartition(parts)


def test_a_broken_off_batch_goes_on(spark, tmp_path):
    folder = str(tmp_path / "d")
    tables.write_raw(measured(spark, 500, 6), folder, "a")
    tables.write_raw(measured(spark, 500, 6), folder, "whole")
    want = batches.judge_one(spark, folder, "whole", LIMITS, "v")

    def until(k):
        def seen(done, total):
            if done == k:
                raise Died

        return seen

    with pytest.raises(Died):
        batches.judge_one(spark, folder, "a", LIMITS, "v", split=1, progress=until(2))
    assert [b for b, _ in tables.list_batches(spark, folder, "judged")] == ["whole"]  # nothing of it counts as judged yet
    with pytest.raises(Died):
        batches.judge_one(spark, folder, "a", LIMITS, "v", split=1, progress=until(4))
    calls = []
    got = batches.judge_one(spark, folder, "a", LIMITS, "v", split=1, progress=lambda done, total: calls.append((done, total)))
    assert (got["ranges"], got["resumed"], calls) == (6, 4, [(k, 6) for k in range(7)])
    assert {k: got[k] for k in ("total_rows", "ng_count", "yield_rate", "matched")} == {k: want[k] for k in ("total_rows", "ng_count", "yield_rate", "matched")}
    rows = lambda b: sorted(tuple(r[:6]) for r in tables.read_batch(spark, folder, b, "judged").select("SN", "FAI1", "FAI2", "FAI1_result", "FAI2_result", "overall_result").collect())
    assert rows("a") == rows("whole") and len({r["judged_at"] for r in tables.read_batch(spark, folder, "a", "judged").collect()}) == 1
    assert files.names(spark, f"{folder}/versions", "judging_*") == []


def test_nothing_is_taken_over_from_another_run(spark, tmp_path):
    folder = str(tmp_path / "d")
    tables.write_raw(measured(spark, 60, 3), folder, "a")

    def broken(limits, version, split):
        def stop(done, total):
            if done == 2:
                raise Died

        with pytest.raises(Died):
            batches.judge_one(spark, folder, "a", limits, version, split=split, progress=stop)

    for limits, version, split in (({"FAI1": (1.0, 4.0)}, "v", 1), (LIMITS, "w", 1), (LIMITS, "v", 2)):
        broken(limits, version, split)
        assert batches.judge_one(spark, folder, "a", LIMITS, "v", split=1)["resumed"] == 0
    broken(LIMITS, "v", 1)
    assert batches.judge_one(spark, folder, "a", LIMITS, "v", split=1, resume=False)["resumed"] == 0
    assert values(tables.read_batch(spark, folder, "a", "judged").groupBy("SN").count().select(F.col("count").cast("int").alias("n"))) == [1] * 60


def test_progress_rises(spark, tmp_path):
    tasks, seen = Tasks(spark, str(tmp_path / "tasks")), []
    over = threading.Event()

    def reader():
        while not over.wait(0.05):
            seen.extend((r["percent"], r["left_s"]) for r in tasks.list() if r["name"] == "judge_x")

    thread = threading.Thread(target=reader)
    thread.start()
    with followed(tasks, "judge_x", every=0.1) as task:
        slow = F.udf(lambda x: __import__("time").sleep(0.3) or x, "long")
        spark.range(0, 24, 1, 24).select(slow("id")).write.format("noop").mode("overwrite").save()
    over.set()
    thread.join()
    percents = [p for p, _ in seen]
    assert percents == sorted(percents) and len({p for p in percents if 0 < p < 100}) >= 2 and any(left for _, left in seen)
    assert tasks.get(task)["state"] == "completed" and tasks.get(task)["percent"] == 100.0
    with pytest.raises(ValueError):
        with followed(tasks, "bad"):
            raise ValueError("no")
    assert [r["state"] for r in tasks.list()] == ["failed", "completed"] and "no" in tasks.list()[0]["error"]


def test_many_files_of_two_schemas_are_two_scans(spark, tmp_path):
    for k in range(12):
        kind = "int" if k % 2 else "string"
        spark.createDataFrame([(f"s{k}", 1 if k % 2 else "x")], f"SN string, n {kind}").withColumn(f"m{k % 4}", F.lit(k)).write.parquet(str(tmp_path / f"judged_{k}"))
    df = tables.judged(spark, str(tmp_path / "judged_*"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    assert {r["SN"]: (r["n"], r["m0"], r["m1"]) for r in df.collect()} == {f"s{k}": ("1" if k % 2 else "x", k if k % 4 == 0 else None, k if k % 4 == 1 else None) for k in range(12)}


def test_the_first_of_repeats_in_the_file_stays(spark, tmp_path):
    body = "".join(f'u{k % 7},2026-01-02,L,V,P,{k},"a\nb"\n' for k in range(400))
    (tmp_path / "a.csv").write_text("SN,Time,CFG,Vendor,Project,FAI1,Note\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 900)
    try:
        rows = cleaning.import_rows(tables.read_csv(spark, str(tmp_path / "a.csv"), places=True))
        assert sorted((r["SN"], r["FAI1"]) for r in rows.collect()) == [(f"u{k}", float(k)) for k in range(7)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    sheet = tables.rows_to_raw(spark, ["SN", "Time", "Line", "Vendor", "Project", "FAI1"], [["x", "2026-01-02", "L", "V", "P", k] for k in range(50)], places=True)
    got = cleaning.import_rows(sheet.repartition(5))
    assert [r["FAI1"] for r in got.collect()] == [0.0] and "__row" not in got.columns


def test_shared_folder_without_any_setting():
    from types import SimpleNamespace

    def session(master, given=None, checkpoint=None):
        context = SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: checkpoint)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: given))

    own = files.shared_dir(session("local[4]"))
    assert own.startswith("file:///") and files.shared_dir(session("local[4]")) == own
    assert files.shared_dir(session("spark://x", "hdfs://a/b/")) == "hdfs://a/b" and files.shared_dir(session("spark://x", None, "hdfs://c")) == "hdfs://c"
    for master in ("spark://x", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            files.shared_dir(session(master))
