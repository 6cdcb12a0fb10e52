"""Answers that outlive a run, histories, counted scans."""

import pytest
from pyspark.sql import functions as F

from loomstone.sources import scans, stores


def requests(spark, n):
    return spark.range(n).select((F.col("id") % 100).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("q"), F.lit(1).alias("extra"))


class Service:
    """Answers, and remembers each key it was asked for."""

    def __init__(self, fail_at=None, silent=()):
        self.asked, self.calls, self.fail_at, self.silent = [], 0, fail_at, silent

    def __call__(self, missing):
        self.calls += 1
        if self.calls == self.fail_at:
            raise RuntimeError("killed")
        self.asked += [(r.k, r.q) for r in missing.collect()]
        says = ~F.coalesce(F.col("q").isin(list(self.silent)), F.lit(False))
        return missing.select("k", "q", F.when(says, F.concat_ws("-", F.lit("a"), "k", "q")).alias("text"), F.when(says, F.col("k")).alias("score"))


def test_a_second_run_asks_nothing(spark, tmp_path):
    store = stores.Answers(spark, str(tmp_path / "a"), ["k", "q"], "text string, score long", buckets=8)
    first, second = Service(silent=["1", "4"]), Service()
    want = {(r.k, r.q) for r in requests(spark, 300).collect()}
    assert store.fill(requests(spark, 300), first) == len(want) - 2 and set(first.asked) == want and len(first.asked) == len(want)
    assert store.fill(requests(spark, 300), second) == 2 and sorted(second.asked) == [(1, "1"), (4, "4")]
    assert store.fill(requests(spark, 300), third := Service()) == 0 and third.asked == []
    got = store.lookup(requests(spark, 301))
    assert got.columns == ["k", "q", "extra", "text", "score"] and got.count() == 301
    for r in got.collect():
        assert r.text == "-".join(["a", str(r.k), *([r.q] if r.q else [])]) and r.score == r.k
    again = stores.Answers(spark, str(tmp_path / "a"), ["k", "q"], "text string, score long", buckets=8)
    again.compact(requests(spark, 1))
    assert len(again.batches()) == 1 and again.vacuum() > 0
    assert sorted(map(str, again.lookup(requests(spark, 301)).collect())) == sorted(map(str, got.collect()))
    assert again.fill(requests(spark, 300), Service()) == 0
    none = stores.Answers(spark, str(tmp_path / "none"), ["k"], "text string")
    assert none.lookup(requests(spark, 5)).where("text is null").count() == 5 and none.batches() == []


def test_a_run_killed_half_way_loses_one_step(spark, tmp_path):
    store = stores.Answers(spark, str(tmp_path / "a"), ["k", "q"], "text string, score long", buckets=16)
    killed, after = Service(fail_at=3), Service()
    with pytest.raises(RuntimeError, match="killed"):
        store.fill(requests(spark, 300), killed, steps=4)
    # an attempt whose manifest is missing counts for nothing
    spark.createDataFrame([(5, None, "wrong", 0, 1)], "k long, q string, text string, score long, bucket int").write.partitionBy("bucket").parquet(f"{tmp_path}/a/data/batch=dead")
    store.fill(requests(spark, 300), after, steps=4)
    assert not set(killed.asked) & set(after.asked)
    assert set(killed.asked) | set(after.asked) == {(r.k, r.q) for r in requests(spark, 300).collect()}
    assert store.lookup(requests(spark, 300)).where("text = 'wrong' or text is null").count() == 0
    assert store.vacuum() >= 1


def test_history(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = lambda n: spark.range(n).select("id", F.lit("x").alias("run_id"))
    assert stores.runs(spark, path).count() == 0
    stores.write_run({"rows": rows(5), "summary": rows(1)}, path, "2024-01", {"model": "m"})
    stores.write_run({"rows": rows(7), "summary": rows(1)}, path, "2024-02")
    stores.write_run({"rows": rows(6), "summary": rows(1)}, path, "2024-01", {"model": "n"})  # the same run again
    counts = lambda name="rows", **k: {r.run_id: r["count"] for r in stores.read_runs(spark, path, name, **k).groupBy("run_id").count().collect()}
    assert counts() == {"2024-01": 6, "2024-02": 7} and counts("summary") == {"2024-01": 1, "2024-02": 1}
    bad = {"rows": rows(9), "summary": spark.range(1).select(F.raise_error(F.lit("broken")).alias("id"))}
    for run in ("2024-02", "2024-03"):
        with pytest.raises(Exception, match="broken"):
            stores.write_run(bad, path, run)
    assert counts() == {"2024-01": 6, "2024-02": 7} and counts(run_ids=["2024-02"]) == {"2024-02": 7}
    assert {r.run_id: r.meta for r in stores.runs(spark, path).collect()} == {"2024-01": '{"model": "n"}', "2024-02": "{}"}
    assert stores.vacuum_runs(spark, path) == 4 and counts() == {"2024-01": 6, "2024-02": 7}


def test_counts_of_a_scan_take_no_second_job(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("v"), F.lit(0).alias("reason"))
    tests = {"missing": F.col("v").isNull(), "long": F.length("v") > 2, "even": F.col("id") % 2 == 0}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sorting", "")
    found = stores.sort_out(rows, tests, str(tmp_path / "out"))
    jobs = len(tracker.getJobIdsForGroup("sorting"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs == 1
    v = lambda i: str(i) if i % 10 else None
    want = ["missing" if v(i) is None else "long" if len(v(i)) > 2 else "even" if i % 2 == 0 else "ok" for i in range(1000)]
    assert found.counts == {n: want.count(n) for n in ("ok", "missing", "long", "even")}
    assert sorted(r.id for r in found.good.collect()) == [i for i, w in enumerate(want) if w == "ok"]
    assert {(r.id, r.reason) for r in found.rejected.collect()} == {(i, w) for i, w in enumerate(want) if w != "ok"}
    empty = stores.sort_out(rows.where("false"), tests, str(tmp_path / "none"))
    assert empty.counts == {"ok": 0, "missing": 0, "long": 0, "even": 0} and empty.good.count() == 0


def test_counted_lines_and_files(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x.log").write_text('{"a":1}\n\n  \noops\n==== end\n{"a":2}\n[1\n')
    lines = scans.json_lines_sorted(spark, str(tmp_path / "log"), "a int", str(tmp_path / "out"))
    assert lines.counts == {"ok": 2, "blank": 2, "footer": 1, "not json": 2}
    assert sorted(r.a for r in lines.good.collect()) == [1, 2] and {r.value for r in lines.rejected.where("reason = 'not json'").collect()} == {"oops", "[1"}
    (tmp_path / "files").mkdir()
    for name, said in (("a.json", '{"x":1}'), ("b.json", "oops"), ("c.json", " \n"), ("d.txt", "")):
        (tmp_path / "files" / name).write_text(said)
    files = scans.json_files_sorted(spark, str(tmp_path / "files"), str(tmp_path / "out2"))
    assert files.counts == {"ok": 1, "blank": 1, "not json": 1} and [r.name for r in files.good.collect()] == ["a.json"]
    assert {r.name for r in files.rejected.collect()} == {"b.json", "c.json"}
