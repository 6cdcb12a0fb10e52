"""Lists that many classes share are split over tasks, and each still has one leader."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.llm import ngram_join


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def wanted(rows):
    lists = {}
    for s, fp, tag in rows:
        lists.setdefault(s, set()).add((fp, tag))
    return sorted((s, min(its)[0], fp, tag) for s, its in lists.items() if len(its) > 1 for fp, tag in its)


def postings(rng, n, hot):
    rows = [(rng.choice([7, -7]) if rng.random() < hot else rng.randint(-n // 2, n // 2), fp) for fp in rng.sample(range(-(10**9), 10**9), n)]
    rows += rng.sample(rows, n // 5)  # repeated rows
    return [(s, fp, 256 + fp % 9) for s, fp in rows]


@pytest.mark.parametrize(("n", "hot"), [(3000, 0.6), (3000, 0.0), (3000, 1.0), (9, 0.3), (1, 0.0), (2, 1.0), (0, 0.0)])
def test_one_leader(many_tasks, n, hot):
    rows = postings(random.Random(n + int(hot * 10)), n, hot)
    df = many_tasks.createDataFrame(rows, "s long, fp1 long, tag int")
    got = ngram_join._shared(df).select("s", "leader", "fp1", "tag").collect()
    assert sorted(tuple(r) for r in got) == wanted(rows)


def test_hot_list_is_spread(many_tasks):
    """A list that 60 of 100 rows are in gives no task more than three times the median."""
    rows = postings(random.Random(1), 20_000, 0.6)
    parts = many_tasks.createDataFrame(rows, "s long, fp1 long, tag int").repartitionByRange("s", "fp1")
    sizes = sorted(r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) >= 4 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("seed", range(30))
def test_any_cut(seed):
    """Tasks and batches may begin and end anywhere between two classes."""
    rng = random.Random(seed)
    rows = sorted((rng.choice("aab") == "a" and 3 or rng.randint(0, 12), fp, 300) for fp in range(rng.randint(1, 40)))
    cuts = sorted({0, len(rows), *(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 5)))})
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        inner = sorted({a, b, *(rng.randint(a, b) for _ in range(3))})
        batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i:j], strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["s", "fp1", "tag"]) for i, j in zip(inner, inner[1:], strict=False)]
        mine = [r for x in ngram_join._lists(iter(batches)) for r in zip(*x.to_pydict().values(), strict=True)]
        assert sum(r[2] is None for r in mine) <= 2
        out += mine
    first, tasks = {}, {}
    for s, leader, fp, _ in out:
        if fp is None:
            first[s], tasks[s] = min(first.get(s, leader), leader), tasks.get(s, 0) + 1
    got = [(s, first[s] if tasks.get(s, 0) > 1 else leader, fp, abs(tag)) for s, leader, fp, tag in out if fp is not None and (tag > 0 or tasks[s] > 1)]
    assert sorted(got) == wanted(rows)


def test_join_over_many_tasks(many_tasks):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(80)] = f"v{i}"
        docs.append((i % 90, " ".join(w) if i % 3 else " ".join(rng.choice(base) for _ in range(50))))
    df = many_tasks.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in ngram_join.ngram_join(df, 3, 90, 100).collect()}
    near = {i for i, (_, t) in enumerate(docs) if i % 3}
    least = min(docs[i][0] for i in near)
    copies = {docs[i][0] for i in near}
    assert got == {(i, least if i in copies else i) for i, _ in docs}


def test_shared_lists_are_worked_out_once(many_tasks):
    """Steps that read shared lists read a table, and not a join that each of them would run again."""
    df = many_tasks.createDataFrame(postings(random.Random(2), 3000, 0.3), "s long, fp1 long, tag int")
    plan = ngram_join._shared(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" not in plan


@pytest.mark.parametrize("seed", range(10))
def test_only_lists_at_an_edge_are_marked(seed):
    """A list without the mark begins and ends in its task; nearly all lists are such."""
    rng = random.Random(seed)
    rows = sorted((i // 3, fp, 300) for i, fp in enumerate(rng.sample(range(10**6), 3000)))
    cut = rng.randint(1400, 1600)
    out = []
    for part in (rows[:cut], rows[cut:]):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part[i : i + 500], strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["s", "fp1", "tag"]) for i in range(0, len(part), 500)]
        out.append([r for x in ngram_join._edged(iter(batches)) for r in zip(*x.to_pydict().values(), strict=True)])
    ends = {s for part in out for s in (min(r[0] for r in part), max(r[0] for r in part))}
    assert all(r[4] for part in out for r in part if r[0] in ends or r[2] is None or r[3] <= 0)
    assert sum(r[4] for part in out for r in part) < 100


@pytest.mark.parametrize("hot", [0.0, 0.6, 1.0])
def test_a_posting_meets_its_list_once(many_tasks, monkeypatch, hot):
    """Leader and length of a list reach its postings in one inner join, as many rows as postings, however long lists are."""
    made, plain = {}, ngram_join.store

    def store(df, name):
        made[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(ngram_join, "store", store)
    rows = postings(random.Random(3), 3000, hot)
    lists = ngram_join._shared(many_tasks.createDataFrame(rows, "s long, fp1 long, tag int"))
    made["rarest"] = ngram_join._rarest(lists)._jdf.queryExecution().optimizedPlan().toString()
    assert [line.split("Join ")[1][:5] for plan in made.values() for line in plan.splitlines() if "Join " in line] == ["Inner"]
    sets = {}
    for s, _, _, _ in wanted(rows):
        sets[s] = sets.get(s, 0) + 1
    assert sorted((r.s, r.sets) for r in lists.collect()) == sorted((s, n) for s, n in sets.items() for _ in range(n))
