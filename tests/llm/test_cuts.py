"""Fill-in-middle, periodic runs and sharding against plain Python."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import infill, registry, runs, sharding
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_infill", "op12_runs", "op13_sharding"])
def test_sql(spark, name):
    assert assert_same(registry.QUERIES[name](spark, SF), registry.SQL[name], SF) > 0


# -- fill-in-middle

ODD = ["", None, " ", "a", "ab", "ab cd", "é", "日本語 text", "a<P>b", "<S>", "x<M>", "<", "<<S", "P><S", "a\x00b\n\tc", "\U0001f600\U0001f600 ok"]


def odd_texts(rng):
    pieces = ["word", " ", "<", ">", "S", "P", "M", "<S", "P>", "é", "7", "\n", "日", "\U0001f600"]
    return ODD + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(300)]


def test_cut_and_restore():
    rng, forms = random.Random(3), set()
    for i, text in enumerate(odd_texts(rng)):
        text = text or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
        n, form, before, middle, output = infill.cut(text, str(i), "1")
        assert n == len(units) and list(infill.unit_ends(text)) == [len("".join(units[:k])) for k in range(n + 1)]
        assert infill.restore(output, form) == text
        h = hashlib.sha256(f"1:{i}".encode()).hexdigest()
        h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(c in text for c in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            assert (form, before, middle, output) == ("plain", None, None, text)
        else:
            assert (form, before, middle) == ("spm" if h[3] % 100 < 20 else "psm", len(p), len(m))
            assert output == (f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_fill_in_middle_of_odd_tables(spark):
    texts = odd_texts(random.Random(5))
    long = "ab, 日" * 400_000
    rows = [(i, t, "kept", 1) for i, t in enumerate(texts)] + [(None, "no id", None, None), (7, "twice", "a", 2), (7, "twice", "a", 2), (8, long, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim string, n int")
    made = infill.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "fim", "n"] and made.count() == len(rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None, tuple(r.fim)) for r in made.collect())
    want = sorted((i is None, i or 0, t or "", t is None, infill.cut(t or "", "" if i is None else str(i), "1")) for i, t, _, _ in rows)
    assert got == want
    read = infill.digests(made).where("digests.restored_sha256 <> sha2(coalesce(text, ''), 256) or digests.output_sha256 <> sha2(fim.output, 256)")
    assert read.count() == 0
    assert infill.fill_in_middle(docs.where("false")).count() == 0
    other = {r.fim.form for r in infill.fill_in_middle(docs, into="cut", seed="2", plain_percent=0, spm_percent=100).select(F.col("cut").alias("fim")).where("fim.n > 0").collect()}
    assert other == {"spm", "plain"}  # plain where a text holds a control string


# -- periodic runs


def brute_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            part = w[s : i + q]
            if len(part) >= max(6, 4 * q) and not any(all(part[j] == part[j + p] for j in range(len(part) - p)) for p in range(1, q)):
                out.add((s, len(part), q))
            i += 1
    return sorted(out)


def word_lists(rng):
    for k in range(600):
        if k % 3 == 0:
            yield [rng.choice("ab" if k % 2 else "abc") for _ in range(rng.randint(0, 120))]
        elif k % 3 == 1:
            yield [w for _ in range(rng.randint(1, 6)) for w in ([rng.choice("abc") for _ in range(rng.randint(1, 9))] * 9)[: rng.randint(1, 60)]]
        else:
            inner = [rng.choice("ab") for _ in range(rng.randint(1, 4))] * rng.randint(1, 6) + ["c"]
            yield inner * rng.randint(1, 8) + [rng.choice("ab") for _ in range(5)]


def test_runs_equal_brute_force():
    for w in word_lists(random.Random(2)):
        assert runs.find_runs(runs.word_ids(w)) == brute_runs(w), w


def test_long_texts_take_little_time():
    rng = np.random.default_rng(0)
    began = time.time()
    common = (rng.zipf(1.3, 400_000) % 20_000).astype(np.int32)
    common[100_000:200_000] = np.tile(np.arange(5_000), 20)
    assert (100_000, 100_000, 5_000) in [(s, size, q) for s, size, q in runs.find_runs(common) if q == 5_000]
    assert runs.find_runs(np.zeros(200_000, dtype=np.int32)) == [(0, 200_000, 1)]
    assert time.time() - began < 20


def test_periodic_runs_of_odd_tables(spark):
    lists = [w for w in word_lists(random.Random(8)) if w][:60]
    rows = [(i, rng_gap(i).join(w), 5, "x") for i, w in enumerate(lists)]
    rows += [(100, None, 1, None), (101, "", 1, ""), (102, " \t\n ", 1, ""), (103, "a b " * 9, None, ""), (103, "a b " * 9, None, ""), (None, "z " * 8, 0, ""), (104, "é b " * 40_000, 0, ""), (105, "w" * 300_000, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, runs string")
    got = runs.periodic_runs(docs).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "runs", "start", "length", "period", "exponent_milli", "collapsed"}
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want = brute_runs(words) if len(words) < 1000 else [(0, 40_000, 1)]
        assert [tuple(x) for x in r.runs] == want
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        gone = {i for s, size, q in want for i in range(s + q, s + size)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert runs.periodic_runs(docs.where("false")).count() == 0


def rng_gap(i):
    return [" ", "\n", " \t ", "\x0b\x0c"][i % 4]


def test_planted_texts(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(300)] + [(None, "a b"), (35, None)]
    got = {(r.doc_id, r.text) for r in runs.plant(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set()
    for i, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[:a] + [words[a + (j - a) % p] for j in range(a, n)])
        want.add((i, text))
    assert got == want


# -- sharding


def plain_shards(rows, shards):
    sized = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows))
    total, start, out, slots = sum(s[3] for s in sized), 0, [], {}
    for known, i, crc, size in sized:
        shard = min(shards - 1, shards * (2 * start + size) // (2 * total))
        out.append((i if known else None, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        start += size
    return out


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_shards(spark, shards):
    rng = random.Random(shards)
    rows = [(i, rng.choice(["", None, "é" * rng.randint(0, 50), "word " * rng.randint(0, 90)])) for i in range(400)]
    rows += [(7, "hot")] * 300 + [(None, "no id")] * 3 + [(9, "日" * 9_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], "doc_id long, text string, size int, shard string, id int")
    got = sharding.assign_shards(docs, shards)
    assert got.columns == ["doc_id", "text", "id", "size", "text_crc32", "shard", "slot"]
    key = lambda r: (r[3], r[4])
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got.collect()), key=key) == sorted(plain_shards(rows, shards), key=key)


def test_shards_of_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign_shards(none).count() == 0
    one = sharding.assign_shards(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [(r["size"], r.text_crc32, r.shard, r.slot) for r in one] == [(1, 0, 8, 0)]
    equal = sharding.assign_shards(spark.range(1600).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit("same").alias("text")), keep=["doc_id"])
    assert {r["n"] for r in equal.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {100}
    sharding.write_shards(spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), str(tmp_path / "out"), shards=4)
    read = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.shard, r.n, r.low) for r in read.groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).collect()} == {(k, 25, 25 * k) for k in range(4)}


def test_sharding_is_native(spark):
    plan = registry.QUERIES["op13_sharding"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_stored_tables_go_by_age(spark):
    from loomstone.llm import common

    before = common.stored(spark)
    tables = [common.store(spark.range(n), "kept") for n in (1, 2, 3)]
    assert common.stored(spark) == before + 3 and common.drop_stored(spark, since=before, but_last=1) == 2
    assert tables[2].count() == 3 and common.stored(spark) == before + 1
    with pytest.raises(Exception, match="not exist|NOT_EXIST"):
        tables[0].collect()
    assert common.drop_stored(spark, since=before) == 1 and common.drop_stored(spark, since=before) == 0
