"""Work that costs far more than its rows weigh is dealt over the cores, and an array that is opened is worked out once."""

import pytest
from pyspark.sql import functions as F

from loomstone.catalog import QUERIES
from loomstone.functions.records import unnest
from loomstone.session import spread, tasks

SF = "/root/testdata/sf0.001"
DEALT = [
    "q_record_totals",
    "q_role_totals",
    "q_record_confusion",
    "q_coerce",
    "q_value_paths",
    "q_string_leaves",
    "q_locate",
    "q_conformance",
    "q_mapping",
]


@pytest.mark.parametrize("name", DEALT)
def test_rows_are_dealt_and_arrays_worked_out_once(spark, name):
    query = QUERIES[name](spark, SF)._jdf.queryExecution()
    assert f"Repartition {tasks(spark)}, true" in query.optimizedPlan().toString()
    assert "Filter ((size(" not in query.optimizedPlan().toString()


def test_spread_gives_every_task_rows(spark):
    counts = spread(spark.range(1200).coalesce(1)).groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) == tasks(spark) and max(c["count"] for c in counts) <= 2 * 1200 // tasks(spark)


def test_unnest_equals_explode(spark):
    rows = spark.createDataFrame([(1, ["a", None, "b"]), (2, []), (3, None), (4, [None])], "k int, v array<string>")
    want = rows.select("k", F.explode("v").alias("x")).collect()
    assert sorted(map(str, unnest(rows, "v", "k").collect())) == sorted(map(str, want)) and len(want) == 4


def test_files_of_keys_are_written_by_many_tasks(spark, tmp_path):
    from loomstone.sources.scans import write_one_per_key

    write_one_per_key(spark.range(200).selectExpr("id as k", "id as v"), "k", f"{tmp_path}/out")
    files = [p.name for p in (tmp_path / "out").rglob("part-*.json")]
    assert len(files) == 200 and len({name.split("-")[1] for name in files}) > 4


@pytest.mark.parametrize("name", ["q_record_confusion", "q_record_totals"])
def test_a_roles_value_is_looked_up_once_a_side(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.hasMatrix") == 2


def test_shapes_look_up_the_values_they_ask_for_alone(spark):
    plan = QUERIES["q_shacl"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and plan.count("Aggregate [") == 3
    assert "lambdafunction" not in plan
    looked_up = plan[plan.index("Join LeftOuter") : plan.index("Aggregate [", plan.index("Join LeftOuter"))]
    assert "IN (http://example.org/home,http://example.org/placedBy)" in looked_up and "priority" not in looked_up


def test_mapped_triples_have_a_number_for_what_many_share(spark):
    plan = QUERIES["q_mapping"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    distinct = next(line for line in plan.splitlines() if "Aggregate [" in line)
    assert "form#" in distinct and "datatype" not in distinct.split("], [")[0] and "lambdafunction" not in plan


@pytest.mark.parametrize("name", ["q_shacl", "q_mapping"])
def test_iris_are_joined_by_a_number_first(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if " Join " in line]
    assert joins and all("(number#" in line for line in joins)
