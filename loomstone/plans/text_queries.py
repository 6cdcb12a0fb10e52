"""Queries of text and record functions over mixed records, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import records, similarity, text
from loomstone.operators import grids, metrics, scoring
from loomstone.plans import summary
from loomstone.plans.queries import _mixed_records, _record_sql, query, t
from loomstone.sources import scans

_BASE = _record_sql().split(", s AS (")[0]  # WITH r(k, seg, gt, pred)
_EMPTY = """({x} IS NULL OR json_type({x}) = 'NULL' OR CAST({x} AS VARCHAR) IN ('[]', '{{}}') OR (json_type({x}) = 'VARCHAR' AND trim({x} ->> '$') = ''))"""


def _empty(side: str, role: str) -> str:
    return _EMPTY.format(x=f"json_extract({side}, '$.{role}')")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS definition, p_type AS label, 'n' || p_partkey AS local, 'a_b_' || p_partkey AS audit,
  translate(p_name, ' /', '__') AS stem, p_type || ' is a ' || CASE WHEN p_partkey % 2 = 0 THEN 'matrix' ELSE 'concept' END || '.' AS context, p_name AS kept, p_partkey % 5 <> 0 AS changed FROM part""")
def q_text_forms(spark, d):
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    kept, changed = records.overwritten(F.when(F.col("p_partkey") % 5 == 0, name).otherwise(F.lit(None)), name)
    return t(spark, d, "part").select(
        "p_partkey",
        text.definition_or_comment(F.when(F.col("p_partkey") % 3 == 0, "").otherwise(name), F.col("p_type")).alias("definition"),
        text.after_colon(F.concat("p_brand", F.lit(": "), "p_type")).alias("label"),
        text.local_name(F.concat(F.lit("http://example.org/x#n"), key)).alias("local"),
        text.audit_path(F.concat(F.lit("a.b."), key)).alias("audit"),
        text.file_stem(name).alias("stem"),
        text.context_sentence(F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, "hasMatrix").otherwise("other"), {"hasMatrix": "matrix"}).alias("context"),
        kept.alias("kept"),
        changed.alias("changed"),
    )


@query("""SELECT event_id % 4 AS form, count(*) FILTER (WHERE event_id % 4 < 3) AS blank, count(*) FILTER (WHERE event_id % 4 < 2) AS falsy FROM events GROUP BY 1""")
def q_empty_answers(spark, d):
    form = F.col("event_id") % 4
    said = F.when(form == 1, "").when(form == 2, " \n\t").when(form == 3, F.col("event_type"))
    return t(spark, d, "events").select(form.alias("form"), said.alias("said")).groupBy("form").agg(F.count_if(text.is_blank(F.col("said"))).alias("blank"), F.count_if(text.is_falsy(F.col("said"))).alias("falsy"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '@prefix a: <b> .' || chr(10) || p_name || ' .' || chr(10) WHEN 1 THEN '@prefix ex: <http://example.org/> .' || chr(10) || p_name || ' .' || chr(10) END AS block FROM part""")
def q_turtle_block(spark, d):
    kind = F.col("p_partkey") % 3
    body = F.concat(F.when(kind == 0, "@prefix a: <b> .\n").otherwise(""), "p_name", F.lit(" .\n"))
    said = F.when(kind == 2, F.col("p_name")).otherwise(F.concat(F.lit("Here:\n```turtle\n"), body, F.lit("```\nmore ``` text")))
    return t(spark, d, "part").select("p_partkey", text.turtle_block(said, "@prefix ex: <http://example.org/> .").alias("block"))


@query(f"""{_BASE} SELECT k, CASE WHEN coalesce(json_type(json_extract(pred, '$.hasProperty')), 'NULL') = 'NULL' THEN '""' ELSE CAST(json_extract(pred, '$.hasProperty') AS VARCHAR) END AS property,
  CASE WHEN json_type(json_extract(pred, '$.hasConstraint')) = 'ARRAY' THEN CAST(json_extract(pred, '$.hasConstraint') AS VARCHAR) ELSE '[]' END AS constraints FROM r""")
def q_defaults(spark, d):
    rows = _mixed_records(spark, d).select("k", records.with_defaults(records.parsed(F.col("pred"))).alias("m"))
    return rows.select("k", F.col("m")["hasProperty"].alias("property"), F.col("m")["hasConstraint"].alias("constraints"))


@query(f"""{_BASE} SELECT k, {" + ".join(f"CAST(NOT list_contains(coalesce(json_keys(pred), []), '{r}') AS INT)" for r in text.ROLES)} AS n_missing,
  len(list_filter(coalesce(json_keys(pred), []), lambda x: x NOT IN ('hasProperty', 'hasMatrix'))) AS n_extra FROM r""")
def q_key_audit(spark, d):
    audit = records.key_audit(F.col("pred"), ("hasProperty", "hasMatrix"))
    return _mixed_records(spark, d).select("k", audit.alias("a")).select("k", F.size("a.missing_keys").alias("n_missing"), F.size("a.extra_keys").cast("bigint").alias("n_extra"))


_ITEMS = "CASE WHEN json_type(json_extract({x}, '$.hasConstraint')) = 'ARRAY' THEN list_transform(CAST(json_extract({x}, '$.hasConstraint') AS JSON[]), lambda x: x ->> '$.{f}') ELSE [] END"
_TARGETS = f"""list_transform({_ITEMS.format(x="gt", f="on")}, lambda x: CASE WHEN regexp_matches(x, '^\\s*({"|".join(text.ROLES)})\\s*:') THEN trim(regexp_replace(x, '^\\s*[A-Za-z]+\\s*:', '')) ELSE x END)"""


@query(f"""{_BASE} SELECT k, len(list_distinct(list_filter([gt ->> '$.hasProperty', gt ->> '$.hasStatisticalModifier'], lambda x: x <> ''))) AS concept,
  len(list_distinct(list_filter(list_concat({_ITEMS.format(x="gt", f="label")}, {_TARGETS}), lambda x: x <> ''))) AS texts,
  len(list_distinct(list_filter(list_concat([gt ->> '$.hasProperty', gt ->> '$.hasStatisticalModifier'], list_concat({_ITEMS.format(x="gt", f="label")}, {_TARGETS})), lambda x: x <> ''))) AS both_kinds FROM r""")
def q_atoms(spark, d):
    doc = records.parsed(F.col("gt"))
    rows = _mixed_records(spark, d).select("k", doc.alias("doc"))
    at = lambda r: F.try_variant_get("doc", f"$.{r}", "string")
    sets = {name: records.atoms(at("hasProperty"), at("hasStatisticalModifier"), F.lit(None).cast("string"), records.constraints(F.col("doc")), mode) for name, mode in (("concept", "concept"), ("texts", "text"), ("both_kinds", "both"))}
    return rows.select("k", *[F.size(v).cast("bigint").alias(n) for n, v in sets.items()])


@query(f"""{_BASE}, l AS (SELECT k, pred, unnest({_ITEMS.format(x="gt", f="label")}) AS label FROM r)
SELECT k, label, array_to_string(list_filter([CASE WHEN json_type(json_extract(pred, '$.hasProperty')) = 'VARCHAR' AND pred ->> '$.hasProperty' = label THEN 'hasProperty' END,
  CASE WHEN json_extract(pred, '$.hasMatrix') ->> '$.hasSource' = label THEN 'hasMatrix.hasSource' END,
  CASE WHEN (json_type(json_extract(pred, '$.hasConstraint')) = 'ARRAY' AND NOT list_contains(list_transform(CAST(json_extract(pred, '$.hasConstraint') AS JSON[]), lambda x: json_type(x)), 'VARCHAR'))
    AND list_contains({_ITEMS.format(x="pred", f="label")}, label) THEN 'hasConstraint.label' END], lambda x: x IS NOT NULL), ',') AS found FROM l""")
def q_locate_constraints(spark, d):
    rows = _mixed_records(spark, d).select("k", records.parsed(F.col("gt")).alias("gt"), records.parsed(F.col("pred")).alias("pred"))
    each = records.unnest(rows, metrics.locate_constraints(F.col("gt"), F.col("pred")), "k")
    return each.select("k", "x.label", F.array_join("x.found_in", ",").alias("found"))


@query(f"""{_BASE}, e AS (SELECT k, gt, pred, unnest(json_keys(gt)) AS key FROM r),
f AS (SELECT k, coalesce(list_contains(json_keys(pred), key), false) AND {_EMPTY.format(x="json_extract(gt, '$.' || key)")} = {_EMPTY.format(x="json_extract(pred, '$.' || key)")} AS same FROM e)
SELECT k, round(count(*) FILTER (WHERE same) / count(*), 6) AS overlap FROM f GROUP BY k""")
def q_overlap_mixed(spark, d):
    return _mixed_records(spark, d).select("k", F.round(metrics.structural_overlap(F.col("gt"), F.col("pred")), 6).alias("overlap"))


@query(f"""{_BASE}, e AS (SELECT k, gt, pred, unnest(json_keys(gt)) AS key FROM r),
f AS (SELECT k, coalesce(list_contains(json_keys(pred), key), false) AND {_EMPTY.format(x="json_extract(gt, '$.' || key)")} = {_EMPTY.format(x="json_extract(pred, '$.' || key)")} AS same FROM e)
SELECT round(sum(o) / 100, 4) AS mean FROM (SELECT k, count(*) FILTER (WHERE same) / count(*) AS o FROM f GROUP BY k)""")
def q_mean_overlap(spark, d):
    rows = _mixed_records(spark, d).select(metrics.structural_overlap(F.col("gt"), F.col("pred")).alias("overlap"))
    return metrics.mean_overlap(rows, "overlap", 100).select(F.round("mean", 4).alias("mean"))


@query(f"""{_BASE} SELECT k, {", ".join(f'CAST({_empty("gt", r)} AND NOT {_empty("pred", r)} AS INT) AS "{r}"' for r in text.ROLES)} FROM r""")
def q_hallucinations_mixed(spark, d):
    rows = _mixed_records(spark, d).select("k", records.parsed(F.col("gt")).alias("gt"), records.parsed(F.col("pred")).alias("pred"))
    return rows.select("k", *metrics.hallucinations(F.col("gt"), F.col("pred")))


@query(f"""{_BASE} SELECT k, substr(fullkey, 3) AS path, atom ->> '$' AS text FROM r, json_tree(pred) AS j WHERE j.type = 'VARCHAR'""")
def q_string_leaves(spark, d):
    return records.unnest(_mixed_records(spark, d), records.string_leaves(F.col("pred")), "k").select("k", "x.*")


@query(f"""{_BASE} SELECT k, array_to_string(list_sort(list(substr(fullkey, 3))), ' ') AS paths FROM r, json_tree(pred) AS j WHERE j.type = 'VARCHAR' AND atom ->> '$' = seg GROUP BY k""")
def q_value_paths(spark, d):
    paths = F.array_sort(metrics.value_paths(F.col("seg"), F.col("pred")))
    rows = records.unnest(_mixed_records(spark, d), F.filter(F.array(paths), lambda x: F.size(x) > 0), "k", name="paths")
    return rows.select("k", F.array_join("paths", " ").alias("paths"))


@query("""WITH s AS (SELECT a.vec_id, a.label AS x, b.label AS y, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(CASE WHEN x = y THEN 1.0 ELSE score END, 5) AS score FROM s""")
def q_close_scores(spark, d):
    vectors = t(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("x"), "embedding")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"), F.col("embedding").alias("other"))
    return vectors.join(after, "vec_id").select("vec_id", F.round(similarity.close(F.col("x"), F.col("y"), similarity.cosine(F.col("embedding"), F.col("other"))), 5).alias("score"))


@query("""SELECT (event_id % 12) || '-shot' AS shot, CAST(event_id % 12 AS INT) AS place, count(*) AS n FROM events GROUP BY ALL""")
def q_natural_sort(spark, d):
    rows = t(spark, d, "events").select(F.concat((F.col("event_id") % 12).cast("string"), F.lit("-shot")).alias("shot")).groupBy("shot").agg(F.count("*").alias("n"))
    return rows.withColumn("place", summary.natural_order("shot")).orderBy("place")


@query("""WITH c AS (SELECT l_returnflag AS flag, l_linenumber AS shot, CAST(count(*) AS VARCHAR) AS n FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL)
SELECT flag, coalesce(max(n) FILTER (WHERE shot = 1), '') AS shot_1, coalesce(max(n) FILTER (WHERE shot = 2), '') AS shot_2, '' AS shot_3 FROM c GROUP BY flag""")
def q_by_shot(spark, d):
    rows = t(spark, d, "lineitem").where("l_linenumber <> 3").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").cast("int").alias("shot")).agg(F.count("*").cast("string").alias("n"))
    return summary.by_shot(rows, "flag", "shot", [1, 2, 3], "n")


@query("""SELECT r_regionkey, 'Do.' || chr(10) || chr(10) || '{}' || chr(10) || chr(10) || CASE WHEN r_regionkey % 2 = 0 THEN r_name || chr(10) || chr(10) || 'x' || chr(10) || chr(10) ELSE '' END || r_name || chr(10) || chr(10) || 'JSON only' AS prompt FROM region""")
def q_prompt(spark, d):
    shots = F.when(F.col("r_regionkey") % 2 == 0, F.array("r_name", F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return t(spark, d, "region").select("r_regionkey", scans.build_prompt(F.lit("Do."), F.lit("{}"), shots, F.col("r_name"), "JSON only").alias("prompt"))


@query("SELECT r_name, CASE r_name WHEN 'EUROPE' THEN 1 ELSE 2 END AS place FROM region WHERE r_name IN ('EUROPE', 'ASIA')")
def q_fixed_examples(spark, d):
    return grids.resolve_fixed(t(spark, d, "region").select("r_name"), ["EUROPE", "ASIA"], "r_name").select("r_name", F.col("place").cast("int").alias("place"))


@query(_record_sql() + """ SELECT role, round(sum(c.tp), 4) AS tp, round(sum(c.fp), 4) AS fp, round(sum(c.fn), 4) AS fn, round(sum(c.tn), 4) AS tn FROM s GROUP BY role""")
def q_role_totals(spark, d):
    rows = scoring.by_role(scoring.score_records(_mixed_records(spark, d), "gt", "pred"), ["k"])
    return rows.groupBy("role").agg(*[F.round(F.sum(c), 4).alias(c) for c in scoring.COUNTS])


_OBJECT = """replace({pred}, '"hasProperty":"else"', concat('"other":1.5,"hasProperty":{{"z":[1,"a"],"label":"', seg, '","a":null}}'))"""


@query(f"""{_BASE}, p AS (SELECT k, TRY_CAST({_OBJECT.format(pred="CAST(pred AS VARCHAR)")} AS JSON) AS pred FROM r WHERE pred IS NOT NULL),
m AS (SELECT k, pred, json_keys(pred) AS keys, json_type(json_extract(pred, '$.hasProperty')) IS NOT DISTINCT FROM 'OBJECT' AS is_object,
  list_filter([{", ".join(f"'{r}'" for r in text.ROLES)}], lambda x: NOT list_contains(json_keys(pred), x)) AS missing FROM p)
SELECT k, '{{' || array_to_string(list_concat(
    list_transform(keys, lambda x: '"' || x || '":' || CASE WHEN x = 'hasProperty' AND is_object THEN CAST(json_extract(pred, '$.hasProperty.label') AS VARCHAR) ELSE CAST(json_extract(pred, '$.' || x) AS VARCHAR) END),
    list_transform(missing, lambda x: '"' || x || '":' || CASE x WHEN 'hasConstraint' THEN '[]' ELSE '""' END)), ',') || '}}' AS record,
  array_to_string(missing, ',') AS missing, array_to_string(list_filter(keys, lambda x: x NOT IN ('label', 'comment', {", ".join(f"'{r}'" for r in text.ROLES)})), ',') AS extra,
  is_object AS coerced, CASE WHEN is_object THEN CAST(json_extract(pred, '$.hasProperty') AS VARCHAR) END AS orig FROM m""")
def q_coerce(spark, d):
    rows = _mixed_records(spark, d).selectExpr("k", f"{_OBJECT.format(pred='pred')} AS pred")
    rows = records.unnest(rows, F.filter(F.array(records.coerced(F.col("pred"))), lambda c: c.isNotNull()), "k", name="c")
    return rows.select("k", "c.record", F.array_join("c.audit.missing_keys", ",").alias("missing"), F.array_join("c.audit.extra_keys", ",").alias("extra"), F.col("c.audit.coerced_property").alias("coerced"), F.col("c.audit.orig_property").alias("orig"))
