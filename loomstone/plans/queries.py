"""The query catalogue: library operators over the driver's tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import records, similarity, text
from loomstone.operators import confusion, graphs, grids, linking, metrics, scoring
from loomstone.plans import summary
from loomstone.session import spread
from loomstone.sources import scans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _judged(spark: SparkSession, d: str, least: int = 1000) -> DataFrame:
    """Labelled documents with confusion counts of the rule ``n_chars >= least`` against quality."""
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    c = confusion.role_confusion(F.col("quality") == 0, F.col("n_chars") < least, F.lit(1.0))
    return rows.withColumn("c", c).select("doc_id", "source", "lang", "n_chars", "quality", "c.*")


_COUNTS_SQL = """
  SELECT d.source, d.lang, CAST(l.quality = 1 AND d.n_chars >= 1000 AS DOUBLE) AS tp, CAST(l.quality = 0 AND d.n_chars >= 1000 AS DOUBLE) AS fp,
         CAST(l.quality = 1 AND d.n_chars < 1000 AS DOUBLE) AS fn, CAST(l.quality = 0 AND d.n_chars < 1000 AS DOUBLE) AS tn
  FROM labels l JOIN documents d USING (doc_id)"""
_PRF_SQL = """round(p, 3) AS "P", round(r, 3) AS "R", round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 3) AS "F" """
_PR_SQL = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r"


@query(f"""WITH c AS ({_COUNTS_SQL}), s AS (SELECT source, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM c GROUP BY source)
SELECT source, tp, fp, fn, tn, {_PRF_SQL} FROM (SELECT *, {_PR_SQL} FROM s)""")
def q_confusion_micro(spark, d):
    return summary.micro(_judged(spark, d), ["source"])


@query(f"""WITH c AS ({_COUNTS_SQL}), s AS (SELECT source, lang, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM c GROUP BY source, lang),
u AS (SELECT source, lang, {_PRF_SQL} FROM (SELECT *, {_PR_SQL} FROM s))
SELECT source, round(avg("P"), 3) AS "P", round(avg("R"), 3) AS "R", round(avg("F"), 3) AS "F", count(*) AS units FROM u GROUP BY source""")
def q_confusion_macro(spark, d):
    return summary.macro(_judged(spark, d), ["source", "lang"], ["source"])


@query(f"""WITH c AS (
  SELECT g.least, CAST(l.quality = 1 AND d.n_chars >= g.least AS DOUBLE) AS tp, CAST(l.quality = 0 AND d.n_chars >= g.least AS DOUBLE) AS fp,
         CAST(l.quality = 1 AND d.n_chars < g.least AS DOUBLE) AS fn, CAST(l.quality = 0 AND d.n_chars < g.least AS DOUBLE) AS tn
  FROM labels l JOIN documents d USING (doc_id) CROSS JOIN (VALUES (100), (500), (1000), (5000)) AS g(least)
), s AS (SELECT least, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM c GROUP BY least)
SELECT least, tp, fp, fn, tn, {_PRF_SQL} FROM (SELECT *, {_PR_SQL} FROM s)""")
def q_prf_by_grid(spark, d):
    rows = grids.grid(_judged(spark, d).select("quality", "n_chars"), least=[100, 500, 1000, 5000])
    c = confusion.role_confusion(F.col("quality") == 0, F.col("n_chars") < F.col("least"), F.lit(1.0))
    return summary.micro(rows.withColumn("c", c).select("least", "c.*"), ["least"])


@query("""SELECT doc_id, source FROM documents WHERE lower(trim(text)) NOT IN (SELECT lower(trim(text)) FROM benchmark WHERE text IS NOT NULL)""")
def q_leakage_anti(spark, d):
    key = F.lower(F.trim("text")).alias("key")
    docs = t(spark, d, "documents").select("doc_id", "source", key)
    return grids.without(docs, t(spark, d, "benchmark").select(key), "key").select("doc_id", "source")


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_name, p_partkey LIMIT 100")
def q_sort_take(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_name", "p_retailprice").orderBy("p_name", "p_partkey").limit(100)


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('7|' || c_custkey), c_custkey LIMIT 50")
def q_sample_exact(spark, d):
    return grids.sample_exact(t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 50, seed=7)


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def q_fence_extract(spark, d):
    said = F.concat(F.lit("Sure, here it is:\n```json\n"), F.col("props"), F.lit("\n```\nAnything else?"))
    doc = records.parsed(text.json_block(text.strip_fences(said)))
    return t(spark, d, "events").select("event_id", F.try_variant_get(doc, "$.k", "string").alias("k"))


@query("""SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE event_id % 3 = 0) AS non_json_prefix,
       count(*) FILTER (WHERE event_id % 5 = 0) AS non_json_suffix FROM events GROUP BY event_type""")
def q_noise_flags(spark, d):
    said = F.concat(F.when(F.col("event_id") % 3 == 0, "Well: ").otherwise(""), F.col("props"), F.when(F.col("event_id") % 5 == 0, " done").otherwise("\n"))
    rows = t(spark, d, "events").select("event_type", said.alias("said"))
    rows = rows.withColumn("non_json_prefix", text.noise_before(F.col("said")) != "").withColumn("non_json_suffix", text.noise_after(F.col("said")) != "")
    return rows.groupBy("event_type").agg(F.count("*").alias("rows"), *[F.count_if(f).alias(f) for f in ("non_json_prefix", "non_json_suffix")])


@query("""SELECT page_id, coalesce(starts_with(ltrim(html), '<!DOCTYPE html') OR starts_with(ltrim(html), '<html'), false) AS is_html FROM pages""")
def q_html_detect(spark, d):
    return t(spark, d, "pages").select("page_id", text.is_html(F.col("html")).alias("is_html"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(u, 'Q\d+') THEN 'https://www.wikidata.org/wiki/' || regexp_extract(u, 'Q\d+') ELSE regexp_replace(replace(u, 'http://', 'https://'), '/$', '') END AS uri
FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'http://www.wikidata.org/entity/Q' || page_id ELSE url END AS u FROM pages)""")
def q_url_canon(spark, d):
    uri = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("http://www.wikidata.org/entity/Q"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return t(spark, d, "pages").select("page_id", text.canonical_uri(uri).alias("uri"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest FROM documents""")
def q_normalise_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.normalise(F.col("text"))).alias("digest"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'other: ' || event_type ELSE event_type END AS target FROM events""")
def q_on_prefix(spark, d):
    head = F.when(F.col("event_id") % 3 == 0, "hasMatrix: ").when(F.col("event_id") % 3 == 1, "").otherwise("other: ")
    return t(spark, d, "events").select("event_id", text.canonical_target(F.concat(head, F.col("event_type"))).alias("target"))


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1.0
       ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS jaccard
FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def q_set_jaccard(spark, d):
    turns = t(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != "")).alias("w"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(similarity.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


def _record_pair():
    """A customer's truth and prediction as JSON texts."""
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    gt = F.struct(F.col("c_name").alias("hasProperty"), F.when(key % 2 == 0, segment).otherwise("").alias("hasMatrix"), F.lit("x").alias("hasObjectOfInterest"))
    pred = F.struct(F.when(key % 5 == 0, "").otherwise(F.col("c_name")).alias("hasProperty"), F.when(key % 3 == 0, segment).otherwise("").alias("hasMatrix"))
    return F.to_json(gt), F.to_json(pred)


@query("""SELECT c_custkey, round((CAST(c_custkey % 5 <> 0 AS INT) + CAST((c_custkey % 2 = 0) = (c_custkey % 3 = 0) AS INT)) / 3, 6) AS overlap FROM customer""")
def q_structural_overlap(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.round(metrics.structural_overlap(*_record_pair()), 6).alias("overlap"))


@query("""SELECT c_custkey, 0 AS "hasStatisticalModifier", 0 AS "hasProperty", 0 AS "hasObjectOfInterest",
       CAST(c_custkey % 2 <> 0 AND c_custkey % 3 = 0 AS INT) AS "hasMatrix", 0 AS "hasContextObject", 0 AS "hasConstraint" FROM customer""")
def q_hallucination_flags(spark, d):
    gt, pred = (records.parsed(x) for x in _record_pair())
    return t(spark, d, "customer").select("c_custkey", gt.alias("gt"), pred.alias("pred")).select("c_custkey", *metrics.hallucinations(F.col("gt"), F.col("pred")))


@query("""SELECT p_partkey, 1 AS property_grounded, CAST(contains(lower(p_name), lower(p_type)) AS INT) AS object_of_interest_grounded,
       1 AS matrix_sources_grounded, CAST(contains(lower(p_name), lower(p_brand)) AS INT) AS constraints_grounded FROM part""")
def q_grounding(spark, d):
    rule = F.array(F.struct(F.col("p_brand").alias("label"), F.lit("hasProperty").alias("on")))
    record = F.to_json(F.struct(F.upper(F.substring("p_name", 1, 4)).alias("hasProperty"), F.col("p_type").alias("hasObjectOfInterest"), rule.alias("hasConstraint")))
    return t(spark, d, "part").select("p_partkey", "p_name", records.parsed(record).alias("doc")).select("p_partkey", *metrics.grounding(F.col("doc"), F.col("p_name")))


@query("""SELECT location, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN event_id % 2 = 0 THEN 'hasProperty' END,
  CASE WHEN event_id % 3 = 0 THEN 'hasObjectOfInterest' END, CASE WHEN event_id % 5 = 0 THEN 'hasConstraint.label' END], lambda x: x IS NOT NULL)) AS location FROM events)
GROUP BY location""")
def q_locate(spark, d):
    here = lambda n: F.when(F.col("event_id") % n == 0, F.col("event_type")).otherwise("-")
    rule = F.array(F.struct(here(5).alias("label"), F.lit("-").alias("on")))
    record = F.to_json(F.struct(here(2).alias("hasProperty"), here(3).alias("hasObjectOfInterest"), rule.alias("hasConstraint")))
    rows = spread(t(spark, d, "events").select("event_id", "event_type")).select("event_type", records.parsed(record).alias("doc"))
    return metrics.location_counts(rows.select(metrics.locate(F.col("event_type"), F.col("doc")).alias("found_in")))


@query("""WITH s AS (SELECT a.vec_id, a.label, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT label, count(*) AS n, count(*) FILTER (WHERE score >= 0.1) AS n_close, max(score) AS best, arg_max(vec_id, (score, -vec_id)) AS best_id FROM s GROUP BY label""")
def q_cosine_argmax(spark, d):
    vectors = t(spark, d, "embeddings").select("vec_id", "label", "embedding")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    scored = vectors.join(after, "vec_id").withColumn("score", F.round(similarity.cosine(F.col("embedding"), F.col("other")), 6))
    return scored.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.1).alias("n_close"), F.max("score").alias("best"), F.max_by("vec_id", F.struct("score", -F.col("vec_id"))).alias("best_id"))


def _order_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Each order's line items as constraints: odd lines are the truth, even ones predicted. An order has few lines."""
    item = F.struct(F.col("l_linenumber").alias("n"), F.lower("l_returnflag").alias("label"), F.concat(F.lit("hasMatrix: "), F.col("l_linestatus")).alias("on"))
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    side = lambda odd: F.transform(F.filter("items", lambda x: (x["n"] % 2 == 1) == F.lit(odd)), lambda x: F.struct(x["label"].alias("label"), x["on"].alias("on")))
    return rows.select("l_orderkey", side(True).alias("gt"), side(False).alias("pred"))


def _matched(rows: DataFrame, counts) -> DataFrame:
    return rows.withColumn("c", counts).select("l_orderkey", *[F.round(f"c.{x}", 6).alias(x) for x in ("tp", "fp", "fn", "tn")])


def _sim_sql(a: str, b: str) -> str:
    return f"(CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0 WHEN lower(trim({a})) = lower(trim({b})) THEN 1.0 ELSE 0.0 END)::DOUBLE"


def _counts_sql(tp: str, fp: str, fn: str, tn: str) -> str:
    return f"{{'tp': ({tp})::DOUBLE, 'fp': ({fp})::DOUBLE, 'fn': ({fn})::DOUBLE, 'tn': ({tn})::DOUBLE}}"


def _greedy_sql(table: str, keys: str) -> str:
    """SQL of ``match_constraints`` over a table with lists gt and pred of (label, target), as column c."""
    pair = f"{{'s': -({_sim_sql('gt[i].label', 'pred[j].label')} + {_sim_sql('gt[i].target', 'pred[j].target')}) / 2, 'i': i, 'j': j, 'l': {_sim_sql('gt[i].label', 'pred[j].label')}, 'o': {_sim_sql('gt[i].target', 'pred[j].target')}}}"
    unit = "STRUCT(s DOUBLE, i BIGINT, j BIGINT, l DOUBLE, o DOUBLE)[]"
    return f"""(SELECT {keys}, CASE WHEN len(gt) = 0 AND len(pred) = 0 THEN {_counts_sql('0', '0', '0', '1')} WHEN len(gt) = 0 THEN {_counts_sql('0', '1', '0', '0')}
    WHEN len(pred) = 0 THEN {_counts_sql('0', '0', '1', '0')} ELSE {_counts_sql('tp / z', 'fp / z', 'fn / z', '0')} END AS c
  FROM (SELECT *, greatest(1.0, tp + fp + fn) AS z FROM (
    SELECT *, good / (2.0 * greatest(len(gt), 1)) AS tp, (2 * len(m) - good) / (2.0 * greatest(len(gt), 1)) + greatest(len(pred) - len(m), 0) / greatest(len(gt), 1) AS fp,
           greatest(len(gt) - len(m), 0) / greatest(len(gt), 1) AS fn
    FROM (SELECT *, list_sum(list_transform(m, lambda x: CAST(x.l >= 1 AS INT) + CAST(x.o >= 1 AS INT))) AS good FROM (
      SELECT *, list_reduce(pairs, lambda a, x: CASE WHEN list_contains(list_transform(a, lambda y: y.i), x.i) OR list_contains(list_transform(a, lambda y: y.j), x.j) THEN a ELSE list_append(a, x) END, []::{unit}) AS m
      FROM (SELECT *, list_sort(flatten(list_transform(range(1, len(gt) + 1), lambda i: list_transform(range(1, len(pred) + 1), lambda j: {pair}))))::{unit} AS pairs FROM {table})))))) """


_ORDERS_SQL = """(SELECT l_orderkey, list({'label': lower(l_returnflag), 'target': l_linestatus} ORDER BY l_linenumber, l_returnflag, l_linestatus) FILTER (WHERE l_linenumber % 2 = 1) AS g,
  list({'label': lower(l_returnflag), 'target': l_linestatus} ORDER BY l_linenumber, l_returnflag, l_linestatus) FILTER (WHERE l_linenumber % 2 = 0) AS p FROM lineitem GROUP BY l_orderkey)"""
_LISTS_SQL = f"(SELECT l_orderkey, coalesce(g, []) AS gt, coalesce(p, []) AS pred FROM {_ORDERS_SQL})"
_MATCHED_SQL = ", ".join(f"round(c.{x}, 6) AS {x}" for x in ("tp", "fp", "fn", "tn"))
_GREEDY_SQL = f"SELECT l_orderkey, {_MATCHED_SQL} FROM {_greedy_sql(_LISTS_SQL, 'l_orderkey')}"


@query(_GREEDY_SQL)
def q_matcher_normalised(spark, d):
    rows = _order_constraints(spark, d)
    gt, pred = (records.normal_constraints(F.col(c)) for c in ("gt", "pred"))
    return _matched(rows.select("l_orderkey", gt.alias("gt"), pred.alias("pred")), confusion.match_constraints(F.col("gt"), F.col("pred")))


@query(_GREEDY_SQL)
def q_matcher_greedy(spark, d):
    return _matched(_order_constraints(spark, d), confusion.match_constraints(F.col("gt"), F.col("pred")))


_TURN_STEP = f"""list_append(a, coalesce((list_sort(list_filter(list_transform(range(1, len(pred) + 1), lambda j: {{'s': -({_sim_sql('gt[i].label', 'pred[j].label')} + {_sim_sql('gt[i].target', 'pred[j].target')}) / 2, 'j': j}}),
  lambda x: x.s < 0 AND NOT list_contains(list_transform(a, lambda y: y.j), x.j))))[1], {{'s': 0.0, 'j': 0}}))"""


@query(f"""SELECT l_orderkey, {_MATCHED_SQL} FROM (SELECT l_orderkey, CASE WHEN len(gt) = 0 AND len(pred) = 0 THEN {_counts_sql('0', '0', '0', '1')} WHEN len(gt) = 0 THEN {_counts_sql('0', '1', '0', '0')}
  WHEN len(pred) = 0 THEN {_counts_sql('0', '0', '1', '0')}
  ELSE {_counts_sql("len(list_filter(b, lambda x: x.s <= -1)) / len(gt)", "len(list_filter(b, lambda x: x.s < 0 AND x.s > -1)) / len(gt)", "len(list_filter(b, lambda x: x.j = 0)) / len(gt)", "0")} END AS c
  FROM (SELECT *, list_reduce(range(1, len(gt) + 1), lambda a, i: {_TURN_STEP}, []::STRUCT(s DOUBLE, j BIGINT)[]) AS b FROM {_LISTS_SQL}))""")
def q_matcher_in_turn(spark, d):
    return _matched(_order_constraints(spark, d), confusion.match_in_turn(F.col("gt"), F.col("pred")))


#: a truth and a prediction of mixed shapes for each customer, in SQL that Spark and DuckDB read alike
_GT_SQL = """concat('{"hasConstraint":', CASE k % 4 WHEN 0 THEN '[]' WHEN 1 THEN concat('[{"label":"Daily  mean","on":"hasMatrix: ', seg, '"},{"label":"', name, '","on":"hasProperty:x"}]')
  WHEN 2 THEN concat('[{"label":"', seg, '","on":"soil"},{"label":"', seg, '","on":"soil"},{"label":"deep","on":""}]') ELSE 'null' END,
 ',"hasContextObject":', CASE k % 7 WHEN 0 THEN 'null' WHEN 1 THEN '0' WHEN 2 THEN '7' ELSE concat('"', lower(seg), '"') END,
 ',"hasMatrix":', CASE k % 6 WHEN 0 THEN concat('{"AsymmetricSystem":"s","hasSource":"', name, '","hasTarget":"', seg, '"}') WHEN 1 THEN concat('{"SymmetricSystem":"', seg, '","hasPart":["a","b"]}')
  WHEN 2 THEN concat('{"label":"', seg, '"}') WHEN 3 THEN concat('["', seg, '","b"]') WHEN 4 THEN '""' ELSE concat('"', name, '"') END,
 ',"hasProperty":"', name, '"', CASE WHEN k % 3 = 0 THEN '' ELSE concat(',"hasStatisticalModifier":"', CASE k % 5 WHEN 0 THEN ' ' ELSE 'mean' END, '"') END, '}')"""
_PRED_SQL = """CASE WHEN k % 31 = 0 THEN 'no record' ELSE concat('{"hasConstraint":', CASE (k * 7) % 5 WHEN 0 THEN '[]' WHEN 1 THEN concat('[{"label":"', upper(name), '","on":"x"},{"label":"daily mean","on":"', lower(seg), '"}]')
  WHEN 2 THEN concat('["text",{"label":"', lower(seg), '","on":" Soil "}]') WHEN 3 THEN '"none"' ELSE concat('[{"label":"deep","on":"hasMatrix:soil"},{"label":"other","on":"soil"},{"label":"', seg, '","on":"soil"},{"label":"x","on":"y"}]') END,
 ',"hasContextObject":', CASE k % 3 WHEN 0 THEN 'false' WHEN 1 THEN '7' ELSE concat('"', seg, '"') END,
 ',"hasMatrix":', CASE (k * 5) % 8 WHEN 0 THEN concat('{"AsymmetricSystem":"S ","hasSource":"', upper(name), '","hasTarget":"-"}') WHEN 1 THEN concat('{"SymmetricSystem":"', lower(seg), '","hasPart":["b","c"]}')
  WHEN 2 THEN concat('{"label":"', seg, '"}') WHEN 3 THEN concat('["', seg, '","b"]') WHEN 4 THEN '{}' WHEN 5 THEN concat('{"SymmetricSystem":"', seg, '"}') WHEN 6 THEN concat('{"AsymmetricSystem":"s","hasSource":"', name, '","hasTarget":"', seg, '"}') ELSE concat('" ', lower(name), '"') END,
 CASE WHEN k % 4 = 0 THEN '' ELSE concat(',"hasProperty":"', CASE WHEN k % 2 = 0 THEN lower(name) ELSE 'else' END, '"') END,
 ',"hasStatisticalModifier":', CASE k % 4 WHEN 0 THEN '""' WHEN 1 THEN '"MEAN"' WHEN 2 THEN '"  "' ELSE '[]' END, '}') END"""


def _record_sql() -> str:
    """The oracle of ``scoring.score_records`` over JSON columns."""
    none = """('null', '""', '[]', '{}', '0', 'false')"""
    out = []
    for role in scoring.PLAIN_ROLES:
        g, p = f"json_extract(gt, '$.{role}')", f"json_extract(pred, '$.{role}')"
        empty = lambda x: f"({x} IS NULL OR CAST({x} AS VARCHAR) IN {none})"
        text = lambda x: f"CASE json_type({x}) WHEN 'VARCHAR' THEN {x} ->> '$' ELSE CAST({x} AS VARCHAR) END"
        at = lambda x, f: f"({x} ->> '$.{f}')"
        part = lambda x: f"coalesce(TRY_CAST(json_extract({x}, '$.hasPart') AS VARCHAR[]), [])"
        label = lambda x: f"CASE WHEN json_extract({x}, '$.hasPart') IS NOT NULL THEN {at(x, 'SymmetricSystem')} END"
        union = f"len(list_distinct(list_concat({part(g)}, {part(p)})))"
        shared = f"CASE WHEN {union} = 0 THEN 1.0 ELSE len(list_intersect({part(g)}, {part(p)})) / {union} END"
        asym = "(" + " + ".join(_sim_sql(at(g, f), at(p, f)) for f in ("AsymmetricSystem", "hasSource", "hasTarget")) + ") / 3"
        sym = f"CASE WHEN coalesce({label(g)}, '') = '' AND coalesce({label(p)}, '') = '' THEN 0 ELSE ({_sim_sql(label(g), label(p))} + {shared}) / 2 END"
        score = f"CASE WHEN json_extract({g}, '$.AsymmetricSystem') IS NOT NULL THEN {asym} WHEN json_extract({g}, '$.SymmetricSystem') IS NOT NULL THEN {sym} ELSE {_sim_sql(text(g), text(p))} END"
        c = f"CASE WHEN {empty(g)} AND {empty(p)} THEN {_counts_sql('0', '0', '0', '1')} WHEN {empty(g)} THEN {_counts_sql('0', '1', '0', '0')} WHEN {empty(p)} THEN {_counts_sql('0', '0', '1', '0')} WHEN {score} >= 1 THEN {_counts_sql('1', '0', '0', '0')} ELSE {_counts_sql('0', '1', '0', '0')} END"
        out.append(f"SELECT k, '{role}' AS role, {c} AS c FROM r")
    squeeze = lambda x: f"regexp_replace(lower(trim({x})), '\\s+', ' ', 'g')"
    target = f"regexp_replace(coalesce(x ->> '$.on', ''), '^\\s*({'|'.join(scoring.ROLES)})\\s*:', '')"
    items = lambda side: f"CASE WHEN json_type(json_extract({side}, '$.hasConstraint')) = 'ARRAY' THEN list_transform(CAST(json_extract({side}, '$.hasConstraint') AS JSON[]), lambda x: {{'label': {squeeze("coalesce(x ->> '$.label', '')")}, 'target': {squeeze(target)}}}) ELSE [] END"
    out.append(f"SELECT k, 'hasConstraint' AS role, c FROM {_greedy_sql(f'(SELECT k, {items("gt")} AS gt, {items("pred")} AS pred FROM r)', 'k')}")
    base = f"SELECT k, seg, CAST({_GT_SQL} AS JSON) AS gt, TRY_CAST({_PRED_SQL} AS JSON) AS pred FROM (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer)"
    return f"WITH r AS MATERIALIZED ({base}), s AS ({' UNION ALL '.join(out)})"


@query(_record_sql() + " SELECT k, role, round(c.tp, 6) AS tp, round(c.fp, 6) AS fp, round(c.fn, 6) AS fn, round(c.tn, 6) AS tn FROM s")
def q_record_confusion(spark, d):
    scored = scoring.score_records(_mixed_records(spark, d), "gt", "pred")
    return scoring.by_role(scored, ["k"]).select("k", "role", *[F.round(c, 6).alias(c) for c in scoring.COUNTS])


@query(_record_sql() + """, t AS (SELECT seg, k, sum(c.tp) AS tp, sum(c.fp) AS fp, sum(c.fn) AS fn, sum(c.tn) AS tn FROM s JOIN r USING (k) GROUP BY seg, k)
SELECT seg, count(*) AS n, round(sum(tp), 4) AS tp, round(sum(fp), 4) AS fp, round(sum(fn), 4) AS fn, round(sum(tn), 4) AS tn FROM t GROUP BY seg""")
def q_record_totals(spark, d):
    scored = scoring.score_records(_mixed_records(spark, d), "gt", "pred")
    return scored.groupBy("seg").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 4).alias(c) for c in scoring.COUNTS])


def _mixed_records(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(t(spark, d, "customer").selectExpr("c_custkey AS k", "c_name AS name", "c_mktsegment AS seg"))
    return rows.selectExpr("k", "seg", f"{_GT_SQL} AS gt", f"{_PRED_SQL} AS pred")


@query("""WITH t AS (SELECT o_custkey % 50 AS model, o_orderpriority AS shot, a AS approach FROM orders, (VALUES ('ef'), ('mcp'), ('naive')) v(a) WHERE o_orderkey % 3 = 0 GROUP BY ALL),
a AS (SELECT o_custkey % 50 AS model, o_orderpriority AS shot, count(*) AS answer FROM orders WHERE o_custkey % 5 <> 0 GROUP BY ALL)
SELECT approach, count(*) AS tasks, count(answer) AS answered, count(*) FILTER (WHERE answer IS NOT NULL AND approach <> 'ef') AS reused, CAST(sum(answer) AS BIGINT) AS total
FROM t LEFT JOIN a USING (model, shot) GROUP BY approach""")
def q_reuse(spark, d):
    orders = t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("model"), F.col("o_orderpriority").alias("shot"), "o_orderkey", "o_custkey")
    tasks = orders.where("o_orderkey % 3 = 0").select("model", "shot").distinct().select("model", "shot", F.explode(F.array(*map(F.lit, ("ef", "mcp", "naive")))).alias("approach"))
    answers = orders.where("o_custkey % 5 <> 0").groupBy("model", "shot").agg(F.count("*").alias("answer"))
    joined = scoring.reuse(tasks, answers, ["model", "shot"], "approach")
    return joined.groupBy("approach").agg(F.count("*").alias("tasks"), F.count("answer").alias("answered"), F.count_if("reused").alias("reused"), F.sum("answer").alias("total"))


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE value > 50) AS unparsable_json, count(*) FILTER (WHERE user_id % 2 = 0) AS label_overwritten,
       CAST(sum(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS missing_keys FROM events""")
def q_audit_counters(spark, d):
    keys = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("a"), F.lit("b")))
    events = t(spark, d, "events").select((F.col("value") > 50).alias("unparsable_json"), (F.col("user_id") % 2 == 0).alias("label_overwritten"), keys.alias("missing_keys"))
    return summary.audit_counters(events, ["unparsable_json", "label_overwritten"], ["missing_keys"])


@query("""SELECT o_orderstatus, round(avg(o_totalprice) FILTER (WHERE shot = 0), 3) AS "0", round(avg(o_totalprice) FILTER (WHERE shot = 1), 3) AS "1",
       round(avg(o_totalprice) FILTER (WHERE shot = 3), 3) AS "3" FROM (SELECT *, [0, 1, 3][1 + o_orderkey % 3] AS shot FROM orders) GROUP BY o_orderstatus""")
def q_shot_pivot(spark, d):
    shot = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(3)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return summary.pivot_mean(t(spark, d, "orders").withColumn("shot", shot), "o_orderstatus", "shot", [0, 1, 3], "o_totalprice")


@query("""WITH s AS (SELECT o_orderpriority AS key, round(avg(o_totalprice), 3) AS v FROM orders GROUP BY ALL
  UNION ALL SELECT o_orderpriority, o_totalprice FROM orders)
SELECT key, round(avg(v), 3) AS mean FROM s GROUP BY key""")
def q_stack_means(spark, d):
    orders = t(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_totalprice").alias("v"))
    means = orders.groupBy("key").agg(F.round(F.avg("v"), 3).alias("v"))
    return summary.stacked_means([means, orders], "key", "v")


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_discount), 3) AS l_discount FROM lineitem GROUP BY ALL""")
def q_best_pairs(spark, d):
    return summary.ranking(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount")


@query("""SELECT event_type, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS std FROM events GROUP BY event_type""")
def q_repeat_stats(spark, d):
    return summary.repeat_stats(t(spark, d, "events"), ["event_type"], "value")


@query("""SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey""")
def q_first_value(spark, d):
    return summary.first_value(t(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["o_orderdate", "o_orderkey"])


@query("""SELECT event_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS event_type FROM events""")
def q_forward_fill(spark, d):
    rows = t(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise("").alias("event_type"))
    return scans.forward_fill(rows, "event_type", "event_id", ["user_id"]).select("event_id", "event_type")


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL),
l AS (SELECT user_id, list(event_type ORDER BY first_id) AS types FROM f GROUP BY user_id)
SELECT user_id, CASE WHEN len(types) = 1 THEN types[1] ELSE '["' || array_to_string(types, '","') || '"]' END AS event_type FROM l""")
def q_distinct_or_list(spark, d):
    return scans.distinct_or_list(t(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""SELECT event_id, event_id % 2 = 0 AS same FROM events""")
def q_exact_json(spark, d):
    doc = lambda a, b: F.concat(F.lit("{"), *[x for i, (k, v) in enumerate((a, b)) for x in (F.lit(', "' if i else '"'), F.lit(k), F.lit('": "'), v, F.lit('"'))], F.lit("}"))
    left = doc(("a", F.col("event_type")), ("b", F.col("user_id").cast("string")))
    right = doc(("b", F.col("user_id").cast("string")), ("a", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("?")))
    return t(spark, d, "events").select("event_id", records.json_equal(left, right).alias("same"))


@query("""WITH a AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1), b AS (SELECT n.n_regionkey AS k, count(*) AS n FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1)
SELECT a.k, a.n AS n_nations, b.n AS n_customers FROM a JOIN b USING (k)""")
def q_merge_summaries(spark, d):
    nation = t(spark, d, "nation").withColumnRenamed("n_regionkey", "k")
    customers = t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    count = lambda df: df.groupBy("k").agg(F.count("*").alias("n"))
    return summary.merge_summaries(count(nation), count(customers), "k", ("_nations", "_customers"))


def _two_keys(spark: SparkSession, d: str) -> DataFrame:
    gt, pred = F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, "").otherwise("other")
    return t(spark, d, "customer").select("c_nationkey", confusion.text_confusion(gt, pred).alias("segment"), confusion.text_confusion(F.lit(""), pred).alias("nothing"))


_TWO_SQL = """SELECT c_nationkey, 'segment' AS key, CAST(c_custkey % 3 = 0 AS DOUBLE) AS tp, CAST(c_custkey % 3 = 2 AS DOUBLE) AS fp, CAST(c_custkey % 3 = 1 AS DOUBLE) AS fn, 0.0::DOUBLE AS tn FROM customer
UNION ALL SELECT c_nationkey, 'nothing', 0, CAST(c_custkey % 3 <> 1 AS DOUBLE), 0, CAST(c_custkey % 3 = 1 AS DOUBLE) FROM customer"""


@query(f"SELECT c_nationkey, key, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM ({_TWO_SQL}) GROUP BY ALL")
def q_long_unpivot(spark, d):
    long = summary.long_counts(_two_keys(spark, d), ["c_nationkey"], ["segment", "nothing"])
    return long.groupBy("c_nationkey", "key").agg(*[F.sum(c).alias(c) for c in summary.COUNTS])


@query(f"""SELECT c_nationkey, {", ".join(f"sum({c}) FILTER (WHERE key = '{k}') AS {k}_{c}" for k in ("segment", "nothing") for c in ("tp", "fp", "fn", "tn"))} FROM ({_TWO_SQL}) GROUP BY c_nationkey""")
def q_wide_keys(spark, d):
    long = summary.long_counts(_two_keys(spark, d), ["c_nationkey"], ["segment", "nothing"])
    return summary.wide_counts(long, ["c_nationkey"], ["segment", "nothing"])


@query("""SELECT mismatch, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM (
  SELECT m AS mismatch, CAST(o_orderkey % 2 = 0 AS DOUBLE) AS tp, CAST(o_orderkey % 2 = 1 AND m = 'fp' AS DOUBLE) AS fp, CAST(o_orderkey % 2 = 1 AND m = 'fn' AS DOUBLE) AS fn, 0.0::DOUBLE AS tn
  FROM orders, (VALUES ('fp'), ('fn')) v(m)) GROUP BY mismatch""")
def q_mismatch_rules(spark, d):
    pred = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.lower("o_orderpriority"))).otherwise("none of these")
    rows = t(spark, d, "orders").select("o_orderpriority", pred.alias("pred"))
    each = F.array(*[F.struct(F.lit(m).alias("mismatch"), confusion.text_confusion(F.col("o_orderpriority"), F.col("pred"), m).alias("c")) for m in ("fp", "fn")])
    return rows.select(F.inline(each)).groupBy("mismatch").agg(*[F.sum(f"c.{c}").alias(c) for c in summary.COUNTS])


@query("""SELECT s_suppkey, round((CAST(s_suppkey % 2 = 0 AS INT) + CAST(s_suppkey % 3 = 0 AS INT)) / 2, 6) AS asym,
       round((1 + CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE 1.0 / 3 END) / 2, 6) AS sym FROM supplier""")
def q_systems(spark, d):
    even, third = F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 3 == 0
    none = F.lit(None).cast("string")
    side = lambda a, b, parts: F.struct(F.lit("sys").alias("system"), a.alias("source"), b.alias("target"), none.alias("numerator"), none.alias("denominator"), parts.alias("parts"))
    name = F.col("s_name")
    gt = side(name, name, F.array(name, F.lit("p")))
    pred = side(F.when(even, F.upper(name)).otherwise("-"), F.when(third, name).otherwise("-"), F.when(even, F.array(F.lit("p"), name)).otherwise(F.array(F.lit("p"), F.lit("q"))))
    rows = t(spark, d, "supplier").select("s_suppkey", gt.alias("gt"), pred.alias("pred"))
    return rows.select("s_suppkey", F.round(similarity.asymmetric(F.col("gt"), F.col("pred")), 6).alias("asym"), F.round(similarity.symmetric(F.col("gt"), F.col("pred")), 6).alias("sym"))


@query()
def q_string_ratios(spark, d):
    rows = t(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return rows.select("p_partkey", F.round(similarity.fuzzy_ratio("p_name", "p_type"), 6).alias("fuzzy"), F.round(similarity.matcher_ratio("p_name", "p_type"), 6).alias("matcher"))


@query("""WITH RECURSIVE dp(k, a, b, i, r) AS (
  SELECT p_partkey, lower(trim(p_name)), lower(trim(p_type || ' ' || p_brand)), 0, list_transform(range(len(trim(p_name)) + 1), lambda x: 0) FROM part
  UNION ALL
  SELECT k, a, b, i + 1, list_prepend(0, list_transform(range(1, len(a) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda t: greatest(r[t + 1], r[t] + CAST(a[t] = b[i + 1] AS INT))))))
  FROM dp WHERE i < len(b)
)
SELECT k AS p_partkey, round(2 * r[len(a) + 1] / (len(a) + len(b)), 6) AS fuzzy FROM dp WHERE i = len(b)""")
def q_fuzzy_ratio(spark, d):
    rows = t(spark, d, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_type", "p_brand").alias("said"))
    return rows.select("p_partkey", F.round(similarity.fuzzy_ratio("p_name", "said"), 6).alias("fuzzy"))


@query()
def q_conformance(spark, d):
    listed = F.col("p_partkey") % 3 == 0  # these have the name in a list below objects, the others in an object
    label = F.when(~listed, F.upper("p_name"))
    deep = F.struct(F.struct(F.struct(F.struct(F.array(F.col("p_type"), F.when(listed, F.upper("p_name"))).alias("hasPart")).alias("z")).alias("y")).alias("x"))
    constraint = F.struct(F.col("p_brand").alias("label"), F.col("p_size").alias("on"))
    record = F.to_json(F.struct(F.struct(label.alias("label"), F.col("p_type").alias("kind")).alias("a"), F.col("p_brand").alias("b"), F.array(constraint, constraint).alias("hasConstraint"), deep.alias("d")))
    parts = spread(t(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"))
    pairs = parts.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("gt"), records.string_leaves(record).alias("leaves"))
    return metrics.best_matches(pairs)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Parts as candidates for their brand: (term, pos, id, label, score)."""
    label = F.when(F.col("p_size") == 7, F.col("p_brand")).otherwise(F.col("p_name"))
    return t(spark, d, "part").select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("pos"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("id"), label.alias("label"), (F.col("p_retailprice") / 10000).alias("score"))


_CANDIDATES_SQL = "SELECT p_brand AS term, p_partkey AS pos, 'Q' || p_partkey AS id, CASE WHEN p_size = 7 THEN p_brand ELSE p_name END AS label, p_retailprice / 10000 AS score FROM part"


@query(f"""SELECT term, 'https://www.wikidata.org/wiki/' || arg_min(id, pos) AS naive, 'https://www.wikidata.org/wiki/' || arg_max(id, (score, -pos)) AS embedding,
  'https://www.wikidata.org/wiki/' || coalesce(arg_min(id, pos) FILTER (WHERE label = term), arg_max(id, (score, -pos))) AS ef FROM ({_CANDIDATES_SQL}) GROUP BY term""")
def q_link(spark, d):
    approaches = ("naive", "embedding", "ef")
    linked = linking.link_all(_candidates(spark, d), approaches)
    return linked.select("term", *[F.concat(F.lit("https://www.wikidata.org/wiki/"), a).alias(a) for a in approaches])


@query("""SELECT p_brand, count(*) FILTER (WHERE p_partkey % 7 <> 0) AS total, count(*) FILTER (WHERE p_partkey % 7 <> 0 AND p_partkey % 2 = 0 AND p_partkey % 3 <> 1) AS correct,
  count(*) FILTER (WHERE p_partkey % 7 <> 0 AND p_partkey % 3 <> 1) AS predicted,
  round(count(*) FILTER (WHERE p_partkey % 7 <> 0 AND p_partkey % 2 = 0 AND p_partkey % 3 <> 1) / greatest(1, count(*) FILTER (WHERE p_partkey % 7 <> 0)), 3) AS accuracy,
  round(count(*) FILTER (WHERE p_partkey % 7 <> 0 AND p_partkey % 3 <> 1) / greatest(1, count(*) FILTER (WHERE p_partkey % 7 <> 0)), 3) AS coverage
FROM part GROUP BY p_brand""")
def q_uri_compare(spark, d):
    key = F.col("p_partkey").cast("string")
    expected = F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("http://www.wikidata.org/entity/Q"), key))
    given = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://www.wikidata.org/wiki/Q"), key)).otherwise("https://example.org/x/")
    rows = t(spark, d, "part").select("p_brand", expected.alias("expected"), F.when(F.col("p_partkey") % 3 != 1, given).alias("predicted"))
    return linking.uri_scores(rows, ["p_brand"])


EX = "http://example.org/"


def _triples(spark: SparkSession, d: str) -> DataFrame:
    nation, region = t(spark, d, "nation"), t(spark, d, "region")
    at = lambda kind, col: graphs.template(EX + kind + "/%s", F.col(col).cast("string"))
    parts = [
        graphs.map_rows(nation, "g", at("nation", "n_nationkey"), [(graphs.RDF_TYPE, F.lit(EX + "Nation"), "iri"), (graphs.RDFS + "label", F.col("n_name"), "literal")]),
        graphs.map_rows(region, "g", at("region", "r_regionkey"), [(graphs.RDF_TYPE, F.lit(EX + "Region"), "iri"), (graphs.RDFS + "label", F.when(F.col("r_regionkey") > 0, F.col("r_name")), "literal")]),
        graphs.reference_join(nation, region, "n_regionkey", "r_regionkey", at("nation", "n_nationkey"), EX + "in", at("region", "r_regionkey"), "g"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""SELECT '<{EX}nation/' || n_nationkey || '> <{graphs.RDF_TYPE}> <{EX}Nation> .' AS value FROM nation
UNION ALL SELECT '<{EX}nation/' || n_nationkey || '> <{graphs.RDFS}label> "' || n_name || '" .' FROM nation
UNION ALL SELECT '<{EX}region/' || r_regionkey || '> <{graphs.RDF_TYPE}> <{EX}Region> .' FROM region
UNION ALL SELECT '<{EX}region/' || r_regionkey || '> <{graphs.RDFS}label> "' || r_name || '" .' FROM region WHERE r_regionkey > 0
UNION ALL SELECT '<{EX}nation/' || n_nationkey || '> <{EX}in> <{EX}region/' || r_regionkey || '> .' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def q_triples(spark, d):
    return graphs.n_triples(_triples(spark, d))


@query(f"""SELECT 'label' AS rule, '{EX}region/' || r_regionkey AS s, 0 AS n FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'short label', '{EX}nation/' || n_nationkey, 0 FROM nation WHERE len(n_name) < 7""")
def q_shapes(spark, d):
    triples = _triples(spark, d)
    label = graphs.RDFS + "label"
    missing = graphs.cardinality(triples, EX + "Region", label, low=1).select(F.lit("label").alias("rule"), "s", F.col("n").cast("int").alias("n"))
    short = graphs.cardinality(triples, EX + "Nation", label, low=1, min_length=7).select(F.lit("short label").alias("rule"), "s", F.col("n").cast("int").alias("n"))
    return missing.unionByName(short)
