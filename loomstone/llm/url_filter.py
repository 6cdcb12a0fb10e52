"""URL filters (operator 7): rules, and a path-template tree for the rest.

Longest matching rules decide first; their verdicts are also the labels. For all
other urls every host gets a tree of path templates over its distinct paths:

1. Segments that look variable (numbers, dates, hex, long mixed names) become
   wildcards, then segments of which a parent has too many different values.
2. Sibling branches with the same main sub-paths, whose urls are distributed
   over all sub-paths alike (a chi-square test against those siblings together)
   and whose labelled block rates do not differ significantly, merge into one;
   unlabelled ones join those that they resemble. Merging starts at the leaves
   and goes up as far as branches keep merging.
3. A template is rejected where the labelled purity of its merged branch,
   smoothed towards its host's and that towards all hosts', reaches ``REJECT``.
   A branch in which no label stands is allowed.

Everything is DataFrame work on (host, template) counts, which aggregate before
they are shuffled, so a host with a third of all urls stays small. Steps 1 and 2
handle all levels of all trees at once and repeat until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import checkpoint, table

#: (host, path, verdict); a host covers its subdomains, a path all that begin with it
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
VARIETY = 20  # so many different literals under a parent, ...
SPREAD = 0.5  # ... of at least this share of its distinct urls, are a variable
MIN_URLS = 5  # distinct urls that a branch needs before it may merge with its siblings
MIN_LABELS = 5  # labels from which a branch's own block rate counts in that
MAIN_SHARE = 0.1  # of a branch's distinct urls, from which a sub-path is one of its main ones
SIMILAR_Z = 1.96  # standard deviations that a merging branch may differ by
PRIOR_WEIGHT = 5.0
REJECT = 0.9


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct<size, rule, verdict>, else null. Ties go to the later rule in text order."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    if not fits:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return fits[0] if len(fits) == 1 else F.greatest(*fits)


def generalise(path: Column) -> Column:
    """Path segments with variable-looking ones as wildcards; a file ending stays."""

    def one(s: Column) -> Column:
        stem, ending = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$", 1), F.regexp_extract(s, r"^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$", 2)
        variable = stem.rlike(r"^[0-9][0-9_.-]*$|^[0-9a-fA-F-]{8,}$|^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]{12,}$")
        return F.when(variable, F.concat(F.lit("*"), ending)).otherwise(s)

    return F.transform(F.split(path, "/"), one)


MERGED = "|~"  # begins the segment of merged siblings, before the first one's name


def _literal(s: Column) -> Column:
    return (s != "") & ~s.startswith("*") & ~s.startswith(MERGED)


def _positions(stats: DataFrame) -> DataFrame:
    """One row for each literal segment of each final template: level, parent, literal and the rest below."""
    level = stats.select("host", "final", "urls", "labelled", "blocked", F.explode(F.sequence(F.lit(1), F.size("final") - 1)).alias("level")).where("size(final) > 1")
    out = level.select(
        "host", "final", "urls", "labelled", "blocked", "level", F.slice("final", F.lit(1), F.col("level")).alias("parent"), F.element_at("final", F.col("level") + 1).alias("literal"),
        F.slice("final", F.col("level") + 2, F.size("final")).alias("rest"),
    )
    return out.where(_literal(F.col("literal")))


def _turn(stats: DataFrame, where: DataFrame) -> DataFrame | None:
    """``stats`` with the segments at (host, final, level) turned into others, or None where there are none."""
    places = checkpoint(where.select("host", "final", "level", "into").distinct().groupBy("host", "final").agg(F.map_from_entries(F.collect_list(F.struct("level", "into"))).alias("turned")))
    if not places.limit(1).count():
        return None
    final = F.transform("final", lambda s, i: F.coalesce(F.try_element_at("turned", i), s))
    return checkpoint(stats.join(places, ["host", "final"], "left").withColumn("final", F.when(F.col("turned").isNotNull(), final).otherwise(F.col("final"))).drop("turned"))


def _wide(stats: DataFrame) -> DataFrame:
    """Places of literals whose parent has too many of them."""
    at = _positions(stats)
    kinds = at.groupBy("host", "parent", "literal").agg(F.sum("urls").alias("n")).groupBy("host", "parent").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    wide = kinds.where((F.col("kinds") >= VARIETY) & (F.col("kinds") >= F.col("n") * SPREAD)).select("host", "parent")
    return at.join(wide, ["host", "parent"]).withColumn("into", F.lit("*"))


def _alike(stats: DataFrame) -> DataFrame:
    """Places of literals whose branches merge with a sibling."""
    at, own, here = _positions(stats), ["host", "parent", "literal"], ["host", "parent", "main"]
    shape = at.groupBy(*own, "rest").agg(*(F.sum(c).alias(c) for c in ("urls", "labelled", "blocked")))
    size = shape.groupBy(*own).agg(F.sum("urls").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    part = shape.select(*own, "rest", "urls").join(size, own)
    main = part.where(F.col("urls") >= F.col("n") * MAIN_SHARE).groupBy(*own).agg(F.sort_array(F.collect_set("rest")).alias("main"))
    part = checkpoint(part.join(main, own))
    common = part.groupBy(*here, "rest").agg(F.sum("urls").alias("all_urls"))
    whole = common.groupBy(*here).agg(F.sum("all_urls").alias("total"), (F.count("*") - 1).alias("free"))
    branch = part.join(common, [*here, "rest"]).groupBy(*own, "main", "n", "labelled", "blocked").agg(F.sum(F.col("urls") * F.col("urls") / F.col("all_urls")).alias("squares"))
    branch = branch.join(whole, here)
    chi = F.col("squares") * F.col("total") / F.col("n") - F.col("n")
    branch = branch.where((F.col("n") >= MIN_URLS) & (chi <= F.col("free") + SIMILAR_Z * F.sqrt(F.col("free") * 2) + 1e-9))
    rated = branch.where(F.col("labelled") >= MIN_LABELS).groupBy(*here).agg((F.sum("blocked") / F.sum("labelled")).alias("mean"))
    branch = branch.join(rated, here, "left")
    gap = F.abs(F.col("blocked") / F.col("labelled") - F.col("mean"))
    near = (F.col("labelled") < MIN_LABELS) | (gap <= SIMILAR_Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / F.col("labelled")))
    branch = branch.where(near).select(*own, "main")
    several = branch.groupBy(*here).agg(F.count("*").alias("kinds"), F.concat(F.lit(MERGED), F.min("literal")).alias("into")).where("kinds > 1").drop("kinds")
    return at.join(branch.join(several, here).select(*own, "into"), own)


def judge_templates(urls: DataFrame) -> DataFrame:
    """(host, template, rejected) from urls with host, path and bad (1 block, 0 allow, null unlabelled)."""
    distinct = urls.groupBy("host", "path").agg(F.max("bad").alias("bad"))
    stats = distinct.groupBy("host", generalise(F.col("path")).alias("template")).agg(F.count("*").alias("urls"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("blocked"))
    stats = checkpoint(stats.withColumn("final", F.col("template")))
    for find in (_wide, _alike):
        while (turned := _turn(stats, find(stats))) is not None:
            stats = turned
    total = stats.agg(F.sum("labelled"), F.sum("blocked")).first()
    prior = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)
    smoothed = lambda mean: (F.col("blocked") + PRIOR_WEIGHT * mean) / (F.col("labelled") + PRIOR_WEIGHT)
    sums = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
    hosts = stats.groupBy("host").agg(*sums).select("host", smoothed(F.lit(prior)).alias("usual"))
    branch = stats.groupBy("host", "final").agg(*sums).join(hosts, "host")
    judged = branch.select("host", "final", ((F.col("labelled") > 0) & (smoothed(F.col("usual")) >= REJECT)).alias("rejected"))
    return stats.select("host", "template", "final").join(judged, ["host", "final"]).select("host", "template", "rejected")


def filter_urls(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """Append host, path, rule and verdict to each row.

    Host and path are empty for a null url or one without ``://``. Without a
    fitting rule the verdict is ``block`` where the url's template is rejected,
    else ``allow``. Repeated urls get the same verdict and count once in the
    tree; columns of ``pages`` called like an added one are replaced, any others
    stay; an empty table gives none. ``rules`` is configuration and becomes part
    of the plan; without rules there are no labels and everything is allowed.
    """
    url, kept = F.col(url_col), [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    base = pages.select(F.struct(*kept).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("hit", match_rules(F.col("host"), F.col("path"), rules)).withColumn("template", generalise(F.col("path")))
    said = F.col("hit.verdict")
    judged = judge_templates(base.select("host", "path", F.when(said == "block", 1).when(said == "allow", 0).alias("bad")))
    rejects = judged.where("rejected").select("host", "template", F.lit("block").alias("judged"))
    joined = base.join(rejects, ["host", "template"], "left")
    return joined.select("row.*", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "judged", F.lit("allow")).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _sql(passes: int = 4) -> str:
    """The same in SQL, with a fixed number of passes of either kind (more change nothing once a pass changes nothing)."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    literal = lambda x: f"({x} <> '' AND NOT starts_with({x}, '*') AND NOT starts_with({x}, '{MERGED}'))"

    def one(k: int, wide: bool) -> str:
        at = f"""
a{k} AS MATERIALIZED (
  SELECT * FROM (SELECT host, final, urls, labelled, blocked, i, final[1:i] AS parent, final[i + 1] AS lit, final[i + 2:] AS rest
    FROM (SELECT *, unnest(range(1, len(final))) AS i FROM s{k - 1})) WHERE {literal("lit")}
),"""
        turn = f"""
t{k} AS (SELECT host, final, list(i ORDER BY i) AS turned, list(into_ ORDER BY i) AS names FROM (SELECT DISTINCT host, final, i, into_ FROM f{k}) GROUP BY host, final),
s{k} AS MATERIALIZED (
  SELECT s.host, s.template, s.urls, s.labelled, s.blocked,
         CASE WHEN turned IS NULL THEN s.final
              ELSE list_transform(s.final, lambda x, j: CASE WHEN list_contains(turned, j - 1) THEN names[list_position(turned, j - 1)] ELSE x END) END AS final
  FROM s{k - 1} s LEFT JOIN t{k} USING (host, final)
),"""
        if wide:
            found = f"""
f{k} AS (
  SELECT a{k}.*, '*' AS into_ FROM a{k} JOIN (
    SELECT host, parent FROM (SELECT host, parent, lit, sum(urls) AS n FROM a{k} GROUP BY ALL)
    GROUP BY host, parent HAVING count(*) >= {VARIETY} AND count(*) >= sum(n) * {SPREAD}) USING (host, parent)
),"""
        else:
            found = f"""
c{k} AS (SELECT host, parent, lit, rest, sum(urls)::DOUBLE AS u, sum(labelled)::DOUBLE AS l, sum(blocked)::DOUBLE AS b FROM a{k} GROUP BY ALL),
n{k} AS (SELECT host, parent, lit, sum(u) AS n, sum(l) AS l, sum(b) AS b FROM c{k} GROUP BY ALL),
e{k} AS MATERIALIZED (
  SELECT host, parent, lit, rest, u, n, n{k}.l AS l, n{k}.b AS b, main FROM c{k} JOIN n{k} USING (host, parent, lit)
  JOIN (SELECT host, parent, lit, list(rest ORDER BY rest) AS main FROM c{k} JOIN n{k} USING (host, parent, lit) WHERE u >= n * {MAIN_SHARE} GROUP BY ALL) USING (host, parent, lit)
), p{k} AS (SELECT host, parent, main, rest, sum(u) AS au FROM e{k} GROUP BY ALL),
w{k} AS (SELECT host, parent, main, sum(au) AS total, count(*) - 1 AS free FROM p{k} GROUP BY ALL),
b{k} AS (
  SELECT * FROM (SELECT host, parent, main, lit, n, l, b, sum(u * u / au) AS sq FROM e{k} JOIN p{k} USING (host, parent, main, rest) GROUP BY ALL)
  JOIN w{k} USING (host, parent, main) WHERE n >= {MIN_URLS} AND sq * total / n - n <= free + {SIMILAR_Z} * sqrt(free * 2) + 1e-9
), m{k} AS (SELECT host, parent, main, sum(b) / sum(l) AS mean FROM b{k} WHERE l >= {MIN_LABELS} GROUP BY ALL),
g{k} AS (
  SELECT host, parent, main, lit FROM b{k} LEFT JOIN m{k} USING (host, parent, main)
  WHERE CASE WHEN l < {MIN_LABELS} THEN true ELSE abs(b / l - mean) <= {SIMILAR_Z} * sqrt(mean * (1 - mean) / l) END
), f{k} AS (
  SELECT a{k}.*, into_ FROM a{k} JOIN g{k} USING (host, parent, lit)
  JOIN (SELECT host, parent, main, '{MERGED}' || min(lit) AS into_ FROM g{k} GROUP BY ALL HAVING count(*) > 1) USING (host, parent, main)
),"""
        return at + found + turn

    steps = "".join(one(k, k <= passes) for k in range(1, 2 * passes + 1))
    ending = r"'^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$'"
    stem = f"regexp_extract(x, {ending}, 1)"
    return rf"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT rid, arg_max(h || q, (len(h || q), h || q)) AS rule, arg_max(v, (len(h || q), h || q)) AS said
  FROM p JOIN (VALUES {rules}) AS rules(h, q, v) ON (p.host = h OR suffix(p.host, '.' || h)) AND starts_with(p.path, q)
  GROUP BY rid
), u AS MATERIALIZED (
  SELECT p.*, r.rule, r.said,
         list_transform(string_split(path, '/'), lambda x: CASE WHEN regexp_matches({stem}, '^[0-9][0-9_.-]*$') OR regexp_matches({stem}, '^[0-9a-fA-F-]{{8,}}$')
           OR (regexp_matches({stem}, '[0-9]') AND regexp_matches({stem}, '[A-Za-z]') AND regexp_matches({stem}, '^[A-Za-z0-9_-]{{12,}}$'))
           THEN '*' || regexp_extract(x, {ending}, 2) ELSE x END) AS template
  FROM p LEFT JOIN r USING (rid)
), s0 AS MATERIALIZED (
  SELECT host, template, template AS final, count(*) AS urls, count(said) AS labelled, count(*) FILTER (WHERE said = 'block') AS blocked
  FROM (SELECT DISTINCT host, path, template, said FROM u) GROUP BY host, template
), prior AS (SELECT (coalesce(sum(blocked), 0) + 1) / (coalesce(sum(labelled), 0) + 2) AS prior FROM s0),{steps}
h AS (SELECT host, (sum(blocked) + {PRIOR_WEIGHT} * any_value(prior)) / (sum(labelled) + {PRIOR_WEIGHT}) AS usual FROM s0, prior GROUP BY host),
j AS (
  SELECT host, final FROM (SELECT host, final, sum(labelled) AS l, sum(blocked) AS b FROM s{2 * passes} GROUP BY host, final) JOIN h USING (host)
  WHERE l > 0 AND (b + {PRIOR_WEIGHT} * usual) / (l + {PRIOR_WEIGHT}) >= {REJECT}
), x AS (SELECT DISTINCT host, template FROM s{2 * passes} JOIN j USING (host, final))
SELECT u.page_id, u.host, u.path, u.rule, coalesce(u.said, CASE WHEN x.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN x ON x.host = u.host AND x.template = u.template
"""


OP7_SQL = _sql()
