"""Personal data (operator 10), in DataFrame functions only.

Regular expressions propose spans, validators (octet range, Luhn, digit counts,
mod 97) confirm them, and context words nearby raise the score. The matches of
a pattern and the gaps between them give every position: a match starts after
all gaps up to it and all matches before it.

The patterns are anchored at the beginning of a run (``\\G`` or no run character
before) and take runs possessively. They find what the plain patterns find, in
time linear in the text and without recursion on long runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import table

NEAR = 48  # code points on either side in which context words count
BLOCK = 128  # of running sums
ACCEPT = 0.7  # score from which spans of the added kinds stay


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: Callable[[Column], Column]  # cheap test that any match passes
    valid: Callable[[Column], Column]
    checked: bool  # a validator that chance rarely passes
    context: str
    base: bool  # such spans stay whatever their score


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(m, "\\."), lambda p: (F.length(bare(p)) <= 3) & (F.substring(bare(p), 1, 3).cast("int") <= 255))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.split(F.reverse(digits), "(?<=.)(?=.)")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2).cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(each, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _card(m: Column) -> Column:
    return let(F.regexp_replace(m, "[ -]", ""), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))


def mod97(m: Column) -> Column:
    """Whether an account number leaves 1 modulo 97 once its first four characters go last."""
    bare = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


_YES = lambda m: F.lit(True)

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), _YES, False, "e-?mails?|contact|write|reach", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]"), _octets, True, "address|host|server|gateway", True),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++", lambda t: t.rlike(r"[0-9][ -]?[0-9]"), _card, True, "cards?|visa|credit|debit|payment", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(9, 15), False, "phone|tel|telephone|call|mobile|fax", True),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), mod97, True, "iban|account|bank|transfer", False),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", lambda t: t.rlike("[0-9]{3}-[0-9]{2}-"), _YES, False, "ssn|social security|insured", False),
)


def running_sums(lens: Column) -> Column:
    """For each element, the sum of those before it, in blocks of ``BLOCK``."""
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def of_blocks(values: Column) -> Column:
        n = F.ceil(F.size(values) / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), n - 1), lambda b: add(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
        before = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda b: add(F.slice(s, F.lit(1), b)))
        at = lambda off: F.transform(values, lambda _, i: F.element_at(off, (F.floor(i / BLOCK) + 1).cast("int")) + add(F.slice(values, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK)))
        return let(sums, lambda s: let(before(s), at))

    return let(lens, of_blocks)


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind, by their start."""
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")

    def placed(found: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)
        lens = F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(F.coalesce(F.length(g), F.lit(0)), F.coalesce(F.length(m), F.lit(0)))))

        def put(sums: Column) -> Column:
            made = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.element_at(sums, i * 2 + 2).alias("at")))
            return F.transform(F.filter(made, lambda x: kind.valid(x["m"])), scored)

        def scored(x: Column) -> Column:
            low = F.greatest(F.lit(0), x["at"] - NEAR)
            around = F.concat(text.substr(low + 1, x["at"] - low), F.lit(" "), text.substr(x["at"] + F.length(x["m"]) + 1, F.lit(NEAR)))
            score = F.lit(0.8 if kind.checked else 0.5) + F.when(F.lower(around).rlike(rf"\b(?:{kind.context})\b"), 0.2).otherwise(0.0)
            return F.struct(F.lit(kind.name).alias("kind"), x["at"].alias("start"), (x["at"] + F.length(x["m"])).alias("end"), score.alias("score"))

        got = let(running_sums(lens), put)
        return got if kind.base else F.filter(got, lambda s: s["score"] >= ACCEPT)

    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), 0), lambda ms: F.when(F.size(ms) > 0, placed(ms)).otherwise(empty))
    return F.when(kind.hint(text), found).otherwise(empty)


def find_pii(docs: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """Append ``into``: array<struct<kind, start, end, score>> by kind, then start.

    Positions are code points, ends exclusive; spans of one kind do not overlap,
    those of different kinds may. Base kinds are email, ip, card and phone; iban
    and ssn are added where their score reaches ``ACCEPT``. Null text counts as
    empty and has no spans; every row is kept. A column called ``into`` is
    replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(into, F.concat(*[_spans(text, k) for k in KINDS]))


def mask_pii(docs: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """Replace what ``find_pii`` found by ``[KIND]``; overlapping spans become one, named by the first."""
    spans = F.array_sort(F.transform(into, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind"))))
    unit = "array<struct<start:int,end:int,kind:string>>"

    def fold(merged: Column, s: Column) -> Column:
        last = F.element_at(merged, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        joined = F.concat(F.slice(merged, F.lit(1), F.size(merged) - 1), F.array(wider))
        return F.when((F.size(merged) > 0) & (F.coalesce(F.try_element_at(merged, F.lit(-1))["end"], F.lit(-1)) > s["start"]), joined).otherwise(F.concat(merged, F.array(s)))

    merged = F.aggregate(spans, F.expr(f"cast(array() as {unit})"), fold)

    def rebuilt(ms: Column) -> Column:
        text = F.col(text_col)
        parts = F.transform(ms, lambda m, i: F.concat(text.substr(F.when(i == 0, 0).otherwise(F.element_at(ms, F.greatest(i, F.lit(1)))["end"]) + 1, m["start"] - F.when(i == 0, 0).otherwise(F.element_at(ms, F.greatest(i, F.lit(1)))["end"])), F.lit("["), m["kind"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), text.substr(F.element_at(ms, -1)["end"] + 1, F.length(text)))

    return docs.withColumn(text_col, F.when(F.size(into) > 0, let(merged, rebuilt)).otherwise(F.col(text_col)))


BASE = [k.name for k in KINDS if k.base]


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(named(F.filter("pii", lambda s: s["kind"].isin(BASE))), 256).alias("base_sha256"),
        named(F.col("pii")).alias("spans"),
    )


def _sql() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    bare = "replace(replace(m, ' ', ''), '-', '')"
    turned = "(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4))"
    numeral = f"list_reduce(list_transform(range(1, len({turned}) + 1), lambda i: CASE WHEN {turned}[i] BETWEEN '0' AND '9' THEN {turned}[i] ELSE CAST(ascii({turned}[i]) - 55 AS VARCHAR) END), lambda a, b: a || b)"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0",
        "card": f"len({bare}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len({bare}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({bare})[i] AS INTEGER) ELSE CAST(reverse({bare})[i] AS INTEGER) * 2 - CASE WHEN reverse({bare})[i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0",
        "phone": "len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
        "iban": f"list_reduce(list_prepend(0, list_transform(range(1, len({numeral}) + 1), lambda i: CAST({numeral}[i] AS INTEGER))), lambda a, d: (a * 10 + d) % 97) = 1",
        "ssn": f"regexp_matches(lower(substr(text, greatest(1, s - {NEAR} + 1), s - greatest(0, s - {NEAR})) || ' ' || substr(text, s + len(m) + 1, {NEAR})), '\\b(?:ssn|social security|insured)\\b')",
    }
    parts = []
    for i, k in enumerate(KINDS):
        parts.append(f"""
  SELECT rid, {i} AS k, '{k.name}' AS kind, s, s + len(m) AS e FROM (
    SELECT rid, text, ms[i] AS m,
           CAST(list_sum(list_transform(gs[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s
    FROM (SELECT rid, text, ms, gs, unnest(range(1, len(ms) + 1)) AS i
          FROM (SELECT rid, text, regexp_extract_all(text, '{plain[k.name]}') AS ms, regexp_split_to_array(text, '{plain[k.name]}') AS gs FROM d))
  ) WHERE {valid[k.name]}""")
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS n_{k}" for k in BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(parts)}
), g AS (
  SELECT rid, {counts},
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (WHERE k < {len(BASE)}) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans
  FROM f GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


OP10_SQL = _sql()
