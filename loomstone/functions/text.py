"""Text functions of the evaluation, Column in and Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the scored roles in their order
ROLES = ("hasStatisticalModifier", "hasProperty", "hasObjectOfInterest", "hasMatrix", "hasContextObject", "hasConstraint")
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"  # what Python's strip() and \s take for white space


def strip(col: Column) -> Column:
    """Trim all white space, not only spaces."""
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def collapse(col: Column) -> Column:
    """Runs of white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(col, f"{SPACE}+", " "))


def normalise(col: Column) -> Column:
    """Lower case, trimmed, inner white space collapsed; null becomes empty."""
    return F.coalesce(collapse(F.lower(col)), F.lit(""))


def is_blank(col: Column) -> Column:
    """Null or white space only: the stripped sense of empty."""
    return F.coalesce(F.length(strip(col)) == 0, F.lit(True))


def is_falsy(col: Column) -> Column:
    """Null or the empty string: the truthiness sense of empty, in which a blank is not."""
    return F.coalesce(F.length(col) == 0, F.lit(True))


def definition_or_comment(definition: Column, comment: Column) -> Column:
    return F.coalesce(F.nullif(definition, F.lit("")), F.nullif(comment, F.lit("")))


def strip_fences(col: Column) -> Column:
    """Remove Markdown code fences, with or without a json tag, wherever they stand."""
    return strip(F.regexp_replace(col, r"```(?:json)?", ""))


def json_block(col: Column) -> Column:
    """From the first ``{`` to the last ``}``, null where there is none."""
    return F.nullif(F.regexp_extract(col, r"(?s)\{.*\}", 0), F.lit(""))


def turtle_block(col: Column, prefix: str) -> Column:
    """The first fenced block with a language tag, with a default prefix where it declares none."""
    block = F.nullif(F.regexp_extract(col, r"(?s)```[A-Za-z]+\s*\n(.*?)```", 1), F.lit(""))
    return F.when(block.contains("@prefix"), block).otherwise(F.concat(F.lit(prefix + "\n"), block))


def noise_before(col: Column, keep: int = 200) -> Column:
    """Up to ``keep`` characters of what stands before the first ``{``."""
    return F.when(col.contains("{"), F.left(strip(F.substring_index(col, "{", 1)), F.lit(keep))).otherwise(F.lit(""))


def noise_after(col: Column, keep: int = 200) -> Column:
    return F.when(col.contains("}"), F.left(strip(F.substring_index(col, "}", -1)), F.lit(keep))).otherwise(F.lit(""))


def is_html(col: Column) -> Column:
    text = strip(col)
    return F.coalesce(text.startswith("<!DOCTYPE html") | text.startswith("<html"), F.lit(False))


def contains_folded(text: Column, needle: Column) -> Column:
    """Case-insensitive containment; an empty needle is contained in everything, null in nothing."""
    return F.coalesce(F.instr(F.lower(text), F.lower(needle)) > 0, F.lit(False))


def canonical_target(col: Column) -> Column:
    """Drop a leading ``<role>:`` of a known role; anything else stays."""
    head = F.regexp_extract(col, r"^\s*([A-Za-z]+)\s*:", 1)
    return F.when(head.isin(*ROLES), strip(F.regexp_replace(col, r"^\s*[A-Za-z]+\s*:", ""))).otherwise(col)


def after_colon(col: Column) -> Column:
    return F.when(col.contains(":"), strip(F.substring(col, F.instr(col, ":") + 1, F.length(col)))).otherwise(col)


def local_name(iri: Column) -> Column:
    return F.substring_index(F.substring_index(iri, "/", -1), "#", -1)


def entity_id(uri: Column) -> Column:
    """The first ``Q`` with digits anywhere, else null."""
    return F.nullif(F.regexp_extract(uri, r"Q\d+", 0), F.lit(""))


def canonical_uri(uri: Column) -> Column:
    """One form for every way to write an entity; other URIs get https and no final slash."""
    plain = F.regexp_replace(F.replace(uri, F.lit("http://"), F.lit("https://")), "/$", "")
    return F.coalesce(F.concat(F.lit("https://www.wikidata.org/wiki/"), entity_id(uri)), plain)


def file_stem(col: Column) -> Column:
    return F.translate(col, " /", "__")


def audit_path(col: Column) -> Column:
    return F.replace(col, F.lit("."), F.lit("_"))


def context_sentence(term: Column, role: Column, names: dict[str, str]) -> Column:
    """``<term> is a <role>.`` with the role's plain name, ``concept`` where it has none."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    plain = F.try_element_at(F.create_map(*pairs), role) if pairs else F.lit(None)
    return F.concat(term, F.lit(" is a "), F.coalesce(plain, F.lit("concept")), F.lit("."))
