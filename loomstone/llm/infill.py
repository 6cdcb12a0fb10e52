"""Fill-in-middle transformation (operator 11): whole texts cut into prefix, middle and suffix at unit ends.

A unit is a run of ASCII letters or any other single code point. A pandas UDF
gets Arrow batches; for each text one pass of ``finditer`` leaves the units' end
offsets in a compact array, and two lookups in it give the cuts. Everything that
looks random comes from a digest of the seed and the row's id, so a row that is
computed again comes out the same.

Three forms: ``plain`` is the text itself, ``psm`` is
``<P>prefix<S>suffix<M>middle`` and ``spm`` is ``<S>suffix<P>prefix<M>middle``.
A text that holds a control string stays plain, so in the other forms the first
occurrence of each control string is the one that was put there, and the text
can be rebuilt exactly.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import small_batches, table

PREFIX, SUFFIX, MIDDLE = CONTROLS = ("<P>", "<S>", "<M>")
PLAIN_PERCENT = 10  # of the texts that could be cut
SPM_PERCENT = 20  # of the texts that are cut

_UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
_CUT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def unit_ends(text: str) -> array:
    """Offset after each unit, with 0 before the first."""
    ends = array("i" if len(text) < 1 << 31 else "q", (0,))
    ends.extend(m.end() for m in _UNIT.finditer(text))
    return ends


def numbers(seed: str, key: str) -> list[int]:
    """The first four 8-digit groups of the hex digest of ``seed:key``."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(text: str, key: str, seed: str, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix and middle length in code points, output) of one text."""
    ends = unit_ends(text)
    n = len(ends) - 1
    first, second, plain, order = numbers(seed, key)
    if not text or any(c in text for c in CONTROLS) or plain % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    a, b = sorted((ends[first % (n + 1)], ends[second % (n + 1)]))
    before, middle, after = text[:a], text[a:b], text[b:]
    if order % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that ``cut`` was given, from its output and form alone."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "fim", seed: str = "1", plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Append ``into``: struct<n, form, prefix_chars, middle_chars, output> of each whole text.

    Null and empty texts have no units, are plain and give an empty output; a null
    id is hashed as an empty one. Rows with equal ids draw equal numbers, and
    repeated rows come out alike. Lengths are code points, null where the form is
    plain. Every row stays, and a column called ``into`` is replaced; an empty
    table gives none.
    """

    @F.pandas_udf(_CUT)
    def run(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = [cut(t, k, seed, plain_percent, spm_percent) for t, k in zip(texts, keys, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    small_batches(docs.sparkSession)
    empty = F.lit("")
    return docs.withColumn(into, run(F.coalesce(F.col(text_col), empty), F.coalesce(F.col(id_col).cast("string"), empty)))


def digests(made: DataFrame, into: str = "fim") -> DataFrame:
    """Append the digests of what ``fill_in_middle`` made: of each output, and of the text rebuilt from it."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        rows = [(sha(o), sha(restore(o, f))) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame(rows, columns=["output_sha256", "restored_sha256"])

    return made.withColumn("digests", run(f"{into}.output", f"{into}.form"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = digests(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return told.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", "digests.output_sha256", "digests.restored_sha256")


OP11_SQL = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), h AS (
  SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM u
), c AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM h
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""
