"""Periodic run detection (operator 12): bit-parallel lags.

The words of a text get small ids, and the ids' bits become planes: big integers
with a bit for each word. For a lag q each plane is XORed with itself shifted by
q, and the results are ORed; a zero says that the words at its place and q later
are equal. ANDing the zeros with shifted copies of themselves, in doubling
steps, leaves the stretches that are long enough, and a stretch of zeros is a
run of period q with q words more.

A run of period q has at least ``TIMES * q`` words, so its zeros cover three
neighbouring multiples of q and all between: four words at multiples of q agree,
and so do words q apart in between. Lags without such four, or with such four only
inside runs of a period that divides q, cannot hold a run of their own (the whole
stretch would have the smaller period) and need no planes. Looking at the
multiples of all lags takes n log n steps, so that long texts without repetition
stay cheap.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import crc32_sql, map_columns, table

LEAST = 6  # words of a run at least
TIMES = 4  # periods of a run at least; the lag test relies on four

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")

Run = tuple[int, int, int]  # start, length, period


def word_ids(words: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.frombuffer(array("i", [known.setdefault(w, len(known)) for w in words]), dtype=np.int32)


def planes_of(ids: np.ndarray) -> list[int]:
    """Bit b of all ids as one big integer, word 0 lowest."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(bits)]


def _bits(x: int) -> np.ndarray:
    raw = np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def stretches(planes: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """(first, last + 1) of the maximal stretches of ``least`` or more words that equal the word ``lag`` later."""
    unequal = 0
    for plane in planes:
        unequal |= plane ^ (plane >> lag)
    x = ~unequal & ((1 << (n - lag)) - 1)
    have = 1
    while have < least and x:
        step = min(have, least - have)
        x &= x >> step
        have += step
    if not x:
        return []
    return list(zip(_bits(x & ~(x << 1)).tolist(), (_bits(x & ~(x >> 1)) + least).tolist(), strict=True))


def _agree(ids: np.ndarray, q: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lags and multiples where words between kq and (k+2)q, too, equal the word q later; a few places are looked at."""
    for quarter in (2, 6, 1, 3, 5, 7):
        x = k * q + q * quarter // 4
        same = ids[x] == ids[x + q]
        q, k = q[same], k[same]
    return q, k


def anchored_lags(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(q, multiples k) for each lag q, ascending, at which a run of period q may lie over kq to (k+3)q."""
    n = len(ids)
    top = n // TIMES
    few = min(top, int(n**0.5))
    for q in range(1, few + 1):
        own = ids[::q]
        same = own[1:] == own[:-1]
        k = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(k):
            k = _agree(ids, np.full(len(k), q), k)[1]
        if len(k):
            yield q, k
    # beyond, each multiple is looked at for all its lags at once
    lags, multiples = [], []
    k = 0
    while few < top and (last := min(top, (n - 1) // (k + 3))) > few:
        q = np.arange(few + 1, last + 1)
        for i in range(k, k + 3):
            q = q[ids[i * q] == ids[(i + 1) * q]]
            if not len(q):
                break
        else:
            q, m = _agree(ids, q, np.full(len(q), k))
            lags.append(q)
            multiples.append(m)
        k += 1
    if sum(map(len, lags)):
        lag, multiple = np.concatenate(lags), np.concatenate(multiples)
        order = np.argsort(lag, kind="stable")
        lag, multiple = lag[order], multiple[order]
        at = np.flatnonzero(np.diff(lag, prepend=-1))
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(lag)], strict=True):
            yield int(lag[a]), multiple[a:b]


class _Known:
    """The runs found so far, and whether they explain four equal words at multiples of a lag."""

    def __init__(self) -> None:
        self.runs: list[Run] = []
        self.spans: set[tuple[int, int]] = set()

    def add(self, start: int, end: int, period: int) -> None:
        if (start, end) not in self.spans:  # else a period that divides this one spans the same words
            self.spans.add((start, end))
            self.runs.append((start, end - start, period))

    def explains(self, q: int, multiples: np.ndarray) -> bool:
        inside = sorted((s, s + size) for s, size, p in self.runs if size > 3 * q and q % p == 0)
        if not inside:
            return False
        starts, reach = [s for s, _ in inside], list(accumulate((e for _, e in inside), max))
        for k in multiples.tolist():
            i = bisect_right(starts, k * q)
            if i == 0 or reach[i - 1] <= (k + 3) * q:
                return False
        return True


def find_runs(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of every maximal run, by start, then period.

    A run is a stretch with smallest period q and at least max(LEAST, TIMES * q)
    words that no neighbouring word extends.
    """
    n, known, planes = len(ids), _Known(), None
    if n < LEAST:
        return []
    for q, multiples in anchored_lags(ids):
        if known.explains(q, multiples):
            continue
        if planes is None:
            planes = planes_of(ids)
        for first, last in stretches(planes, n, q, max(LEAST, TIMES * q) - q):
            known.add(first, last + q, q)
    return sorted((s, size, p) for s, size, p in known.runs)


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Whether each word stays when only the first period of every run does."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, size, period in runs:
        change[start + period] += 1
        change[start + size] -= 1
    return np.cumsum(change[:-1]) == 0


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length by period; of equal ones the first, then that of the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_STRONGEST = ("start", "length", "period", "exponent_milli")


def periodic_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append runs, the strongest one and the collapsed text of each whole text.

    ``runs`` is array<struct<start, length, period>> in words, by start, then
    period; ``start``, ``length``, ``period`` and ``exponent_milli`` tell the run
    with the greatest length by period (null where there is none); ``collapsed``
    has the words that no run contains after its first period, joined by one
    space. Words are what ASCII white space parts. Null, empty and blank texts
    have no words, no runs and an empty ``collapsed``; repeated rows come out
    alike, every row stays, and an empty table gives none. Columns with the names
    of the added ones are replaced; ``keep`` names the others that stay (all).
    """

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found, best, collapsed = [], [], []
        for text in batch.column(text_col):
            words = _WORDS.findall(text.as_py() or "")
            runs = find_runs(word_ids(words))
            top = strongest(runs)
            found.append([dict(zip(_STRONGEST, r, strict=False)) for r in runs])
            best.append((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
            collapsed.append(" ".join([w for w, stays in zip(words, kept_words(len(words), runs).tolist(), strict=True) if stays] if runs else words))
        out = {name: pa.array([b[i] for b in best], pa.int64()) for i, name in enumerate(_STRONGEST)}
        return out | {"runs": pa.array(found, _RUNS), "collapsed": pa.array(collapsed, pa.string())}

    added = "runs array<struct<start:bigint,length:bigint,period:bigint>>, start bigint, length bigint, period bigint, exponent_milli bigint, collapsed string"
    return map_columns(docs, run, added, keep)


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Make a tenth of the texts, chosen by a checksum of the id, end in a stretch of some period; their words are joined by one space.

    Texts without words and rows with a null id stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text_col, F.lit(r"[^\x20\x09-\x0D]++"), 0)
    n = F.size("words")
    turned = docs.withColumn("words", F.when(h % 10 == 0, words))
    turned = turned.withColumn("a", F.when(n > 0, g % n))
    turned = turned.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    begin = F.expr("slice(words, 1, int(a))")
    rest = F.transform(F.sequence(F.lit(0).cast("bigint"), n - F.col("a") - 1), lambda i: F.get("words", (F.col("a") + i % F.col("p")).cast("int")))
    return turned.withColumn(text_col, F.when(n > 0, F.array_join(F.concat(begin, rest), " ")).otherwise(F.col(text_col))).drop("words", "a", "p")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(plant(table(spark, sf_dir, "documents").select("doc_id", "text")), keep=["doc_id"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *_STRONGEST, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP12_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS o,
         {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h
  FROM documents
), e AS (SELECT rid, doc_id, len(o) AS n, coalesce(h % 10 = 0, false) AND len(o) > 0 AS turned, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a, 3 + (h // 10) % 8 AS parts FROM d),
u AS MATERIALIZED (SELECT rid, unnest(o) AS word, unnest(range(len(o))) AS i FROM d),
w AS MATERIALIZED (
  SELECT u.rid, u.i, coalesce(s.word, u.word) AS word, e.n
  FROM u JOIN e USING (rid) LEFT JOIN u s ON e.turned AND u.i >= e.a AND s.rid = u.rid AND s.i = e.a + (u.i - e.a) % (1 + (e.n - e.a) // e.parts)
), p AS (
  SELECT x.rid, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), g AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM p
), z AS (
  SELECT rid, q, min(i) AS start, count(*) + q AS size FROM g GROUP BY rid, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), r AS MATERIALIZED (
  SELECT rid, start, size, min(q) AS q FROM z GROUP BY rid, start, size
), best AS (
  SELECT a.rid, a.start, a.size AS length, a.q AS period FROM r a
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY CAST(size AS DOUBLE) / q DESC, start, q) = 1
), told AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || size || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM r GROUP BY rid
), gone AS (
  SELECT DISTINCT rid, unnest(range(start + q, start + size)) AS i FROM r
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM e LEFT JOIN best USING (rid) LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid)
"""
