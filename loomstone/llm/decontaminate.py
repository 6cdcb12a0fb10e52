"""Benchmark decontamination (operator 5): an FM-index over each shard.

A shard is a batch of documents inside a task. Its words become integers over
the vocabulary of the test phrases; the shard's suffix order gives a
Burrows-Wheeler transform kept as a wavelet matrix. All test phrases are
searched backwards together through wavelet ranks, occurrences are located by
walking to the next sampled suffix position, and hit words merge into spans.

A word that no phrase holds can be in no occurrence. Maximal runs of phrase
words that are shorter than the shortest phrase are left out of the index for
the same reason, and phrases with a word that the shard lacks are not searched
there; these steps are lossless.

Benchmark items are cut into overlapping segments on Spark and dealt into blocks
of about ``BLOCK_ITEMS_BYTES``. One block at a time is collected, broadcast,
searched and given up: only the hits of the blocks before the last are stored,
by the digest of their text. With one block there is no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import arrow, free_name, map_columns, store, table
from loomstone.llm.words import ALNUM, Chunk, chunks, code_points

WINDOW = 10
BLOCK_ITEMS_BYTES = 2 << 20  # of benchmark text that the driver and a task hold at once
SEGMENT_WORDS = 20_000  # of an item, before the overlap of its neighbours
SAMPLE = 8  # every so many text positions, the suffix position is stored

ADDED = (
    "n_words bigint, spans array<struct<word_start:bigint,word_end:bigint,char_start:bigint,char_end:bigint>>, "
    "items array<bigint>"
)
_SPAN = pa.list_(pa.struct([(n, pa.int64()) for n in ("word_start", "word_end", "char_start", "char_end")]))


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            plane = (seq >> b) & 1
            count = np.zeros(len(seq) + 1, dtype=np.int32)
            np.cumsum(plane, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(seq) - int(count[-1]))
            seq = np.concatenate([seq[plane == 0], seq[plane == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(at), at.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling."""
    n = len(seq)
    rank, k = np.unique(seq, return_inverse=True)[1].astype(np.int64), 1
    while True:
        second = np.full(n, 0, dtype=np.int64)
        if k < n:
            second[:-k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        sorted_key = key[order]
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if new[order[-1]] == n - 1 or k >= n:
            return order
        rank, k = new, 2 * k


class FMIndex:
    """Count and locate phrases of symbols (1 and up; 0 separates) in a sequence.

    Inside, symbols are one higher and a single 0 ends the sequence, so that
    the order of suffixes is the order of their rotations.
    """

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = SAMPLE):
        seq = np.concatenate([np.asarray(seq, dtype=np.int64) + 1, [0]])
        self.n = len(seq)
        sa = suffix_order(seq)
        self.bwt = seq[sa - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols + 2))])
        self.tree = WaveletMatrix(self.bwt, int(symbols + 1).bit_length())
        kept = sa % sample == 0
        self.kept_before = np.zeros(self.n + 1, dtype=np.int64)
        np.cumsum(kept, out=self.kept_before[1:])
        self.kept, self.positions = kept, sa[kept]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of equally long phrases, one a row, by backward search."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j] + 1
            lo[live] = self.less[c] + self.tree.rank(c, lo[live])
            hi[live] = self.less[c] + self.tree.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back to the next sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.kept[at[live]]
            got = live[done]
            out[got] = self.positions[self.kept_before[at[got]]] + steps[got]
            live = live[~done]
            c = self.bwt[at[live]]
            at[live] = self.less[c] + self.tree.rank(c, at[live])
            steps[live] += 1
        return out


class Phrases:
    """The windows of a block of benchmark items as words of a small vocabulary.

    ``groups`` holds, for each length, the distinct windows, one a row, and their
    items: those of window i are ``items[bounds[i]:bounds[i + 1]]``.
    """

    def __init__(self, item_ids: list[int], texts: list[str | None], window: int):
        seqs = []
        for c in chunks(pa.array(texts, pa.large_string()), ALNUM):
            seqs += [c.hash[c.bounds[i] : c.bounds[i + 1]] for i in range(c.rows)]
        self.vocabulary = np.unique(np.concatenate([*seqs, np.zeros(0, np.uint64)]))
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, seq in zip(item_ids, seqs, strict=True):
            if len(seq):
                size = min(window, len(seq))
                ids = (np.searchsorted(self.vocabulary, seq) + 1).astype(np.int32)
                by_size.setdefault(size, []).append((item, np.lib.stride_tricks.sliding_window_view(ids, size)))
        self.groups = []
        for _, found in sorted(by_size.items()):
            items = np.repeat(np.array([x[0] for x in found], dtype=np.int64), [len(x[1]) for x in found])
            patterns, owner = np.unique(np.concatenate([x[1] for x in found]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([owner.ravel(), items], axis=1), axis=0)
            self.groups.append((patterns, np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1)), pairs[:, 1]))
        self.shortest = min(by_size, default=0)


def _runs(ids: np.ndarray, row: np.ndarray, shortest: int) -> np.ndarray:
    """Which words stand in a run of vocabulary words, inside a row, of enough words."""
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = ((ids[1:] == 0) != (ids[:-1] == 0)) | (row[1:] != row[:-1])
    run = np.cumsum(fresh) - 1
    return (np.bincount(run)[run] >= shortest) & (ids > 0)


def _phrase_words(chunk: Chunk, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(places, symbols) of the chunk's words that an occurrence can hold."""
    none = np.zeros(0, dtype=np.int64)
    if not len(chunk.hash) or not phrases.groups:
        return none, none
    at = np.searchsorted(phrases.vocabulary, chunk.hash)
    at[at == len(phrases.vocabulary)] = 0
    ids = np.where(phrases.vocabulary[at] == chunk.hash, at + 1, 0)
    words = np.flatnonzero(_runs(ids, chunk.row_of, phrases.shortest))
    return words, ids[words]


def search_shard(shard: list[Chunk], phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(hit flag of each word of all chunks, distinct pairs of row and item that occurs)."""
    base = np.concatenate([[0], np.cumsum([len(c.hash) for c in shard])]).astype(np.int64)
    row = np.concatenate([c.row_of + c.first for c in shard]) if shard else np.zeros(0, dtype=np.int64)
    found = [_phrase_words(c, phrases) for c in shard]
    words = np.concatenate([base[i] + f[0] for i, f in enumerate(found)]) if found else np.zeros(0, dtype=np.int64)
    pairs = np.zeros((0, 2), dtype=np.int64)
    if not len(words):
        return np.zeros(base[-1], dtype=bool), pairs
    ids = np.concatenate([f[1] for f in found])
    gap = np.ones(len(words), dtype=np.int64)
    gap[1:] += (np.diff(words) > 1) | (row[words[1:]] != row[words[:-1]])
    place = np.cumsum(gap) - 1
    seq = np.zeros(place[-1] + 1, dtype=np.int64)
    seq[place] = ids
    word_at = np.full(len(seq), -1, dtype=np.int64)
    word_at[place] = words
    there = np.zeros(len(phrases.vocabulary) + 1, dtype=bool)
    there[ids] = True
    index = FMIndex(seq, len(phrases.vocabulary))
    edge = np.zeros(base[-1] + 1, dtype=np.int64)
    for patterns, bounds, items in phrases.groups:
        live = np.flatnonzero(there[patterns].all(axis=1))
        lo, hi = index.ranges(patterns[live].astype(np.int64))
        which = np.flatnonzero(hi > lo)
        if not len(which):
            continue
        count = (hi - lo)[which]
        suffixes = np.repeat(lo[which] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        begin = word_at[index.locate(suffixes)]
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + patterns.shape[1], -1)
        pair = np.unique(np.stack([row[begin], np.repeat(live[which], count)], axis=1), axis=0)
        owners = np.diff(bounds)[pair[:, 1]]
        at = np.repeat(bounds[pair[:, 1]] - np.concatenate([[0], np.cumsum(owners)[:-1]]), owners) + np.arange(owners.sum())
        pairs = np.unique(np.concatenate([pairs, np.stack([np.repeat(pair[:, 0], owners), items[at]], axis=1)]), axis=0)
    return np.cumsum(edge[:-1]) > 0, pairs


def _search_batch(phrases: Phrases, text_col: str, old: tuple[str, str] | None) -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n_words = np.zeros(batch.num_rows, dtype=np.int64)
        spans = [x or [] for x in batch.column(old[0]).to_pylist()] if old else [[] for _ in range(batch.num_rows)]
        items = [x or [] for x in batch.column(old[1]).to_pylist()] if old else [[] for _ in range(batch.num_rows)]
        shard = list(chunks(batch.column(text_col), ALNUM))
        hit, pairs = search_shard(shard, phrases)
        cuts = np.searchsorted(pairs[:, 0], np.arange(batch.num_rows + 1))
        base = 0
        for chunk in shard:
            n_words[chunk.first : chunk.first + chunk.rows] = np.diff(chunk.bounds)
            fresh = np.diff(cuts[chunk.first : chunk.first + chunk.rows + 1]) > 0
            fresh |= [bool(x) for x in spans[chunk.first : chunk.first + chunk.rows]]
            for r in np.flatnonzero(fresh).tolist():
                a, b, i = int(chunk.bounds[r]), int(chunk.bounds[r + 1]), chunk.first + r
                flags = np.zeros(b - a + 2, dtype=np.int8)
                flags[1:-1] = hit[base + a : base + b]
                for s in spans[i]:
                    flags[1 + s["word_start"] : 1 + s["word_end"]] = 1
                first = np.flatnonzero(np.diff(flags) == 1)
                last = np.flatnonzero(np.diff(flags) == -1)
                lo = int(chunk.row_start[r])
                points = code_points(chunk.raw[lo : int(chunk.row_start[r + 1])])
                spans[i] = [
                    {"word_start": s, "word_end": e, "char_start": int(points[chunk.start[a + s] - lo]), "char_end": int(points[chunk.end[a + e - 1] - lo])}
                    for s, e in zip(first.tolist(), last.tolist(), strict=True)
                ]
                items[i] = sorted({*items[i], *pairs[cuts[i] : cuts[i + 1], 1].tolist()})
            base += len(chunk.hash)
        return {"n_words": pa.array(n_words), "spans": pa.array(spans, _SPAN), "items": pa.array(items, pa.list_(pa.int64()))}

    return run


def _segments(window: int, words: int):
    """Rows (item_id, text) -> (item_id, segment, text): pieces of an item that hold each of its windows whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for c in chunks(batch.column(1), ALNUM):
                for r in range(c.rows):
                    a, n = int(c.bounds[r]), int(c.bounds[r + 1] - c.bounds[r])
                    for s in range(0, max(n - window, 0) + 1 if n else 0, words):
                        to = min(n, s + words + window - 1)
                        out.append((ids[c.first + r], s, c.raw[c.start[a + s] : c.end[a + to - 1]].tobytes().decode()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["item_id", "segment", "text"])

    return run


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int | None = None, words: int = SEGMENT_WORDS) -> Iterator[tuple[bool, Phrases]]:
    """(whether it is the last, phrases) of each block of about ``block_bytes`` of benchmark text, one at a time."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    pieces = store(arrow(items, _segments(window, words), "item_id bigint, segment int, text string"), "benchmark")
    size = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(size) // (block_bytes or BLOCK_ITEMS_BYTES)
    for b in range(n):
        rows = pieces.where(F.pmod(F.xxhash64("item_id", "segment"), F.lit(n)) == b).select("item_id", "text").distinct().toArrow()
        yield b == n - 1, Phrases(rows.column(0).to_pylist(), rows.column(1).to_pylist(), window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Append ``n_words``, merged hit ``spans`` and occurring ``items`` to each row.

    Words are runs of ASCII letters and digits and non-ASCII characters with
    A-Z lower-cased. A window is ``window`` consecutive words of an item; an
    item of fewer words, but not none, is one window. Spans carry word and code
    point offsets, ends exclusive, and never touch.

    Null or empty text: 0 words, no spans. Benchmark rows without id or text
    are ignored; items sharing an id count as one. Repeated document rows each
    get their own result. Empty tables give empty results or no hits. Columns of
    ``docs`` called like an added one are replaced.
    """
    spark = docs.sparkSession
    out = docs.drop("n_words", "spans", "items")
    earlier: list[DataFrame] = []
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    for last, phrases in benchmark_blocks(benchmark, window):
        shared = spark.sparkContext.broadcast(phrases)
        del phrases
        if not last:
            hits = map_columns(out.select(F.col(text_col)), _late(shared, text_col, None), ADDED).where("size(spans) > 0")
            earlier.append(store(hits.select(digest.alias("digest"), "spans", "items").distinct(), "hits"))
            shared.destroy()
            continue
        old = None
        if earlier:
            key, old = free_name(out, "digest"), (free_name(out, "spans_before"), free_name(out, "items_before"))
            before = earlier[0]
            for more in earlier[1:]:
                before = before.union(more)
            merged = F.array_sort(F.flatten(F.collect_list("spans"))).alias(old[0]), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(old[1])
            before = before.groupBy(F.col("digest").alias(key)).agg(*merged)
            out = out.withColumn(key, digest).join(before, key, "left").drop(key)
        out = map_columns(out, _late(shared, text_col, old), ADDED)
        out = out.drop(*old) if old else out
    return out


def _late(shared, text_col: str, old: tuple[str, str] | None):
    return lambda batch: _search_batch(shared.value, text_col, old)(batch)


def free_marker(benchmark: DataFrame) -> str:
    """Ellipses that stand alone in no benchmark text: one more in a row than any text has."""
    runs = F.transform(F.regexp_extract_all("text", F.lit("(\u2026+)"), F.lit(1)), F.length)
    most = benchmark.agg(F.max(F.array_max(runs))).first()[0] or 0
    return " " + "\u2026" * (most + 1) + " "


def remove_spans(docs: DataFrame, text_col: str = "text", marker: str = " \u2026 ") -> DataFrame:
    """Put ``marker`` in place of each span that ``decontaminate`` found.

    The marker holds a word of its own, so the words on both sides of a cut can
    not make a window together where no benchmark item has that word; see
    ``free_marker``.
    """
    start = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("spans", lambda s: s["char_end"]))
    end = F.concat(F.transform("spans", lambda s: s["char_start"]), F.array(F.length(text_col).cast("bigint")))
    pieces = F.transform(F.arrays_zip(start.alias("s"), end.alias("e")), lambda p: F.substring(F.col(text_col), p["s"].cast("int") + 1, (p["e"] - p["s"]).cast("int")))
    return docs.withColumn(text_col, F.when(F.size("spans") > 0, F.array_join(pieces, marker)).otherwise(F.col(text_col)))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["word_end"] - s["word_start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), p AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase, least(10, len(w)) AS size
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM p),
g AS (
  SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), o AS (SELECT g.rid, g.i, g.size, p.item_id FROM g JOIN p USING (phrase, size)),
h AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS x FROM o) GROUP BY rid),
t AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
