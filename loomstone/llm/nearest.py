"""Approximate nearest neighbours (operator 1): a block matrix join.

Vectors are quantised once to int8 codes, their residuals to int16 codes, with a
scale and a residual norm of each, and packed into blocks. Query blocks meet
candidate blocks in tiles; a tile's int8 product matrix gives every inner product
up to a bound that follows from the residuals. Pairs whose upper bound reaches
the query's k-th best lower bound are computed again in the tile with the
residuals' codes, which makes the bound some 65,000 times tighter: near copies,
all of which the int8 bounds leave open, are told apart there. What still reaches
the k-th lower bound survives the tile, then the merge of all tiles; only these
pairs are recomputed in double precision from the original vectors, so the answer
is exact: recall is 1. Heaps merge the tiles' bounds and the recomputed scores.

Only codes travel to the tiles (three bytes a component, and 48 bytes a vector);
originals are joined to the survivors alone. Tiles are keyed by (group of query
blocks, group of candidate blocks). A tile holds the codes of one query group and
at most ``HELD`` k pairs a query; candidates stream past, and pairs beyond that
leave the tile early, to be cut by the merge. So its memory is bounded whatever
the tables' sizes are and however alike the vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm.common import arrow, store, table

K = 20
BLOCK = 1024  # vectors in one packed row, and on either side of one product
QUERY_GROUP = 64 * BLOCK  # queries whose codes a tile holds
TILE_PAIRS = 1 << 33  # pairs of a tile
HELD = 8  # times k pairs a query that a tile holds
GATHERED = 1 << 21  # components of pairs that are computed at once, one by one
ROUNDING = 1e-12  # of the norms' product: more than double sums of up to 4,000 products are off

_CODED = "dim bigint, ids binary, codes binary, finer binary, measures binary"
_BOUNDS = "query_id bigint, vec_id bigint, low double, high double"


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _coded(x: np.ndarray, top: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of up to ``top``, their scales and what they say."""
    scale = np.abs(x).max(axis=1) / top
    scale[scale == 0] = np.finfo(np.float64).tiny
    codes = np.rint(x / scale[:, None]).astype(kind)
    return codes, scale, codes * scale[:, None]


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, int16 codes of the residuals, and the rows of measures that ``Block`` names."""
    codes, scale, back = _coded(x, 127, np.int8)
    finer, step, more = _coded(x - back, 32767, np.int16)
    norm = np.linalg.norm
    return codes, finer, np.stack([scale, norm(back, axis=1), norm(x - back, axis=1), step, norm(x - (back + more), axis=1)])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) -> rows (dim, ids, codes, finer, measures) of up to ``BLOCK`` vectors each."""
    held: dict[int, list] = {}

    def row(dim: int, n: int) -> pa.RecordBatch:
        ids, xs = (np.concatenate([x[i] for x in held[dim]]) for i in (0, 1))
        held[dim] = [(ids[n:], xs[n:])]
        columns = [x.tobytes() for x in (ids[:n], *_quantised(xs[:n]))]
        return pa.RecordBatch.from_arrays([pa.array([dim]), *(pa.array([x]) for x in columns)], names=["dim", "ids", "codes", "finer", "measures"])

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        lists = batch.column(1)
        dims = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(dims)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            held.setdefault(dim, []).append((ids[rows], flat[(ends[rows] - dim)[:, None] + np.arange(dim)[None, :]]))
            while sum(len(x[0]) for x in held[dim]) >= BLOCK:
                yield row(dim, BLOCK)
    for dim in list(held):
        if n := sum(len(x[0]) for x in held[dim]):
            yield row(dim, n)


class Block:
    """Coded vectors: ids, codes and their scales, norms and residual norms; finer codes of the residuals, their steps and what these leave."""

    def __init__(self, ids: bytes, codes: bytes, finer: bytes, measures: bytes):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        codes = np.frombuffer(codes, dtype=np.int8).reshape(len(self.ids), -1)
        # a kind that holds every sum of int8 products exactly
        self.codes = codes.astype(np.float32 if codes.shape[1] * 127 * 127 < 1 << 24 else np.float64)
        self.finer = np.frombuffer(finer, dtype=np.int16).reshape(codes.shape)
        self.scale, self.norm, self.rest, self.step, self.left = np.frombuffer(measures, dtype=np.float64).reshape(5, -1)
        self.size = self.norm + self.rest + self.left  # no smaller than the vector's norm and that of its codes

    def said(self, rows: np.ndarray) -> np.ndarray:
        """The vectors that both codes give."""
        return self.codes[rows].astype(np.float64) * self.scale[rows, None] + self.finer[rows] * self.step[rows, None]


class QueryBlock(Block):
    """Queries of a tile with the k best lower bounds of each so far, and the pairs that reach them."""

    def __init__(self, ids: bytes, codes: bytes, finer: bytes, measures: bytes, k: int):
        super().__init__(ids, codes, finer, measures)
        self.best = np.full((len(self.ids), k), -np.inf)
        self.pairs: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def meet(self, c: Block) -> pa.RecordBatch | None:
        """Hold the block's pairs that may be among the k best; pairs beyond ``HELD`` k a query are returned instead."""
        about = (self.codes @ c.codes.T).astype(np.float64) * self.scale[:, None] * c.scale[None, :]
        slack = (self.rest[:, None] * (c.norm + c.rest)[None, :] + self.norm[:, None] * c.rest[None, :]) * (1 + 1e-9) + ROUNDING * self.size[:, None] * c.size[None, :]
        about[self.ids[:, None] == c.ids[None, :]] = -np.inf
        high = about + slack
        k = self.best.shape[1]
        row, col = np.nonzero((high >= self.best.min(axis=1)[:, None]) & (about > -np.inf))
        if len(row) > self.best.size:  # the block's own lower bounds tell, too
            bar = self._risen(about - slack).min(axis=1)
            row, col = np.nonzero((high >= bar[:, None]) & (about > -np.inf))
        if not len(row):
            return None
        low, high = self._again(c, row, col)
        rows, r = np.unique(row, return_inverse=True)
        cols, j = np.unique(col, return_inverse=True)
        lows = np.full((len(rows), len(cols)), -np.inf)
        lows[r, j] = low
        self.best[rows] = np.partition(np.concatenate([self.best[rows], lows], axis=1), len(cols), axis=1)[:, len(cols) :]
        keep = high >= self.best.min(axis=1)[row]
        self.pairs.append((row[keep], c.ids[col[keep]], low[keep], high[keep]))
        self.held += int(keep.sum())
        if self.held > HELD * self.best.size:
            self.prune()
            if self.held > HELD // 2 * self.best.size:
                return self.survivors()
        return None

    def _risen(self, low: np.ndarray) -> np.ndarray:
        return np.partition(np.concatenate([self.best, low], axis=1), low.shape[1], axis=1)[:, low.shape[1] :]

    def _again(self, c: Block, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of some pairs by both codes: one product of matrices where they are many, else pair by pair."""
        rows, r = np.unique(row, return_inverse=True)
        cols, j = np.unique(col, return_inverse=True)
        mine, theirs = self.said(rows), c.said(cols)
        if 16 * len(row) > len(rows) * len(cols):
            about = (mine @ theirs.T)[r, j]
        else:
            about = np.empty(len(row))
            step = max(1, GATHERED // mine.shape[1])
            for i in range(0, len(row), step):
                about[i : i + step] = np.einsum("ij,ij->i", mine[r[i : i + step]], theirs[j[i : i + step]])
        slack = (self.left[row] * c.size[col] + self.size[row] * c.left[col]) * (1 + 1e-9) + ROUNDING * self.size[row] * c.size[col]
        return about - slack, about + slack

    def prune(self) -> None:
        row, vec, low, high = (np.concatenate([p[i] for p in self.pairs]) for i in range(4))
        keep = high >= self.best.min(axis=1)[row]
        self.pairs = [(row[keep], vec[keep], low[keep], high[keep])]
        self.held = int(keep.sum())

    def survivors(self) -> pa.RecordBatch | None:
        """The pairs that are held, which are held no longer."""
        if not self.pairs:
            return None
        self.prune()
        (row, vec, low, high), self.pairs, self.held = self.pairs[0], [], 0
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(vec), pa.array(low), pa.array(high)], names=["query_id", "vec_id", "low", "high"])


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (tile, side, ids, codes, finer, measures), a tile's queries before its candidates -> pairs that may be among the k best."""
        now, queries = None, []
        for batch in batches:
            for tile, side, *packed in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if tile != now:
                    yield from (out for q in queries if (out := q.survivors()) is not None)
                    now, queries = tile, []
                if side == 0:
                    queries.append(QueryBlock(*packed, k))
                else:
                    candidates = Block(*packed)
                    yield from (out for q in queries if (out := q.meet(candidates)) is not None)
        yield from (out for q in queries if (out := q.survivors()) is not None)

    return run


def _cut(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by query and falling upper bound -> those that may be among the query's k best of all tiles."""
        now, heap = None, []
        for batch in batches:
            keep = []
            for i, (query, low, high) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 2, 3)), strict=True)):
                if query != now:
                    now, heap = query, []
                if len(heap) < k:
                    heapq.heappush(heap, low)
                elif high < heap[0]:
                    continue
                elif low > heap[0]:
                    heapq.heapreplace(heap, low)
                keep.append(i)
            if keep:
                yield batch.take(pa.array(keep)).select([0, 1])

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by query -> the k best of each query with their ranks."""
        now, heap = None, []

        def ranked() -> list[tuple]:
            return [(now, i + 1, -v, s) for i, (s, v) in enumerate(sorted(heap, key=lambda x: (-x[0], -x[1])))]

        for batch in batches:
            rows = []
            for query, vec, score in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if query != now:
                    rows += ranked()
                    now, heap = query, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))
            yield _ranked_batch(rows)
        if heap:
            yield _ranked_batch(ranked())

    return run


def _ranked_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest by inner product.

    Queries are the rows where ``is_query`` holds, candidates all other rows
    than the query's own. Ties go to the smaller id. Vectors that are null,
    empty or zero, or hold a null or non-finite component, and rows with a null
    id take no part; vectors meet only those of their own length. Rows that
    share an id count once, with the smallest of their usable vectors. Other
    columns are ignored; empty tables give no rows.
    """
    spark = vectors.sparkSession
    plain = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    plain = store(plain.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(vector_col).alias("v"), F.max(is_query).alias("q")), "vectors")
    n, total = plain.agg(F.count_if("q"), F.count("*")).first()
    q_groups = -(-max(1, n) // QUERY_GROUP)
    c_groups = max(-(-total * -(-max(1, n) // q_groups) // TILE_PAIRS), min(spark.sparkContext.defaultParallelism, total // (4 * BLOCK)), 1)
    deal = lambda groups: F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")
    each = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    # of equal vectors only the k smallest ids, besides the query's own, can be among any query's k
    digests = [F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2")]
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    last = plain.select("id", *digests).withColumn("place", place).where(F.col("place") <= k + 1).where(F.col("place") == k + 1).select("h1", "h2", F.col("id").alias("last"))
    some = plain.select("id", "v", *digests).join(last, ["h1", "h2"], "left").where("last is null or id <= last").select("id", "v")
    left = arrow(plain.where("q").select("id", "v"), _pack, _CODED).withColumn("qg", deal(q_groups)).withColumn("cg", each(c_groups)).withColumn("side", F.lit(0))
    right = arrow(some, _pack, _CODED).withColumn("cg", deal(c_groups)).withColumn("qg", each(q_groups)).withColumn("side", F.lit(1))
    tiles = left.unionByName(right).select(F.xxhash64("dim", "qg", "cg").alias("tile"), "side", "ids", "codes", "finer", "measures")
    found = arrow(tiles.repartition("tile").sortWithinPartitions("tile", "side"), _tiles(k), _BOUNDS)
    pairs = store(arrow(found.repartition("query_id").sortWithinPartitions("query_id", F.desc("high")), _cut(k), "query_id bigint, vec_id bigint"), "pairs")
    original = lambda rows, id_, v: rows.select(F.col("id").alias(id_), F.col("v").alias(v))
    scored = pairs.join(original(plain, "vec_id", "c"), "vec_id").join(original(plain.where("q"), "query_id", "q"), "query_id")
    product = F.aggregate(F.zip_with("q", "c", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)  # from the first component on
    best = scored.select("query_id", "vec_id", product.alias("score")).repartition("query_id").sortWithinPartitions("query_id")
    return arrow(best, _merge(k), "query_id bigint, rank int, vec_id bigint, score double")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


OP1_SQL = """
WITH e AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) AS score
  FROM e AS q JOIN e AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
