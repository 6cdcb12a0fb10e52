"""N-gram Jaccard join (operator 6): T-occurrence search with DivideSkip.

1. One pass over the texts gives each document its number of shingles, a
   128-bit digest of its shingle set and its signature. Equal sets form a class
   at once, so exact copies never meet again.
2. Two linked sets of at most ``u`` shingles differ in at most ``d(u)`` of them.
   A signature deals the set by hash into ``d + c`` parts and keeps one hash of
   each part's content: linked sets agree in ``c`` parts or more. A part holds
   several shingles, so unrelated texts hardly ever agree in one, however large
   the corpus. Lists of a part are streamed in sorted order, long ones by several
   tasks, each of which has a range of the classes; those of one class go at once. A class with fewer shared parts than a link needs goes too, and of
   the others only the rarest parts stay that a link can not do without. Each
   class is joined to the first class (the leader) of its lists.
3. Every class is first searched in its largest group alone: an inverted index,
   a heap merge of the short lists, binary probes into the long ones, and a link
   where the overlap reaches the threshold. Sets that are already connected need
   no further check, so a task emits a spanning forest and never all pairs.
4. Only groups that still hold several components are searched again. Where one
   is larger than a block, its classes meet on the rarest shingles within the
   group by the same rule as in step 2, in tiles of two bounded blocks.
5. Components come from alternating stars over the forest.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import arrow, checkpoint, drop_stored, store, stored, table
from loomstone.llm.components import components
from loomstone.llm.words import NONSPACE, chunks, mix, shingles

BLOCK_DOCS = 1024  # classes searched in one task at once
BLOCK_SHINGLES = 500_000  # and their shingles
PILOTS = 8  # classes of a large group that go to every block
SPARE = 5  # a link keeps one part more than it must for each so many that may differ
MU = 0.0085  # DivideSkip's weight of a probe against a merge step

_META = "doc_id bigint, n int, fp1 bigint, fp2 bigint, keys array<bigint>, tags array<int>"
_TAG = 256  # a tag is the number of shared parts that a link needs, times this, plus the band of sizes


def size_bands(most: int) -> np.ndarray:
    """Largest sizes of the bands up to ``most``: each half as large again as the one before."""
    limits = [1]
    while limits[-1] < most:
        limits.append(max(limits[-1] + 1, limits[-1] * 3 // 2))
    return np.array(limits, dtype=np.int64)


def parts(limit: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts, parts that two linked sets of at most ``limit`` shingles agree in at least)."""
    differ = 2 * limit * (den - num) // (den + num)
    agree = 1 + differ // SPARE
    return differ + agree, agree


def digests(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, two 64-bit digests of the shingle set) of each row."""
    n = np.bincount(row, minlength=rows)
    fp = np.zeros((2, rows), dtype=np.uint64)
    some = np.flatnonzero(n)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    if len(some):
        with np.errstate(over="ignore"):
            for i, salt in enumerate((0x51ED270B7A2C91F3, 0xA24BAED4963EE407)):
                fp[i, some] = mix(np.add.reduceat(mix(h ^ np.uint64(salt)), first[some]) + n[some].astype(np.uint64))
    return n, fp


def part_keys(h: np.ndarray, row: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, tag) of the parts of each row, for every band in which the row can meet an equal or larger set.

    Empty parts agree too but have no content to meet on, so a row needs fewer
    agreeing parts by its empty ones; where that leaves none to ask for, its
    empty parts get keys as well.
    """
    limits = size_bands(int(n.max(initial=1)) * den // num + 1)
    count, agree = parts(limits, num, den)
    low, high = np.searchsorted(limits, n), np.searchsorted(limits, n * den // num)
    with np.errstate(over="ignore"):
        content = mix(h ^ np.uint64(0x2B7E151628AED2A6))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in range(int((high - low).max(initial=0)) + 1):
        band = np.minimum(low + step, len(limits) - 1)
        live = (low + step <= high) & (n > 0)
        size = np.where(live, count[band], 0)
        base = np.concatenate([[0], np.cumsum(size)])
        use = live[row]
        r = row[use]
        with np.errstate(over="ignore"):
            spread = mix(h[use] + band[r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            part = base[r] + ((spread * size[r].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            total = np.zeros(base[-1], dtype=np.uint64)
            np.add.at(total, part, content[use])
        filled = np.bincount(part, minlength=base[-1])
        owner = np.repeat(np.arange(len(n)), size)
        missing = np.bincount(owner[filled == 0], minlength=len(n))
        need = agree[band] - missing
        keep = (filled > 0) | (need < 1)[owner]
        own = owner[keep]
        with np.errstate(over="ignore"):
            place = (np.flatnonzero(keep) - base[own]).astype(np.uint64) * np.uint64(_TAG) + band[own].astype(np.uint64)
            key = mix(total[keep] ^ mix(place + np.uint64(1)))
        found.append((own, key, np.maximum(1, need)[own] * _TAG + band[own]))
    own, key, tag = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(own, kind="stable")
    return own[order], key[order], tag[order]


def _signatures(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # one signature for each set of a task is enough
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) if batch.num_rows else None
            for c in chunks(batch.column(1), NONSPACE):
                h, row, _ = shingles(c, k)
                n, fp = digests(h, row, c.rows)
                fresh = np.zeros(c.rows, dtype=bool)
                for i, x in enumerate(fp[0].tolist()):
                    if n[i] and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                use = fresh[row]
                own, key, tag = part_keys(h[use], row[use], np.where(fresh, n, 0), num, den)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=c.rows))]).astype(np.int32))
                columns = [pa.array(ids[c.first : c.first + c.rows]), pa.array(n.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in fp)]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(key.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(tag.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "fp1", "fp2", "keys", "tags"])

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (s, fp1, tag) sorted by s, fp1 -> (s, leader, fp1, tag) of every s that two or more classes have.

    The lists of the first and the last s may go on in other tasks: each gives a
    row without a class, too, and a class that is alone in one gives a row with
    its tag below zero.
    """
    last_s = last_fp = leader = held = None
    edges: dict[int, tuple[int, int, int]] = {}  # s -> its first class here, that class's tag and classes, two at most
    for batch in batches:
        s, fp, tag = (batch.column(i).to_numpy() for i in range(3))
        if held is not None:
            s, fp, tag = (np.append(a, b) for a, b in zip(held, (s, fp, tag), strict=True))
        if not len(s):
            continue
        fresh = np.ones(len(s), dtype=bool)
        fresh[1:] = (s[1:] != s[:-1]) | (fp[1:] != fp[:-1])
        fresh[0] = held is not None or s[0] != last_s or fp[0] != last_fp
        s, fp, tag = s[fresh], fp[fresh], tag[fresh]
        if not len(s):
            continue
        goes_on = held is None and s[0] == last_s
        begin = np.ones(len(s), dtype=bool)
        begin[1:] = s[1:] != s[:-1]
        begin[0] = not goes_on
        group = np.cumsum(begin) - (0 if goes_on else 1)
        size = np.bincount(group)
        heads = np.zeros(len(size), dtype=np.int64)
        heads[group[begin]] = fp[begin]
        real = size > 1
        if goes_on:
            heads[0], real[0] = leader, True
        if not edges:
            first_s, edges[int(s[0])] = int(s[0]), (int(fp[0]), int(tag[0]), 0)
        if int(s[0]) == first_s and real[0]:
            edges[first_s] = (*edges[first_s][:2], 2)
        last_s, last_fp, leader = int(s[-1]), int(fp[-1]), int(heads[-1])
        held = None if real[-1] else (s[-1:], fp[-1:], tag[-1:])
        use = real[group]
        if use.any():
            columns = [s[use].astype(np.int64), heads[group][use], fp[use].astype(np.int64), tag[use].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["s", "leader", "fp1", "tag"])
    if not edges:
        return
    if last_s != first_s:
        edges[last_s] = (leader, 0, 2) if held is None else (int(held[1][0]), int(held[2][0]), 0)
    rows = [(x, fp, None, 0) for x, (fp, _, _) in edges.items()] + [(x, fp, fp, -t) for x, (fp, t, several) in edges.items() if not several]
    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["s", "leader", "fp1", "tag"])


def _edged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_lists`` with a column that is false for lists that surely begin and end in this task."""
    for batch in _lists(batches):
        s, tag = batch.column(0).to_numpy(), batch.column(3).to_numpy()
        edge = (s == s[0]) | (s == s[-1]) | (tag <= 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edge)], names=[*batch.schema.names, "edge"])


def _meet(postings: DataFrame) -> DataFrame:
    """(leader, fp1) of the classes that can link, from postings (s, fp1, tag).

    A class keeps its shared keys, rarest first, but for as many of the most
    frequent as a link needs less one: two linked classes have their rarest common
    key among those that either keeps.
    """
    return _rarest(_shared(postings))


def _shared(postings: DataFrame) -> DataFrame:
    """The postings (s, fp1, tag) whose s two or more classes have, with the first of those as ``leader`` and their number as ``sets``.

    Ranges of (s, class) go to the tasks, so a list that many classes share is
    not one task's: it has a piece in each of several, named by its first class
    there. What is asked of a list is worked out from its pieces, and a posting
    meets its piece, once, so that no list comes together again. The
    result is stored, as several steps read it; what it was made from goes.
    """
    spark = postings.sparkSession
    since = stored(spark)
    lists = arrow(postings.repartitionByRange("s", "fp1").sortWithinPartitions("s", "fp1"), _lists, "s bigint, leader bigint, fp1 bigint, tag int")
    rows = store(lists.withColumnRenamed("leader", "piece"), "lists").where("fp1 is not null")
    whole = Window.partitionBy("s")
    pieces = rows.groupBy("s", "piece").agg(F.count("*").alias("sets"))
    pieces = pieces.withColumns({"leader": F.min("piece").over(whole), "sets": F.sum("sets").over(whole)}).where("sets > 1")
    shared = store(rows.join(pieces, ["s", "piece"]).select("s", "leader", "fp1", F.abs("tag").alias("tag"), "sets"), "shared")
    drop_stored(spark, since, but_last=1)
    return shared


def _rarest(lists: DataFrame) -> DataFrame:
    mine = Window.partitionBy("fp1", "tag")
    ranked = lists.select("leader", "fp1", "tag", F.count("*").over(mine).alias("shared"), F.row_number().over(mine.orderBy("sets", "s")).alias("rank"))
    return ranked.where(F.col("rank") <= F.col("shared") - F.floor(F.col("tag") / _TAG) + 1).select("leader", "fp1").distinct()


def merge_skip(lists: list[list[int]], need: int, least: int = 0) -> Iterator[tuple[int, int]]:
    """(element, count) of those from ``least`` on in at least ``need`` of the ascending lists.

    A heap holds the head of each list; where too few lists agree, the next
    ``need - 1`` heads are popped and their lists skip ahead by binary search.
    """
    w = len(lists)
    at = [bisect_left(x, least) for x in lists] if least else [0] * w
    heap = [x[at[i]] * w + i for i, x in enumerate(lists) if at[i] < len(x)]
    heapify(heap)
    while len(heap) >= need:
        top = heap[0] // w
        after, popped = (top + 1) * w, []
        while heap and heap[0] < after:
            popped.append(heappop(heap) % w)
        if len(popped) >= need:
            yield top, len(popped)
            for i in popped:
                at[i] += 1
                if at[i] < len(lists[i]):
                    heappush(heap, lists[i][at[i]] * w + i)
            continue
        while heap and len(popped) < need - 1:
            popped.append(heappop(heap) % w)
        if not heap:
            return
        target = heap[0] // w
        for i in popped:
            at[i] = bisect_left(lists[i], target, at[i])
            if at[i] < len(lists[i]):
                heappush(heap, lists[i][at[i]] * w + i)


class _Group:
    """Sets by ascending size, their components, and two inverted indexes.

    One index holds the sets of the largest component, the other all the rest. A
    set that is linked into the largest component needs no second link there.
    """

    def __init__(self, size: list[int], labels: list[int], num: int, den: int):
        self.size, self.num, self.den = size, num, den
        first: dict[int, int] = {}
        self.parent = [first.setdefault(x, i) for i, x in enumerate(labels)]
        often = Counter(labels).most_common(1)
        self.main = first[often[0][0]] if often and often[0][1] > 1 else None
        self.lists: tuple[dict, dict] = ({}, {})  # of the largest component, of the rest
        self.rest: dict[int, list[tuple[int, list[int]]]] = {}  # sets of the other components

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def largest(self, r: int, shared: int) -> int:
        """The largest set that r can link with, if others have but ``shared`` of its shingles."""
        return shared * (self.num + self.den) // self.num - self.size[r]

    def linked(self, r: int, tokens: list[int], which: int) -> Iterator[int]:
        """Earlier sets of an index that link with set r, by DivideSkip."""
        index, n = self.lists[which], self.size[r]
        need = -((-self.num * n) // self.den)
        most = self.largest(r, len(tokens))
        if most < need:
            return
        lists = [x for t in tokens if (x := index.get(t))]
        if len(lists) < need:
            return
        lists.sort(key=len)
        long = min(need - 1, int(need / (MU * math.log2(len(lists[-1]) + 1) + 1)))
        short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
        for other, hits in merge_skip(short, need - long, bisect_left(self.size, need)):
            if self.size[other] > most:
                return
            if which and self.find(other) == self.find(r):
                continue
            enough = -((-self.num * (n + self.size[other])) // (self.num + self.den))
            left = long
            for x in probed:
                if hits + left < enough:
                    break
                j = bisect_left(x, other)
                hits += j < len(x) and x[j] == other
                left -= 1
            if hits >= enough:
                yield other

    def place(self, r: int, tokens: list[int]) -> list[tuple[int, int]]:
        """Link set r with the sets before it and take it into an index."""
        links = []
        if self.main is not None and self.find(r) != self.find(self.main):
            other = next(self.linked(r, tokens, 0), None)
            if other is not None:
                links.append((r, other))
                self.join(r, other)
        for other in list(self.linked(r, tokens, 1)):
            if self.find(other) != self.find(r):
                links.append((r, other))
                self.join(r, other)
        if self.main is None and links:
            self.main = r
        if self.largest(r, len(tokens)) < self.size[r]:  # no larger set can link with it
            return links
        home = self.find(r)
        if self.main is not None and home == self.find(self.main):
            for one, its in self.rest.pop(home, []):
                for t in its:
                    x = self.lists[1][t]
                    del x[bisect_left(x, one)]
                    insort(self.lists[0].setdefault(t, []), one)
            which = 0
        else:
            self.rest.setdefault(home, []).append((r, tokens))
            which = 1
        index = self.lists[which]
        for t in tokens:
            index.setdefault(t, []).append(r)
        return links

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[a] = b
        if moved := self.rest.pop(a, None):
            self.rest.setdefault(b, []).extend(moved)


def search_group(values: np.ndarray, bounds: np.ndarray, labels: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect the sets of a group, as pairs of positions.

    Set i is ``values[bounds[i]:bounds[i + 1]]``, distinct. Sets with equal
    labels count as connected. Every pair that links is connected afterwards.
    """
    size = np.diff(bounds)
    order = np.argsort(size, kind="stable")
    token, df = np.unique(values, return_inverse=True, return_counts=True)[1:]
    several = df[token] > 1
    group = _Group(size[order].tolist(), labels[order].tolist(), num, den)
    links = []
    for r, i in enumerate(order.tolist()):
        mine = token[bounds[i] : bounds[i + 1]][several[bounds[i] : bounds[i + 1]]]
        if len(mine) and den * len(mine) >= num * int(size[i]):  # fewer shared shingles than any link needs
            links += [(i, int(order[other])) for _, other in group.place(r, mine.tolist())]
    return links


def _search_sorted(k: int, num: int, den: int):
    """Rows (gkey, fp1, label, text) sorted by gkey -> links (u, v) of classes."""

    def flush(held: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        ids = np.array(list(held), dtype=np.int64)
        sets = [x[1] for x in held.values()]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        links = search_group(np.concatenate(sets), bounds, np.array([x[0] for x in held.values()], dtype=np.int64), num, den)
        if not links:
            return None
        a = np.array(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[a[:, 0]]), pa.array(ids[a[:, 1]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            keys, classes, label = (batch.column(i).to_pylist() for i in range(3))
            for c in chunks(batch.column(3), NONSPACE):
                h, row, _ = shingles(c, k)
                n, fp = digests(h, row, c.rows)
                bounds = np.concatenate([[0], np.cumsum(n)])
                for i, digest in enumerate(fp[0].view(np.int64).tolist()):
                    j = c.first + i
                    if keys[j] != now:
                        if (out := flush(held)) is not None:
                            yield out
                        now, held = keys[j], {}
                    if digest == classes[j] and digest not in held:  # an id may come with several texts
                        held[digest] = (label[j], h[bounds[i] : bounds[i + 1]].copy())
        if (out := flush(held)) is not None:
            yield out

    return run


def _links(rows: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Search each gkey of ``rows`` (gkey, doc_id, fp1, label) over the texts."""
    full = rows.join(texts, "doc_id").select("gkey", "fp1", "label", "text")
    return arrow(full.repartition("gkey").sortWithinPartitions("gkey"), _search_sorted(k, num, den), "u bigint, v bigint")


def _blocks(kinds: float = 1) -> Column:
    """Blocks that a group's classes need, ``kinds`` of them at once in a task."""
    return F.greatest(F.ceil(F.count("*") * kinds / BLOCK_DOCS), F.ceil(F.sum("n") * kinds / BLOCK_SHINGLES)).cast("int")


def _open(named: DataFrame) -> DataFrame:
    """Rows (leader, fp1, label, ...) of groups with more than one component, with the largest one's name."""
    main = named.groupBy("leader", "label").count().groupBy("leader").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("kinds"))
    return named.join(main.where("kinds > 1"), "leader").drop("kinds")


def _again(members: DataFrame, cells: DataFrame, found: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """Links inside groups that hold several components and were not searched whole."""
    named = members.join(found, members["fp1"] == found["node"], "left").select("leader", "doc_id", "fp1", "n", F.coalesce("component", "fp1").alias("label"))
    # all that is asked of a group comes from one grouping, so its members meet it once
    each = named.join(cells, "fp1").groupBy("leader", "label").agg(F.min("cell").alias("a"), F.max("cell").alias("b"), F.count("cell").alias("in_one"), F.count("*").alias("count"), F.sum("n").alias("n"))
    group = each.groupBy("leader").agg(
        F.max_by("label", F.struct("count", "label")).alias("main"),
        *[F.min("a").alias("a"), F.max("b").alias("b"), F.sum("in_one").alias("in_one"), F.count("*").alias("kinds")],
        F.greatest(F.ceil(F.sum("count") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        F.sum("count").alias("count"),
    )
    group = group.where("kinds > 1 and (a <> b or in_one < count)").select("leader", "main", "blocks", "count")
    named = checkpoint(named.join(group, "leader"))
    # a group whose classes all have one larger group in common is searched as a part of that
    whole = named.groupBy("fp1").agg(F.max_by("leader", F.struct("count", "leader")).alias("whole"))
    part = named.select("leader", "fp1").join(whole, "fp1").groupBy("leader").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a = b and a <> leader").select("leader")
    named = checkpoint(named.join(part, "leader", "left_anti"))
    large = named.where("blocks > 1")
    rows = named.where("blocks = 1").select(F.xxhash64("leader").alias("gkey"), "doc_id", "fp1", "label")
    if large.limit(1).count():
        keyed = large.select("leader", "doc_id", "fp1", "n", "label", F.xxhash64("leader", "fp1").alias("key"))
        postings = arrow(keyed.join(texts, "doc_id").select("leader", "key", "fp1", "text"), _all_shingles(k, num, den), "s bigint, fp1 bigint, tag int")
        lists = _shared(postings)
        # a set of n of whose shingles others have but s links with none of over s (num + den) / num - n
        shared = lists.groupBy(F.col("fp1").alias("key")).agg(F.count("*").alias("shared"))
        able = keyed.join(shared, "key").withColumns({"least": F.expr(f"(n * {num} + {den - 1}) div {den}"), "most": F.expr(f"shared * {num + den} div {num} - n")})
        able = checkpoint(able)
        there = able.groupBy("leader").agg(F.collect_set("n").alias("sizes"))
        able = able.join(there, "leader").where(F.exists("sizes", lambda x: (x >= F.col("least")) & (x <= F.col("most"))))
        able = checkpoint(_open(able.select("leader", "doc_id", "fp1", "n", "label", "key")).drop("main"))
        # frequencies are those in the whole group: any one order of the keys will do
        near = _rarest(lists).withColumnsRenamed({"leader": "rarest", "fp1": "key"})
        near = checkpoint(able.join(near, "key").select(F.col("rarest").alias("leader"), "doc_id", "fp1", "n", "label"))
        rows = rows.union(_tiles(checkpoint(_open(near))))
    elif not rows.limit(1).count():
        return None
    return _links(rows, texts, k, num, den)


def _tiles(named: DataFrame) -> DataFrame:
    """(leader, doc_id, fp1, label, main, n) -> rows (gkey, doc_id, fp1, label) in which any two sets of a leader whose labels differ meet.

    The largest component and the others are dealt into blocks of half a task
    each. A tile holds a block of either, or two blocks of others; sets of the
    largest component need not meet each other.
    """
    sides = named.withColumn("side", F.col("label") == F.col("main"))
    sizes = sides.groupBy("leader", "side").agg(_blocks(2).alias("blocks")).groupBy("leader")
    sizes = sizes.agg(F.max(F.when(F.col("side"), F.col("blocks"))).alias("mains"), F.max(F.when(~F.col("side"), F.col("blocks"))).alias("others"))
    pair = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    mine = F.transform(_all_blocks("others"), lambda j: pair("main", F.col("own"), j))
    theirs = F.transform(_all_blocks("mains"), lambda i: pair("main", i, F.col("own")))
    among = F.transform(F.filter(_all_blocks("others"), lambda j: j != F.col("own")), lambda j: pair("others", F.least(j, F.col("own")), F.greatest(j, F.col("own"))))
    sides = sides.join(sizes, "leader").withColumn("blocks", F.when(F.col("side"), F.col("mains")).otherwise(F.col("others"))).withColumn("own", _own_block())
    sides = sides.select("leader", "doc_id", "fp1", "label", F.explode(F.when(F.col("side"), mine).otherwise(F.concat(theirs, among))).alias("tile"))
    return sides.select(F.xxhash64("leader", "tile.kind", "tile.a", "tile.b").alias("gkey"), "doc_id", "fp1", "label")


def _own_block() -> Column:
    return F.pmod(F.xxhash64("fp1", "leader"), F.col("blocks")).cast("int")


def _all_blocks(count: str = "blocks") -> Column:
    return F.sequence(F.lit(0), F.col(count) - 1)


def _all_shingles(k: int, num: int, den: int):
    """Rows (leader, key, fp1, text) -> (shingle within the leader, key, tag) of the texts of class fp1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leader, key, wanted = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1, 2))
            for c in chunks(batch.column(3), NONSPACE):
                h, row, _ = shingles(c, k)
                n, fp = digests(h, row, c.rows)
                use = (fp[0].view(np.int64) == wanted[c.first : c.first + c.rows])[row]
                h, row = h[use], row[use]
                at = row + c.first
                with np.errstate(over="ignore"):
                    s = mix(h ^ mix(leader[at].view(np.uint64)))
                tag = (-((-n * num) // den) * _TAG)[row]
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(key[at]), pa.array(tag.astype(np.int32))], names=["s", "fp1", "tag"])

    return run


def ngram_join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``.

    Words are runs of anything but ASCII white space with A-Z lower-cased. The
    set of a document holds its distinct ``k``-word shingles, or its whole
    sequence where it has fewer words. Two documents link where
    ``den * |intersection| >= num * |union|``; shingles are compared by 64-bit
    hashes. ``component_id`` is the smallest id reachable by links.

    Null and empty texts, and texts without words, have no shingles and link
    with nothing. Rows sharing an id count as one document for reachability,
    whatever their texts, and keep their own ``n_shingles``. A row with a null
    id links with nothing and gets a null component. Other columns are ignored.
    Empty tables give none.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = plain.where("doc_id is not null")
    meta = store(arrow(known, _signatures(k, num, den), T._parse_datatype_string(_META)), "signatures")
    classes = checkpoint(meta.where("n > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")))
    postings = meta.where("size(keys) > 0").select("fp1", F.explode(F.arrays_zip("keys", "tags")).alias("p")).select(F.col("p.keys").alias("s"), "fp1", F.col("p.tags").alias("tag"))
    members = _meet(postings).join(classes, "fp1").select("leader", F.col("rep").alias("doc_id"), "fp1", "n")
    members = checkpoint(members)
    # from here on only the texts of classes that may link move
    texts = store(known.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "suspects")
    sizes = members.groupBy("leader").agg(F.count("*").alias("count"))
    home = checkpoint(members.join(sizes, "leader").groupBy("fp1", "doc_id", "n").agg(F.max_by("leader", F.struct("count", "leader")).alias("leader")))
    homes = home.groupBy("leader").agg(_blocks().alias("blocks"), F.count("*").alias("count")).where("count > 1")
    home = checkpoint(home.join(homes, "leader").withColumn("own", _own_block()))
    pilot = F.pmod(F.xxhash64("fp1"), F.greatest(F.lit(1), F.floor(F.col("count") / PILOTS))) == 0
    keyed = home.select("leader", "doc_id", "fp1", F.explode(F.when(pilot, _all_blocks()).otherwise(F.array("own"))).alias("block"))
    first = keyed.select(F.xxhash64("leader", "block").alias("gkey"), "doc_id", "fp1", F.col("fp1").alias("label"))
    edges = checkpoint(_links(first, texts, k, num, den).distinct())
    found = components(edges)
    cells = members.select("fp1").distinct().join(home.select("fp1", F.xxhash64("leader", "own").alias("cell")), "fp1", "left")
    again = _again(members, cells, found, texts, k, num, den)
    edges = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    # rows that share an id are one document: their classes hang together
    twins = meta.where("n > 0").groupBy("doc_id").agg(F.min("fp1").alias("u"), F.max("fp1").alias("v")).where("u < v").select("doc_id", "u")
    edges = edges.union(meta.where("n > 0").join(twins, "doc_id").where("fp1 <> u").select("u", F.col("fp1").alias("v")).distinct())
    found = components(edges if again is None else edges.union(again))
    linked = classes.join(found, classes["fp1"] == found["node"]).select("fp1", "component", "rep")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").select("fp1", "least").distinct()
    named = checkpoint(classes.join(linked, "fp1", "left").select("fp1", "fp2", F.coalesce("least", "rep").alias("component")))
    out = meta.select("doc_id", "n", "fp1", "fp2").join(named, ["fp1", "fp2"], "left")
    out = out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    nameless = plain.where("doc_id is null")
    if nameless.limit(1).count():
        lone = arrow(nameless.select(F.lit(0).cast("bigint").alias("doc_id"), "text"), _signatures(k, num, den), T._parse_datatype_string(_META))
        out = out.union(lone.select(F.lit(None).cast("bigint"), F.col("n").cast("bigint"), F.lit(None).cast("bigint")))
    return out


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(3, len(w)) - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 90 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)
GROUP BY d.doc_id
"""
