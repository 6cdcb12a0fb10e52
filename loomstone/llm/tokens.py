"""Token counts (operator 9): a linear longest-match automaton.

The vocabulary becomes a trie with failure links; each link carries how many
tokens are popped when it is taken, so greedy longest-match piece counts come
out of one walk over a word, with no pieces built and nothing read twice. The
automaton walks all distinct words of a chunk together, a byte at a time; once
few are left, such as the long ones of scripts without spaces, each goes on alone
over a table of edges, which costs nothing for the words that have ended.

Words are runs of letters (ASCII letters and any non-ASCII character), single
ASCII digits, and runs of other ASCII characters but white space; A-Z are
lower-cased. Word-end forms of the vocabulary count as plain strings, so a
piece may stand anywhere in a word.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomstone.llm.common import map_columns, table
from loomstone.llm.words import FOLD, chunks, mix

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"

FEW = 96  # words that are left when each goes on alone

_CLASS = np.full(256, 3, dtype=np.uint8)  # 0 white space, 1 letter, 2 digit, 3 other
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_CLASS[0x30:0x3A] = 2
_ANY = _CLASS > 0


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary as bytes, without word-end marks."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    # byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}
    pieces = []
    for name in names:
        if name.startswith("<|"):
            continue
        body = name.removesuffix("</w>")
        if body and all(c in byte for c in body):
            pieces.append(tuple(byte[c] for c in body))
    return sorted(set(pieces))


@lru_cache(maxsize=2)
def automaton_of(path: str) -> LongestMatch:
    return LongestMatch(read_vocabulary(path))


class LongestMatch:
    """Trie, failure links and popped counts, as arrays."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        child: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            v = 0
            for c in piece:
                if c not in child[v]:
                    child[v][c] = len(child)
                    child.append({})
                    final.append(False)
                v = child[v][c]
            final[v] = True
        fail, pops = [-1] * len(child), [0] * len(child)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in child[u].items():
                queue.append(v)
                if final[v]:
                    fail[v], pops[v] = 0, 1
                    continue
                z, n = fail[u], pops[u]
                while z >= 0 and c not in child[z]:
                    n += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = child[z][c], n
        edges = sorted((u * 256 + c, v) for u, cs in enumerate(child) for c, v in cs.items())
        self.key = np.array([e[0] for e in edges], dtype=np.int64)
        self.to = np.array([e[1] for e in edges], dtype=np.int32)
        self.fail, self.pops = np.array(fail, dtype=np.int32), np.array(pops, dtype=np.int32)
        self.root = np.full(256, -1, dtype=np.int32)
        for c, v in child[0].items():
            self.root[c] = v

    def _step(self, state: np.ndarray, symbol: np.ndarray, count: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Move the live words on by one symbol each; those that cannot go on leave with count -1."""
        go = live
        while len(go):
            s, c = state[go], symbol[go]
            key = s.astype(np.int64) * 256 + c
            at = np.searchsorted(self.key, key)
            at[at == len(self.key)] = 0
            found = np.where(s == 0, self.root[c], np.where(self.key[at] == key, self.to[at], -1))
            ok = found >= 0
            state[go[ok]] = found[ok]
            go = go[~ok]
            stuck = self.fail[state[go]] < 0
            count[go[stuck]] = -1
            go = go[~stuck]
            count[go] += self.pops[state[go]]
            state[go] = self.fail[state[go]]
        return live[count[live] >= 0]

    def _tables(self) -> tuple[dict[int, int], list[int], list[int]]:
        """Edges by state and byte, failure links and popped counts, made once a process."""
        if not hasattr(self, "_plain"):
            self._plain = dict(zip(self.key.tolist(), self.to.tolist(), strict=True)), self.fail.tolist(), self.pops.tolist()
        return self._plain

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_plain"}

    def _walk(self, word: bytes, state: int, count: int) -> tuple[int, int]:
        """Move one word on to its end; count -1 where it cannot go on."""
        edges, fail, pops = self._tables()
        for c in word:
            to = edges.get(state << 8 | c)
            while to is None:
                if fail[state] < 0:
                    return state, -1
                count += pops[state]
                state = fail[state]
                to = edges.get(state << 8 | c)
            state = to
        return state, count

    def count(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Pieces of each word; a word that the vocabulary cannot spell counts as one unknown."""
        n = len(start)
        state, count = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64)
        symbol = np.zeros(n, dtype=np.int64)
        live = np.argsort(-size, kind="stable")
        step = 0
        while len(live := live[size[live] > step]) > FEW:
            symbol[live] = data[start[live] + step]
            live = self._step(state, symbol, count, live)
            step += 1
        for i in live.tolist():
            state[i], count[i] = self._walk(data[start[i] + step : start[i] + size[i]].tobytes(), int(state[i]), int(count[i]))
        rest = np.flatnonzero((count >= 0) & (state > 0))  # pop what is left at the word's end
        while len(rest):
            lost = self.fail[state[rest]] < 0
            count[rest[lost]] = -1
            rest = rest[~lost]
            count[rest] += self.pops[state[rest]]
            state[rest] = self.fail[state[rest]]
            rest = rest[state[rest] > 0]
        return np.where(count < 0, 1, count)


def words_of(data: np.ndarray, row_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in folded bytes; none runs over a row's end."""
    kind = _CLASS[data]
    fresh = np.ones(len(data) + 1, dtype=bool)
    fresh[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    fresh[row_start] = True
    at = np.flatnonzero(fresh)
    start, end = at[:-1], at[1:]
    some = kind[start] > 0
    return start[some], end[some]


def count_tokens(texts: pa.Array, automaton: LongestMatch) -> np.ndarray:
    """Tokens of each text of a column; null counts as empty."""
    out = np.zeros(len(texts), dtype=np.int64)
    for c in chunks(texts, _ANY, hashed=False):
        if not len(c.data):
            continue
        start, end = words_of(c.data, c.row_start)
        h = _word_hash(c.data, start, end)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        pieces = automaton.count(c.data, start[first], (end - start)[first])[inverse]
        total = np.zeros(len(start) + 1, dtype=np.int64)
        np.cumsum(pieces, out=total[1:])
        at = np.searchsorted(start, c.row_start)
        out[c.first : c.first + c.rows] = total[at[1:]] - total[at[:-1]]
    return out


def _word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    from loomstone.llm.words import _BYTE, _pow

    up, down = _pow(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, into: str = "n_tokens") -> DataFrame:
    """Append ``into``, the number of greedy longest-match tokens of each whole text.

    Null and empty texts have 0. The vocabulary (a fixed file of some megabytes;
    by default the session's ``spark.loomstone.vocabulary``, else ``VOCABULARY``)
    is read on the driver and broadcast as arrays. A column called ``into`` is
    replaced; every row is kept, and repeated rows count alike.
    """
    vocabulary = vocabulary or docs.sparkSession.conf.get("spark.loomstone.vocabulary", VOCABULARY)
    shared = docs.sparkSession.sparkContext.broadcast(automaton_of(vocabulary))
    return map_columns(docs, lambda b: {into: pa.array(count_tokens(b.column(text_col), shared.value))}, f"{into} bigint")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


__all__ = ["FOLD", "LongestMatch", "count_tokens", "op9_tokens", "read_vocabulary", "token_counts", "words_of"]
