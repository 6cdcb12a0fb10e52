"""Vectorised tokenising and hashing of whole text columns.

Everything works on the UTF-8 bytes of an Arrow string column at once, so a
batch of documents costs a few numpy passes and no per-word Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # bytes of text handled at once; one longer text makes its own chunk

_M = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_M_INV = np.uint64(pow(int(_M), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: runs of ASCII letters, digits and any non-ASCII characters
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: runs of anything but ASCII white space
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _M), ("down", _M_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0x7FB5D329728EA185)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


@dataclass
class Chunk:
    """Some consecutive rows of a text column, cut into words."""

    first: int  # row of the column
    rows: int
    data: np.ndarray  # folded bytes
    raw: np.ndarray  # bytes as they were
    row_start: np.ndarray  # byte offset of each row in data, rows + 1 values
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    bounds: np.ndarray  # words of row i: bounds[i]:bounds[i + 1]
    hash: np.ndarray  # 64 bits for each word

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off, raw


def chunks(col: pa.Array, word: np.ndarray, fold: bool = True, hashed: bool = True) -> Iterator[Chunk]:
    """Cut a text column into chunks of whole rows, and those into words.

    ``word`` says of each byte whether words hold it. Null counts as empty.
    """
    off, raw = _buffers(col)
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK_BYTES, side="right")) - 1)
        to = min(to, n)
        part = raw[off[at] : off[to]]
        row_start = off[at : to + 1] - off[at]
        yield _cut(at, to - at, part, row_start, word, fold, hashed)
        at = to


def _cut(first: int, rows: int, raw: np.ndarray, row_start: np.ndarray, word: np.ndarray, fold: bool, hashed: bool) -> Chunk:
    data = FOLD[raw] if fold else raw
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = word[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    at = row_start[:-1][np.diff(row_start) > 0]
    begins[at] = inside[1:-1][at]
    last = row_start[1:][np.diff(row_start) > 0] - 1
    ends[last] = inside[1:-1][last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, row_start)
    h = np.zeros(len(start), dtype=np.uint64)
    if hashed and len(start):
        up, down = _pow(len(raw) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data] * up[: len(raw)], out=total[1:])
            h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Chunk(first, rows, data, raw, row_start, start, end, bounds, h)


def code_points(raw: np.ndarray) -> np.ndarray:
    """For each byte offset, the code points before it (one value more than bytes)."""
    out = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def shingles(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row: (hash, row, bytes of the shingle's words).

    A row of fewer than ``k`` words, but at least one, gives its whole sequence
    as one shingle. Rows come in order, hashes ascending inside a row.
    """
    n = np.diff(chunk.bounds)
    total = len(chunk.hash)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.minimum(n, k)
    each = np.where(n > 0, n - size + 1, 0)
    row = np.repeat(np.arange(chunk.rows), each)
    begin = np.repeat(chunk.bounds[:-1] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(int(each.sum()))
    long = size[row]
    with np.errstate(over="ignore"):
        h = np.zeros(len(row), dtype=np.uint64)
        for j in range(k):
            ok = j < long
            at = np.where(ok, begin + j, 0)
            h = np.where(ok, (h ^ chunk.hash[at]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j + 1), h)
            h ^= h >> np.uint64(29)
        h = mix(h)
    letters = np.zeros(total + 1, dtype=np.int64)
    np.cumsum(chunk.end - chunk.start, out=letters[1:])
    length = letters[begin + long] - letters[begin]
    order = np.lexsort((h, row))
    h, row, length = h[order], row[order], length[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], row[fresh], length[fresh]
