"""Vectorised byte, word and shingle handling on Arrow batches.

Every text operator that needs Python reads whole texts through `slices`, which cuts Arrow
batches so that a worker never holds more than about SLICE_BYTES of text beside its own arrays
(one longer text makes one slice of its own). Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Odd constants that weigh the words of a shingle by their place.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


@lru_cache(maxsize=1)
def lean() -> None:
    """In a task: Arrow's buffers come from the system's allocator, which gives freed ones back; workers live on between tasks."""
    pa.set_memory_pool(pa.system_memory_pool())


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, in pieces of about so many rows or bytes at most, whose results fit a worker."""
    lean()
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def grouped(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 30, size: int = 16_000_000) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by their first columns, of some rows or bytes at least."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows and sum(b.nbytes for b in held) < size:
            continue
        t = pa.Table.from_batches(held)
        same = np.logical_and.reduce([t.column(c).to_numpy() == t.column(c)[t.num_rows - 1].as_py() for c in range(keys)])
        whole = t.num_rows - int(same.sum())
        if whole:
            yield t.slice(0, whole)
            held = t.slice(whole).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def byte_table(word_bytes: set[int]) -> np.ndarray:
    """For each byte its A-Z-lowered value if it belongs to a word, else 0."""
    t = np.zeros(256, np.uint8)
    for b in word_bytes:
        t[b] = b + 32 if 65 <= b <= 90 else b
    return t


#: `[^\\x20\\x09-\\x0D]+` and `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lowering A-Z, as bytes of UTF-8.
SPACED = byte_table(set(range(256)) - {0x20, *range(9, 14)})
ALNUM = byte_table({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)})


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their texts' bytes, offsets) of at most limit bytes, or one row."""
    lean()
    for batch in batches:
        at = batch.schema.get_field_index(text)
        col = batch.column(at)
        if pa.types.is_large_string(col.type):
            col = col.cast(pa.string())
        if col.null_count:
            col = col.fill_null("")
        if not len(col):
            continue
        n = len(col)
        offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
    up, down = np.full(n, _MULT), np.full(n, inverse)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, for prefix hashes."""
    size = 1 << max(12, int(n).bit_length())
    return _powers(size)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the hash of data[i:j] times the i-th power."""
    p = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of the bytes in [start, end), from prefix_hash."""
    with np.errstate(over="ignore"):
        h = (p[end] - p[start]) * powers(len(p))[1][start]
        return mix(h + (end - start).astype(np.uint64) * PLACES[1])


def word_bounds(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mapped bytes, word starts, word ends, first word of each text and one past the last); words end where texts do."""
    mapped = table[data]
    inside = mapped != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    edge = edge[: len(data)]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        before[edge] = False
        after[-1] = False
        after[:-1] = inside[1:]
        after[:-1][edge[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return mapped, starts, ends, np.searchsorted(starts, offs)


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, starts, ends, first word of each text and one past the last)."""
    mapped, starts, ends, first = word_bounds(data, offs, table)
    return span_hash(prefix_hash(mapped), starts, ends), starts, ends, first


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of k consecutive words, first shingle of each text and one past the last).

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    start = first[:-1][doc] + (np.arange(at[-1]) - at[:-1][doc])
    out = np.zeros(at[-1], np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            here = j < count[doc]
            out += np.where(here, h[np.minimum(start + j, max(len(h) - 1, 0))] * PLACES[j] if len(h) else np.uint64(0), np.uint64(0))
    return mix(out), at


def span_string(h: str) -> np.uint64:
    """Hash of one word, as `words` gives it."""
    raw = np.frombuffer(h.encode(), np.uint8)
    return span_hash(prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0]
