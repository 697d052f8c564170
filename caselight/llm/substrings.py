"""Suffix-array dedup (2): repeated LENGTH-byte strings by backward extension on a Burrows-Wheeler transform.

A byte is removed if a string of LENGTH bytes covers it that also starts earlier in the corpus (smaller id, or
same document and earlier start). One suffix array of a whole corpus does not distribute, so equal strings are
first brought together, exactly:

1. Winnowing: each LENGTH-byte window names the leftmost of its GRAM-byte substrings of least hash, its anchor.
   Equal windows name equal anchors at equal offsets, and the windows that name one anchor are consecutive, so
   an anchor stands for a run of windows, about one in 39 bytes.
2. Anchors that occur once stand for windows that occur once. The others are joined back; runs of equal bytes
   (128-bit BLAKE2 digests) and anchor are one class, in which all but the first run is removed whole.
3. Where an anchor has several classes, the bytes of each class's first run make a text. Its suffix array and
   Burrows-Wheeler transform are built, and intervals of equal strings that end where a window ends grow by
   backward extension, breadth first, a symbol a level. Intervals of one row are closed, levels stop at LENGTH;
   the rows of an interval left then start with one LENGTH-byte string, and all but the earliest are removed.
4. An anchor of more than CLASSES classes (a common line between very many different neighbours) doesn't fit one
   text. Its runs are halved: each of their windows holds the anchor and either as many bytes before it or
   after it as make the core longer by half of what is missing to LENGTH, so equal windows have equal longer cores.
   The halves are filed by these cores, equal ones become classes again, and steps 2 to 4 go on with them. After at
   most 7 such steps a core is a whole window, and its runs are one class.

Scale: the shuffles move an anchor's hash, then its place and digest, the bytes of step 3 and twice the texts of
documents (to cut the bytes of step 3, to apply the spans). No group grows with the copies of a string.

Defined results: null or empty texts and texts under LENGTH bytes lose nothing; rows with a null id come after
all others and give a row each; rows of one id are one document at different times: a string is earlier by its
start, equal starts of such rows are not earlier than each other, and each row's own text is cut; ties don't occur
between other places; empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.shared import Scratch
from caselight.llm.textbatch import grouped, mix, pieces, powers, prefix_hash, slices
from caselight.session import ship_package

LENGTH = 100
GRAM = 24
#: Contexts of one anchor that make one text: 4000 of at most 176 bytes, 0.7 MB.
CLASSES = 4000
SHARD_BYTES = 1_000_000
TEXT_SLICE = 1_000_000
#: Stands for a null id, which comes after all others.
LAST = (1 << 63) - 1
_PLACE_BITS = np.uint64(24)


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows by anchor: (document, first start, windows, anchor's hash, place of the anchor from the first start), starts in data."""
    n, w = len(data), length - gram + 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if n < length:
        return none
    p = prefix_hash(data)
    with np.errstate(over="ignore"):
        g = mix((p[gram:] - p[:-gram]) * powers(len(p))[1][: n - gram + 1])
    places = np.uint64(1) << np.uint64(max(int(_PLACE_BITS), n.bit_length()))
    least = (g // places) * places + np.arange(len(g), dtype=np.uint64)
    size = 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    at = (least % places).astype(np.int64)  # the anchor of the window that starts here
    start = np.arange(n - length + 1)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: n - length + 1]
    inside = start + length <= offs[1:][doc]
    start, at, doc = start[inside], at[: len(inside)][inside], doc[inside]
    if not len(start):
        return none
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    count = np.diff(np.r_[new, len(start)])
    s0, a = start[new], at[new]
    return doc[new], s0, count, g[a], a - s0


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the text in the order of the depth symbols (at least) from there on; symbols are from 1 to 511."""
    n = len(text)
    padded = np.r_[text.astype(np.int64), np.zeros(8, np.int64)]
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = (key << 9) | padded[i : n + i]
    known = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
        if known >= depth or rank[order[-1]] == n - 1:
            return order
        later = np.zeros(n, np.int64)
        if known < n:
            later[: n - known] = rank[known:] + 1
        key = rank * (n + 1) + later
        known *= 2


def repeated_starts(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, number of the string) of the strings text[end - length:end] that stand at several of the ends.

    Intervals of the Burrows-Wheeler transform grow by backward extension, breadth first: the rows of an interval
    that the symbol c precedes are the interval of the string with c before it. Level l holds the intervals of l
    symbols that end at the ends, and of these only the ones of several rows: those of one row can't be common
    prefixes any more, so they are closed. Levels stop at length, or as soon as no interval is open.
    """
    order = suffix_array(text, length)
    place = np.empty(len(text), np.int32)
    place[order] = np.arange(len(text), dtype=np.int32)
    transform, back = text[order - 1].astype(np.uint16), place[order - 1]
    rows = np.sort(place[ends])
    interval = np.zeros(len(rows), np.int32)
    for _ in range(length):
        if not len(rows):
            break
        c = transform[rows]
        by = np.argsort(c, kind="stable")
        c, interval = c[by], interval[by]
        new = np.ones(len(by) + 1, bool)
        new[1:-1] = (c[1:] != c[:-1]) | (interval[1:] != interval[:-1])
        several = ~(new[:-1] & new[1:])
        rows, interval = back[rows[by[several]]], np.cumsum(new[:-1], dtype=np.int32)[several]
    return order[rows], interval


def later_windows(contexts: list[bytes], windows: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context the windows (from 0) whose bytes also start at an earlier (doc, start) of another window."""
    size = np.array([len(c) for c in contexts])
    at = np.r_[0, np.cumsum(size + 1)]
    text = np.ones(at[-1], np.int16)  # 1 separates
    for c, s in zip(contexts, at[:-1], strict=True):
        text[s : s + len(c)] = np.frombuffer(c, np.uint8).astype(np.int16) + 2
    own = np.repeat(np.arange(len(contexts)), windows)
    row_of = np.arange(len(own)) - np.repeat(np.r_[0, np.cumsum(windows)[:-1]], windows)
    place, group = repeated_starts(text, at[own] + row_of + length, length)
    own = np.searchsorted(at, place, "right") - 1
    row_of = place - at[own]
    d, s = doc[own], start[own] + row_of
    by = np.lexsort((s, d, group))
    g, dd, ss = group[by], d[by], s[by]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    lead = np.repeat(first, np.diff(np.r_[first, len(g)]))
    later = place[by][(dd != dd[lead]) | (ss != ss[lead])]
    later.sort()
    own = np.searchsorted(at, later, "right") - 1
    return np.split(later - at[own], np.searchsorted(own, np.arange(1, len(contexts))))


def runs_of(places: np.ndarray) -> list[tuple[int, int]]:
    """(first, past the last) of consecutive numbers."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.r_[0, cut + 1]].tolist(), (places[np.r_[cut, len(places) - 1]] + 1).tolist(), strict=True))


_RUN = [("doc", pa.int64()), ("t", pa.int64()), ("s0", pa.int64()), ("n", pa.int32())]
_KEY = [("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())]
_RUN_SCHEMA = "doc long, t long, s0 long, n int"


def _digests(parts: list[bytes]) -> np.ndarray:
    """128-bit BLAKE2 digests, two numbers a row."""
    start = hashlib.blake2b(digest_size=16)

    def one(b: bytes) -> bytes:
        h = start.copy()
        h.update(b)
        return h.digest()

    return np.frombuffer(b"".join(map(one, parts)), np.int64).reshape(-1, 2)


def _anchor_rows(length: int):
    schema = pa.schema([*_RUN, *_KEY, ("o", pa.int32())])

    def run(batches):
        for rows, data, offs in slices(batches, "text", TEXT_SLICE):
            ids, t = (rows.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            doc, s0, n, h, o = anchors(data, offs, length)
            raw = data.tobytes()
            c = _digests([raw[s:e] for s, e in zip(s0.tolist(), (s0 + n + length - 1).tolist(), strict=True)])
            s0 = s0 - offs[:-1][doc] if len(doc) else s0
            yield pa.RecordBatch.from_arrays([*map(pa.array, (ids[doc], t[doc], s0)), pa.array(n, pa.int32()), pa.array(h.view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(o, pa.int32())], schema=schema)

    return run


def _anchor_hashes(length: int):
    schema = pa.schema([("h", pa.int64())])

    def run(batches):
        for _, data, offs in slices(batches, "text", TEXT_SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(data, offs, length)[3].view(np.int64))], schema=schema)

    return run


_CUT = pa.schema([("h", pa.int64()), *_RUN, ("x", pa.int32()), ("m", pa.int32()), ("b", pa.binary())])
_CUT_SCHEMA = f"h long, {_RUN_SCHEMA}, x int, m int, b binary"


def _cut(length: int, gram: int):
    """The bytes of each run of (doc, t, text, runs), with the place x and size m of what all its windows hold."""

    def run(batches):
        for batch in pieces(batches, 100):
            out = [[] for _ in _CUT]
            for doc, t, raw, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).to_pylist(), strict=True):
                raw = raw.as_py()
                for r in runs:
                    for col, v in zip(out, (r["h"], doc, t, r["s0"], r["n"], r["o"], gram, raw[r["s0"] : r["s0"] + r["n"] + length - 1]), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _CUT, strict=True)], schema=_CUT)

    return run


def halves(start: int, n: int, x: int, m: int, length: int) -> list[tuple[int, int, int, int]]:
    """(first window, windows, place and size of the core) of the two parts of a run, windows start, ..., start + n - 1.

    All windows hold the core, m bytes from x on. Those that start well before it also hold the bytes before it, the
    others the bytes after it: each part's core is longer by half of what its windows have besides the old core.
    """
    half = -(-(length - m) // 2)
    cut = min(max(x - half + 1, start), start + n)
    parts = [(start, cut - start, x - half, m + half), (cut, start + n - cut, x, length + 1 - half)]
    return [p for p in parts if p[1]]


def _split(length: int):
    """Runs by their halves' cores, as places in the run's own bytes, each with its digest."""
    schema = pa.schema([*_CUT, ("c1", pa.int64()), ("c2", pa.int64())])

    def run(batches):
        for batch in pieces(batches, 5000):
            out = [[] for _ in _CUT]
            for h, doc, t, s0, n, x, m, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for first, count, y, size in halves(0, n, x, m, length):
                    core = hashlib.blake2b(b[y : y + size] + (b"<" if y < x else b">"), digest_size=8, key=h.to_bytes(8, "little", signed=True)).digest()
                    for col, v in zip(out, (int.from_bytes(core, "little", signed=True), doc, t, s0 + first, count, y - first, size, b[first : first + count + length - 1]), strict=True):
                        col.append(v)
            c = _digests(out[-1])
            yield pa.RecordBatch.from_arrays([*(pa.array(v, f.type) for v, f in zip(out, _CUT, strict=True)), pa.array(c[:, 0]), pa.array(c[:, 1])], schema=schema)

    return run


def _extend(length: int):
    """Removed windows [s, e) of the runs of one anchor after another."""
    schema = pa.schema([("doc", pa.int64()), ("t", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])

    def run(batches):
        for table in grouped(batches, 1, size=SHARD_BYTES):
            doc, t, s0, n = (table.column(c).to_numpy() for c in (1, 2, 3, 4))
            found = later_windows([b.as_py() for b in table.column(7)], n.astype(np.int64), doc, s0, length)
            out = [(d, k, s + x, s + y) for d, k, s, places in zip(doc, t, s0, found, strict=True) for x, y in runs_of(places)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], schema=schema)

    return run


def _kept(length: int, with_text: bool):
    fields = [("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, ("kept", pa.binary())] if with_text else fields)

    def run(batches):
        for batch in pieces(batches, 200):
            out: list[list] = [[] for _ in fields] + [[]]
            for doc, raw, spans, nameless in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw, doc = raw.as_py() or b"", None if nameless else doc
                merged: list[list[int]] = []
                for s, e in sorted((x["s"], x["e"] + length - 1) for x in spans or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                kept, at = [], 0
                for s, e in merged:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                for col, v in zip(out, (doc, len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=False)], schema=schema)

    return run


def _first_and_copies(scratch: Scratch, runs: DataFrame, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """The earliest run of each class (h, c1, c2) of a written table, and the windows [s, e) of all others, written."""
    key = ["h", "c1", "c2"]
    classes = scratch.write(runs.groupBy(*key).agg(F.min(F.struct("doc", "s0", "t", "n", *more)).alias("f"), F.count(F.lit(1)).alias("m")))
    led = classes.where("m > 1").select(*key, F.col("f.doc").alias("doc0"), F.col("f.s0").alias("s00"))
    copies = runs.join(led, key).where("doc <> doc0 OR s0 <> s00").select("doc", "t", F.col("s0").alias("s"), (F.col("s0") + F.col("n")).alias("e"))
    return classes.select("h", *(f"f.{c}" for c in ("doc", "t", "s0", "n", *more))), scratch.write(copies)


def _mixed(runs: DataFrame) -> DataFrame:
    """h, k: how many classes, where they are several."""
    return runs.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")


def remove_repeats(documents: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes kept."""
    spark = documents.sparkSession
    ship_package(spark)
    with Scratch(spark) as scratch:
        spans, docs = _spans(scratch, documents, length, id_col, text_col)
        scratch.keep_only(spans)
        out = docs.join(spans, ["doc", "t"], "left").select("doc", "text", "spans", "nameless").mapInArrow(_kept(length, with_text), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
        return out.withColumnRenamed("doc", id_col)


def _spans(scratch: Scratch, documents: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc, t, spans of removed windows) and (doc, t, text, nameless) of the documents."""
    named = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Rows of one id with different texts are told apart by a hash of the text; without such rows t needs no bytes.
    several = named.groupBy("id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a < b OR id IS NULL").limit(1).count()
    docs = named.select(F.coalesce("id", F.lit(LAST)).alias("doc"), (F.xxhash64("text", F.col("id").isNull()) if several else F.lit(0).cast("long")).alias("t"), "text", F.col("id").isNull().alias("nameless"))
    texts = docs.select("doc", "t", "text")
    # The anchors are found twice, which costs less than to write and read a row for every 39 bytes.
    twice = scratch.write(texts.mapInArrow(_anchor_hashes(length), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h"))
    placed = scratch.write(texts.mapInArrow(_anchor_rows(length), f"{_RUN_SCHEMA}, h long, c1 long, c2 long, o int").join(twice, "h"))
    scratch.drop(twice)
    runs, copies = _first_and_copies(scratch, placed, ["o"])
    scratch.drop(placed)
    removed = [copies]
    mixed = scratch.write(_mixed(runs))
    listed = runs.join(mixed, "h").groupBy("doc", "t").agg(F.collect_list(F.struct("h", "s0", "n", "o")).alias("runs"))
    once = docs.where("text IS NOT NULL").dropDuplicates(["doc", "t"]) if several else docs
    cut = scratch.write(listed.join(once, ["doc", "t"]).select("doc", "t", "text", "runs").mapInArrow(_cut(length, GRAM), _CUT_SCHEMA))
    while True:
        few, many = ((scratch.write(mixed.where(c).select("h"))) for c in (f"k <= {CLASSES}", f"k > {CLASSES}"))
        extended = cut.join(few, "h", "left_semi").repartition("h").sortWithinPartitions("h").mapInArrow(_extend(length), "doc long, t long, s long, e long")
        removed.append(scratch.write(extended))
        if not many.limit(1).count():
            break
        # Runs of anchors between very many neighbours go by longer cores; at last a core is a whole window, of one class.
        halved = scratch.write(cut.join(many, "h", "left_semi").mapInArrow(_split(length), f"{_CUT_SCHEMA}, c1 long, c2 long"))
        cut, copies = _first_and_copies(scratch, halved, ["x", "m", "b"])
        scratch.drop(halved)
        removed.append(copies)
        mixed = scratch.write(_mixed(cut))
    every = removed[0]
    for more in removed[1:]:
        every = every.union(more)
    return scratch.write(every.groupBy("doc", "t").agg(F.collect_list(F.struct("s", "e")).alias("spans"))), docs
