"""Benchmark decontamination (8): one Aho-Corasick automaton over normalised item windows.

Normalising lower-cases A-Z and takes words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is `window`
consecutive words of an item; an item of fewer words, but not none, is one window. The items' words are numbered,
each number is written with two symbols (the first from one alphabet, the second from another, so matches begin
where words do), all windows make one automaton of such symbols, and each document is written alike, words of
no item as blanks, and scanned once. A match's end names its last word, and the words' byte offsets map it to the
original text. With two symbols a word the automaton has a sixth of the nodes that it would have over characters,
and no node has more children than the root of the number of words.

Scale: the automaton lies with every Python worker, which keeps the last one it built, so its size is bounded: AUTOMATON_BYTES
(NODE_BYTES for each symbol of each window; items are cut into pieces that overlap by window - 1 words first). Within it
documents are scanned once, without a shuffle. A larger benchmark costs one scan more, whatever its size: a first scan passes the
documents' windows through a bitmap of all item windows' hashes (BITS bits a window, so that about one window in a million passes
by chance; 256 MB at most, beyond which more pass). What passes goes to the block of its hash, where the block's own automaton, again within
the bound, decides; blocks with many candidates are split. The second scan joins the hits to the documents by the text's MD5 digest. No block
reads the documents.

Defined results: null or empty texts have no words and no hits; items without words are ignored; items
repeated under several ids count under each id; items with a null id hit words and drop documents, but
aren't among the ids or in their number; empty tables give empty results; rows repeated in the
documents each give a row; null document ids stay null. Other columns of either table are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.shared import Scratch
from caselight.llm.textbatch import ALNUM, mix, pieces, powers, slices, words
from caselight.session import ship_package

WINDOW = 10
#: Bytes of a node with its link, as measured, and of one block's automaton.
NODE_BYTES = 56
AUTOMATON_BYTES = 200_000_000
#: Bits of the bitmap a window of the benchmark, at most so many in all (256 MB), places a window, and bits of a part.
BITS, MOST_BITS, PROBES, PART = 32, 1 << 31, 6, 1 << 16
#: Candidate windows of one block that one task compares.
CANDIDATES = 2_000_000
#: Words of an item that stay together, besides the overlap.
PIECE = 2000
#: Digests of texts that may be sent to every executor at once.
BROADCAST_TEXTS = 1_000_000
_TO_SPACE = bytes(int(b) or 32 for b in ALNUM)

_HITS = [("n_words", pa.int64()), ("words", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
_SPANS = ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
_SCAN_SCHEMA = "doc_id long, n_words long, words array<int>, items array<string>, spans array<struct<start:int,end:int>>"
_BLANK = "\0\0"


def normalise(text: str | bytes) -> list[bytes]:
    """The words of a text, as bytes of UTF-8."""
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return raw.translate(_TO_SPACE).split()


def item_windows(text: str | None, window: int = WINDOW) -> set[tuple[bytes, ...]]:
    """The windows of one item."""
    w = normalise(text or "")
    if not w:
        return set()
    return {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))}


def held_windows(items: list[tuple[str | None, str | None]], window: int) -> dict[tuple[bytes, ...], set[str]]:
    """The windows of (item id, text) pairs, each with the ids that aren't null."""
    held: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        for w in item_windows(text, window):
            held.setdefault(w, set()).update(() if item is None else (item,))
    return held


class Automaton:
    """The automaton of windows; each has its number of words and its item ids."""

    def __init__(self, held: dict[tuple[bytes, ...], set[str]]):
        import ahocorasick

        known = sorted({x for w in held for x in w})
        base = math.isqrt(len(known)) + 1
        self.code = {x: chr(1 + i // base) + chr(2 + base + i % base) for i, x in enumerate(known)}
        self.found = [(len(w), tuple(sorted(ids))) for w, ids in held.items()]
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, w in enumerate(held):
            self.tree.add_word("".join(map(self.code.get, w)), n)
        if held:
            self.tree.make_automaton()

    def size(self) -> int:
        """Bytes of its nodes and links."""
        return self.tree.get_stats()["total_size"] if self.found else 0

    def scan(self, text: str | bytes | None) -> tuple[int, np.ndarray, set[str]]:
        """(number of words, places of hit words, items with occurring windows)."""
        w = normalise(text or b"")
        none = np.zeros(0, np.int64)
        if not w or not self.found:
            return len(w), none, set()
        code = self.code
        found = list(self.tree.iter("".join([code.get(x, _BLANK) for x in w])))
        if not found:
            return len(w), none, set()
        past = np.array([end // 2 + 1 for end, _ in found])
        size = np.array([self.found[n][0] for _, n in found])
        change = np.zeros(len(w) + 1, np.int64)
        np.add.at(change, past - size, 1)
        np.add.at(change, past, -1)
        return len(w), np.flatnonzero(np.cumsum(change[:-1]) > 0), {i for n in {n for _, n in found} for i in self.found[n][1]}


_LAST: dict[tuple[str, int], Automaton] = {}


class Block:
    """All items of a benchmark whose automaton is within its bound, broadcast under a name of their own."""

    def __init__(self, spark, items: DataFrame):
        self.name = uuid.uuid4().hex
        self.items = spark.sparkContext.broadcast([(r.i, r.t) for r in items.select("i", "t").collect()])

    def automaton(self, window: int) -> Automaton:
        """Built once a worker, and let go when the worker meets other items."""
        if (self.name, window) not in _LAST:
            _LAST.clear()
            _LAST[self.name, window] = Automaton(held_windows(self.items.value, window))
        return _LAST[self.name, window]


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.r_[0, cut + 1]].tolist(), (places[np.r_[cut, len(places) - 1]] + 1).tolist(), strict=True))


def _char_spans(raw: bytes, places: np.ndarray) -> list[dict]:
    """Code-point spans of runs of hit words in the original text."""
    b = np.frombuffer(raw, np.uint8)
    inside = ALNUM[b] != 0
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    points = np.r_[0, np.cumsum((b & 0xC0) != 0x80)]
    return [{"start": int(points[starts[i]]), "end": int(points[ends[j - 1]])} for i, j in _runs(places)]


def _blocks(scratch: Scratch, benchmark: DataFrame, item_col: str, text_col: str, window: int, bytes_each: int) -> tuple[int, DataFrame]:
    """(number of blocks, table of item id and text) of the items' pieces."""
    b = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    words = F.split(F.trim(F.regexp_replace("t", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), " ")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(PIECE))
    cut = b.select("i", words.alias("w")).select("i", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s + 1, F.lit(PIECE + window - 1)))).alias("w"))
    cut = scratch.write(cut.distinct())
    symbols = 2 * window * (cut.agg(F.sum(F.size("w"))).first()[0] or 0)
    n = -(-symbols * NODE_BYTES // bytes_each) or 1
    return n, cut.select("i", F.array_join("w", " ").alias("t"))


def _scanner(held: Block, window: int):
    """(doc_id, text) to the hits and their spans."""
    schema = pa.schema([("doc_id", pa.int64()), *_HITS, _SPANS])

    def run(batches):
        auto = held.automaton(window)
        for batch in pieces(batches):
            cols: list[list] = [[], [], [], []]
            for v in batch.column(1).cast(pa.binary()):
                raw = v.as_py() or b""
                n, places, ids = auto.scan(raw)
                for col, x in zip(cols, (n, places, sorted(ids), _char_spans(raw, places) if len(places) else []), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    return run


def _window_hashes(texts: pa.Array, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, hashes, texts, first words) of the windows of each size of a batch of texts that have so many words."""
    batch = pa.RecordBatch.from_arrays([texts], names=["t"])
    at = 0
    for rows, data, offs in slices(iter([batch]), "t"):
        h, _, _, first = words(data, offs, ALNUM)
        up, down = powers(len(h) + 1)
        prefix = np.zeros(len(h) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(h * up[: len(h)], out=prefix[1:])
            for size in sizes:
                n = np.maximum(np.diff(first) - size + 1, 0)
                text = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
                start = first[:-1][text] + place
                yield size, mix((prefix[start + size] - prefix[start]) * down[start] + np.uint64(size)), text + at, place
        at += rows.num_rows


def _bits_of(h: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES places of each hash in a bitmap."""
    step = mix(h) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([mix(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)], 1).astype(np.int64)


_WINDOWS = pa.schema([("block", pa.int64()), ("w", pa.string()), ("i", pa.string())])


def _item_windows(items: DataFrame, window: int, n: int) -> DataFrame:
    """block, w, i: every window of every item, dealt to n blocks by its hash."""

    def run(batches):
        for batch in pieces(batches):
            out: list[list] = [[], [], []]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in item_windows(t, window):
                    joined = b" ".join(w)
                    for col, v in zip(out, (_block(joined, n), joined.decode(), i), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _WINDOWS, strict=True)], schema=_WINDOWS)

    return items.mapInArrow(run, "block long, w string, i string").distinct()


def _block(w: bytes, n: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(w) % n


def _bitmap(scratch: Scratch, windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """(a bitmap of all windows' hashes, the windows' different sizes); BITS bits a window, rounded up, MOST_BITS at most. Parts of it are united in tasks."""
    sizes = windows.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.size(F.split("w", " "))).alias("s")).first()
    bits = min(MOST_BITS, max(PART, 1 << (BITS * max(sizes["n"], 1) - 1).bit_length()))

    def places(batches):
        for batch in batches:
            found = [h for size in sizes["s"] for _, h, text, _ in _window_hashes(batch.column(0), [size]) for h in [h[_whole(batch.column(0), text, size)]]]
            at = np.unique(_bits_of(np.concatenate(found), bits)) if found else np.zeros(0, np.int64)
            part = at // PART
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(at) else np.zeros(1, np.int64)
            blobs = [(at[i:j] % PART).astype("<u2").tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "at"])

    def united(batches):
        part, seen = None, np.zeros(PART, bool)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])
        for batch in batches:
            for p, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part:
                    if part is not None:
                        yield out()
                    part, seen = p, np.zeros(PART, bool)
                seen[np.frombuffer(at, "<u2")] = True
        if part is not None:
            yield out()

    parts = windows.select("w").mapInArrow(places, "part int, at binary").repartition("part").sortWithinPartitions("part").mapInArrow(united, "part int, bits binary")
    whole = np.zeros(bits // 8, np.uint8)
    for r in scratch.write(parts).toLocalIterator():
        whole[r.part * (PART // 8) :][: PART // 8] = np.frombuffer(r.bits, np.uint8)
    return whole, sorted(sizes["s"])


def _whole(texts: pa.Array, text: np.ndarray, size: int) -> np.ndarray:
    """Which windows are all of their text: a window's text has as many words as it."""
    n = np.array([t.count(" ") + 1 for t in texts.to_pylist()])
    return n[text] == size


def _candidates(texts: DataFrame, bitmap, sizes: list[int], n: int) -> DataFrame:
    """block, k, place, w: the windows of the texts (k, text) whose hash is in the bitmap; one scan."""
    schema = pa.schema([("block", pa.int64()), ("k", pa.string()), ("place", pa.int32()), ("w", pa.string())])

    def run(batches):
        bits = bitmap.value
        for batch in pieces(batches):
            out: list[list] = [[], [], [], []]
            known: dict[int, list[bytes]] = {}
            keys, raw = batch.column(0), batch.column(1)
            for size, h, text, place in _window_hashes(raw, sizes):
                at = _bits_of(h, len(bits) * 8)
                for j in np.flatnonzero(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)).tolist():
                    t, p = int(text[j]), int(place[j])
                    if t not in known:
                        known[t] = normalise(raw[t].as_py() or "")
                    w = b" ".join(known[t][p : p + size])
                    for col, v in zip(out, (_block(w, n), keys[t].as_py(), p, w.decode()), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return texts.mapInArrow(run, "block long, k string, place int, w string").dropDuplicates(["k", "place", "w"])


def _matched(batches):
    """Rows of a block, its items' windows (kind 0) before texts' candidates, to k, place, size and items of the candidates that the block's automaton finds."""
    schema = pa.schema([("k", pa.string()), ("place", pa.int32()), ("size", pa.int32()), ("items", pa.list_(pa.string()))])
    last, held, auto = None, {}, None
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for block, part, kind, w, i, k, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (block, part) != last:
                last, held, auto = (block, part), {}, None
            if kind == 0:
                held.setdefault(tuple(w.encode().split(b" ")), set()).update(() if i is None else (i,))
                continue
            auto = auto or Automaton(held)
            n, places, ids = auto.scan(w.encode())
            if len(places) == n:
                for col, v in zip(out, (k, place, n, sorted(ids)), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def _hits(scratch: Scratch, texts: DataFrame, items: DataFrame, n: int, window: int) -> DataFrame:
    """k, words, items: hits of the texts (k, text) that have any, with one scan of the texts whatever the number of blocks."""
    windows = scratch.write(_item_windows(items, window, n))
    bits, sizes = _bitmap(scratch, windows.select("w").distinct())
    bitmap = scratch.spark.sparkContext.broadcast(bits)
    found = scratch.write(_candidates(texts, bitmap, sizes, n))
    bitmap.destroy()
    hot = F.broadcast(found.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).cast("int").alias("parts")))  # a row a block
    none = lambda t: F.lit(None).cast(t)
    left = windows.join(hot, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "w", "i", none("string").alias("k"), none("int").alias("place"))
    right = found.join(hot, "block").select("block", F.pmod(F.xxhash64("k", "place"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "w", none("string").alias("i"), "k", "place")
    met = left.unionByName(right).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    hits = met.mapInArrow(_matched, "k string, place int, size int, items array<string>")
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  of one text
    spread = hits.withColumn("words", F.sequence("place", F.col("place") + F.col("size") - 1))
    out = scratch.write(spread.groupBy("k").agg(every("words").alias("words"), every("items").alias("items")))
    scratch.drop(windows, found)
    return out


def _finisher(batches):
    """(doc_id, text, words, items) to the hits and their spans."""
    schema = pa.schema([("doc_id", pa.int64()), *_HITS, _SPANS])
    for batch in pieces(batches):
        n, spans = [], []
        for v, places in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
            raw = v.as_py() or b""
            n.append(len(normalise(raw)))
            spans.append(_char_spans(raw, np.array(places, np.int64)) if places else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2), batch.column(3), pa.array(spans, _SPANS[1])], schema=schema)


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """doc_id, n_words, places of the hit words, items with occurring windows, hit spans of the original text."""
    spark = documents.sparkSession
    ship_package(spark)
    docs = documents.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with Scratch(spark) as scratch:
        n, blocks = _blocks(scratch, benchmark, item_col, item_text_col, window, automaton_bytes)
        if n == 1:
            return docs.mapInArrow(_scanner(Block(spark, blocks), window), _SCAN_SCHEMA)
        hits = _hits(scratch, docs.select(F.md5("text").alias("k"), "text"), blocks, n, window)
        scratch.keep_only(hits)
        small = F.broadcast(hits) if hits.count() <= BROADCAST_TEXTS // 100 else hits
        both = docs.withColumn("k", F.md5("text")).join(small, "k", "left")
        return both.select("doc_id", "text", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("words", "array<int>"), ("items", "array<string>")))).mapInArrow(_finisher, _SCAN_SCHEMA)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, **columns) -> DataFrame:
    """One row a document: n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    return scan(documents, benchmark, window, **columns).select(
        "doc_id", "n_words", F.size("words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("words") > 0).alias("contaminated"), "spans",
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no window of any item."""
    spark = documents.sparkSession
    ship_package(spark)
    at = documents.columns.index(text_col)
    with Scratch(spark) as scratch:
        n, blocks = _blocks(scratch, benchmark, item_col, item_text_col, window, automaton_bytes)
        if n > 1:
            hits = _hits(scratch, documents.select(F.md5(text_col).alias("k"), F.col(text_col).alias("text")), blocks, n, window).select(F.col("k").alias("_k"))
            gone = scratch.write(hits)
            scratch.keep_only(gone)
            return documents.join(F.broadcast(gone) if gone.count() <= BROADCAST_TEXTS else gone, F.md5(text_col) == F.col("_k"), "left_anti")
        held = Block(spark, blocks)

    def keep(batches):
        auto = held.automaton(window)
        for batch in pieces(batches):
            clean = [not len(auto.scan(v.as_py())[1]) for v in batch.column(at).cast(pa.binary())]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
