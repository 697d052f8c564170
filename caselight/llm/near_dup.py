"""MinHash near-duplicates (10): banded MinHash, odd sketches, leaders, exact sets, components.

Texts are lower-cased (A-Z) and cut at white space; a text's set holds its distinct k-word shingles (with
fewer words, but not none, the whole sequence). Texts of one word sequence (by a 128-bit BLAKE2 digest of it) make
one class, of which the smallest id stands for all. SAMPLES MinHash values of a class are folded into an odd
sketch: sample i flips the bit that a hash of (i, value) names, so the bits in which two sketches differ number
about 2 * SAMPLES * (1 - J) before collisions, and the XOR's population count gives J precisely where J is high.
The first BANDS * ROWS samples make band keys, 1 to a band; classes that share a key are candidates:

1. In rounds, each bucket's rows are held against one leader of it (in the first round the smallest id, then
   others), not against one another. Pairs whose sizes and sketches may reach the bound are confirmed on the
   shingles themselves, words and not hashes, and confirmed pairs tie their classes into components. Rows of their leader's component
   aren't held against it, and buckets of one component drop out, so a group of n near copies costs n pairs a
   round. Rounds go on while they empty buckets of more than FEW rows.
2. The rest, pairs of different components that share a bucket, goes through an exact set join: shingles ordered
   by frequency, those that only one component holds first; two sets that reach the bound share one among their first
   n - need + 1. Rows meet by that shingle, under the length and positional filters and the sketches, all
   within the join's condition, so only pairs that may link leave it; these are confirmed as before.

No bucket or group is capped, and no pair that could link two components is left out: a pair at the bound is
missed by all bands with probability under (1 - J ** ROWS) ** BANDS (1e-10 at 0.85, 5e-8 at 0.80), and by the
sketch beyond SIGMAS standard deviations. Shingle counts (n_shingles) go by 64-bit hashes: a text of n shingles
counts one too few with probability under n * n / 2 ** 65.

Scale: the shuffles move band keys (24 bytes a band and class), pairs with leaders, the sketches and texts of
paired classes, and in step 2 the shingles of classes whose buckets still hold several components. Hot keys meet
combined minima and skew joins.

Defined results: null or empty texts, and texts without words, have the empty set and link with nothing; rows of
one id are one vertex, so their links join and they share a component, and each gives a row; rows with a null id
give a row each with a null component_id and kept = true, and link with nothing; empty tables give empty results.
Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselight.llm.shared import Scratch, components
from caselight.llm.textbatch import SPACED, mix, pieces, shingles, slices, words
from caselight.session import ship_package

WORDS = 5
PERCENT = 80
BANDS, ROWS = 32, 4
SAMPLES = 256
SKETCH_BITS = 1024
SIGMAS = 6.0
#: Rows of a bucket with several components that may go straight to the set join.
FEW = 64
TEXT_SLICE = 400_000
#: Rows that may be sent to every executor at once; with more, both sides are shuffled.
BROADCAST_IDS = 1_000_000

_SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix(_SEEDS) | np.uint64(1)
_PARTS = [f"s{i}" for i in range(SKETCH_BITS // 64)]


def min_hashes(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SAMPLES minima of each non-empty text's shingles, a row a text."""
    start = at[:-1][np.diff(at) > 0]
    out = np.empty((SAMPLES, len(start)), np.uint64)
    buffer = np.empty(len(s), np.uint64)
    for i in range(SAMPLES):
        np.bitwise_xor(s, _SEEDS[i], out=buffer)
        np.multiply(buffer, _ODD[i], out=buffer)
        out[i] = np.minimum.reduceat(buffer, start)
    return np.ascontiguousarray(out.T)


def odd_sketches(m: np.ndarray) -> np.ndarray:
    """Parity bitmaps of (sample, value) pairs, SKETCH_BITS / 8 bytes a row."""
    spot = (mix(m ^ _ODD[None, :]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flat = spot + np.arange(len(m))[:, None] * SKETCH_BITS
    bits = np.bincount(flat.ravel(), minlength=len(m) * SKETCH_BITS).reshape(len(m), SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8), axis=1)


def most_differing(percent: int) -> int:
    """Bits in which sketches may differ for a similarity of percent, with SIGMAS standard deviations to spare."""
    j = percent / 100
    spread = np.sqrt(j * (1 - j) / SAMPLES)
    far = 2 * SAMPLES * (1 - max(j - SIGMAS * spread, 0.0))
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** far)
    return int(np.ceil(mean + 2 * np.sqrt(mean)))


def word_list(raw: bytes | None) -> list[bytes]:
    """The words of a text's bytes: `[^\\x20\\x09-\\x0D]+` after lowering A-Z."""
    return (raw or b"").lower().split()


def word_shingles(raw: bytes | None, k: int) -> set[tuple[bytes, ...]]:
    """A text's set."""
    w = word_list(raw)
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def _distinct(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of each text, sorted, and their bounds."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])] if len(s) else np.zeros(0, bool)
    return s[new], np.r_[0, np.cumsum(np.bincount(doc[new], minlength=len(at) - 1))]


_SIGNATURE = pa.schema([("id", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("word_key", pa.binary()), ("bands", pa.list_(pa.int64())), *((p, pa.int64()) for p in _PARTS)])


def _signatures(k: int):
    def run(batches):
        for rows, data, offs in slices(batches, "text", TEXT_SLICE):
            h, _, _, first = words(data, offs, SPACED)
            s, at = _distinct(*shingles(h, first, k))
            size = np.diff(at)
            full = np.flatnonzero(size)
            keys: list[bytes | None] = [None] * len(size)
            bands: list = [None] * len(size)
            parts = np.zeros((len(size), len(_PARTS)), np.int64)
            if len(full):
                m = min_hashes(s, at)
                b = m[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
                with np.errstate(over="ignore"):
                    key = (b * _ODD[:ROWS]).sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[ROWS]
                key = mix(key).view(np.int64)
                parts[full] = odd_sketches(m).view(np.int64)
                raw = data.tobytes()
                for i, f in enumerate(full):
                    keys[f] = hashlib.blake2b(b" ".join(word_list(raw[offs[f] : offs[f + 1]])), digest_size=16).digest()
                    bands[f] = key[i]
            yield pa.RecordBatch.from_arrays([
                rows.column(0).cast(pa.int64()), rows.column(1), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(parts[:, i]) for i in range(len(_PARTS))),
            ], schema=_SIGNATURE)

    return run


def _tokens(k: int):
    """id, c, n, hashes of the different shingles."""
    schema = pa.schema([("id", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for rows, data, offs in slices(batches, "text", TEXT_SLICE):
            h, _, _, first = words(data, offs, SPACED)
            s, at = _distinct(*shingles(h, first, k))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(1), pa.array(np.diff(at), pa.int64()), lists], schema=schema)

    return run


def _confirm(k: int, percent: int):
    """(a, b) of the rows (a, b, text of a, text of b) whose sets reach the bound; a's set is held while a stays the same."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        raw, mine = None, set()
        for batch in pieces(batches, 200):
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            linked = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True)):
                if (x := x.as_py()) != raw:
                    raw, mine = x, word_shingles(x, k)
                other = word_shingles(y.as_py(), k)
                both = len(mine & other)
                linked[i] = both and 100 * both >= percent * (len(mine) + len(other) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], schema=schema)

    return run


def _small(scratch: Scratch, table: DataFrame) -> DataFrame:
    """The written table, marked for broadcast if it has no more than BROADCAST_IDS rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def _may_link(x: str, y: str, percent: int):
    """The length filter and the sketches' population count, over columns of two prefixes."""
    far = sum((F.bit_count(F.col(x + p).bitwiseXOR(F.col(y + p))) for p in _PARTS), F.lit(0))
    sizes = 100 * F.least(x + "n", y + "n") >= percent * F.greatest(x + "n", y + "n")
    return sizes & (far <= most_differing(percent))


def _as(table: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return table.select(*(F.col(c).alias(prefix + c) for c in columns))


class _Search:
    """The candidate search of one run: classes (id, c, n, bands, sketch), documents (id, c, text), links found so far."""

    def __init__(self, scratch: Scratch, docs: DataFrame, classes: DataFrame, k: int, percent: int, tied: DataFrame):
        self.scratch, self.docs, self.classes, self.k, self.percent = scratch, docs, classes, k, percent
        self.links = tied
        self.group: DataFrame | None = None

    def texts(self, rows: DataFrame) -> DataFrame:
        """id, c, text of the given classes."""
        known = self.scratch.write(rows.select("id", "c").distinct())
        return self.docs.join(_small(self.scratch, known), ["id", "c"], "left_semi").dropDuplicates(["id", "c"])

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Ties the pairs (x_id, x_c, y_id, y_c) whose sets reach the bound; the links."""
        s = self.scratch
        pairs = s.write(pairs)
        texts = s.write(self.texts(pairs.select(F.explode(F.array(F.struct(F.col("x_id").alias("id"), F.col("x_c").alias("c")), F.struct(F.col("y_id").alias("id"), F.col("y_c").alias("c")))).alias("e")).select("e.*")))
        both = pairs.join(_as(texts, "y_", ["id", "c", "text"]), ["y_id", "y_c"]).join(_as(texts, "x_", ["id", "c", "text"]), ["x_id", "x_c"])
        found = s.write(both.select("x_id", "y_id", "x_text", "y_text").mapInArrow(_confirm(self.k, self.percent), "a long, b long").where("a <> b").distinct())
        s.drop(pairs, texts)
        self.links = s.write(self.links.union(found))
        self.group = _components(s, self.links)
        return found

    def grouped(self, rows: DataFrame) -> DataFrame:
        """Rows with g, their component."""
        if self.group is None:
            return rows.withColumn("g", F.col("id"))
        return rows.join(self.group.withColumnRenamed("component", "g"), "id", "left").withColumn("g", F.coalesce("g", "id"))

    def open_rows(self, filed: DataFrame) -> DataFrame:
        """key, id, c, g of the rows in buckets of several components."""
        rows = self.scratch.write(self.grouped(filed.select("key", "id", "c")))
        open_keys = rows.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.count(F.lit(1)).alias("size")).where("g0 < g1").select("key", "size")
        # Written, so that the join can split a hot key's rows, which it can't above an aggregate.
        return self.scratch.write(rows.join(self.scratch.write(open_keys), "key"))

    def hold_against_leaders(self, rows: DataFrame, turn: int) -> None:
        """Ties the rows that link with the leader of one of their buckets."""
        rank = F.col("id") if turn == 0 else F.xxhash64("id", "c", F.lit(turn))
        lead = rows.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "id", "c", "g")).alias("x")).select("key", F.col("x.id").alias("x_id"), F.col("x.c").alias("x_c"), F.col("x.g").alias("x_g"))
        pairs = rows.join(self.scratch.write(lead), "key").where("g <> x_g").select("x_id", "x_c", F.col("id").alias("y_id"), F.col("c").alias("y_c")).distinct()
        columns = ["id", "c", "n", *_PARTS]
        near = pairs.join(_as(self.classes, "y_", columns), ["y_id", "y_c"]).join(_as(self.classes, "x_", columns), ["x_id", "x_c"])
        self.confirm(near.where(_may_link("x_", "y_", self.percent)).select("x_id", "x_c", "y_id", "y_c"))

    def join_rest(self, rows: DataFrame) -> None:
        """Ties the rows of different components by an exact prefix-filtered set join."""
        s, p = self.scratch, self.percent
        rest = s.write(rows.select("id", "c", "g").distinct())
        sets = s.write(self.texts(rest).mapInArrow(_tokens(self.k), "id long, c long, n long, tokens array<long>"))
        placed = s.write(sets.join(rest, ["id", "c"]).select("id", "c", "g", "n", F.explode("tokens").alias("t")))
        s.drop(sets)
        common = placed.groupBy("t").agg(F.count(F.lit(1)).alias("f"), F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("t", "f")
        held = placed.join(s.write(common), "t")
        mine = Window.partitionBy("id", "c")
        # Shingles of one component come first in the order, so the others start at n - count.
        ranked = held.withColumn("i", F.row_number().over(mine.orderBy("f", "t")) + F.col("n") - F.count(F.lit(1)).over(mine) - 1)
        need = F.ceil(F.col("n") * p / 100)
        first = ranked.where(F.col("i") < F.col("n") - need + 1).select("id", "c", "g", "t", "i")
        full = s.write(first.join(self.classes.select("id", "c", "n", *_PARTS), ["id", "c"]))
        s.drop(placed, rest)
        columns = ["id", "c", "g", "n", "i", *_PARTS]
        x, y = (full.select("t", *(F.col(c).alias(f"{w}_{c}") for c in columns)) for w in "xy")
        overlap = F.ceil((F.col("x_n") + F.col("y_n")) * p / (100 + p) - 1e-9)
        room = F.least(F.col("x_n") - F.col("x_i"), F.col("y_n") - F.col("y_i")) >= overlap
        pairs = x.join(y, (x.t == y.t) & (F.col("x_g") < F.col("y_g")) & room & _may_link("x_", "y_", p))
        self.confirm(pairs.select("x_id", "x_c", "y_id", "y_c").distinct())
        s.drop(full)

    def run(self) -> DataFrame | None:
        """id, component of every vertex that is tied to another."""
        s = self.scratch
        filed = self.classes.select("id", "c", F.explode("bands").alias("key"))
        shared = s.write(filed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "size"))
        if self.links.limit(1).count():
            self.group = _components(s, self.links)
        rows = s.write(self.grouped(filed.join(shared, "key")))
        before, turn = None, 0
        while rows.limit(1).count():
            self.hold_against_leaders(rows, turn)
            nxt = self.open_rows(rows)
            s.drop(rows)
            rows = nxt
            large = rows.where(F.col("size") > FEW).count()
            if not large or (before is not None and large > 0.75 * before):
                break
            before, turn = large, turn + 1
        if rows.limit(1).count():
            self.join_rest(rows)
        s.drop(rows)
        return self.group


def _components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    if edges.limit(1).count():
        return components(scratch, edges)
    return scratch.write(edges.select(F.col("a").alias("id"), F.col("b").alias("component")))


def near_duplicates(documents: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id, kept."""
    spark = documents.sparkSession
    ship_package(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("c"), F.col(text_col).alias("text"))
    with Scratch(spark) as scratch:
        parts = ", ".join(f"{p} long" for p in _PARTS)
        signed = scratch.write(docs.mapInArrow(_signatures(k), f"id long, c long, n long, word_key binary, bands array<long>, {parts}"))
        usable = signed.where("n > 0 AND id IS NOT NULL")
        least = scratch.write(usable.groupBy("word_key").agg(F.min("id").alias("id")))
        classes = scratch.write(usable.join(least, ["word_key", "id"]).dropDuplicates(["word_key"]).select("id", "c", "n", "bands", *_PARTS))
        # Ids with rows of several classes tie those classes' first ids.
        several = scratch.write(signed.where("id IS NOT NULL").select("id", F.coalesce(F.xxhash64("word_key"), F.lit(0)).alias("w")).groupBy("id").agg(F.min("w").alias("w0"), F.max("w").alias("w1")).where("w0 < w1").select("id"))
        tied = usable.join(several, "id").join(least.withColumnRenamed("id", "first"), "word_key").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
        search = _Search(scratch, docs.where("id IS NOT NULL"), classes, k, percent, scratch.write(tied.distinct()))
        group = search.run()
        if group is None:
            group = search.links.select(F.col("a").alias("id"), F.col("b").alias("component"))

        # Every class and document gets its component; the rest of the written tables go.
        named = scratch.write(least.join(group, "id", "left").select("word_key", F.coalesce("component", "id").alias("component")))
        own = scratch.write(several.join(group, "id").select("id", F.col("component").alias("own")))
        sizes = scratch.write(signed.select("id", "n", "word_key"))
        scratch.keep_only(named, own, sizes)
        out = sizes.join(named, "word_key", "left").join(own, "id", "left")
        out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("own", "component", "id")))
        return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, one of each group.

    The row of the smallest id stays; of several rows with that id, the least by text and then by the other columns. Rows with a null id stay.
    """
    with Scratch(documents.sparkSession) as scratch:
        found = near_duplicates(documents, k, percent, id_col, text_col).where(F.col(id_col).isNotNull())
        state = scratch.write(found.groupBy(id_col).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")).where("NOT kept OR rows > 1").withColumnRenamed(id_col, "_gone"))
        twice = scratch.write(state.where("kept").select("_gone"))
        scratch.keep_only(state, twice)
        once = documents.join(_small(scratch, state.select("_gone")), F.col(id_col) == F.col("_gone"), "left_anti")
        if not twice.limit(1).count():
            return once
        columns = [text_col, *(c for c in documents.columns if c != text_col)]
        again = documents.join(_small(scratch, twice), F.col(id_col) == F.col("_gone"), "left_semi")
        one = again.groupBy(F.col(id_col).alias("_one")).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in columns))).alias("_row"))
        return once.select(documents.columns).union(one.select(*(F.col("_row")[c].alias(c) for c in documents.columns)))
