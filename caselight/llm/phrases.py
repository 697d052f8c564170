"""Phrase collocations (12) by hash-bucket pruning: each pass counts its n-grams exactly and the next length's in buckets.

Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`; all counts are per
language (null: und). Pass 1 counts words exactly and all word pairs in BUCKETS buckets. Pass k counts k-grams exactly whose bucket
reached the least count and whose two (k-1)-grams did (Apriori), and in buckets the (k+1)-grams both of whose k-grams passed
the filters. A bucket's count is at least that of each of its n-grams, and n-grams that are filtered are below the
least count, so nothing frequent is lost; the exact counts decide.

Bitmaps: counts stop at the least count in each task; they are sent in parts of 65,536 buckets, as places and counts where few are
filled, and added up part by part. What reaches the driver and is broadcast is one bit a bucket: BUCKETS / 8 bytes, at every size of
input. The bitmap of frequent k-grams has the same size. With far more than BUCKETS times the least count of n-grams the buckets fill and
prune less, and the Apriori bitmap and exact counts carry on; `buckets` is a parameter. Exact counts are keyed by whole phrases, summed in tasks and
before the shuffle; a worker numbers words exactly, so hashes only choose buckets.

A candidate of 2 to 4 words with a = f(phrase) >= the least count is cut after its first k words into parts with l and r; floor(2000000 * a / (l + r)), in decimals,
is its score at the lowest cut, ties to the smallest k. Candidates inside a longer one with 100 * f(longer) >= 80 * a are dropped. Each language's first
2000 by score, a, phrase (bytes) are ranked in two steps, so that no task orders a language's candidates.

Defined results: null and empty texts have no words; each row counts, repeated or not, null ids too; one long text is one batch of its own;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselight.llm.shared import Scratch
from caselight.llm.textbatch import PLACES, mix
from caselight.session import ship_package

#: Buckets of a pass and in a part; a power of two.
BUCKETS = 1 << 24
PART = 1 << 16
#: Bytes of text a batch, and words a worker numbers before it starts afresh.
BATCH_BYTES = 8_000_000
NUMBERED = 400_000
LONGEST = 4
SALTS = 64
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_LOWER_AND_BREAK = bytes(46 if b in _BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

_ROWS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("part", pa.int32()), ("sparse", pa.bool_()), ("data", pa.binary())])
_ROWS_DDL = "lang string, phrase string, n long, part int, sparse boolean, data binary"


class _Words:
    """Numbers of the words that a worker meets, each language's apart, with a hash of each."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        counter = itertools.count(1)
        self.by_lang: dict[str, defaultdict] = defaultdict(lambda: defaultdict(counter.__next__))
        self.words, self.langs, self.hashes = [b""], [""], np.zeros(1, np.uint64)

    def numbers(self, texts: list[str], langs: list[str]) -> np.ndarray:
        """The texts' words as numbers, 0 between pieces and texts."""
        import xxhash

        out = []
        for text, lang in zip(texts, langs, strict=True):
            found = text.encode("utf-8", "surrogatepass").translate(_LOWER_AND_BREAK).replace(b".", b" . ").split()
            known = self.by_lang[lang]
            known[b"."] = 0
            out.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
            out.append(np.zeros(1, np.int64))
        total = 1 + sum(len(k) - 1 for k in self.by_lang.values())
        if total > len(self.words):
            fresh: dict[int, tuple[bytes, str]] = {}
            least = len(self.words)
            for lang, known in self.by_lang.items():
                for word, i in reversed(known.items()):  # the newest come first
                    if i and i < least:
                        break
                    if i:
                        fresh[i] = (word, lang)
            added = [fresh[i] for i in range(least, total)]
            self.words += [w for w, _ in added]
            self.langs += [lang for _, lang in added]
            seeds = {lang: xxhash.xxh64_intdigest(lang.encode()) for _, lang in added}
            self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh64_intdigest(w, seeds[lang]) for w, lang in added], np.uint64)])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _bucket(hashes: np.ndarray, at: np.ndarray, k: int, buckets: int) -> np.ndarray:
    """Buckets of the k-grams of word hashes that start at some places."""
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = mix(h + hashes[at + j] * PLACES[j])
    return (h & np.uint64(buckets - 1)).astype(np.int64)


def _has(bits: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 != 0


def _starts(number: np.ndarray, k: int) -> np.ndarray:
    """Places where k words stand inside one piece."""
    if len(number) < k:
        return np.zeros(0, np.int64)
    inside = number[: len(number) - k + 1] > 0
    for j in range(1, k):
        inside &= number[j : len(number) - k + 1 + j] > 0
    return np.flatnonzero(inside)


def _groups(number: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of each different k-gram, its occurrences), by numbers of pairs, so exactly."""
    key = number[at]
    if k == 1:
        count = np.bincount(key)
        key = np.flatnonzero(count)
        return key[:, None], count[key]
    for j in range(1, k):
        _, dense = np.unique(key, return_inverse=True)
        key = dense.astype(np.int64) << 32 | number[at + j]
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return number[at[first][:, None] + np.arange(k)], count


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str]]]:
    """(texts, languages) of about BATCH_BYTES; rows without text are left out."""
    texts, langs, size = [], [], 0
    for b in batches:
        for text, lang, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc.binary_length(b.column(0)).to_pylist(), strict=True):
            if not text:
                continue
            if texts and size + n > BATCH_BYTES:
                yield texts, langs
                texts, langs, size = [], [], 0
            texts.append(text)
            langs.append(lang)
            size += n
    if texts:
        yield texts, langs


def _pass(documents: DataFrame, k: int, least: int, buckets: int, bitmap, frequent) -> DataFrame:
    """Rows (lang, phrase, n) of counted k-grams and (part, sparse, data) of bucket counts of (k+1)-grams, of each task."""
    kind = "<u1" if least <= 255 else "<u4"
    last = k == LONGEST

    def run(batches):
        words, filled = _Words(), None if last else np.zeros(buckets, kind)

        def passing(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Of the places, those whose k-gram may be frequent."""
            if k == 1:
                return at
            at = at[_has(frequent.value, _bucket(hashes, at, k - 1, buckets))]
            at = at[_has(frequent.value, _bucket(hashes, at + 1, k - 1, buckets))]
            return at[_has(bitmap.value, _bucket(hashes, at, k, buckets))]

        for texts, langs in _batches(batches):
            if len(words.words) > NUMBERED:
                words.reset()
            number = words.numbers(texts, langs)
            hashes = words.hashes[number]
            at = passing(hashes, _starts(number, k))
            ids, count = _groups(number, at, k)
            ids = ids.tolist()
            phrases = [b" ".join([words.words[i] for i in row]) for row in ids]
            n = len(phrases)
            yield pa.RecordBatch.from_arrays([pa.array([words.langs[row[0]] for row in ids], pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), *[pa.nulls(n, f.type) for f in list(_ROWS)[3:]]], schema=_ROWS)
            if not last and len(at):
                ok = np.zeros(len(number) + 1, bool)
                ok[at] = True
                longer = at[ok[at + 1]]
                bucket, count = np.unique(_bucket(hashes, longer, k + 1, buckets), return_counts=True)
                filled[bucket] = np.minimum(filled[bucket] + count, least)
        if last:
            return
        for part in range(0, buckets, PART):
            data = filled[part : part + PART]
            places = np.flatnonzero(data)
            if len(places):
                sparse = len(places) * 3 < len(data)
                raw = places.astype("<u2").tobytes() + data[places].tobytes() if sparse else data.tobytes()
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in list(_ROWS)[:3]], pa.array([part // PART], pa.int32()), pa.array([sparse]), pa.array([raw], pa.binary())], schema=_ROWS)

    return documents.mapInArrow(run, _ROWS_DDL)


def _bits(found: DataFrame, least: int, buckets: int) -> np.ndarray:
    """The bitmap of buckets whose counts over all tasks reach the least; parts are added up one by one."""
    kind = np.dtype("<u1" if least <= 255 else "<u4")
    size = min(PART, buckets)

    def run(batches):
        part, total = None, None
        shape = pa.schema([("part", pa.int32()), ("data", pa.binary())])

        def out():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], schema=shape)

        for b in batches:
            for p, sparse, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    if part is not None:
                        yield out()
                    part, total = p, np.zeros(size, np.int64)
                if sparse:
                    n = len(raw) // (2 + kind.itemsize)
                    total[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, kind, n, 2 * n)
                else:
                    total += np.frombuffer(raw, kind)
        if part is not None:
            yield out()

    parts = found.where("part is not null").select("part", "sparse", "data").repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, data binary").collect()
    bits = np.zeros(buckets // 8, np.uint8)
    for r in parts:
        bits[r.part * size // 8 :][: size // 8] = np.frombuffer(r.data, np.uint8)
    return bits


def _frequent_bits(counts: DataFrame, k: int, least: int, buckets: int) -> np.ndarray:
    """The bitmap of the exactly counted k-grams that reach the least count; bits of tasks are sent by part and joined by or."""

    def run(batches):
        import xxhash

        bits = np.zeros(buckets, bool)
        for b in batches:
            langs, phrases = b.column(0).to_pylist(), b.column(1).to_pylist()
            seeds = {lang: xxhash.xxh64_intdigest(lang.encode()) for lang in set(langs)}
            hashes = np.array([xxhash.xxh64_intdigest(w, seeds[lang]) for lang, p in zip(langs, phrases, strict=True) for w in p.split(" ")], np.uint64)
            bits[_bucket(hashes, np.arange(len(langs)) * k, k, buckets)] = True
        shape = pa.schema([("part", pa.int32()), ("sparse", pa.bool_()), ("data", pa.binary())])
        for part in range(0, buckets, PART):
            places = np.flatnonzero(bits[part : part + PART])
            if len(places):
                raw = places.astype("<u2").tobytes() + np.full(len(places), 1, "<u1").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part // PART], pa.int32()), pa.array([True]), pa.array([raw], pa.binary())], schema=shape)

    return _bits(counts.where(F.col("n") >= least).select("lang", "phrase").mapInArrow(run, "part int, sparse boolean, data binary"), 1, buckets)


def frequent_phrases(scratch: Scratch, documents: DataFrame, least: int = 30, buckets: int = BUCKETS, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, n: words of each language; lang, phrase, k, n: all phrases of one to four words that reach the least count)."""
    if buckets & (buckets - 1) or buckets < 8 or not 0 < least < 1 << 32:
        raise ValueError("buckets must be a power of two and the least count positive")
    spark: SparkSession = documents.sparkSession
    ship_package(spark)
    documents = documents.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    bitmap = frequent = words = None
    found: list[DataFrame] = []
    held = []
    for k in range(1, LONGEST + 1):
        rows = scratch.write(_pass(documents, k, least, buckets, bitmap, frequent))
        counts = rows.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if k == 1:
            words = scratch.write(rows.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n")))
        exact = scratch.write(counts.where(F.col("n") >= least).withColumn("k", F.lit(k)))
        found.append(exact)
        if k < LONGEST:
            old = held
            held = [spark.sparkContext.broadcast(_bits(rows, least, buckets)), spark.sparkContext.broadcast(_frequent_bits(exact, k, least, buckets))]
            bitmap, frequent = held
            for b in old:
                b.destroy()
        scratch.drop(rows)
    for b in held:
        b.destroy()
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return words, out


def _part(start: Column | int, n: Column | int) -> Column:
    """Words of a phrase, joined."""
    return F.array_join(F.slice("w", start, n), " ")


def _scored(found: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, score of every candidate at its lowest cut."""
    wide = F.col("n").cast("decimal(20,0)")
    candidates = found.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    sides = cuts.select("lang", "phrase", "k", "a", "cut", F.explode(F.array(F.struct(F.lit(True).alias("left"), _part(F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit(False).alias("left"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part")))).alias("s")).select("lang", "phrase", "k", "a", "cut", "s.left", "s.part")
    known = found.select("lang", F.col("phrase").alias("part"), "n")
    both = sides.join(known, ["lang", "part"]).groupBy("lang", "phrase", "k", "a", "cut").agg(F.max(F.when(F.col("left"), F.col("n"))).alias("l"), F.max(F.when(~F.col("left"), F.col("n"))).alias("r"))
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)")
    return both.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("lang", "phrase", "k", "a", "m.l", "m.r", "m.score")


def collocations(documents: DataFrame, least: int = 30, first: int = 2000, buckets: int = BUCKETS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    with Scratch(documents.sparkSession) as scratch:
        words, found = frequent_phrases(scratch, documents, least, buckets, text_col, lang_col)
        scored = _scored(found)
        longer = found.where("k > 2").select("lang", "k", "n", F.split("phrase", " ").alias("w"))
        spans = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
        inside = spans.select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
        covered = F.coalesce(F.col("most").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * 80, F.lit(False))
        kept = scored.join(inside, ["lang", "phrase"], "left").where(~covered).select("lang", "phrase", "a", "l", "r", "score")
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= first)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
        out = scratch.write(ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
        scratch.keep_only(out)
        return out
