"""Cross-tokenizer alignment (11): which ids of two tokenizers cover the same bytes, and how often in the corpus.

A byte-level BPE (A) encodes space+text, a piece model with byte fallback (B) the text, before which it puts its own
space. Places where tokens of both end cut the bytes into groups; every A and B token of a group is a link.
Postings cogroup: each batch of documents becomes postings, one row an A id and batch, that hold the (B id, document,
multiplicity) of its linked pairs in order. They are written once, with one row a document of its own figures.
The documents of each pair are counted with sums inside tasks first. Then counts and postings meet by A id: they are shuffled by it and
sorted, counts first, so a task holds the counts of one A id (at most one for each id of B) and streams that id's postings past them; the
highest count is local. It emits what documents gain, summed and packed by batch of documents, and those are summed by document.

Scale: pieces between lone spaces are encoded apart (no token of either crosses the place before a lone space), and a worker keeps
what it has encoded, CACHE_PIECES at most between batches; a batch is BATCH_BYTES of text or one longer text. An A id of more
than SALT_ENTRIES postings is split by batches into so many parts, each with the id's counts; the table of such ids
has at most one row for each id of A, so it is broadcast. Sorts and shuffles spill; everything read twice is a written table.

Defined results: texts that are null, empty or that B doesn't give back byte for byte (U+2581 is a space to it) have no tokens: zeros and ''
for the groups. Each row is a document of its own, so repeated rows count each and null ids stay null; special tokens' strings
are plain text; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.bpe import _SPACE, _resolve, byte_symbols
from caselight.llm.shared import Scratch
from caselight.session import ship_package

#: Bytes of text and rows of a batch; rows of a batch are numbered with 16 bits.
BATCH_BYTES = 4_000_000
BATCH_ROWS = 1 << 16
#: Pieces a worker keeps when a batch begins; those met once go first.
CACHE_PIECES = 250_000
#: Postings of one A id that one task streams.
SALT_ENTRIES = 4_000_000
#: Postings held before they are summed by document.
HELD = 2_000_000
#: Bits of an id; both vocabularies are smaller.
BITS = 20
_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    """Groups and linked pairs of texts under two vocabularies, with what it has worked out by piece."""

    def __init__(self, path_a: str, path_b: str):
        import regex
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        to_byte = {c: b for b, c in byte_symbols().items()}
        added = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        own = {i: s for s, i in self.a.get_vocab().items()}
        self.bytes_a = [added[i].encode() if i in added else bytes(to_byte[c] for c in own.get(i, "")) for i in range(max(own) + 1)]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.vocab_size()) for p in [self.b.id_to_piece(i)]]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << BITS:
            raise ValueError(f"a vocabulary has more than {1 << BITS} ids")
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = ([b"%d" % i for i in range(len(x))] for x in (self.bytes_a, self.bytes_b))
        self.touching = regex.compile(rf"^[{_SPACE}]|[{_SPACE}]$|^$").search
        self.lone = regex.compile(rf"(?<=[^{_SPACE}]) (?=[^{_SPACE}])").split
        self._keep(np.zeros(0, np.int64))

    def _keep(self, ids: np.ndarray) -> None:
        """Forgets all pieces but these; piece 0 stands for pieces that touch white space and is nobody's."""
        if len(ids) == 0:
            self.names, self.groups, self.figures = [None], [b""], np.zeros((1, 5), np.int64)
            self.at, self.pairs, self.times = np.zeros(2, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            ids = np.concatenate([[0], ids])
            self.names, self.groups = [self.names[i] for i in ids], [self.groups[i] for i in ids]
            self.figures = self.figures[ids]
            n = self.at[ids + 1] - self.at[ids]
            take = _ranges(self.at[ids], n)
            self.pairs, self.times, self.at = self.pairs[take], self.times[take], np.concatenate([[0], np.cumsum(n)])
        self.hits = np.zeros(len(self.names), np.int64)
        self.index = {k: i for i, k in enumerate(self.names) if isinstance(k, str)}
        self.wholes = {k[0]: i for i, k in enumerate(self.names) if isinstance(k, tuple)}

    def _places(self, text: str) -> list[int]:
        """Numbers of a text's pieces; new ones wait in self.names."""
        get = self.index.get
        parts = text.split(" ")
        out = list(map(get, parts))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    out[i] = self._number(parts[i])
        if 0 not in out:
            return out
        out = []
        for p in self.lone(text):
            if i := self.index.get(p) or self.wholes.get(p):
                out.append(i)
            else:
                self.wholes[p] = len(self.names)
                out.append(len(self.names))
                self.names.append((p,))
        return out

    def _number(self, p: str) -> int:
        if (i := self.index.get(p)) is None:
            if self.touching(p):
                i = 0
            else:
                i = len(self.names)
                self.names.append(p)
            self.index[p] = i
        return i

    def _work_out(self) -> None:
        """Encodes and aligns the pieces that wait."""
        new = [k if isinstance(k, str) else k[0] for k in self.names[len(self.groups) :]]
        if not new:
            return
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in new], add_special_tokens=False)]
        ids_b = self.b.encode(new, num_threads=1)
        na, nb = (np.fromiter(map(len, x), np.int64, len(new)) for x in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (ids_a, ids_b))
        same = np.ones(len(new), bool)
        for i, p in enumerate(new):
            raw = (" " + p).encode()
            same[i] = b"".join([self.bytes_a[x] for x in ids_a[i]]) == raw and b"".join([self.bytes_b[x] for x in ids_b[i]]) == raw
        # Pieces that don't come back have no part in any document that counts; their bytes needn't agree.
        good_a, good_b = np.repeat(same, na), np.repeat(same, nb)
        flat_a, flat_b, na, nb = flat_a[good_a], flat_b[good_b], na * same, nb * same
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        size_a, size_b = (np.bincount(g, minlength=len(cuts)) for g in (group_a, group_b))
        piece = np.repeat(np.arange(len(new)), na)[np.cumsum(size_a) - 1] if len(cuts) else np.zeros(0, np.int64)
        links = size_a * size_b
        n_groups = np.bincount(piece, minlength=len(new))
        n_links = np.zeros(len(new), np.int64)
        np.add.at(n_links, piece, links)
        # Linked pairs by (group, id) with counts, so that a group's repeats aren't paired one by one.
        ga, ca = np.unique(group_a << BITS | flat_a, return_counts=True)
        gb, cb = np.unique(group_b << BITS | flat_b, return_counts=True)
        start, stop = (np.searchsorted(gb >> BITS, ga >> BITS, side) for side in ("left", "right"))
        of_a, of_b = np.repeat(np.arange(len(ga)), stop - start), _ranges(start, stop - start)
        low = (1 << BITS) - 1
        pair, times = (ga[of_a] & low) << BITS | gb[of_b] & low, ca[of_a] * cb[of_b]
        of_piece = piece[ga[of_a] >> BITS]
        order = np.lexsort((pair, of_piece))
        pair, times, of_piece = pair[order], times[order], of_piece[order]
        first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (of_piece[1:] != of_piece[:-1])]) if len(pair) else np.zeros(0, np.int64)
        self.pairs = np.concatenate([self.pairs, pair[first]])
        self.times = np.concatenate([self.times, np.add.reduceat(times, first) if len(first) else times])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.bincount(of_piece[first], minlength=len(new)))])
        self.figures = np.concatenate([self.figures, np.stack([na, nb, n_groups, n_links, 1 - same], 1)])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        ta, tb = [self.text_a[i] for i in flat_a.tolist()], [self.text_b[i] for i in flat_b.tolist()]
        i = j = 0
        shown = []
        for x, y in zip(size_a.tolist(), size_b.tolist(), strict=True):
            shown.append(b",".join(ta[i : i + x]) + b"|" + b",".join(tb[j : j + y]))
            i, j = i + x, j + y
        at = 0
        for n in n_groups.tolist():
            self.groups.append(b";".join(shown[at : at + n]))
            at += n

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(figures a text, SHA-256 of its groups, keys pair << 16 | text in order, their multiplicities)."""
        if len(self.names) > CACHE_PIECES:
            self._keep(np.flatnonzero(self.hits > 1))
        places = [self._places(t) if t else [] for t in texts]
        self._work_out()
        n = np.fromiter(map(len, places), np.int64, len(places))
        flat = np.fromiter((i for p in places for i in p), np.int64, int(n.sum()))
        self.hits += np.bincount(flat, minlength=len(self.hits))
        text = np.repeat(np.arange(len(places)), n)
        figures = np.zeros((len(places), 5), np.int64)
        some = np.flatnonzero(n)
        for c in range(5 if len(some) else 0):
            figures[some, c] = np.add.reduceat(self.figures[flat, c], (np.cumsum(n) - n)[some])
        ok = (figures[:, 4] == 0) & (n > 0)
        figures = figures[:, :4] * ok[:, None]
        digests = [hashlib.sha256(b";".join([self.groups[i] for i in p])).hexdigest() if o else "" for p, o in zip(places, ok.tolist(), strict=True)]
        kept = ok[text] if len(text) else np.zeros(0, bool)
        used, count = np.unique(text[kept] << 40 | flat[kept], return_counts=True)
        doc, p = used >> 40, used & ((1 << 40) - 1)
        size = self.at[p + 1] - self.at[p]
        take = _ranges(self.at[p], size)
        key = self.pairs[take] << 16 | np.repeat(doc, size)
        times = self.times[take] * np.repeat(count, size)
        order = np.argsort(key)
        key, times = key[order], times[order]
        if not len(key):
            return figures, digests, key, times
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return figures, digests, key[first], np.add.reduceat(times, first)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., n places each, one after another."""
    if not len(n) or not (total := int(n.sum())):
        return np.zeros(0, np.int64)
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(total)


@lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most BATCH_BYTES of text and BATCH_ROWS rows, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(np.array([0 if v is None else v for v in pc.binary_length(b.column(1)).to_pylist()], np.int64))
        i = 0
        while i < b.num_rows:
            j = int(np.searchsorted(size, (size[i - 1] if i else 0) + BATCH_BYTES, "right"))
            j = min(max(j, i + 1), i + BATCH_ROWS)
            yield b.slice(i, j - i)
            i = j


def _blob(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values, cut from one array at places."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


_POSTINGS = pa.schema(
    [("kind", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in _FIGURES], ("groups_sha256", pa.string()), ("a", pa.int32()), ("n", pa.int64()), ("b", pa.binary()), ("d", pa.binary()), ("m", pa.binary())]
)
_POSTINGS_DDL = "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, n long, b binary, d binary, m binary"


def _table(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in _POSTINGS], schema=_POSTINGS)


def _encoded(documents: DataFrame, vocabulary_a: str, vocabulary_b: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of kind 0, one a document (row: its number in the table), and of kind 1, the postings of an A id in a batch (row: the batch's first)."""

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = _aligner(_resolve(vocabulary_a), _resolve(vocabulary_b))
        first = TaskContext.get().partitionId() << 40
        for batch in _batches(batches):
            figures, digests, key, times = aligner.batch(batch.column(1).to_pylist())
            n = batch.num_rows
            yield _table(n, kind=pa.array(np.zeros(n, np.int32)), row=pa.array(first + np.arange(n)), doc_id=batch.column(0).cast(pa.int64()), groups_sha256=pa.array(digests, pa.string()), **{c: pa.array(figures[:, i]) for i, c in enumerate(_FIGURES)})
            if len(key):
                a = key >> (16 + BITS)
                at = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True])
                wide = int(times.max()) > 0xFFFF
                b, d = (key >> 16 & ((1 << BITS) - 1)).astype("<u4" if len(aligner.bytes_b) > 1 << 16 else "<u2"), (key & 0xFFFF).astype("<u2")
                rows = len(at) - 1
                yield _table(rows, kind=pa.array(np.ones(rows, np.int32)), row=pa.array(np.full(rows, first)), a=pa.array(a[at[:-1]].astype(np.int32)), n=pa.array(np.diff(at)), b=_blob(b, at), d=_blob(d, at), m=_blob(times.astype("<i8" if wide else "<u2"), at))
            first += BATCH_ROWS

    ship_package(documents.sparkSession)
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _POSTINGS_DDL)


_WIDTHS = {2: "<u2", 4: "<u4", 8: "<i8"}


def _read(blobs: pa.Array, n: np.ndarray) -> np.ndarray:
    """The numbers of binary values, n in each; their widths follow from n."""
    blobs, total = blobs.to_pylist(), int(n.sum())
    if (size := sum(map(len, blobs))) == 2 * total:
        return np.frombuffer(b"".join(blobs), "<u2").astype(np.int64)
    if size == 8 * total:
        return np.frombuffer(b"".join(blobs), "<i8")
    return np.concatenate([np.frombuffer(b, _WIDTHS[len(b) // k]).astype(np.int64) for b, k in zip(blobs, n.tolist(), strict=True)])


def _pair_counts(postings: DataFrame) -> DataFrame:
    """a, b, n: the documents that link each pair, summed inside tasks, then over them."""
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def flush(held: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        pair, at = np.unique(np.concatenate(held), return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, at, np.concatenate(counts))
        return pair, total

    def out(pair: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(pair), 100_000):
            p = pair[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array((p >> BITS).astype(np.int32)), pa.array((p & ((1 << BITS) - 1)).astype(np.int32)), pa.array(total[i : i + 100_000])], schema=schema)

    def run(batches):
        held, counts, size = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).to_numpy()
            pair = np.repeat(batch.column(0).to_numpy().astype(np.int64), n) << BITS | _read(batch.column(2), n)
            u, c = np.unique(pair, return_counts=True)
            held.append(u)
            counts.append(c)
            size += len(u)
            if size > HELD:
                pair, total = flush(held, counts)
                if len(pair) > HELD // 2:
                    yield from out(pair, total)
                    held, counts, size = [], [], 0
                else:
                    held, counts, size = [pair], [total], len(pair)
        if held:
            yield from out(*flush(held, counts))

    return postings.select("a", "n", "b").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the gains of each batch of documents, which come one after another."""
    last, best, total = None, np.zeros(BATCH_ROWS, np.int64), np.zeros(BATCH_ROWS, np.int64)

    def out() -> pa.RecordBatch:
        d = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(last + d), pa.array(best[d]), pa.array(total[d])], names=["row", "n_best", "count_sum"])

    for batch in batches:
        for base, d, b, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if base != last:
                if last is not None:
                    yield out()
                last, best[:], total[:] = base, 0, 0
            at = np.frombuffer(d, "<u2")
            best[at] += np.frombuffer(b, np.int64)
            total[at] += np.frombuffer(t, np.int64)
    if last is not None:
        yield out()


def _gains(counts: DataFrame, postings: DataFrame) -> DataFrame:
    """row, n_best, count_sum of every document with links, from counts and postings that meet by A id."""
    hot = counts.groupBy("a").agg(F.sum("n").alias("entries")).where(F.col("entries") > SALT_ENTRIES).select("a", F.ceil(F.col("entries") / SALT_ENTRIES).cast("int").alias("parts"))
    hot = F.broadcast(hot)  # at most one row for each id of A
    parts = F.coalesce("parts", F.lit(1))
    left = counts.join(hot, "a", "left").select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind"), F.col("b").alias("id"), "n", *[F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("b", "binary"), ("d", "binary"), ("m", "binary"))])
    right = postings.join(hot, "a", "left").select("a", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("id"), "n", "row", "b", "d", "m")
    met = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    schema = pa.schema([("base", pa.int64()), ("d", pa.binary()), ("best", pa.binary()), ("total", pa.binary())])

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """What the documents gain, summed and packed: a row a batch of documents."""
        row, best, total = map(np.concatenate, zip(*held, strict=True))
        order = np.argsort(row)
        row = row[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        best, total = (np.add.reduceat(x[order], first) for x in (best, total))
        row = row[first]
        base = row & ~0xFFFF
        at = np.flatnonzero(np.r_[True, base[1:] != base[:-1], True])
        return pa.RecordBatch.from_arrays([pa.array(base[at[:-1]]), _blob((row & 0xFFFF).astype("<u2"), at), _blob(best, at), _blob(total, at)], schema=schema)

    def run(batches):
        count, known, last, most = np.zeros(1 << BITS, np.int64), [], None, 0
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            kind, n = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]), True])
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if kind[i] == 0:
                    if key[i] != last:
                        for k in known:
                            count[k] = 0
                        known, last, most = [], key[i], 0
                    ids = batch.column(3).slice(i, j - i).to_numpy()
                    count[ids] = n[i:j]
                    known.append(ids)
                    most = max(most, int(n[i:j].max()))
                    continue
                while i < j:  # some rows at a time, of HELD postings at most or one row
                    k = max(i + 1, i + int(np.searchsorted(np.cumsum(n[i:j]), HELD, "right")))
                    b, d, m = (_read(batch.column(c).slice(i, k - i), n[i:k]) for c in (6, 7, 8))
                    row = np.repeat(batch.column(5).slice(i, k - i).to_numpy(), n[i:k]) + d
                    held.append((row, np.where(count[b] == most, m, 0), count[b] * m))
                    size += len(row)
                    if size >= HELD:
                        yield flush(held)
                        held, size = [], 0
                    i = k
        if held:
            yield flush(held)

    return met.select("a", "part", "kind", "id", "n", "row", "b", "d", "m").mapInArrow(run, "base long, d binary, best binary, total binary").repartition("base").sortWithinPartitions("base").mapInArrow(_summed, "row long, n_best long, count_sum long")


def align(documents: DataFrame, vocabulary_a: str = "byte_bpe_50k.json", vocabulary_b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    with Scratch(documents.sparkSession) as scratch:
        encoded = scratch.write(_encoded(documents, vocabulary_a, vocabulary_b, id_col, text_col))
        postings = encoded.where("kind = 1")
        counts = scratch.write(_pair_counts(postings))
        gains = scratch.write(_gains(counts, postings))
        scratch.keep_only(encoded, gains)
        rows = encoded.where("kind = 0").select("row", F.col("doc_id").alias(id_col), *_FIGURES, "groups_sha256")
        zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
        return rows.join(gains, "row", "left").select(id_col, *_FIGURES, *zero, "groups_sha256")


def pair_table(documents: DataFrame, vocabulary_a: str = "byte_bpe_50k.json", vocabulary_b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, n: every linked pair of ids with the number of documents that link it; the map from one vocabulary to the other."""
    with Scratch(documents.sparkSession) as scratch:
        encoded = scratch.write(_encoded(documents, vocabulary_a, vocabulary_b, id_col, text_col).where("kind = 1").select("a", "n", "b"))
        scratch.keep_only(encoded)
        return _pair_counts(encoded)
