"""Byte-level BPE encoding and decoding (4): a priority queue of merge ranks over a linked symbol list.

A text is split into words by the byte-level pattern, each word's bytes become symbols in a doubly linked
list, and the queue gives the pair of least rank, leftmost first; an entry whose symbols have changed since
it was queued is stale and skipped. Decoding concatenates the vocabulary strings of the ids and reads the
bytes as UTF-8. Words repeat, so each worker keeps what it has encoded, up to CACHE_WORDS pieces with a space before
them and as many other words, each of at most CACHE_WORD_CHARS characters, and starts afresh beyond; results don't
depend on that (a full cache becomes the old one, from which what is used again moves on). A word never runs over the place before a lone space, so pieces can be encoded apart; a text
where a space touches other white space is split as a whole.

Scale: rows are independent, so there is no shuffle; a worker holds the vocabulary (a file of 1.5 MB, read by
each executor from its own installation, or shipped in the closure as text if it is a local path elsewhere).

Defined results: null or empty texts have no ids and decode to the empty text; every text decodes to itself;
added tokens of the file that occur in a text get their own ids, as the tokenizers library does by default.
Repeated rows and ids each give a row, null ids stay null; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caselight.llm.textbatch import pieces
from caselight.session import ship_package

CACHE_WORDS = 160_000
CACHE_WORD_CHARS = 64
#: The split pattern of byte-level BPE, with White_Space spelt out.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file.

    Printable Latin-1 bytes stand for themselves, the others take code points from 256 on, in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: chr(b if b in own else next(others)) for b in range(256)}


class Tokenizer:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: str):
        import regex

        model = json.loads(spec)
        vocab: dict[str, int] = model["model"]["vocab"]
        to_byte = {c: b for b, c in byte_symbols().items()}
        self.added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        # An id's string as bytes; concatenation of these is decoding.
        self.pieces = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items() if s not in self.added}
        self.pieces |= {i: s.encode() for s, i in self.added.items()}
        self.byte_ids = [vocab[c] for _, c in sorted(byte_symbols().items())]
        # The rank of a pair, and the ids that the merges make, by rank.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.words: dict[str, tuple[int, str, bytes]] = {}
        self.chunks: dict[str, tuple[int, str, bytes]] = {}
        self.old_words, self.old_chunks = self.words, self.chunks
        self.touching = regex.compile(rf"^[{_SPACE}]|[{_SPACE}]$|^$").search

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word: merges by rank, then from the left. Queue entries are rank * n + place."""
        byte_ids, rank, made = self.byte_ids, self.rank.get, self.made
        ids = [byte_ids[b] for b in word.encode("utf-8", "surrogatepass")]
        n = len(ids)
        queue = [r * n + i for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        if not queue:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            r, i = divmod(pop(queue), n)
            j = after[i]
            if j < 0 or ids[i] < 0 or rank(ids[i] << 20 | ids[j]) != r:
                continue  # stale
            ids[i] = new = made[r]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (q := rank(new << 20 | ids[k])) is not None:
                    push(queue, q * n + i)
            h = before[i]
            if h >= 0 and (q := rank(ids[h] << 20 | new)) is not None:
                push(queue, q * n + h)
        return [x for x in ids if x >= 0]

    def _new(self, word: str) -> tuple[int, str, bytes]:
        ids = self.word_ids(word)
        return len(ids), ",".join(map(str, ids)), b"".join([self.pieces[i] for i in ids])

    def _word(self, word: str) -> tuple[int, str, bytes]:
        if word[0] == " " and len(word) > 1:
            return self._chunk(word[1:])
        if out := self.words.get(word):
            return out
        out = self.old_words.get(word) or self._new(word)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self.words) >= CACHE_WORDS:
                self.old_words, self.words = self.words, {}
            self.words[word] = out
        return out

    def _chunk(self, p: str) -> tuple[int, str, bytes]:
        """A piece with the space before it; a piece of one word is worked out here, others from their words."""
        if out := self.chunks.get(p):
            return out
        if not (out := self.old_chunks.get(p)):
            words = self.split(" " + p)
            out = self._new(words[0]) if len(words) == 1 else self._joined(words)
        if len(p) <= CACHE_WORD_CHARS:
            if len(self.chunks) >= CACHE_WORDS:
                self.old_chunks, self.chunks = self.chunks, {}
            self.chunks[p] = out
        return out

    def _joined(self, words: list[str]) -> tuple[int, str, bytes]:
        n, ids, raw = zip(*map(self._word, words), strict=True)
        return sum(n), ",".join(ids), b"".join(raw)

    def _part(self, part: str) -> list[tuple[int, str, bytes]]:
        """A text without added tokens: its first piece, then the others with the space before them."""
        first, *rest = part.split(" ")
        found = list(map(self.chunks.get, rest))
        if None in found or self.touching(first):
            if self.touching(first) or any(f is None and self.touching(p) for f, p in zip(found, rest, strict=True)):
                return [self._joined(self.split(part))]
            for i, f in enumerate(found):
                if f is None:
                    found[i] = self._chunk(rest[i])
        return [self._joined(self.split(first)), *found]

    def encoded(self, text: str | None) -> list[tuple[int, str, bytes]]:
        """(number of ids, ids joined by commas, their bytes) of each piece and added token."""
        if not text:
            return []
        if not (self.cut and any(t in text for t in self.added)):
            return self._part(text)
        out = []
        for part in self.cut(text):
            if part in self.added:
                i = self.added[part]
                out.append((1, str(i), self.pieces[i]))
            elif part:
                out += self._part(part)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text."""
        return [int(i) for _, s, _ in self.encoded(text) for i in s.split(",")]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join([self.pieces[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(spec_path: str, name: str = "") -> Tokenizer:
    """The tokenizer of a vocabulary file on this machine."""
    with open(spec_path, encoding="utf-8") as f:
        return Tokenizer(f.read())


def _resolve(vocabulary: str) -> str:
    """A path as it is, or the name of a file of the installed public vocabularies."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def encode(documents: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids array<int> and decoded, the text that they decode to."""
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        t = tokenizer(_resolve(vocabulary))
        for batch in pieces(batches):
            n, ids, decoded = [], [], []
            for v in batch.column(1):
                size, a, raw = zip(*e, strict=True) if (e := t.encoded(v.as_py())) else ((), (), ())
                n.append(sum(size))
                ids.append(np.array(",".join(a).split(","), np.int32) if a else np.zeros(0, np.int32))
                decoded.append(b"".join(raw).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], schema=schema)

    ship_package(documents.sparkSession)
    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` long, n_tokens long, ids array<int>, decoded string")


def encode_digests(documents: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, SHA-256 of the decimal ids joined by commas and of the decoded text.

    The same encoding and decoding as `encode`, without the ids themselves leaving the worker.
    """
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        t, sha = tokenizer(_resolve(vocabulary)), hashlib.sha256
        for batch in pieces(batches):
            n, a, b = [], [], []
            for v in batch.column(1):
                e = t.encoded(v.as_py())
                size, ids, raw = zip(*e, strict=True) if e else ((), (), ())
                n.append(sum(size))
                a.append(sha(",".join(ids).encode()).hexdigest())
                raw = b"".join(raw)
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    raw = raw.decode("utf-8", "replace").encode()
                b.append(sha(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], schema=schema)

    ship_package(documents.sparkSession)
    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
