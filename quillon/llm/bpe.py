"""Byte-level BPE encoding and decoding.

A text is cut into pre-tokens by the tokenizer's pattern. Each pre-token is resolved in two tiers:

1. a minimal perfect hash over the vocabulary finds pre-tokens that are whole vocabulary entries;
2. for the others, a heap of mergeable pairs over the linked bytes of the pre-token applies merges by rank,
   leftmost first, in O(n log n) however long the pre-token is.

The hash is built once by the driver from the vocabulary file, whose size is fixed (50,256 entries, about 1 MB),
and broadcast. Tasks stream Arrow batches; each row depends on its own text only, so there is no shuffle, and a
lost executor costs the redoing of its tasks. Answers are remembered in two dictionaries of bounded size.

Defined results: a null or empty text has no ids and decodes to nothing; repeated rows get equal results; ids
(null or not) and other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Entries of a generation of a memo, of pre-tokens and of words between spaces.
MEMO, WORD_MEMO = 150_000, 400_000
#: Pre-tokens, and characters of a text, that are taken at once.
CHUNK_TOKENS, CHUNK_CHARS = 100_000, 1_000_000


def _mix(h: int, d: int) -> int:
    """A second hash of h, another for each d."""
    x = (h + d * 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


class PerfectHash:
    """A minimal perfect hash of n byte strings onto n slots, by hashing into n groups and displacing each group.

    Groups are placed by falling size. A group of two or more keys takes the first displacement that puts all its
    keys into free slots; a single key is sent straight to a free slot, written as a negative displacement.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        if len(set(keys)) != len(keys):
            raise ValueError("keys must differ")
        n = len(keys)
        groups: list[list[int]] = [[] for _ in range(n)]
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[h % n].append(i)
        self.shift = np.zeros(n, np.int64)
        owner = np.full(n, -1, np.int64)
        order = sorted((g for g in groups if g), key=len, reverse=True)
        many = [g for g in order if len(g) > 1]
        for g in many:
            d = 0
            while True:
                slots = [_mix(hashes[i], d) % n for i in g]
                if len(set(slots)) == len(slots) and all(owner[s] < 0 for s in slots):
                    break
                d += 1
            for i, s in zip(g, slots, strict=True):
                owner[s] = i
            self.shift[hashes[g[0]] % n] = d
        free = iter(np.flatnonzero(owner < 0).tolist())
        for g in order[len(many) :]:
            s = next(free)
            owner[s] = g[0]
            self.shift[hashes[g[0]] % n] = -s - 1
        self.n = n
        self.keys = [keys[i] for i in owner]
        self.values = [values[i] for i in owner]

    def get(self, key: bytes) -> int:
        """The value of key, or -1 if it isn't one of the keys."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = int(self.shift[h % self.n])
        slot = -d - 1 if d < 0 else _mix(h, d) % self.n
        return self.values[slot] if self.keys[slot] == key else -1


class _Memo(dict):
    """Answers of a function of one argument, in two generations of ``size`` entries each."""

    def __init__(self, answer, size: int = MEMO):
        super().__init__()
        self.answer, self.size = answer, size
        self.old: dict = {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.answer(key)
        self[key] = value
        return value


def merge(ids: list[int], rows: list[dict[int, int]]) -> list[int]:
    """Ids of a piece that isn't a vocabulary entry; ids: those of its bytes. rows[a][b] is the rank of the entry that
    the parts a and b make together.

    The parts are a linked list over the bytes: ``after[i]`` is where the part that follows the one at i begins. The
    heap holds rank and place of adjacent pairs as one number. ``now[i]`` is the rank of the pair that begins at i; an
    entry of the heap with another rank is stale.
    """
    n = len(ids)
    shift = n.bit_length()
    mask = (1 << shift) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    now, heap = [-1] * n, []
    for i in range(n - 1):
        row, b = rows[ids[i]], ids[i + 1]
        if b in row:
            now[i] = q = row[b]
            heap.append(q << shift | i)
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        x = pop(heap)
        i, r = x & mask, x >> shift
        if now[i] != r:
            continue
        j = after[i]
        after[i] = end = after[j]
        ids[i] = r
        # the part at j is part of the one at i now
        ids[j] = now[j] = now[i] = -1
        if end < n:
            before[end] = i
            row, b = rows[r], ids[end]
            if b in row:
                now[i] = q = row[b]
                push(heap, q << shift | i)
        p = before[i]
        if p >= 0:
            row = rows[ids[p]]
            if r in row:
                now[p] = q = row[r]
                push(heap, q << shift | p)
            else:
                now[p] = -1
    return [x for x in ids if x >= 0]


def _pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """(a, b, rank): the two entries and the rank of each way to cut an entry into two."""
    found = []
    for token, r in ranks.items():
        for k in range(1, len(token)):
            a = ranks.get(token[:k])
            if a is not None and (b := ranks.get(token[k:])) is not None:
                found.append((a, b, r))
    return np.array(found, np.int32).reshape(-1, 3)


class Tokenizer:
    """Encodes and decodes with one vocabulary. It is pickled with its hash; memos and patterns are made anew."""

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        self.pattern = pattern
        self.hash = PerfectHash(list(ranks), list(ranks.values()))
        self.pairs = _pairs(ranks)
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, r in ranks.items():
            self.table[r] = token
        self._start()

    def _start(self) -> None:
        self._find = regex.compile(self.pattern)
        self._double = re.compile(r"\s\s|^\s|\s$")
        self._span = re.compile(r" ?[^ ]+")
        none: dict[int, int] = {}
        self._rows = [none] * len(self.table)
        for a, b, r in self.pairs.tolist():
            if self._rows[a] is none:
                self._rows[a] = {}
            self._rows[a][b] = r
        self._byte_id = [self.hash.get(bytes([b])) for b in range(256)]
        self._ids = _Memo(self._encode_piece)
        self._span_ids = _Memo(self._encode_span)
        self._word_ids = _Memo(lambda word: self._encode_span(f" {word}"), WORD_MEMO)
        self._lengths = np.array([len(x) for x in self.table], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(self.table), np.uint8)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._start()

    def _encode_piece(self, token: str) -> bytes:
        piece = token.encode()
        whole = self.hash.get(piece)
        if whole >= 0:
            return whole.to_bytes(4, "little")
        ids = [self._byte_id[b] for b in piece]
        if min(ids) < 0:
            raise ValueError(f"the vocabulary lacks a byte of {piece[:20]!r}")
        return np.asarray(merge(ids, self._rows), "<u4").tobytes()

    def _encode_span(self, span: str) -> bytes:
        pieces = self._find.findall(span)
        return self._ids[span] if len(pieces) == 1 else b"".join(map(self._ids.__getitem__, pieces))

    def encode_spans(self, text: str) -> Iterator[list[bytes]]:
        """Ids of a text as little-endian unsigned 32-bit integers: lists, bounded in size, of the ids of spans.

        A space between two characters that aren't white space always begins a match of the pattern, so a text
        whose white space comes one at a time is cut there, and spans that return are answered from memory. In
        other texts the matches are the spans.
        """
        if self._double.search(text):
            spans, answer = (m.group() for m in self._find.finditer(text)), self._ids
        else:
            first, *rest = text.split(" ") if len(text) <= CHUNK_CHARS else ("",)
            if len(text) > CHUNK_CHARS:
                spans, answer = (m.group() for m in self._span.finditer(text)), self._span_ids
            else:
                yield [self._span_ids[first], *map(self._word_ids.__getitem__, rest)] if text else []
                return
        while found := list(islice(spans, CHUNK_TOKENS)):
            yield list(map(answer.__getitem__, found))

    def encode_chunks(self, text: str) -> Iterator[bytes]:
        """Ids of a text as little-endian unsigned 32-bit integers, in chunks of bounded size."""
        return map(b"".join, self.encode_spans(text))

    def decode_ids(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        lengths = self._lengths[ids]
        ends = np.cumsum(lengths)
        places = np.repeat(self._starts[ids] - ends + lengths, lengths)
        places += np.arange(len(places))
        return self._bytes[places].tobytes()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_chunks(text)), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.decode_ids(np.fromiter(ids, np.int64))


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks from the lines of a vocabulary file: base64 of the token, a space, the rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


def load_tokenizer(path: str, pattern: str) -> Tokenizer:
    with open(path, "rb") as lines:
        return Tokenizer(pattern, read_ranks(lines))


def _texts(column: pa.Array, rows: int = 256) -> Iterator[str]:
    for at in range(0, len(column), rows):
        for x in column.slice(at, rows).to_pylist():
            yield x or ""


def encode(docs: DataFrame, tokenizer: Tokenizer, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the ids of each whole text as an array of ints."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [np.frombuffer(b"".join(t.encode_chunks(x)), "<u4").astype(np.int32) for x in _texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, "ids"])

    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: Tokenizer, id_column: str = "doc_id") -> DataFrame:
    """(id, text as binary): the bytes that the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer)
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = [t.decode(x or ()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=[id_column, "bytes"])

    return encoded.select(id_column, "ids").mapInArrow(run, f"`{id_column}` {kind}, bytes binary")


def round_trip(docs: DataFrame, tokenizer: Tokenizer, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode the ids, and return digests of both.

    (id, n_tokens, ids_sha256, decoded_sha256, n_bytes), then the columns named in keep, then, if asked for, ids.
    Without them ids never leave the task: memory holds the ids of one chunk of a text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", *keep, *["ids"] * with_ids]

    def digests(t: Tokenizer, x: str) -> tuple[int, str, str, int, np.ndarray | None]:
        ids, back, n, size, all_ids = hashlib.sha256(), hashlib.sha256(), 0, 0, []
        for chunk in t.encode_chunks(x):
            ids.update(chunk)
            n += len(chunk) // 4
            decoded = t.decode_ids(np.frombuffer(chunk, "<u4"))
            back.update(decoded)
            size += len(decoded)
            if with_ids:
                all_ids.append(np.frombuffer(chunk, "<u4").astype(np.int32))
        return n, ids.hexdigest(), back.hexdigest(), size, np.concatenate(all_ids or [np.empty(0, np.int32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                columns = list(zip(*(digests(t, x) for x in _texts(b.column(1))), strict=True))
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()))
                made = [pa.array(c, k) for c, k in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *made[:4], *b.columns[2:], *made[4:] * with_ids], names=names)

    kept = docs.select(F.col(id_column), F.col(text).alias("text"), *[F.col(k) for k in keep])
    others = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    kind = docs.schema[id_column].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long{others}" + ", ids array<int>" * with_ids)
