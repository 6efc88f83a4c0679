"""Periodic runs of words by Baier's grouping: Lyndon arrays, Lyndon roots, extension.

A run is a stretch of consecutive words with smallest period q, that is, words q apart are equal, which no neighbour
extends, of at least max(min_length, min_exponent * q) words. Templated junk (menus, tables, generated rows) is such
runs; ``collapsed`` is the text without what repeats: of each run only the first q words stay.

1. Words that can be in a run are found by their trigrams: a long enough run holds each of its trigrams several times,
   so only stretches of trigrams that are that frequent in their text go on. Equal trigrams have equal hashes, so
   nothing is lost by comparing hashes.
2. The first phase of Baier's suffix sorter groups the suffixes of a stretch: groups are taken from the largest to the
   smallest; each hands its length to the groups of the suffixes right before its members that aren't taken yet, which
   splits them. When a group is taken its length is that of the longest Lyndon word at each of its members, so this is
   the Lyndon array; two members of a group have the same Lyndon word. Done under both orders of the alphabet.
3. A run holds a Lyndon root at every period, all of one group under one of the orders. Where min_exponent - 1 members
   of a group follow each other at the distance of its length, the first is extended in both directions (the longest
   common extension, in blocks that double) into a run.

Each row depends on its own text only: no shuffle, memory of one text. The work is linear in the words, plus the
extensions.

Defined results: a null text counts as empty; a text without runs has an empty list, and collapses to its words joined
by single spaces. Repeated rows get equal results; null ids pass through; other columns are not looked at. Two runs
may overlap; a word goes if it lies after the first period of any.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Texts a task turns into words at a time.
ROWS = 64
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Run = tuple[int, int, int]


def lyndon_groups(letters: Sequence[int], descending: bool = False) -> tuple[list[int], list[int]]:
    """Phase one: for each position the length of the longest Lyndon word that begins there, and its group; the end of
    the sequence is smaller than any letter in both orders.

    Positions not taken yet are a linked list. When all members of a group, in rising order, are taken out of it, the
    left neighbour of each is the nearest suffix before it that is smaller as far as is known.
    """
    n = len(letters)
    first: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(letters):
        first[c].append(i)
    members = [first[c] for c in sorted(first, reverse=descending)]
    length = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    group, lyndon = [0] * n, [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    # a place more for the two ends: index -1 is the last one
    left, right = [*range(-1, n), -1], [*range(1, n + 1), 0]
    g = len(members) - 1
    while g >= 0:
        own, moved, last, times = length[g], defaultdict(list), -1, 0
        for i in members[g]:
            if group[i] != g:
                continue
            lyndon[i] = own
            p, q = left[i], right[i]
            right[p], left[q] = q, p
            if p == last:
                times += 1
            else:
                if last >= 0:
                    moved[times, group[last]].append(last)
                last, times = p, 1
        if last >= 0:
            moved[times, group[last]].append(last)
        # what is followed by more copies is larger, so it comes to stand further up
        for (times, old), js in sorted(moved.items(), reverse=True):
            new, up = len(members), above[old]
            members.append(js)
            length.append(length[old] + times * own)
            below.append(old)
            above.append(up)
            above[old] = below[up] = new
            for j in js:
                group[j] = new
        g = below[g]
    return lyndon, group


def _agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differs = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if differs.size:
            return at + int(differs[0])
        at, step = at + step, 2 * step
    return n


def _stretch_runs(letters: np.ndarray, min_length: int, min_exponent: int) -> set[Run]:
    """Runs of a whole sequence."""
    found, n, plain = set(), len(letters), letters.tolist()
    for descending in (False, True):
        lyndon, group = map(np.array, lyndon_groups(plain, descending))
        at = np.arange(n)
        for k in range(1, min_exponent - 1):
            later = at + k * lyndon[at]
            at, later = at[later < n], later[later < n]
            at = at[group[at] == group[later]]
        done, end = 0, 0
        for i in at[np.lexsort((at, lyndon[at]))].tolist():
            p = int(lyndon[i])
            if p == done and i + p <= end:
                continue  # a later root of the run before
            start = i - _agreement(letters[:i][::-1], letters[: i + p][::-1])
            done, end = p, i + p + _agreement(letters[i:], letters[i + p :])
            if end - start >= max(min_length, min_exponent * p):
                found.add((start, end - start, p))
    return found


def _stretches(codes: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Ranges that hold all runs, by the count of their trigrams."""
    n, least = len(codes), min(min_exponent - 1, min_length - 2)
    if n < min_length:
        return []
    if least < 2:
        return [(0, n)]
    a = codes.view(np.uint64)
    tri = a[:-2] * np.uint64(0x9E3779B97F4A7C15) + a[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + a[2:]
    ranked = np.sort(tri)
    frequent = ranked[: 1 - least][ranked[: 1 - least] == ranked[least - 1 :]]
    if not frequent.size:
        return []
    edges = np.flatnonzero(np.diff(np.isin(tri, frequent), prepend=False, append=False))
    pairs = zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
    return [(b, e + 2) for b, e in pairs if e + 2 - b >= min_length]


def word_runs(words: Sequence[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """(start, length, period) of the runs of a list of words, by start, then period."""
    codes = np.fromiter(map(hash, words), np.int64, len(words))
    out: list[Run] = []
    for b, e in _stretches(codes, min_length, min_exponent):
        numbers: dict[bytes, int] = {}
        letters = np.array([numbers.setdefault(w, len(numbers)) for w in words[b:e]])
        out += [(b + s, n, p) for s, n, p in _stretch_runs(letters, min_length, min_exponent)]
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def collapse(words: Sequence[bytes], runs: Sequence[Run]) -> bytes:
    """The words that lie in no run after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(stays).tolist()])


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(id, n_words, runs array<struct<start, length, period>>, collapsed) of each whole text."""
    if min_exponent < 2 or min_length < 1:
        raise ValueError("a run has at least two periods and one word")
    schema = pa.schema([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])

    def read(x: bytes | None) -> tuple[int, list[dict], str]:
        words = (x or b"").split()  # bytes split at exactly the separators of words
        runs = word_runs(words, min_length, min_exponent)
        shown = [{"start": s, "length": n, "period": p} for s, n, p in runs]
        return len(words), shown, collapse(words, runs).decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                columns = zip(*map(read, b.column(1).to_pylist()), strict=True)
                made = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *made], names=[id_column, *schema.names])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
