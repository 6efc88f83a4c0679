"""Likeness of strings by matching blocks: the longest common stretch, then the same on both sides of it.

ratio = 2 * (characters in matching blocks) / (length of both), which is Python's difflib without its guess at junk. The
longest stretch is found by a suffix automaton, so a pair takes time in proportion to its length for each block instead of
to the product of the lengths; of several longest stretches the one that begins first in a counts, and then first in b.

near_texts leaves out pairs that can't reach a ratio before any block is looked for: by their lengths (SQL), then by how many
characters they share at all, whatever the order. Both are bounds from above, so no pair is lost.

Defined results: two empty strings have ratio 1, a null string counts as empty; repeated pairs get equal results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _automaton(b: str) -> tuple[list[dict[str, int]], list[int], list[int], list[int]]:
    """(next, link, length, end): the suffix automaton of b, and where the first occurrence of each state's strings ends."""
    nexts: list[dict[str, int]] = [{}]
    link, length, end = [-1], [0], [-1]
    last = 0
    for at, c in enumerate(b):
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(at)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(end[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nexts, link, length, end


def longest_match(a: str, b: str) -> tuple[int, int, int]:
    """(i, j, n): the longest stretch a[i:i+n] == b[j:j+n], of the longest the first in a, then the first in b."""
    nexts, link, length, end = _automaton(b)
    state = n = 0
    best = (0, 0, 0)
    for at, c in enumerate(a):
        while state and c not in nexts[state]:
            state = link[state]
            n = length[state]
        if c in nexts[state]:
            state = nexts[state][c]
            n += 1
        if n > best[2]:
            best = (at - n + 1, end[state] - n + 1, n)
    return best


def matched(a: str, b: str) -> int:
    """Characters in matching blocks."""
    total, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        if x and y:
            i, j, n = longest_match(x, y)
            if n:
                total += n
                todo += [(x[:i], y[:j]), (x[i + n :], y[j + n :])]
    return total


def ratio_of(a: str, b: str) -> float:
    return 1.0 if not a and not b else 2.0 * matched(a, b) / (len(a) + len(b))


def most(a: str, b: str) -> float:
    """A bound on the ratio from above: the characters that both have, in any order."""
    return 1.0 if not a and not b else 2.0 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


def match_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """The ratio of two strings, in Arrow batches; null where it is below least, which a bound tells for most such pairs."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(x: str, y: str) -> float | None:
            if most(x, y) < least:
                return None
            r = ratio_of(x, y)
            return r if r >= least else None

        for xs, ys in parts:
            yield pd.Series([one(x, y) for x, y in zip(xs, ys, strict=True)], dtype="float64")

    found = F.pandas_udf(run, "double")(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    return F.when(found.isNotNull() & ~F.isnan(found), found)


def near_texts(pairs: DataFrame, a: str, b: str, least: float = 0.88) -> DataFrame:
    """The pairs whose strings in columns a and b have a ratio of least or more, with the column ratio."""
    n, m = F.length(F.coalesce(a, F.lit(""))), F.length(F.coalesce(b, F.lit("")))
    may = (n + m == 0) | (2.0 * F.least(n, m) >= least * (n + m))
    return pairs.filter(may).withColumn("ratio", match_ratio(F.col(a), F.col(b), least)).filter("ratio IS NOT NULL")
