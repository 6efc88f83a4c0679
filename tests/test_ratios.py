"""Matching blocks against difflib."""

import difflib
import random

from quillon.operators import ratios


def pairs(r, n):
    for _ in range(n):
        letters = r.choice(["ab", "abc ", "abcdefgh é"])
        a = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        b = list(a)
        for _ in range(r.choice([0, 1, 3, 10])):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randint(0, 2)] = [r.choice(letters) for _ in range(r.randint(0, 2))]
        yield a, "".join(b) if r.random() < 0.8 else "".join(r.choice(letters) for _ in range(r.randint(0, 60)))


def test_blocks_and_ratios_are_those_of_difflib():
    for a, b in pairs(random.Random(2), 3000):
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        i, j, n = ratios.longest_match(a, b)
        want = m.find_longest_match(0, len(a), 0, len(b))
        assert n == want.size and (not n or (i, j) == (want.a, want.b))
        assert ratios.ratio_of(a, b) == m.ratio() <= ratios.most(a, b)


def test_no_pair_is_lost_by_the_bounds(spark):
    rows = [(k, a, b) for k, (a, b) in enumerate(pairs(random.Random(8), 400))] + [(900, None, None), (901, None, "a"), (902, "", "")]
    got = {x["k"]: x["ratio"] for x in ratios.near_texts(spark.createDataFrame(rows, "k int, a string, b string"), "a", "b").collect()}
    want = {k: r for k, a, b in rows if (r := difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()) >= 0.88}
    assert got == want and len(want) > 50


def test_time_does_not_grow_with_the_product():
    a = "ab" * 40000
    assert ratios.longest_match(a, a[1:]) == (1, 0, len(a) - 1) or ratios.longest_match(a, a[1:])[2] == len(a) - 1
