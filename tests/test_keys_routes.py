"""Content keys of both normal forms; routes against all pairs."""

import random
import unicodedata

from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import papers


def test_one_text_in_two_normal_forms_has_one_key(spark):
    texts = ["Đề thi Toán học", "café – naïve", "plain", "", "ﬁne Å Å", "가나다"]
    rows = [(i, f, unicodedata.normalize(f, t)) for i, t in enumerate(texts) for f in ("NFC", "NFD")] + [(99, "NFC", None), (99, "NFD", None)]
    keys = spark.createDataFrame(rows, "i int, form string, text string").select("i", tx.content_key(F.col("text")).alias("k"), tx.composed(F.col("text")).alias("c")).collect()
    assert all(len({x["k"] for x in keys if x["i"] == i}) == 1 for i in {x["i"] for x in keys})
    assert all(x["c"] == (None if x["c"] is None else unicodedata.normalize("NFC", x["c"])) for x in keys)


def test_routes_are_the_best_of_all_pairs(spark):
    r = random.Random(4)
    pick = lambda: r.choice(["a", "b", "c", "*", None])
    docs = [(i, pick(), pick(), pick()) for i in range(200)]
    channels = [(f"ch{k}", r.choice(["a", "b", "*"]), r.choice(["a", "b", "*"]), r.choice(["a", "c", "*"])) for k in range(40)]
    # many channels for any subject are no limit
    channels += [(f"x{k}", "*", f"kind{k}", "*") for k in range(10_050)]
    want = {}
    for i, *own in docs:
        scored = []
        for name, *c in channels[:40]:
            points = [w // 2 if y == "*" else w if x == y else None for x, y, w in zip(own, c, (50, 30, 20), strict=True)]
            if None not in points:
                scored.append((sum(points), name))
        if scored:
            want[i] = max(scored)[::-1]
    got = papers.routes(spark.createDataFrame(docs, "id int, subject string, kind string, level string"), spark.createDataFrame(channels, "channel string, subject string, kind string, level string"))
    assert {x["id"]: (x["channel"], x["score"]) for x in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
