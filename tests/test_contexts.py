"""Shared contexts: how they are cut and linked, against a plain reading; defined results; plans without cross joins."""

import random

from quillon.operators import contexts
from quillon.operators import questions as q

PAPER = """Đề thi
Đọc đoạn văn sau và trả lời từ câu 1 đến câu 2.
Once there was a river.
Câu 1: Who?
A. one
B. two
Dựa vào bảng số liệu, trả lời câu 3, 4 và 5
| a | b |
Câu 2: What?
Câu 3: When did all of that happen, then?
Read the following text:
Short but long enough.
Câu 4: Where?
Câu 5: Why?
"""


def test_contexts_of_a_paper(spark):
    df = spark.createDataFrame([(1, PAPER), (2, None), (3, ""), (4, "Read the following text: no questions here at all"), (None, PAPER)], "id long, text string")
    found = sorted(tuple(x)[1:] for x in contexts.shared_contexts(df).collect() if x["id"] == 1)
    assert [(a, k, f, t) for a, k, _, _, f, t in found] == [(-1, "reading_passage", 1, 2), (0, "shared_table", 3, 5), (2, "reading_passage", 4, 4)]
    assert [x[3] for x in found] == ["Once there was a river.", "| a | b |", "Short but long enough."]
    rows = sorted((x["place"], x["stem"], x["after"], len(x["options"])) for x in contexts.questions_in_context(df).collect() if x["id"] == 1)
    assert rows == [(0, "Who?", -1, 2), (1, "What?", -1, 0), (2, "When did all of that happen, then?", 0, 0), (3, "Where?", 2, 0), (4, "Why?", 0, 0)]
    assert contexts.orphans(q.question_blocks(df), contexts.shared_contexts(df)).filter("id = 1").collect() == []


def test_links_are_to_the_nearest_context_that_names_the_number(spark):
    r = random.Random(6)
    qs = [(i, k, r.randint(1, 12)) for i in range(30) for k in range(r.randint(0, 12))]
    cs = [(i, a, f, f + r.randint(0, 6)) for i in range(30) for a in r.sample(range(-1, 12), r.randint(0, 6)) for f in [r.randint(1, 12)]]
    links = contexts.context_links(spark.createDataFrame(qs, "id int, place int, number int"), spark.createDataFrame(cs, "id int, after int, first int, last int"))
    want = {}
    for i, k, n in qs:
        near = [a for j, a, f, e in cs if j == i and a < k and f <= n <= e]
        if near:
            want[i, k] = max(near)
    assert {(x["id"], x["place"]): x["after"] for x in links.collect()} == want
    plan = links._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
