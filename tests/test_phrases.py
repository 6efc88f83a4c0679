"""Places of phrases against a plain search, the dossier against the score, features, defined results."""

import random
import re

from quillon.operators import features, phrases


def test_places_are_those_of_a_plain_search():
    r = random.Random(3)
    for _ in range(300):
        words = ["".join(r.choice("abé ") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 8))]
        text = "".join(r.choice("abé _.") for _ in range(r.randint(0, 80)))
        finder = phrases.Finder(words).build()
        hits, plain = finder.find(text)
        for k, p in enumerate(finder.phrases):
            assert hits.get(k, []) == [m.start() for m in re.finditer(re.escape(p), text)]
            if k in finder.plain:
                assert len(plain.get(k, ())) == phrases.without_accents(text).count(finder.plain[k])
            whole = [m for m in re.finditer(re.escape(p), text) if not re.search(r"\w$", text[: m.start()]) and not re.match(r"\w", text[m.end() :])]
            assert finder.whole(text, k, hits.get(k, [])) == len(whole)


LEXICON = (("MATH", "tích phân", 4.0), ("MATH", "sin", 1.0), ("INFO", "thuật toán", 8.0), ("INFO", "cây", 2.0), ("CHEM", "este", 3.0))
CONFLICTS = (("INFO", "MATH", ("subtask",)),)


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_the_dossier_adds_up(spark):
    far = "x" * 1300
    docs = rows(spark, ["Môn: Toán\ntích phân và tích phân, sin" + far + "tích phân" + "y" * 1600, "subtask 1: thuật toán, tích phân", "tich phan khong dau, ESTE", None, "", "nothing"])
    dossier = phrases.evidence(docs, LEXICON, (("toán", "MATH"),), CONFLICTS, {"CHEM": 2.0})
    got = {(x["id"], x["subject"], x["phrase"], x["zone"]): (x["n"], round(x["points"], 6), x["factor"], round(x["counted"], 6)) for x in dossier.collect()}
    assert got == {
        (0, "MATH", "toán", "title"): (1, 80.0, 1.0, 80.0), (0, "MATH", "tích phân", "header"): (2, 28.0, 1.0, 28.0), (0, "MATH", "tích phân", "body"): (1, 6.772589, 1.0, 6.772589),
        (0, "MATH", "sin", "header"): (1, 3.5, 1.0, 3.5), (1, "INFO", "thuật toán", "header"): (1, 28.0, 1.0, 28.0), (1, "INFO", "thuật toán", "body"): (1, 13.545177, 1.0, 13.545177),
        (1, "INFO", "subtask", "cue"): (1, 70.0, 1.0, 70.0), (1, "MATH", "tích phân", "header"): (1, 14.0, 0.15, 2.1), (1, "MATH", "tích phân", "body"): (1, 6.772589, 0.15, 1.015888),
        (2, "MATH", "tích phân", "plain"): (1, 2.4, 1.0, 2.4), (2, "CHEM", "este", "header"): (1, 21.0, 1.0, 21.0), (2, "CHEM", "este", "body"): (1, 10.158883, 1.0, 10.158883),
    }
    verdicts = {x["id"]: x for x in phrases.classify(docs, dossier, ("MATH", "INFO", "CHEM")).collect()}
    for i in range(6):
        sums = {}
        for (j, s, *_), (*_, c) in got.items():
            if j == i:
                sums[s] = sums.get(s, 0) + c
        assert abs(verdicts[i]["score"] - max(sums.values(), default=0)) < 1e-5
    assert [verdicts[i]["subject"] for i in range(6)] == ["MATH", "INFO", "CHEM", "GENERAL", "GENERAL", "GENERAL"]
    assert [verdicts[i]["confidence"] for i in range(6)] == [1.0, 1.0, 0.98, 0.5, 0.5, 0.5] and verdicts[1]["runner_up"] == "MATH"


def test_fast_classifier_and_ties(spark):
    docs = rows(spark, ["sin sine cosin sin", "cây " * 9, "este este thuật toán", None])
    got = [(x["subject"], x["score"], x["confidence"]) for x in phrases.fast_classify(docs, LEXICON).orderBy("id").collect()]
    assert got == [("MATH", 2.0, 0.75), ("INFO", 10.0, 0.88), ("INFO", 8.0, 0.88), ("GENERAL", 0.0, 0.5)]
    tie = phrases.fast_classify(rows(spark, ["b a"]), (("X", "b", 1.0), ("A", "a", 1.0))).collect()
    assert [x["subject"] for x in tie] == ["X"]
    assert phrases.phrase_hits(rows(spark, ["a"]).limit(0), ["a"]).collect() == []


def test_features_of_odd_texts(spark):
    got = features.second_pass(features.structure_features(rows(spark, [None, "", "Câu 1: tính\nCâu 2: tìm\nCâu 3: nêu", "Time limit: 1 s, Subtask 1, lớp 10"]))).orderBy("id").collect()
    assert [x["candidates"] for x in got] == [["NOT_AN_EXAM"], ["NOT_AN_EXAM"], ["OLYMPIAD_ESSAY"], ["COMPETITIVE_PROGRAMMING"]]
    assert [x["grade"] for x in got] == [None, None, None, "OLYMPIAD_GIFTED"] and [x["n_questions"] for x in got] == [0, 0, 3, 0]
