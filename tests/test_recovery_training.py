"""Recovery: faults fall by round and good questions are parsed once. Training: a numpy twin, whatever the partitions."""

import random

import numpy as np

from quillon.operators import recovery, training


def test_only_faults_are_parsed_again(spark):
    paper = "Câu 1: one good question\nA. a\nB. b\nCâu 402: swallowed here\nA - x\nB - y\nC – z\nCâu 2: next\nCâu 3: dashes all of them\nA - p\nB - q\nC - r\nD - s\nCâu 4: two dashes only\nA - p\nB - q"
    df = spark.createDataFrame([(1, paper), (2, None), (3, "Câu 1: fine")], "id long, text string")
    rows = recovery.recovered(df).orderBy("id", "place").collect()
    assert [(x["id"], x["place"], x["number"], [o["text"] for o in x["options"]], x["parsed"], x["how"]) for x in rows] == [
        (1, 0, 1, ["a", "b"], 2, "cut"), (1, 1, 402, ["x", "y", "z"], 3, "dashes"), (1, 2, 2, [], 1, None), (1, 3, 3, ["p", "q", "r", "s"], 2, "dashes"),
        (1, 4, 4, [], 1, None), (3, 0, 1, [], 1, None),
    ]
    assert rows[1]["stem"] == "swallowed here" and rows[3]["stem"] == "dashes all of them"


def numpy_epochs(scores, target, epochs, rate, per):
    names = sorted({s for row in scores for s in row} | set(target))
    m = np.ones(len(names))
    x = np.array([[row.get(s, 0.0) for s in names] for row in scores])
    t = np.array([names.index(s) for s in target])
    for _ in range(epochs):
        y = np.where(x > 0, x * m, -np.inf).argmax(1)
        bad = y != t
        gain = np.bincount(t[bad], minlength=len(names)) * training.GAIN - np.bincount(y[bad], minlength=len(names))
        touched = np.isin(np.arange(len(names)), [*t[bad], *y[bad]])
        m = np.where(touched, np.clip(m + rate * gain / per, training.LOWEST, training.HIGHEST), m)
        yield dict(zip(names, m, strict=True)), float((~bad).mean())


def test_training_is_its_numpy_twin(spark):
    r = random.Random(5)
    scores = [{s: r.choice([1.0, 2.0, 2.5, 4.0]) for s in r.sample("ABCDE", r.randint(1, 4))} for _ in range(300)]
    target = [r.choice("ABCDE") for _ in scores]
    long = spark.createDataFrame([(i, s, v) for i, row in enumerate(scores) for s, v in row.items()], "id long, subject string, score double")
    expected = spark.createDataFrame([(i, t) for i, t in enumerate(target)] + [(999, "A"), (998, None)], "id long, target string")
    rows = training.evidence_rows(long, expected)
    for per in (1.0, 50.0):
        want = list(numpy_epochs(scores, target, 6, 0.05, per))
        for parts in (1, 7):
            got = training.train(rows.repartition(parts), 6, 0.05, per)
            for e, (m, accuracy) in zip(got, want, strict=True):
                assert abs(e.accuracy - accuracy) < 1e-12 and all(abs(e.multipliers.get(s, 1.0) - v) < 1e-9 for s, v in m.items())
                assert all(training.LOWEST <= v <= training.HIGHEST for v in e.multipliers.values())
    assert training.train(rows.limit(0), 1)[0].accuracy == 0.0
