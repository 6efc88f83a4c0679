"""Work that has to grow no faster than the input: plans, counts of comparisons, sizes of what a task holds."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import text as tx
from quillon.operators import contests, contexts, features, papers, phrases, questions, recovery, similarity
from quillon.sources import session
from quillon.plans import exams, small
from quillon.streaming import stateful


def test_keys_of_fingerprints_are_not_broadcast(spark, tmp_path):
    rows = spark.createDataFrame([(0,), (7,), (15,), (1 << 62,)], "fp long")
    rows.write.parquet(str(tmp_path / "fp"))
    near = similarity.near_fingerprints(spark.read.parquet(str(tmp_path / "fp")))
    assert "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, near.collect())) == [(0, 7, 3), (0, 1 << 62, 1), (7, 15, 1)]


def test_names_of_many_rows_are_compared_once(spark, monkeypatch):
    compared = spark.sparkContext.accumulator(0)

    def counting(a, b):
        def of(x, y):
            compared.add(1)
            return 1.0 if x == y else 0.75

        return F.udf(of, "double")(a, b)

    names = ("hot bolt", "hot bolts", "cold ring")
    rows = spark.createDataFrame([("g", i, names[i % 3]) for i in range(60)], "g string, id long, name string")
    want = sorted((a, b, 1.0 if a % 3 == b % 3 else 0.75) for b in range(60) for a in range(b))
    monkeypatch.setattr(tx, "levenshtein_similarity", counting)
    assert sorted(map(tuple, similarity.similar_names(rows, ["g"], 0.5).collect())) == want
    # six pairs of names, though a planner may ask twice
    assert 0 < compared.value <= 24


def test_performances_are_those_of_the_halves(monkeypatch):
    r = np.random.default_rng(5)
    asked = []
    sums = contests._sums
    for ratings in (r.integers(0, 3334, 900), np.round(r.uniform(-300, 6000, 400), 2), np.zeros(200)):
        others, count = np.unique(ratings.astype(float), return_counts=True)
        rating = np.repeat(r.choice(others, 600), 2)
        rank = r.integers(1, len(ratings) + 1, len(rating)).astype(float)
        own, at = np.unique(rating, return_inverse=True)
        want = np.round(contests._halved(rating, np.sqrt(rank * (0.5 + sums(own, others, count)[at])), others, count), 1)
        monkeypatch.setattr(contests, "_sums", lambda x, o, c: (asked.append(len(x)), sums(x, o, c))[1])
        assert (contests._performance(rating, rank, others, count) == want).all()
        monkeypatch.setattr(contests, "_sums", sums)
    # exact seeds are asked for at ratings off the grid and near the middle of two roundings only
    assert sum(asked) < 2000


def test_ban_status_cuts_fractions_of_seconds():
    import duckdb

    db = duckdb.connect()
    db.sql("CREATE TABLE events AS SELECT 1 AS user_id, 'error' AS event_type, TIMESTAMP '2024-01-29 23:59:59.7' AS ts")
    assert db.sql(small.ORACLE_SQL["ban_status"]).fetchall()[0][3] == "59m 59s"


def test_raids_come_out_in_pieces():
    class Events:
        schema = T.StructType([T.StructField("k", T.StringType())])
        select = withWatermark = groupBy = lambda self, *a: self
        applyInPandasWithState = lambda self, step, *a: step

    class State:
        exists = hasTimedOut = False
        update = setTimeoutTimestamp = lambda self, x: None
        getCurrentWatermarkMs = lambda self: 0

    frame = pd.DataFrame({"k": "x", "ts": pd.to_datetime(range(1, 25_001), unit="s"), "event_id": range(25_000)})
    out = list(stateful.raids(Events(), "k", 60, 3, 300)(("x",), iter([frame[12_000:], frame[:12_000]]), State()))
    assert max(map(len, out)) <= 10_000 and [i for o in out for i in o["event_id"]] == list(range(2, 25_000))
    assert [x for o in out for x in o["started"]] == [True] + [False] * 24_997


def test_zones_count_from_their_own_beginning():
    finder = phrases.Finder(["that"]).build()
    text = "x" * 1198 + "thathat" + "y" * 2000
    assert finder.zones(text, 0, finder.find(text)[0][0]) == (0, text[1200 : len(text) - 1500].count("that")) == (0, 1)


def test_patterns_look_at_one_character_first():
    for phrase in ("câu", "đáp", "hết", "ứng", "số"):
        for first in (phrase[0], phrase[0].upper()):
            assert re.match(questions.begins((phrase,)), first)
    assert not re.search(questions.begins(questions.LONG_LABELS), "xyz 123 .:")


def test_papers_are_dealt_out_once(spark, sf_dir, monkeypatch):
    for made in (exams.papers, exams.passages):
        plan = made(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "RoundRobin" not in plan
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    rows = session.read_table(spark, sf_dir, "lineitem")
    assert session.dealt(rows, "l_orderkey").rdd.getNumPartitions() == -(-rows.count() // 100)


def test_cuts_are_those_of_a_split(spark):
    texts = ["", "1. ab 2. cd", "x1. 2. y", "no", "1. own \uffff seam 2. z", "\uffff", "\uffff1. \uffff"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    cut = rows.select(questions.cut_before(F.col("t"), r"(?=\d\.)").alias("a"), F.split("t", r"(?=\d\.)").alias("b")).collect()
    assert all(r.a == r.b for r in cut)


def test_problems_of_keys_need_no_join(spark, sf_dir, tmp_path):
    q = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3), (None, 3), (2, 9)], "id int, number int")
    k = spark.createDataFrame([(1, 1, "A"), (1, 7, "E"), (1, 7, "B"), (None, 3, "C"), (2, 9, None), (1, 1, "x")], "id int, number int, letter string")
    want = [(1, 2, "unanswered"), (1, 7, "orphan"), (1, 7, "orphan"), (1, 7, "invalid"), (1, 1, "invalid"), (None, 3, "orphan"), (None, 3, "unanswered")]
    assert sorted(map(str, map(tuple, papers.key_problems(q, k).collect()))) == sorted(map(str, want))
    import duckdb

    lineitem = duckdb.connect().sql(f"SELECT * REPLACE (CASE WHEN l_partkey % 7 > 0 THEN l_partkey END AS l_partkey) FROM '{sf_dir}/lineitem.parquet'")
    want = lineitem.query("lineitem", small.ORACLE_SQL["key_problems"]).fetchall()
    lineitem.write_parquet(str(tmp_path / "lineitem.parquet"))
    got = small.QUERIES["key_problems"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    for found in (papers.key_problems(q, k), small.QUERIES["key_problems"](spark, sf_dir)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange ") == 1


def test_letters_of_scripts_are_looked_up(spark):
    texts = [None, "", "plain ascii - only", "ÀÂ éÉ ŒŸ ư Đđ ự!", "がガ한글漢字 Жж \U0001f600 \u0301é]-^", "x" * 50 + "ŷỹ" * 30]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    want = rows.select(*[F.regexp_count(F.lower(F.coalesce("t", F.lit(""))), F.lit(p)).alias(k) for k, p in tx.SCRIPTS.items()]).collect()
    found = rows.select(*[c.alias(k) for k, c in tx.script_counts(F.col("t")).items()])
    assert found.collect() == want and any(map(any, want))
    # only ranges are matched by patterns, and over what isn't ASCII
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert tx.SCRIPTS["french"] not in plan and tx.SCRIPTS["vietnamese"] not in plan and "[\\x00-\\x7F]+" in plan


def test_keys_of_a_paper_are_written_with_its_faults_only(spark, monkeypatch):
    asked = "".join(f"Question {k}: What about lot {k}?\nA. up\nB. down\nC. away\n" for k in range(1, 6))
    dashes = "Question 6: What about the lot?\nA - up\nB - down\nC - away\n"
    text = asked + dashes + "Answer key\n" + " ".join(f"{k}-{'ABC'[k % 3]}" for k in range(1, 7))
    written = []
    write = recovery.materialize
    monkeypatch.setattr(recovery, "materialize", lambda df, label: (written.append(write(df, label)), written[-1])[1])
    got = recovery.recovered(spark.createDataFrame([(1, text)], "id long, text string"))
    assert [(r.number, r.answer, r.parsed) for r in got.orderBy("number").collect()] == [(k, "ABC"[k % 3], 1 + (k == 6)) for k in range(1, 7)]
    assert [w.filter("codes IS NOT NULL").count() for w in written] == [1, 0]


def test_problems_shuffle_no_texts(spark, sf_dir):
    found = exams.exam_problems(spark, sf_dir)
    for line in found._jdf.queryExecution().executedPlan().toString().splitlines():
        if "Window [lag(" in line:
            break
    else:
        raise AssertionError("no window")
    node = found._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Window":
        node = node.children().head()
    below = node.children().head().output().mkString(",")
    assert "own" in below and not any(c in below for c in ("stem", "options", "raw", "answer"))


def test_features_are_looked_for_where_their_words_are(spark):
    texts = [None, "", "no feature at all", "READING PASSAGE 1\nword-formation, LỚP 12", "Clo\u017fe te\u017ft for g\u0130fted \u017ftudents", "a.OUT \u1c80ариант 4 O(n)", "Mục tiêu bài học, KẾ HOẠCH BÀI DẠY; Phần I: đúng sai"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = features.structure_features(rows).orderBy("id")
    text = F.coalesce("text", F.lit(""))
    patterns = {k: features.whole(v) for k, v in features.WORD_FEATURES.items()} | features.PATTERN_FEATURES
    want = rows.orderBy("id").select(*[F.regexp_count(text, F.lit(p)).alias(k) for k, p in patterns.items() if k != "contract"])
    assert found.select(*want.columns).collect() == want.collect()
    assert [r.named_grade for r in found.collect()] == [None, None, None, "GRADE_12", "OLYMPIAD_GIFTED", None, None]
    # patterns are behind words, which are searched as bytes
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") > 50
    words = features.words_of(features.WORD_FEATURES["lesson"])
    assert all(any(w in p for w in words) for p in features.WORD_FEATURES["lesson"])


def test_recovery_looks_for_what_is_asked(spark, monkeypatch):
    text = "Question 1: What about the lot?\nA - up\nB - down\nC - away\nQuestion 2: And this?\nA. x\nB. y\nAnswer key\n1-A 2-B"
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    written = []
    write = recovery.materialize
    monkeypatch.setattr(recovery, "materialize", lambda df, label: (written.append(write(df, label)), written[-1])[1])
    whole = recovery.recovered(rows)
    n = len(written)
    some = recovery.recovered(rows, ("number", "options"))
    assert some.orderBy("place").collect() == whole.select(*some.columns).orderBy("place").collect()
    assert "statements" in written[0].columns and not {"statements", "answer", "stem"} & set(written[n].columns)
    assert written[n].filter("codes IS NOT NULL").count() == 0 and written[n].filter("block IS NOT NULL").count() == 1


def test_texts_without_cues_are_not_split(spark):
    texts = ["Why? " * 12, "Why? " * 12 + "\nRead the following text:\nOnce there was a river.", "Read the following text:\nOnce there was a river.\n \tRead the following article\nx"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    cut = rows.select(*[contexts.cut_context(F.col("t"), F.lit(own)).alias(f"own_{own}") for own in (False, True)])
    told = lambda c: None if c is None else (c["head"], c["cue"], c["body"])
    a = ("Why? " * 12).strip(), "Read the following text:", "Once there was a river."
    b = "Read the following text:\nOnce there was a river.", "Read the following article", "x"
    assert [(told(r.own_False), told(r.own_True)) for r in cut.collect()] == [(None, None), (a, a), (b, ("", "Read the following text:", "Once there was a river.\n \tRead the following article\nx"))]
    assert "split(" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_are_matched_as_java_folds_them(spark):
    letters = sorted({c for p in (*questions.CUES, *questions.LONG_LABELS, *questions.ANSWER_TITLES) for c in p.lower() if c.isalpha()})
    rows = spark.range(0x20, 0xD800).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    differ = [F.sum((F.col("c").rlike(f"^{questions.any_of((x,))}$") != F.col("c").rlike(f"^(?iu:{x})$")).cast("int")) for x in letters]
    assert set(rows.select(*differ).first()) == {0}
    tree = questions.any_of(("true false", "true", "truth"))
    assert spark.range(1).select(F.regexp_extract(F.lit("TRUE-False"), tree, 0)).first()[0] == "TRUE-False" and "(?iu" not in tree


def test_keys_are_looked_for_where_a_number_stands_by_a_letter(spark):
    plan = questions.answer_keys(spark.createDataFrame([(1, "x")], "id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert questions.ANY_KEY in plan
    n = 20_000
    rows = spark.createDataFrame([(k, f"1{c * n}") for k, c in enumerate(" \n1-")], "id long, text string")
    assert questions.answer_keys(rows).count() == 0
