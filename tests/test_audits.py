"""Requirements, channels and texts of exams on odd rows."""

from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import audits

REPORT = """id long, profile string, spoofed boolean, subject string, grade string, difficulty double, tier string, questions int, answers boolean, solutions boolean,
scanned boolean, format_2025 boolean, lesson_plan boolean, quality double, coverage double, topics array<string>"""


def test_all_requirements_of_a_profile(spark):
    row = ("own", "MATH", "12", "advanced", 3.0, 5.0, 10, 20, True, True, False, True, True, True, 50.0, 80.0, ["Sets", "vector"])
    wanted = audits.profiles(spark.createDataFrame([row], audits.PROFILE).unionByName(audits.profiles(spark.createDataFrame([("open",)], "profile string"))))
    good = (False, "MATH", "12", 5.0, "advanced", 10, True, True, False, True, True, 50.0, 80.0, ["Theory of sets", "Vectors"])
    rows = [(1, "own", *good), (2, "own", *[None] * 14), (3, "open", *[None] * 14), (4, "unknown", *good), (5, None, *good), (6, "own", *good[:-1], ["sets"]), (7, "open", *good)]
    checked = audits.checks(spark.createDataFrame(rows, REPORT), wanted)
    got = {r["id"]: (r["n_passed"], r["n_failed"], r["eligible"]) for r in audits.eligible(checked).collect()}
    # what is null fails; a missing topic is a warning only
    assert got == {1: (16, 0, True), 2: (0, 16, False), 3: (0, 1, False), 6: (15, 1, True), 7: (1, 0, True)}
    assert audits.eligible(audits.checks(spark.createDataFrame([], REPORT), wanted)).count() == 0


def test_posts_of_channels(spark):
    channels = spark.createDataFrame([("a", None, None, [], ["X"], None), ("b", "exam", ["t"], ["9"], [], True)], "channel string, category string, tracks array<string>, grades array<string>, subjects array<string>, wildcard boolean")
    home = spark.createDataFrame([("X", "a")], "subject string, suggested string")
    rows = [(1, "a", None, None, None, None, "X"), (2, "a", "ok", "c", "t", "9", None), (3, "b", "ok", None, "t", "9", "X"), (4, "b", "ok", "exam", None, "9", "X"), (5, "b", "ok", "exam", "t", "8", "Y"), (6, "b", "ok", "exam", "t", None, None), (7, "b", "failed", "exam", "t", "9", "X"), (8, "z", "ok", "exam", "t", "9", "X")]
    posts = spark.createDataFrame(rows, "id long, channel string, verdict string, category string, track string, grade string, subject string")
    got = {r["id"]: (r["reason"], r["suggested"]) for r in audits.compliance(posts, channels, home, "lounge").collect()}
    assert got == {1: (None, None), 2: ("subject", "lounge"), 3: ("category", "a"), 4: ("track", "a"), 5: ("grade", "lounge"), 6: (None, None), 7: ("unverifiable", None)}


def test_exam_texts(spark):
    rows = [(1, None), (2, ""), (3, "a  \r\n\r\n\n\nb\t"), (4, "e\u0301\u200b\uf0a3\uf020x"), (5, "µ" * 12), (6, "µ" * 11), (7, "µ" * 12 + "ạ" * 3), (8, "a\rb")]
    got = {r["id"]: r["t"] for r in spark.createDataFrame(rows, "id long, s string").select("id", tx.exam_text(F.col("s")).alias("t")).collect()}
    assert got == {1: "", 2: "", 3: "a\n\nb\t", 4: "é≤ x", 5: "à" * 12, 6: "µ" * 11, 7: "µ" * 12 + "ạ" * 3, 8: "a\nb"}
    assert len({x[0] for x in tx.LEGACY_LETTERS}) == len(tx.LEGACY_LETTERS) and {len(x) for x in (*tx.LEGACY_LETTERS, *tx.SYMBOLS)} == {2}


def test_breakdown_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, "a")], "id long, v string")
    got = {r["v"]: (r["n"], r["n_flagged"], r["share"]) for r in audits.breakdown(rows, "v", F.col("id") > 2).collect()}
    assert got == {None: (1, 0, 0.333333), "a": (2, 1, 0.666667)}
    assert audits.breakdown(rows.limit(0), "v", F.col("id") > 2).count() == 0
