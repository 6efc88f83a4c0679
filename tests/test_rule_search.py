"""Points of the rule-based search, by a plain reading of the table of wishes."""

from quillon.operators import structure

SUBJECTS = {"MATH": ("toán", "đại số"), "INFO": ("tin", "lập trình")}


def test_wishes_of_a_query():
    asked = structure.wishes("Đề Toán  lớp12 chuyên python của", SUBJECTS, ("của", "đề"))
    assert [(w.points, w.any_of) for w in asked] == [
        (120, (("subject", "|math|"),)), (90, (("all", "python"),)), (80, (("all", "đề toán lớp12 chuyên python của"),)), (60, (("level", "12"), ("title", "12"), ("file_name", "12"))),
        (50, structure.GIFTED_ROW), (25, (("all", "toán"),)), (25, (("all", "lớp12"),)), (25, (("all", "chuyên"),)), (25, (("all", "python"),)),
    ]
    assert [w.points for w in structure.wishes("của", SUBJECTS, ("của",))] == [80, 25]


def test_points_of_rows(spark):
    rows = [(1, "MATH", "lớp 12", "Đề chuyên", "de.pdf"), (2, "info", None, "toán 12", None), (3, None, None, None, None), (4, "MATH", "", "x" * 90 + " toán", "")]
    df = spark.createDataFrame(rows, "id int, subject string, level string, title string, file_name string")
    got = {x["id"]: x["s"] for x in df.select("id", structure.rule_score("toán 12", SUBJECTS).alias("s")).collect()}
    # subject, grade, and the words toán (a synonym) and 12; then the whole query, a title that is the query
    assert got == {1: 120.0 + 60 + 25 + 25, 2: 60.0 + 80 + 25 + 25 + 40, 3: 0.0, 4: 120.0 + 25}
    assert all(x["s"] == 0 for x in df.select(structure.rule_score(" ?! ", SUBJECTS).alias("s")).collect())
    long = "a" * 100
    near = spark.createDataFrame([(1, None, None, long[:80] + "b" * 60, None)], "id int, subject string, level string, title string, file_name string")
    some, whole = (near.select(structure.rule_score(long[:80], {}, title_head=h).alias("s")).first()["s"] for h in (80, None))
    assert some == 80 + 25 + 40 and 80 + 25 + 20 < whole < some
