"""Structure of parsed papers: problems of questions and papers, blueprints, the kind of a document, rule-based search.

Questions are rows (id, place, number, group, type, stem, options, n_statements, n_blanks, answer), options being an array
of (marker, text); a paper's contexts, groups and assets are rows (id, kind, name).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the platform's rules.
CHOICES = ("single_choice", "multiple_choice", "choice_unknown")
EXAM_CUES = r"(?i)\b(?:câu\s+\d+|question\s+\d+|đề\s+thi|bài\s+kiểm\s+tra)\b"
QUESTION_HEADER = r"(?im)^\s*(?:câu(?:\s+hỏi)?|question)\s+\d{1,3}\s*[.:)]"
#: Types of exams by precedence, with the subject that a type implies.
EXAM_TYPES = (
    ("COMPETITIVE_PROGRAMMING", "INFORMATICS"), ("MOET_2025_COMBINED", None), ("IELTS_TEST", "ENGLISH"), ("SPECIALIZED_ENGLISH", "ENGLISH"), ("TOEIC_TEST", "ENGLISH"),
    ("JLPT_TEST", "JAPANESE"), ("HSK_TEST", "CHINESE"), ("TOPIK_TEST", "KOREAN"), ("TRKI_TEST", "RUSSIAN"), ("MCQ_STANDARD_4", None), ("MCQ_TRUE_FALSE", None), ("OLYMPIAD_ESSAY", None),
)
GRADE_NUMBERS = ("12", "11", "10", "9", "8", "7", "6")
LANGUAGES = ("python", "c++", "cpp", "pascal", "java", "sql", "dsa")
# Fixed values of the search: points by rule, what stands before a grade and where grades are looked for, and the words of gifted classes
# in queries and in rows.
SEARCH_POINTS = {"subject": 120, "language": 90, "phrase": 80, "grade": 60, "gifted": 50, "word": 25, "title": 40}
GRADE_BEFORE, GRADE_FIELDS = (" ", "lớp", "lop", "k"), ("level", "title", "file_name")
GIFTED_ASKED = ("chuyên", "chuyen", "olympic", "hsg", "nâng cao", "nang cao")
GIFTED_ROW = (("level", "chuyên"), ("level", "hsg"), ("level", "olympic"), ("title", "chuyên"))
TITLE_HEAD, LEAST_ALIKE, ALIKE = 80, 4, 0.35


def question_problems(questions: DataFrame) -> DataFrame:
    """(id, place, problem) of what is wrong within a question, or in its order: a number below that of the question before
    it in its group, other than 1. Each problem is told once a question. Only numbers and problems are sorted, no texts."""
    options, choice = F.col("options"), F.col("type").isin(*CHOICES)
    blank = lambda c: F.coalesce(c, F.lit("")).rlike(r"^\s*$")
    markers = F.transform(options, lambda o: F.upper(o["marker"]))
    letters = F.regexp_extract_all(F.upper(F.coalesce("answer", F.lit(""))), F.lit("[A-F]"), F.lit(0))
    rules = (
        ("no_stem", blank(F.col("stem"))),
        ("few_options", choice & (F.size(options) < 2)),
        ("repeated_marker", choice & (F.size(F.array_distinct(markers)) < F.size(markers))),
        ("empty_option", choice & F.exists(options, lambda o: blank(o["text"]))),
        ("header_in_option", choice & F.exists(options, lambda o: F.coalesce(o["text"], F.lit("")).rlike(QUESTION_HEADER))),
        ("no_statements", (F.col("type") == "true_false") & (F.col("n_statements") == 0)),
        ("no_blank", (F.col("type") == "fill_blank") & (F.col("n_blanks") == 0)),
        ("answer_not_offered", (F.size(options) > 0) & (F.size(F.array_except(letters, markers)) > 0)),
    )
    own = questions.select("id", "place", "number", "group", F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules])).alias("own"))
    before = Window.partitionBy("id").orderBy("place")
    backwards = (F.lag("number").over(before) > F.col("number")) & F.lag("group").over(before).eqNullSafe(F.col("group")) & (F.col("number") != 1)
    found = own.select("id", "place", F.when(backwards, F.array_prepend("own", F.lit("out_of_order"))).otherwise(F.col("own")).alias("p"))
    return found.select("id", "place", F.explode("p").alias("problem"))


def dangling(references: DataFrame, known: DataFrame) -> DataFrame:
    """(id, place, problem) of references (id, place, kind, name) to what the paper doesn't have (known: id, kind, name)."""
    lost = references.filter("name IS NOT NULL").join(known, ["id", "kind", "name"], "left_anti")
    return lost.select("id", "place", F.concat(F.lit("unknown_"), "kind").alias("problem")).distinct()


def paper_problems(papers: DataFrame, questions: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, problem) of whole papers (id, text, n_images, n_loose) by their questions (id, number, raw) and answer keys (id,
    number): nothing in it, cues but no questions, keys without questions, loose blocks, or under a quarter of the text kept."""
    sums = questions.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("kept"))
    orphans = keys.join(questions.select("id", "number"), ["id", "number"], "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("orphans"))
    text = F.coalesce("text", F.lit(""))
    met = papers.withColumn("text", text).join(sums, "id", "left").join(orphans, "id", "left").fillna(0, ["n", "kept", "orphans"])
    rules = (
        ("empty", F.col("text").rlike(r"^\s*$") & (F.col("n_images") == 0)),
        ("no_questions", (F.regexp_count("text", F.lit(EXAM_CUES)) >= 2) & (F.col("n") == 0)),
        ("orphan_keys", (F.col("n") > 0) & (F.col("orphans") > 0)),
        ("loose_questions", F.col("n_loose") > 0),
        ("little_kept", (F.length("text") > 200) & (F.col("n") > 0) & (F.col("kept") / F.length("text") < 0.25)),
    )
    found = met.select("id", F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules])).alias("p"))
    return found.select("id", F.explode("p").alias("problem"))


def blueprint_check(questions: DataFrame, blueprints: DataFrame) -> DataFrame:
    """(id, expected, actual, n_errors, valid) of papers by blueprints (id, expected): the number of questions may differ by
    15 % or 2, whichever is more; a choice question (id, type, n_options, answer) needs four options and an answer."""
    choice = F.col("type") == "mcq"
    wrong = F.when(choice & (F.col("n_options") < 4), 1).otherwise(0) + F.when(choice & (F.coalesce("answer", F.lit("")) == ""), 1).otherwise(0)
    sums = questions.groupBy("id").agg(F.count(F.lit(1)).alias("actual"), F.sum(wrong).alias("wrong"))
    met = blueprints.join(sums, "id", "left").fillna(0, ["actual", "wrong"])
    off = F.abs(F.col("actual") - F.col("expected")) > F.greatest(F.lit(2), F.floor(F.col("expected") * 0.15))
    errors = F.col("wrong") + off.cast("int")
    return met.select("id", "expected", "actual", errors.alias("n_errors"), (errors == 0).alias("valid"))


def document_kind(candidates: Column, lesson: Column, contract: Column, subject: Column, asks: Column) -> list[Column]:
    """category, exam_type and subject: lesson plans and contracts first, then the candidate types of exams by precedence; a
    text that asks something (questions, cloze, answer keys) is an essay of its kind; anything else is a general document."""
    category = F.when(asks, "EXAM_TEST").otherwise("GENERAL_DOCUMENT")
    kind = F.when(asks, F.when(subject == "ENGLISH", "SPECIALIZED_ENGLISH").otherwise("GENERAL_ESSAY")).otherwise("NOT_AN_EXAM")
    told = subject
    for name, implied in reversed(EXAM_TYPES):
        has = F.array_contains(candidates, name)
        category, kind = F.when(has, "EXAM_TEST").otherwise(category), F.when(has, name).otherwise(kind)
        told = F.when(has, F.lit(implied) if implied else subject).otherwise(told)
    return [
        F.when(lesson, "LESSON_PLAN").when(contract, "ADMIN_CONTRACT").otherwise(category).alias("category"),
        F.when(lesson | contract, "NOT_AN_EXAM").otherwise(kind).alias("exam_type"),
        F.when(lesson, subject).when(contract, "NON_ACADEMIC").otherwise(told).alias("subject"),
    ]


@dataclass(frozen=True)
class Wish:
    """What a query asks of a row: points if any of the texts stands in its field."""

    points: int
    any_of: tuple[tuple[str, str], ...]


def wishes(query: str, subjects: dict[str, tuple[str, ...]], stop_words: tuple[str, ...] = ()) -> list[Wish]:
    """The table of wishes of a query: one for each thing that it names."""
    said = " ".join(query.lower().split())
    spaced, tokens = f" {said} ", re.findall(r"\w+", said)
    named = tuple(("subject", f"|{s.lower()}|") for s, names in subjects.items() if any(f" {n} " in spaced for n in names))
    grades = [g for g in GRADE_NUMBERS if any(f"{before}{g} " in spaced for before in GRADE_BEFORE)]
    table = {
        "subject": [named] if named else [],
        "language": [(("all", x),) for x in LANGUAGES if x in said],
        "phrase": [(("all", said),)] if said else [],
        "grade": [tuple((field, g) for field in GRADE_FIELDS) for g in grades],
        "gifted": [GIFTED_ROW] if any(re.search(rf"\b{x}\b", said) for x in GIFTED_ASKED) else [],
        "word": [(("all", x),) for x in [t for t in tokens if t not in stop_words] or tokens],
    }
    return [Wish(SEARCH_POINTS[rule], pairs) for rule, asked in table.items() for pairs in asked]


def rule_score(query: str, subjects: dict[str, tuple[str, ...]], stop_words: tuple[str, ...] = (), title_head: int | None = TITLE_HEAD) -> Column:
    """Points of a row (subject, level, title, file_name) for a query: the sum of the wishes that it meets, and up to
    SEARCH_POINTS["title"] for a title alike. Of titles the first title_head characters are compared, or, with None, all."""
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("subject", "level", "title", "file_name")}
    of_subject = F.create_map(*[F.lit(x) for s, names in subjects.items() for x in (s.lower(), " ".join(names))]) if subjects else F.create_map().cast("map<string, string>")
    synonyms = F.coalesce(F.try_element_at(of_subject, low["subject"]), F.lit(""))
    fields = low | {"subject": F.concat(F.lit("|"), low["subject"], F.lit("|")), "all": F.concat_ws(" ", low["title"], low["file_name"], low["subject"], synonyms, low["level"])}
    asked = wishes(query, subjects, stop_words)
    met = [F.when(reduce(or_, [fields[f].contains(x) for f, x in w.any_of]), float(w.points)).otherwise(0.0) for w in asked]
    said = " ".join(query.lower().split())
    if len(said) >= LEAST_ALIKE:
        title = low["title"] if title_head is None else F.substring(low["title"], 1, title_head)
        alike = 1.0 - F.levenshtein(F.lit(said), title) / F.greatest(F.lit(len(said)), F.length(title))
        met.append(F.when(alike > ALIKE, alike * SEARCH_POINTS["title"]).otherwise(0.0))
    return reduce(add, met, F.lit(0.0)) if re.search(r"\w", said) else F.lit(0.0)


def rule_search(docs: DataFrame, score: Column, key: Column, limit: int) -> DataFrame:
    """The ``limit`` best rows (id and others) with a score above 0, one of each key: the best, then the latest."""
    scored = docs.withColumn("score", F.round(score, 6)).filter("score > 0").withColumn("key", key)
    best = scored.groupBy("key").agg(F.max_by(F.struct("id", "score"), F.struct("score", "id")).alias("b")).select("b.*")
    return best.orderBy(F.desc("score"), F.desc("id")).limit(limit)
