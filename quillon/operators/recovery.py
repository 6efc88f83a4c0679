"""Targeted recovery: questions whose text shows that the parser went wrong are taken apart again, the others never.

Two faults are mended: a last option that has swallowed the next question, which is cut off as a question of its own; and
options marked by dashes (A - x), which are read as options if there are three or more. A round takes only the questions with a
fault, mends their text and parses it again; it goes on until no question has one. Each mend takes its fault out of the text, so
a text is parsed once for each of its faults at most.

A round's questions are written into the shared folder, so later rounds don't repeat earlier ones.

Defined results: papers without faults come back as they were parsed; a null or empty text has no questions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.questions import any_of, build_questions, question_blocks, trim
from quillon.sources.session import materialize

# Fixed values of the platform's rules.
SWALLOWING = ("câu hỏi", "câu", "question", "bài")
LEAST_DASHES, LEAST_STEM = 3, 8

SWALLOWED = rf"\n\s*+(?={any_of(SWALLOWING)}\s+\d{{1,3}}\s*[.:)]\s+\S)"
DASH = r"(?m)(?:^[ \t]*|[ \t]{2,})(?=[A-D]\s*[-–—][ \t]+\S)"
#: Columns of a question that its paper's keys decide.
KEYED = {"answer", "statements", "type"}
HOW = "struct<path: array<int>, parsed: int, how: string>"


def faults() -> tuple[Column, Column]:
    """Whether a question's last option has swallowed another, and whether its options are marked by dashes."""
    last = F.element_at(F.col("options"), -1)["text"]
    swallowed = (F.size("options") > 0) & last.rlike(rf"(?s)\S{SWALLOWED}")
    pieces = F.split("stem", DASH)
    marked = F.filter(pieces, lambda p: p.rlike(r"^[A-D]\s*[-–—][ \t]+\S"))
    dashed = (
        (F.size("options") == 0) & F.col("type").isin("choice_unknown", "essay") & (F.size(marked) >= LEAST_DASHES)
        & F.get(marked, F.lit(0)).startswith("A") & (F.length(F.get(pieces, F.lit(0))) > LEAST_STEM)
    )
    return swallowed, dashed


def mended(bad: DataFrame) -> DataFrame:
    """The blocks of questions with faults, mended: cut before what was swallowed, dashes made points."""
    path, parsed = F.col("place.path"), F.col("place.parsed") + 1
    label = rf"^({any_of(SWALLOWING)}\s+(\d{{1,3}}))"
    parts = F.when(F.col("swallowed"), F.split("block", SWALLOWED)).otherwise(F.array(F.regexp_replace("block", rf"{DASH}([A-D])\s*[-–—][ \t]+", "\n$1. ")))
    rows = bad.select("id", "number", "section", "label", "codes", path.alias("path"), parsed.alias("parsed"), "swallowed", F.posexplode(parts).alias("k", "part"))
    new = F.col("swallowed") & (F.col("k") > 0)
    place = F.struct(F.when(F.col("swallowed"), F.array_append("path", F.col("k"))).otherwise(F.col("path")).alias("path"), "parsed", F.when(F.col("swallowed"), "cut").otherwise("dashes").alias("how")).cast(HOW)
    return rows.select(
        "id", place.alias("place"), F.when(new, F.regexp_extract("part", label, 2).cast("int")).otherwise(F.col("number")).alias("number"), "section",
        F.when(new, F.regexp_extract("part", label, 1)).otherwise(F.col("label")).alias("label"), trim(F.col("part")).alias("block"), "codes",
    )


def recovered(papers: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The questions of papers (id, text), taken apart, with parsed, how often each was, and how the last time came about: null for
    the first, cut or dashes. Places are numbered anew. columns: those of a question that are asked for (default: all); what
    only the others need isn't looked for, nor written."""
    blocks = question_blocks(papers)
    if columns is not None and KEYED.isdisjoint(columns):
        blocks = blocks.withColumn("codes", F.lit(None).cast(blocks.schema["codes"].dataType))
    first = F.struct(F.array("place").alias("path"), F.lit(1).alias("parsed"), F.lit(None).cast("string").alias("how")).cast(HOW)
    work, done = blocks.withColumn("place", first), []
    while True:
        swallowed, dashed = faults()
        bad = F.col("swallowed") | F.col("dashed")
        built = build_questions(work, ("codes",)).withColumn("swallowed", swallowed).withColumn("dashed", dashed)
        if columns is not None:
            mends = [F.when(bad, F.col(c)).alias(c) for c in ("section", "label", "block") if c not in columns]
            built = built.select("id", "place", *dict.fromkeys(("number", *columns)), *mends, "codes", "swallowed", "dashed")
        # a paper's keys go on with the questions of the next round only, not with each that is done
        seen = materialize(built.withColumn("codes", F.when(bad, F.col("codes"))), "recovery")
        done.append(seen.filter(~bad))
        if seen.filter(bad).isEmpty():
            break
        work = mended(seen.filter(bad))
    every = reduce(DataFrame.unionByName, done)
    line = Window.partitionBy("id").orderBy("place.path")
    told = every.withColumns({"parsed": F.col("place.parsed"), "how": F.col("place.how")}).withColumn("place", F.row_number().over(line) - 1).drop("swallowed", "dashed", "codes")
    return told if columns is None else told.select("id", "place", *columns, "parsed", "how")
