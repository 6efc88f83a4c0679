"""Shared contexts of papers: passages, tables and figures that several questions refer to, and which questions those are.

A context begins on a line with a cue, before the first question or in the tail of one, and goes on to the next question. It
names its questions ("questions 3 to 7"), at most MOST of them; one that names none belongs to the next question. A question
belongs to the nearest context before it that names its number.

Contexts are cut out within the row of a paper. To link them, each becomes a row for every number that it names (at most
MOST + 1), so the join is by paper and number: no cross join, no range join, and a paper of many contexts is no hot key.

Defined results: a null or empty text, and one without questions, has no contexts; a paper that is there twice (the same
id) is one paper, whose contexts count by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.questions import any_of, bind, build_questions, found_blocks, question_blocks, trim
from quillon.sources.session import materialize

MOST = 25
#: Characters of the text that a context may be cut from, and of a context.
LEAST_TEXT, LEAST_CONTEXT = 40, 25

# Fixed values of the platform's rules: what a cue is made of, and the words that tell a table or a figure.
READ = [f"đọc {x}" for x in ("đoạn văn", "văn bản", "ngữ liệu", "bài đọc")] + [f"read the following {x}" for x in ("passage", "text", "extract", "article")]
SEEN = [f"{v} {x}" for v in ("dựa vào", "cho") for x in ("thông tin", "đoạn tư liệu", "bảng số liệu", "hình vẽ", "biểu đồ", "sơ đồ")]
USED = [f"use the following {x}" for x in ("information", "table", "graph", "diagram")]
TABLE_WORDS, FIGURE_WORDS = ("bảng số liệu", "bảng sau", "table"), ("hình vẽ", "biểu đồ", "sơ đồ", "figure", "graph", "diagram")

TO = r"(?:[-–—]|đến(?:\s+câu)?|to|through)"
CUE = rf"(?:{any_of((*READ, *SEEN, *USED))}|(?iu:questions?\s+\d{{1,3}}\s*{TO}\s*\d{{1,3}}\s+refer\s+to))[^\n]*"
NAMED = rf"(?iu)(?:từ\s+(?:câu\s+)?|(?:các\s+)?câu(?:\s+hỏi)?\s+|from\s+(?:questions?\s+)?|questions?\s+)(\d{{1,3}})\s*(?:{TO}|và|and|,)\s*(?:câu\s+)?(\d{{1,3}})(?:\s*(?:,|và|and)\s*(?:câu\s+)?(\d{{1,3}}))?"


def cut_context(text: Column, own_line: Column) -> Column:
    """struct<head, cue, body>: what stands before the first line with a cue, that line, and the rest. Null if there is none, or
    too little text. own_line: whether the first line may be the one."""
    after = rf"\n[ \t]*({CUE})"
    begin = rf"(?s)^[ \t]*({CUE})(?:\n(.*))?\z"
    at_start = own_line & text.rlike(begin)
    head = F.when(at_start, "").otherwise(F.regexp_extract(text, rf"(?s)^(.*?){after}", 1))
    cue = F.when(at_start, F.regexp_extract(text, begin, 1)).otherwise(F.regexp_extract(text, after, 1))
    body = F.when(at_start, F.regexp_extract(text, begin, 2)).otherwise(F.regexp_extract(text, rf"(?s){after}(?:\n(.*))?\z", 2))
    found = F.struct(trim(head).alias("head"), trim(cue).alias("cue"), trim(body).alias("body"))
    enough = F.length(text) >= F.when(own_line, LEAST_CONTEXT).otherwise(LEAST_TEXT)
    # most texts have no cue: they are looked at once
    return F.when(enough & (at_start | text.rlike(after)), bind(found, lambda f: F.when(F.length(f["cue"]) + F.length(f["body"]) >= LEAST_CONTEXT, f)))


def found_once(papers: DataFrame, keys: bool = True) -> DataFrame:
    """What found_blocks finds in papers (id, text) that have questions, written once for both its readers; keys: whether with
    the text of the answers and the keys, or nulls for them."""
    found = found_blocks(papers).filter(F.size("blocks") > 0).drop("text")
    if not keys:
        found = found.withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in ("tail", "codes")})
    return materialize(found, "papers")


def shared_contexts(papers: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(id, after, kind, cue, text, first, last) of papers (id, text): the place of the question whose tail has the context (-1
    before the first one), and the numbers of the questions that it names. found: what found_blocks has found, if known."""
    found = (found_blocks(papers) if found is None else found).filter(F.size("blocks") > 0)
    piece = lambda b, e: F.array_join(F.slice("pieces", b + 1, e - b), "")
    first = F.get("blocks", F.lit(0))["at"]
    texts = F.concat(F.array(piece(F.lit(0), first)), F.transform("blocks", lambda b: piece(b["at"], b["until"])))
    rows = found.select("id", F.transform("blocks", lambda b: b["number"]).alias("numbers"), F.posexplode(F.transform(texts, trim)).alias("k", "text"))
    cut = rows.select("id", (F.col("k") - 1).alias("after"), F.coalesce(F.get("numbers", F.col("k")), F.get("numbers", F.col("k") - 1) + 1).alias("next"), cut_context(F.col("text"), F.col("k") == 0).alias("c")).filter("c IS NOT NULL")
    number = lambda k: F.regexp_extract("c.cue", NAMED, k)
    begin, end = number(1).try_cast("int"), F.coalesce(number(3).try_cast("int"), number(2).try_cast("int"))
    named = cut.select("id", "after", "next", F.col("c.cue").alias("cue"), F.col("c.body").alias("body"), begin.alias("b"), end.alias("e"))
    fits = F.coalesce((F.col("e") >= F.col("b")) & (F.col("e") - F.col("b") <= MOST), F.lit(False))
    low = F.lower("cue")
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    kind = F.when(has(TABLE_WORDS), "shared_table").when(has(FIGURE_WORDS), "shared_figure").otherwise("reading_passage")
    return named.select("id", "after", kind.alias("kind"), "cue", F.when(F.col("body") == "", F.col("cue")).otherwise(F.col("body")).alias("text"), F.when(fits, F.col("b")).otherwise(F.col("next")).alias("first"), F.when(fits, F.col("e")).otherwise(F.col("next")).alias("last"))


def context_links(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(id, place, after): for questions (id, place, number) the nearest of contexts (id, after, first, last) before them that names
    their number."""
    named = contexts.select("id", "after", F.explode(F.sequence("first", "last")).alias("number"))
    met = questions.select("id", "place", "number").join(named, ["id", "number"]).filter("after < place")
    return met.groupBy("id", "place").agg(F.max("after").alias("after"))


def without_context(blocks: DataFrame) -> DataFrame:
    """Question blocks without the context in their tail, which belongs to the questions after them."""
    return blocks.withColumn("block", F.coalesce(cut_context(F.col("block"), F.lit(False))["head"], F.col("block")))


def questions_in_context(papers: DataFrame, keys: bool = True) -> DataFrame:
    """The questions of papers, taken apart without the contexts in their tails, with the place (after) and the kind of theirs.
    Without keys their answers are only those that they tell themselves."""
    found = found_once(papers, keys)
    contexts = shared_contexts(papers, found)
    built = build_questions(without_context(question_blocks(papers, found)))
    linked = context_links(built, contexts).join(contexts.select("id", "after", "kind"), ["id", "after"])
    return built.join(linked, ["id", "place"], "left")


def orphans(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(id, after) of contexts that no question belongs to."""
    return contexts.select("id", "after").join(context_links(questions, contexts).select("id", "after").distinct(), ["id", "after"], "left_anti")
