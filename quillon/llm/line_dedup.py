"""Line dedup by overlapping windows of three lines.

Of the lines of a text that hold a word, trimmed of separators, each three that follow one another are a window,
named by a 128-bit hash. Of a window that occurs more than once in the whole table the first occurrence, by
document and place, stays; every later occurrence covers the lines from its first to its last, with the blank
lines between them. Covered ranges are merged and removed from the text.

Windows carry hashes and places, never text. Repeats are found by a grouped minimum, which Spark combines before
it shuffles, so a passage in a third of all rows is one row a task; the join that follows is a plain equi-join,
whose hot keys Spark splits. The text is shuffled once, to meet the covered lines of its document.

Defined results: a null or empty text has no windows and becomes the empty text; a text of fewer than three lines
with a word stays as it is. Documents are ordered by id, null ids first, and then by a hash of their text; rows
that are equal in both are one document and get the same result. A passage that overlaps its own repeat keeps
the lines before its second occurrence. Other columns pass through; one that is named as an output column is
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD, bind, text_of, without
from quillon.sources.session import materialize

WINDOW = 3
TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
ADDED = ("n_lines", "n_removed", "clean_text")


def _worded(lines: Column) -> Column:
    """The lines with a word, trimmed, each with its place."""
    placed = F.transform(lines, lambda x, i: F.struct(F.regexp_replace(x, TRIM, "").alias("x"), i.alias("i")))
    return F.filter(placed, lambda p: p["x"] != "")


def _windows(text: Column) -> Column:
    """array<struct<a, b, start, end>>: the 128-bit hash of each window, its first line and its last."""

    def of(lines: Column) -> Column:
        def joined(h: Column) -> Column:
            three = lambda i, f: [F.element_at(h, i + n)[f] for n in range(WINDOW)]
            return F.transform(
                F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)),
                lambda i: F.struct(
                    F.xxhash64(*three(i, "a")).alias("a"),
                    F.xxhash64(*three(i, "b")).alias("b"),
                    F.element_at(h, i)["i"].alias("start"),
                    F.element_at(h, i + (WINDOW - 1))["i"].alias("end"),
                ),
            )

        hashed = F.transform(lines, lambda p: F.struct(F.xxhash64(p["x"]).alias("a"), F.xxhash64(F.lit("second"), p["x"]).alias("b"), p["i"].alias("i")))
        return F.when(F.size(lines) >= WINDOW, bind(hashed, joined))

    return bind(_worded(F.split(text, "\n")), of)


def covered_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(__id, __key, covered): for each document that repeats a passage, the ranges of lines that go, by place."""
    t = text_of(text)
    windows = materialize(
        docs.select(F.col(id_column).alias("__id"), F.xxhash64(t).alias("__key"), F.explode(_windows(t)).alias("w")).select("__id", "__key", "w.*"),
        "line-windows",
    )
    place = F.struct("__id", "__key", "start")
    repeated = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b", "first")
    later = windows.join(repeated, ["a", "b"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("__id", "__key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("covered"))


def _uncovered(lines: Column, covered: Column) -> Column:
    """The lines outside the ranges. Ranges are sorted, and one that starts later ends later, so what stays before
    each range begins right after the range before it."""

    def before(j: Column) -> Column:
        start = F.when(j == 1, 0).otherwise(F.get(covered, j - 2)["end"] + 1)
        end = F.when(j > F.size(covered), F.size(lines)).otherwise(F.get(covered, j - 1)["start"])
        return F.slice(lines, start + 1, F.greatest(end - start, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(covered) + 1), before))


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ``clean_text`` (the text without its covered lines), ``n_lines`` (lines with a word) and ``n_removed``
    (those that went)."""
    own = without(docs, *ADDED)
    names = [F.col(f"`{c}`") for c in own.columns]
    t = text_of(text)
    keyed = own.select("*", F.xxhash64(t).alias("__key"))
    gone = covered_lines(docs, id_column, text).withColumnRenamed("__key", "__key2")
    joined = keyed.join(gone, F.col(id_column).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__key2")), "left")
    worded = lambda ls: F.size(F.filter(ls, lambda x: x.rlike(WORD))).cast("long")
    split = F.split(t, "\n")
    kept = bind(F.struct(split.alias("ls"), F.col("covered").alias("c")), lambda x: _uncovered(x["ls"], x["c"]))

    def done(ls: Column) -> Column:
        return F.struct((worded(split) - worded(ls)).alias("n_removed"), F.array_join(ls, "\n").alias("clean_text"))

    cut = joined.select(*names, worded(split).alias("n_lines"), F.when(F.col("covered").isNotNull(), bind(kept, done)).alias("__r"))
    return cut.select(
        *names,
        "n_lines",
        F.coalesce(F.col("__r.n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.col("__r.clean_text"), t).alias("clean_text"),
    )
