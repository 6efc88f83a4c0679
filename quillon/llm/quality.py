"""Quality rules, line first: clean each line, then judge what is left of the document.

A line that holds a word fails when one of these holds:

* punctuation: runs of two or more of ``# * $ % & < >`` or of ``! ?`` come to 30 per 100 words or more;
* navigation: it has two or more separators ``| » › · •`` and at least one to every four words;
* boilerplate: it is at most BOILERPLATE_WORDS words long and has one of the BOILERPLATE phrases.

Failing lines go. A document is rejected when its base counts fail (fewer than MIN_WORDS words, or more than
half of its words in three-word windows that occur twice) or when its failing lines hold more than MAX_LOST
percent of its word characters.

Everything is Spark SQL within one row: no shuffle, and no document depends on another.

Defined results: a null text counts as empty and is rejected; so is an empty text. Repeated rows get the same
verdict. Other columns pass through; one that is named as an output column is replaced. Null ids pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD, bind, text_of, without

MIN_WORDS = 50
MAX_LOST = 40
BOILERPLATE_WORDS = 25
#: Phrases of boilerplate lines, in ASCII lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "use cookies", "uses cookies", "accept cookies", "enable javascript",
    "click here", "sign up for our newsletter", "subscribe to our newsletter", "skip to content",
    "share this article", "lorem ipsum",
)
SYMBOLS = "#*$%&|<>"
NOISE_RUN = r"[#*$%&<>]{2,}|[!?]{2,}"
BARS = r"[|»›·•]"
#: A text without a match has no symbol, no run and no bar.
MARKS = r"[#*$%&|<>»›·•]|[!?]{2}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines",
         "n_failed_lines", "lost_chars", "kept", "clean_text")


def word_chars(words: Column) -> Column:
    """Code points of an array of words."""
    return F.length(F.array_join(words, "")).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def line_fails(line: Column, marked: Column) -> Column:
    """Whether one of the three line rules fails a line. marked: false if its document has none of the marks that
    the first two rules look for."""
    noise = F.regexp_count(line, F.lit(NOISE_RUN))
    bars = F.regexp_count(line, F.lit(BARS))
    plate = bind(F.translate(line, UPPER, LOWER), lambda low: reduce(or_, [low.contains(p) for p in BOILERPLATE]))

    def judged(words: Column) -> Column:
        menu = bind(bars, lambda b: (b >= 2) & (b * 4 >= words))
        return (words > 0) & ((marked & ((noise * 10 >= words * 3) | menu)) | ((words <= BOILERPLATE_WORDS) & plate))

    return bind(F.regexp_count(line, F.lit(WORD)), judged)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array.

    Windows are compared by a 64-bit hash. Only a document with an equal pair is sorted: by hash, to find the
    places of the repeats, then by place, to merge the windows that overlap.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            def same(i: Column, by: int) -> Column:
                return F.coalesce(F.get(s, i)["h"] == F.get(s, i + by)["h"], F.lit(False))

            hit = F.filter(F.transform(s, lambda x, k: F.when(same(k, -1) | same(k, 1), x["i"])), lambda p: p.isNotNull())
            return F.sort_array(hit)

        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
        merged = F.aggregate(bind(placed, places), zero, step, lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(merged)

    def windows(w: Column) -> Column:
        # element_at counts from 1
        hashed = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(bind(hashed, covered))

    return windows(words)


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts, the verdict ``kept`` and ``clean_text``, the text without its failing lines."""
    t = text_of(text)

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    def line_counts(ls: Column, marked: Column) -> Column:
        # each line carries its verdict
        judged = F.transform(ls, lambda x: bind(x.rlike(r"[^\x20\x09-\x0D]"), lambda w: F.struct(x.alias("l"), w.alias("w"), (w & line_fails(x, marked)).alias("bad"))))
        texts = lambda js, keep: F.transform(F.filter(js, keep), lambda j: j["l"])

        def counted(js: Column) -> Column:
            def summed(worded: Column, bad: Column) -> Column:
                any_bad = F.size(bad) > 0
                return F.struct(
                    F.size(worded).cast("long").alias("n_lines"),
                    (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
                    F.size(bad).cast("long").alias("n_failed_lines"),
                    F.when(any_bad, word_chars(words_of(F.array_join(bad, " ")))).otherwise(0).cast("long").alias("lost_chars"),
                    F.when(any_bad, F.array_join(texts(js, lambda j: ~j["bad"]), "\n")).otherwise(t).alias("clean_text"),
                )

            return bind(F.struct(texts(js, lambda j: j["w"]).alias("w"), texts(js, lambda j: j["bad"]).alias("b")), lambda x: summed(x["w"], x["b"]))

        return bind(judged, counted)

    own = without(docs, *ADDED)
    marked = t.rlike(MARKS)
    counted = own.select(
        "*",
        bind(words_of(t), counts).alias("__w"),
        bind(F.struct(F.split(t, "\n").alias("ls"), marked.alias("m")), lambda x: line_counts(x["ls"], x["m"])).alias("__l"),
        F.when(marked, F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    lost = F.col("lost_chars") * 100 > F.col("word_chars") * MAX_LOST
    return (
        counted.select(*[f"`{c}`" for c in own.columns], "n_symbols", "__w.*", "__l.*")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~lost)
    )
