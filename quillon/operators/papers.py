"""Exam papers and routes: number gaps, orphan keys, seeded shuffles, channels for documents, repeated page furniture."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_gaps(questions: DataFrame, most: int = 5) -> DataFrame:
    """(id, missing): the numbers between two neighbouring questions (id, number), where ``most`` or fewer are missing."""
    after = F.lead("number").over(Window.partitionBy("id").orderBy("number"))
    gaps = questions.select("id", "number").distinct().withColumn("after", after)
    gaps = gaps.filter((F.col("after") - F.col("number")).between(2, most + 1))
    return gaps.select("id", F.explode(F.sequence(F.col("number") + 1, F.col("after") - 1)).alias("missing"))


def key_problems(questions: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, number, problem): keys without a question (orphan), questions without a key (unanswered), keys that aren't one
    of A to D (invalid). questions: id, number; keys: id, number, letter."""
    is_bad = ~F.col("letter").rlike("^[A-D]$")
    asked = questions.select("id", "number", F.lit(True).alias("asked"), F.lit(0).alias("key"), F.lit(0).alias("bad"))
    known = keys.select("id", "number", F.lit(False).alias("asked"), F.lit(1).alias("key"), F.when(is_bad, 1).otherwise(0).alias("bad"))
    return number_problems(asked.unionAll(known).groupBy("id", "number").agg(F.max("asked").alias("asked"), F.sum("key").alias("n_keys"), F.sum("bad").alias("n_bad")))


def number_problems(numbers: DataFrame) -> DataFrame:
    """key_problems of numbers (id, number, asked, n_keys, n_bad), a row each: whether there is a question, and how many keys and
    invalid keys. Nothing is compared with a null id or number, so such keys are orphans and such questions unanswered."""
    met = F.col("id").isNotNull() & F.col("number").isNotNull()
    times = lambda problem, n: F.array_repeat(F.lit(problem), n.cast("int"))
    told = (
        times("orphan", F.when(met & F.col("asked"), 0).otherwise(F.col("n_keys"))),
        times("unanswered", F.when(F.col("asked") & ~(met & (F.col("n_keys") > 0)), 1).otherwise(0)), times("invalid", F.col("n_bad")),
    )
    return numbers.select("id", "number", F.explode(F.concat(*told)).alias("problem"))


def shuffled_papers(questions: DataFrame, seed: str) -> DataFrame:
    """(id, number, new_number, option, new_option, is_key) of questions (id, number, key): questions of a paper and the
    options of a question stand in an order that the seed decides, and the keys move with them."""
    mix = lambda *parts: F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))
    new = questions.withColumn("new_number", F.row_number().over(Window.partitionBy("id").orderBy(mix(F.col("id"), F.col("number")), "number")))
    options = F.array_sort(F.array(*[F.struct(mix(F.col("id"), F.col("number"), F.lit(x)).alias("h"), F.lit(x).alias("option")) for x in "ABCD"]))
    rows = new.select("id", "number", "key", "new_number", F.posexplode(options).alias("p", "o"))
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), F.col("p") + 1)
    return rows.select("id", "number", "new_number", F.col("o.option").alias("option"), letter.alias("new_option"), (F.col("o.option") == F.col("key")).alias("is_key"))


#: Channels up to which they are sent to every task.


def routes(docs: DataFrame, channels: DataFrame) -> DataFrame:
    """(id, channel, score): the channel (channel, subject, kind, level) that fits a document (id, subject, kind, level)
    best: subject 50, kind 30, level 20; ``*`` fits any and counts half. Of equal scores the last channel by name wins.

    Channels for the same subject, kind and level differ in their names only, so the last stands for all. A document asks for
    the eight ways in which one can fit it, each an equal key: no channel is compared with it that doesn't."""
    parts = (("subject", 50), ("kind", 30), ("level", 20))
    known = channels.groupBy(*[F.col(c).alias(f"c_{c}") for c, _ in parts]).agg(F.max("channel").alias("channel"))
    ways = [F.struct(*[F.when(F.col(c) != "*", F.col(c)).alias(f"c_{c}") if own else F.lit("*").alias(f"c_{c}") for own, (c, _) in zip(way, parts, strict=True)], F.lit(sum(w if own else w // 2 for own, (_, w) in zip(way, parts, strict=True))).alias("score")) for way in product((True, False), repeat=3)]
    asked = docs.select("id", F.explode(F.array(*ways)).alias("w")).select("id", "w.*")
    best = asked.join(known, [f"c_{c}" for c, _ in parts]).groupBy("id").agg(F.max_by(F.struct("channel", "score"), F.struct("score", "channel")).alias("b"))
    return best.select("id", "b.channel", "b.score")


def page_furniture(lines: DataFrame, pages: int = 2) -> DataFrame:
    """(signature, n_pages): lines (page, line) that repeat on two pages or more once digits are masked, as headers and
    footers do."""
    signature = F.regexp_replace(F.lower(F.trim("line")), "[0-9]+", "#")
    counts = lines.select("page", signature.alias("signature")).filter("signature <> ''").distinct().groupBy("signature").agg(F.count(F.lit(1)).alias("n_pages"))
    return counts.filter(F.col("n_pages") >= pages)


#: Expected share of right answers by cognitive level, from recall to high application.
EXPECTED = (0.85, 0.65, 0.45, 0.20)


def item_statistics(levels: DataFrame) -> DataFrame:
    """(id, n, p_value, d_value, difficulty, discrimination) of papers (id, level from 1 to 4): the expected share of right
    answers and how well the paper tells candidates apart, from the shares of its levels."""
    count = lambda k: F.count(F.when(F.col("level") == k, 1))
    c = levels.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[count(k).alias(f"c{k}") for k in (1, 2, 3, 4)])
    p = F.round(sum((F.col(f"c{k}") * e for k, e in enumerate(EXPECTED, 1)), F.lit(0.0)) / F.greatest(F.col("n"), F.lit(1)), 4)
    d = F.round(F.least(F.lit(0.65), F.greatest(F.lit(0.20), 0.25 + (F.col("c3") + F.col("c4")) / F.greatest(F.col("n"), F.lit(1)) * 0.5)), 4)
    label = F.when(F.col("p_value") >= 0.70, "easy").when(F.col("p_value") >= 0.55, "standard").when(F.col("p_value") >= 0.40, "demanding").otherwise("expert")
    apart = F.when(F.col("d_value") >= 0.40, "high").when(F.col("d_value") >= 0.30, "good").otherwise("average")
    return c.select("id", "n", p.alias("p_value"), d.alias("d_value")).withColumn("difficulty", label).withColumn("discrimination", apart)


def evidence_scores(texts: DataFrame, evidence: tuple[tuple[str, int, tuple[str, ...]], ...], least: int) -> DataFrame:
    """(id, label, points): the label with the most points for a text (id, text); a rule (label, points, markers) gives
    its points once if any of its markers occurs. No label below ``least`` points; ties go to the first in order."""
    low = F.lower("text")
    labels = list(dict.fromkeys(name for name, _, _ in evidence))
    points = {}
    for name in labels:
        total = F.lit(0)
        for _, n, markers in (e for e in evidence if e[0] == name):
            hit = F.lit(False)
            for m in markers:
                hit = hit | low.contains(m)
            total = total + F.when(hit, n).otherwise(0)
        points[name] = total
    # the place breaks ties: earlier labels win
    best = F.array_max(F.array(*[F.struct(p.alias("points"), F.lit(-i).alias("place"), F.lit(n).alias("label")) for i, (n, p) in enumerate(points.items())]))
    scored = texts.select("id", best.alias("b"))
    return scored.select("id", F.when(F.col("b.points") >= least, F.col("b.label")).alias("label"), F.col("b.points").alias("points"))


def style_scores(texts: DataFrame, patterns: tuple[tuple[str, int], ...], discounts: tuple[tuple[str, int], ...], comments: str = r"(?m)^[ \t]*(?://|#)") -> DataFrame:
    """(id, score, level): suspicion from 0 to 100 that a text (id, text) isn't written by hand. A pattern adds its weight
    for each hit, twice at most; many comment lines add 15 or 25; habits of people take their discount off."""
    score = F.lit(0)
    for p, w in patterns:
        score = score + F.least(F.regexp_count("text", F.lit(p)) * w, F.lit(2 * w))
    lines = F.size(F.split("text", "\n"))
    ratio = F.regexp_count("text", F.lit(comments)) / lines
    score = score + F.when((ratio > 0.45) & (lines > 12), 25).when((ratio > 0.30) & (lines > 12), 15).otherwise(0)
    less = sum((F.when(F.col("text").rlike(p), d).otherwise(0) for p, d in discounts), F.lit(0))
    final = F.least(F.lit(100), F.greatest(F.lit(0), score - F.least(score, less)))
    scored = texts.select("id", final.cast("int").alias("score"))
    return scored.withColumn("level", F.when(F.col("score") >= 70, "extreme").when(F.col("score") >= 60, "strong").when(F.col("score") >= 30, "light").otherwise("normal"))
