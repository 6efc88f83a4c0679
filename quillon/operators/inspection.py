"""Document inspection: lexicon scores, votes, verdicts, questions, grading and evaluation.

Lexicons are tables (subject, term, weight), so any language or subject can be brought.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import tokens

CAP = 6
#: Terms of a lexicon up to which tokens are looked up within their row.
MANY_TERMS = 5_000
K1, B, AVERAGE = 1.2, 0.75, 1200.0


def term_counts(docs: DataFrame, lexicon: DataFrame, words: Column | None = None) -> DataFrame:
    """(id, length, subject, term, weight, tf) of the lexicon's terms in documents (id, text). A document's other tokens
    go within its row, as long as the lexicon has at most MANY_TERMS terms."""
    ws = words if words is not None else tokens(F.coalesce(F.col("text"), F.lit("")))
    terms = [r[0] for r in lexicon.select("term").distinct().limit(MANY_TERMS + 1).collect()]
    hits = (lambda w: F.filter(w, lambda x: x.isin(terms))) if len(terms) <= MANY_TERMS else (lambda w: w)
    pair = F.element_at(F.transform(F.array(ws), lambda w: F.struct(F.size(w).alias("length"), hits(w).alias("ws"))), 1)
    rows = docs.select("id", pair.alias("p")).select("id", "p.length", F.explode("p.ws").alias("term"))
    return rows.join(lexicon, "term").groupBy("id", "length", "subject", "term", "weight").agg(F.count(F.lit(1)).alias("tf"))


def capped_scores(counts: DataFrame) -> DataFrame:
    """(id, subject, score): weight times capped frequency, summed."""
    return counts.groupBy("id", "subject").agg(F.sum(F.col("weight") * F.least(F.col("tf"), F.lit(CAP))).cast("double").alias("score"))


def saturated_scores(counts: DataFrame) -> DataFrame:
    """(id, subject, score): saturated frequencies without weights or document frequencies."""
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / AVERAGE))
    return counts.groupBy("id", "subject").agg(F.round(F.sum(part), 6).alias("score"))


def best_subject(scores: DataFrame, ids: DataFrame, least: float, bands: tuple[tuple[float, float], ...], floor: float) -> DataFrame:
    """(id, subject, score, runner_up, confidence) for every id: the best subject, GENERAL below ``least``; bands give the
    confidence from a score on."""
    line = Window.partitionBy("id").orderBy(F.desc("score"), F.asc("subject"))
    two = scores.withColumn("r", F.row_number().over(line)).filter("r <= 2").groupBy("id").agg(
        F.max(F.when(F.col("r") == 1, F.col("subject"))).alias("top"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("s2")
    )
    met = ids.select("id").join(two, "id", "left").select("id", "top", F.coalesce("s1", F.lit(0.0)).alias("score"), F.coalesce("s2", F.lit(0.0)).alias("runner_up"))
    confidence = F.lit(floor)
    for at, value in reversed(bands):
        confidence = F.when(F.col("score") >= at, value).otherwise(confidence)
    return met.select("id", F.when(F.col("score") >= least, F.col("top")).otherwise("GENERAL").alias("subject"), "score", "runner_up", confidence.alias("confidence"))


BM25_BANDS, BM25_FLOOR, BM25_LEAST = ((25.0, 0.99), (12.0, 0.94), (5.0, 0.85)), 0.60, 3.0
LEXICON_BANDS, LEXICON_FLOOR, LEXICON_LEAST = ((35.0001, 1.0), (18.0001, 0.98), (6.0001, 0.94), (0.0001, 0.82)), 0.5, 3.0001


def topic_shares(scores: DataFrame) -> DataFrame:
    """(id, subject, share): each subject's percent of a document's score."""
    total = F.sum("score").over(Window.partitionBy("id"))
    return scores.select("id", "subject", F.round(F.col("score") * 100.0 / total, 6).alias("share"))


def quorum(votes: DataFrame) -> DataFrame:
    """(id, subject, weight, votes, unanimous, confidence) from (id, subject, confidence, weight): the subject with the
    largest weighted confidence; full confidence if all agree, else its share of the weights."""
    sums = votes.groupBy("id", "subject").agg(F.sum((F.col("confidence") * F.col("weight")).cast("decimal(18,6)")).alias("w"), F.count(F.lit(1)).alias("n"))
    best = sums.groupBy("id").agg(F.max_by(F.struct("subject", "w", "n"), F.struct("w", "subject")).alias("b"), F.sum("w").alias("all"), F.count(F.lit(1)).alias("kinds"))
    unanimous = F.col("kinds") == 1
    return best.select(
        "id", "b.subject", F.col("b.w").cast("double").alias("weight"), F.col("b.n").alias("votes"), unanimous.alias("unanimous"),
        F.when(unanimous, 1.0).otherwise(F.round(F.col("b.w").cast("double") / F.col("all").cast("double"), 6)).alias("confidence"),
    )


def verdict(n_chars: Column, scanned: Column, exam: Column, questions: Column, subject: Column, confidence: Column, top1: Column, top2: Column) -> Column:
    """failed, unidentified, uncertain or verified, by the first rule that applies."""
    general = subject == "GENERAL"
    failed = ((n_chars == 0) & ~scanned) | (scanned & (n_chars < 30))
    unidentified = exam & (general | ((confidence < 0.60) & (top1 == 0)))
    close = (top2 >= 8) & ((top1 - top2) / F.greatest(top1, F.lit(1.0)) < 0.25)
    uncertain = (confidence < 0.88) | (~exam & (questions == 0) & general) | close | (exam & questions.between(1, 2)) | general
    return F.when(failed, "failed").when(unidentified, "unidentified").when(uncertain, "uncertain").otherwise("verified")


QUESTION = r"(?:Question|Câu|Cau|Bài|Bai)"


def parse_questions(docs: DataFrame) -> DataFrame:
    """(id, number, type, stem, n_options, answer_key) of the numbered questions of documents (id, text).

    A question begins on a line with its word and number; options are lines that begin with A to D. An answer table
    of pairs such as ``1.A`` after the last question gives the keys. A number that returns is a question once.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    blocks = F.filter(F.split(F.concat(F.lit("\n"), t), rf"\n[ \t]*{QUESTION}[ \t]+(?=[0-9]{{1,3}}[ \t]*[.:)-])"), lambda b: b.rlike(r"^[0-9]{1,3}[ \t]*[.:)-]"))
    keys = F.transform(F.regexp_extract_all(t, F.lit(r"\b([0-9]{1,3}[.:-][A-D])\b"), F.lit(1)), lambda k: F.struct(F.regexp_extract(k, "^[0-9]+", 0).alias("n"), F.right(k, F.lit(1)).alias("v")))
    rows = docs.select("id", F.explode(blocks).alias("b"), keys.alias("keys"))
    number = F.regexp_extract("b", r"^([0-9]{1,3})", 1)
    body = F.regexp_replace(F.regexp_extract("b", r"(?s)^[0-9]{1,3}[ \t]*[.:)-][ \t]*(.*)$", 1), r"(?s)\n[ \t]*Answers:.*$", "")
    parsed = rows.select("id", number.alias("n"), body.alias("body"), "keys")
    options = F.regexp_count("body", F.lit(r"(?m)^[ \t]*[A-D][ \t]*[.)][ \t]+"))
    stem = F.trim(F.regexp_replace("body", r"(?s)\n[ \t]*[A-D][ \t]*[.)][ \t]+.*$", ""))
    key = F.try_element_at(F.filter("keys", lambda k: k["n"] == F.col("n")), F.lit(1))["v"]
    shaped = parsed.select("id", F.col("n").cast("int").alias("number"), stem.alias("stem"), F.when(options >= 2, options).otherwise(0).alias("n_options"), key.alias("answer_key"))
    once = shaped.filter(F.length("stem") > 0).groupBy("id", "number").agg(F.min(F.struct("stem", "n_options", "answer_key")).alias("q")).select("id", "number", "q.*")
    return once.withColumn("type", F.when(F.col("n_options") >= 2, "mcq").otherwise("short"))


def grade(answers: DataFrame, solutions: DataFrame, default_points: float = 0.5) -> DataFrame:
    """(session, n_questions, n_correct, score, max_score) of answers (session, number, chosen) by solutions (session,
    number, correct, points); points may be text such as "0.5 points", and count as the default if they can't be read."""
    points = F.coalesce(F.expr("try_cast(regexp_extract(points, '([0-9]+([.][0-9]+)?)', 1) as double)"), F.lit(default_points))
    met = solutions.select("session", "number", "correct", points.alias("p")).join(answers, ["session", "number"], "left")
    right = F.coalesce(F.upper(F.trim("chosen")) == F.upper("correct"), F.lit(False))
    return met.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_questions"), F.count(F.when(right, 1)).alias("n_correct"),
        F.round(F.sum(F.when(right, F.col("p")).otherwise(0.0)), 4).alias("score"), F.round(F.sum("p"), 4).alias("max_score"),
    )


def precision_recall(predicted: Column, expected: Column) -> list[Column]:
    """Aggregates tp, fp, fn, precision, recall, f1. Without predictions precision is 1 only if nothing was expected."""
    tp, fp, fn = F.count(F.when(predicted & expected, 1)), F.count(F.when(predicted & ~expected, 1)), F.count(F.when(~predicted & expected, 1))
    p = F.when(tp + fp > 0, tp / (tp + fp)).when(fn == 0, 1.0).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 9).alias("f1")]


def quality(complete: Column, answered: Column, levels: list[Column], total: Column, legacy: Column, scanned: Column) -> tuple[Column, Column]:
    """(score of 100, grade): 35 for completeness, 30 for answers, 20 for balance of levels, 15 for clean text."""
    share = F.greatest(*levels) / F.greatest(sum(levels[1:], levels[0]), F.lit(1))
    balance = F.when((share > 0.85) & (total > 5), 55.0).when((share > 0.65) & (total > 5), 75.0).otherwise(95.0)
    clean = 100.0 - F.when(legacy, 30.0).otherwise(0.0) - F.when(scanned, 40.0).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), complete * 35.0 + answered * 30.0 + balance * 0.20 + clean * 0.15))
    return score, F.when(score >= 90, "A+").when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").otherwise("D")


def cognitive_difficulty(levels: list[Column]) -> Column:
    """Mean difficulty of four levels of questions, from 1 to 10."""
    n = F.greatest(sum(levels[1:], levels[0]), F.lit(1))
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), (levels[0] * 2.0 + levels[1] * 4.5 + levels[2] * 7.0 + levels[3] * 9.5) / n))
