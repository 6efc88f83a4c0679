"""Full-text, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import tokens
from quillon.sources.session import materialize

K1, B = 1.2, 0.75


def hits(docs: DataFrame, prefixes: tuple[str, ...], every: bool = False) -> DataFrame:
    """(id, score): BM25 of documents (id, text) for tokens that begin with the prefixes, any of them or all.

    score = sum of idf * tf (k1 + 1) / (tf + k1 (1 - b + b length / average)), idf = ln(1 + (N - df + 0.5) / (df + 0.5)).
    Counts per prefix are made within the row of a document; what is shuffled is one row a match.
    """
    words = tokens(F.coalesce(F.col("text"), F.lit("")))
    count = lambda ws, p: F.size(F.filter(ws, lambda w: w.startswith(p)))
    tf = F.element_at(F.transform(F.array(words), lambda ws: F.struct(F.size(ws).alias("length"), F.array(*[F.struct(F.lit(p).alias("p"), count(ws, p).alias("tf")) for p in prefixes]).alias("tfs"))), 1)
    counted = materialize(docs.select("id", tf.alias("t")).select("id", "t.length", "t.tfs"), "search-counts")
    totals = counted.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("average"))
    found = counted.select("id", "length", F.explode("tfs").alias("x")).select("id", "length", "x.p", "x.tf").filter("tf > 0")
    df = found.groupBy("p").agg(F.count(F.lit(1)).alias("df"))
    met = found.join(F.broadcast(df), "p").crossJoin(F.broadcast(totals))  # a row a prefix; one row
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    scored = met.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("matched"))
    return scored.filter(F.col("matched") == len(prefixes)).select("id", "score") if every else scored.select("id", "score")


def top(scored: DataFrame, count: int, least: float | None = None) -> DataFrame:
    """The best ``count`` rows with their rank from 0; ties by id."""
    kept = scored if least is None else scored.filter(F.col("score") >= least)
    best = kept.orderBy(F.desc("score"), F.asc("id")).limit(count)
    return best.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id"))) - 1).cast("long"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def vector_scores(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """(id, score): cosine of all vectors (id, v) with the one query vector (q)."""
    return vectors.crossJoin(F.broadcast(query.limit(1))).select("id", F.round(cosine(F.col("v"), F.col("q")), 6).alias("score"))


def fuse(text_top: DataFrame, vector_top: DataFrame) -> DataFrame:
    """(id, fused) by reciprocal ranks: 1000 * (1 / (60 + rank in text) + 1.3 / (60 + rank in vectors)), absent 0."""
    t = text_top.select("id", F.col("rank").alias("rt"))
    v = vector_top.select(F.col("id").alias("vid"), F.col("rank").alias("rv"))
    both = t.join(v, F.col("id") == F.col("vid"), "full_outer")
    part = lambda c, w: F.coalesce(w / (60.0 + F.col(c)), F.lit(0.0))
    return both.select(F.coalesce("id", "vid").alias("id"), F.round(1000.0 * (part("rt", 1.0) + part("rv", 1.3)), 6).alias("fused"))


def first_of_key(ranked: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The best row of each key."""
    return ranked.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def within_budget(ranked: DataFrame, size: str, budget: int) -> DataFrame:
    """The first rows in rank order whose sizes stay within the budget; the first that doesn't fit ends it. ranked
    is a top-k, so the running sum sees few rows."""
    line = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(size).over(line)).filter(F.col("used") <= budget)
