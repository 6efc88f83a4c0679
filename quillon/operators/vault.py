"""The document vault: facets, pages, duplicate keys, seeded picks. Every operator is DataFrame -> DataFrame."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names per subject code that mean the same; a facet on one matches all.
SUBJECT_SYNONYMS = {"en": ("en", "eng", "english"), "fr": ("fr", "fra", "french"), "de": ("de", "ger", "german"), "es": ("es", "spa", "spanish")}


def vault(documents: DataFrame) -> DataFrame:
    """documents as vault rows: id, subject, author, size, file_hash, file_name, raw_text."""
    return documents.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("subject"), F.col("source").alias("author"), F.col("n_chars").alias("size"),
        F.sha2("text", 256).alias("file_hash"), F.concat("source", F.lit("/"), (F.col("n_chars") % 500).cast("string")).alias("file_name"),
        F.col("text").alias("raw_text"),
    )


def dedup_key() -> Column:
    """The hash, or where there is none the name in lower case."""
    return F.coalesce(F.nullif(F.col("file_hash"), F.lit("")), F.lower("file_name"))


def facets(rows: DataFrame, subject: str = "ALL", authors: tuple[str, ...] = (), keyword: str = "", min_size: int | None = None) -> DataFrame:
    """Conjunction of the facets that are set; "ALL" and empty values match everything. Keywords match without case."""
    tests: list[Column] = []
    if subject != "ALL":
        tests.append(F.lower("subject").isin(*SUBJECT_SYNONYMS.get(subject.lower(), (subject.lower(),))))
    if authors:
        tests.append(F.col("author").isin(*authors))
    if keyword:
        tests.append(F.col("raw_text").ilike(f"%{keyword}%") | F.col("file_name").ilike(f"%{keyword}%"))
    if min_size is not None:
        tests.append(F.col("size") >= min_size)
    return rows.filter(reduce(and_, tests)) if tests else rows


def exam_category(text: Column, patterns: dict[str, tuple[str, ...]], default: str) -> Column:
    """The first category one of whose phrases the text contains."""
    out = F.lit(default)
    for name, phrases in reversed(list(patterns.items())):
        out = F.when(reduce(or_, [F.lower(text).contains(p) for p in phrases]), name).otherwise(out)
    return out


def page(rows: DataFrame, order: list[Column], number: int, size: int, limit: int = 10_000) -> DataFrame:
    """Page ``number`` (from 1) in a total order; sizes are clamped to 1..limit."""
    size = max(1, min(limit, size))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def with_total(rows: DataFrame, page_rows: DataFrame) -> DataFrame:
    """The page with the number of all rows as total_rows; the count is one row."""
    return page_rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total_rows"))))


def key_groups(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """(name, first_id, n): each key's smallest id and count, combined before the shuffle."""
    return rows.groupBy(key.alias(name)).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def duplicate_flags(rows: DataFrame) -> DataFrame:
    """(id, n_copies, is_duplicate, is_copy): group sizes by dedup key, and which rows aren't the first of theirs."""
    keyed = rows.select("id", dedup_key().alias("key"))
    groups = key_groups(keyed, F.col("key"), "k")
    return keyed.join(groups, F.col("key") == F.col("k")).select("id", F.col("n").alias("n_copies"), (F.col("n") > 1).alias("is_duplicate"), (F.col("id") != F.col("first_id")).alias("is_copy"))


def unique_rows(rows: DataFrame) -> DataFrame:
    """(id): the first row of each dedup key."""
    return key_groups(rows, dedup_key(), "k").select(F.col("first_id").alias("id"))


def duplicated_rows(rows: DataFrame) -> DataFrame:
    """(id, by_hash, by_name): rows whose hash or whose name, without case, occurs more than once."""
    slim = rows.select("id", "file_hash", F.lower("file_name").alias("name"))
    more = lambda c: slim.filter(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(c).count().filter("count > 1").select(F.col(c).alias(f"{c}_more"))
    hit = slim.join(more("file_hash"), F.col("file_hash") == F.col("file_hash_more"), "left").join(more("name"), F.col("name") == F.col("name_more"), "left")
    flags = hit.select("id", F.col("file_hash_more").isNotNull().alias("by_hash"), F.col("name_more").isNotNull().alias("by_name"))
    return flags.filter("by_hash or by_name")


def prune_candidates(rows: DataFrame) -> DataFrame:
    """(id): rows that aren't the first of their dedup key."""
    return duplicate_flags(rows).filter("is_copy").select("id")


def vault_stats(rows: DataFrame) -> DataFrame:
    """One row: total_docs, total_bytes, unique_docs, duplicate_docs. Unique and duplicate are not complements."""
    slim = rows.select("id", "size", "file_hash", "file_name")
    total = slim.agg(F.count(F.lit(1)).alias("total_docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))
    unique = unique_rows(slim).agg(F.count(F.lit(1)).alias("unique_docs"))
    double = duplicated_rows(slim).agg(F.count(F.lit(1)).alias("duplicate_docs"))
    return total.crossJoin(unique).crossJoin(double)


def seeded_pick(rows: DataFrame, subject: str, author: str, seed: str, count: int = 1) -> DataFrame:
    """Rows in an order that the seed shuffles: those that match both facets first, then the subject, then any."""
    level = F.when((F.col("subject") == subject) & (F.col("author") == author), 1).when(F.col("subject") == subject, 2).otherwise(3)
    key = F.md5(F.concat(F.col("id").cast("string"), F.lit("|"), F.lit(seed)))
    return rows.select("id", "subject", "author", level.alias("relaxed"), key.alias("shuffle_key")).orderBy("relaxed", "shuffle_key").limit(count)
