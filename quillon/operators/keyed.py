"""Tables kept by key: upserts, inserts that skip, updates, deletes, eviction, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_upsert(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """old with new merged in by key. Rules by column: add, max, last (new unless null), keep (old unless null)."""
    o = old.select(F.col(key).alias("__k"), *[F.col(c).alias(f"o_{c}") for c in rules])
    n = new.select(F.col(key).alias("__j"), *[F.col(c).alias(f"n_{c}") for c in rules])
    merge = {
        "add": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "max": lambda a, b: F.greatest(a, b),
        "last": lambda a, b: F.coalesce(b, a),
        "keep": lambda a, b: F.coalesce(a, b),
    }
    both = o.join(n, F.col("__k") == F.col("__j"), "full_outer")
    return both.select(F.coalesce("__k", "__j").alias(key), *[merge[r](F.col(f"o_{c}"), F.col(f"n_{c}")).alias(c) for c, r in rules.items()])


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """old and those rows of new whose key is not there yet; of equal new keys the first in order."""
    first = new.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__r = 1").drop("__r")
    return old.unionByName(first.join(old.select(key), key, "left_anti"))


def coalesce_update(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with columns overwritten where updates has a value that is neither null nor empty."""
    u = updates.select(F.col(key).alias("__k"), *[F.col(c).alias(f"u_{c}") for c in columns])
    met = rows.join(u, F.col(key) == F.col("__k"), "left")
    new = {c: F.coalesce(F.nullif(F.col(f"u_{c}"), F.lit("")), F.col(c)).alias(c) for c in columns}
    return met.select(*[new.get(c, F.col(c)) for c in rows.columns])


def retention_delete(rows: DataFrame, column: str, newest: str, days: int) -> DataFrame:
    """Rows at most ``days`` older than the given time."""
    return rows.filter(F.col(column) >= F.expr(f"timestamp_ntz'{newest}' - interval {days} days"))


def cascade_delete(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent survives."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def lru_evict(cache: DataFrame, quota_share: float, keep_share: float = 0.85, most: int = 50) -> DataFrame:
    """(key, size, freed): entries to evict, oldest first, until the cache is down to keep_share of its quota.

    cache: key, size, last_used. The quota is a share of the bytes there. Only the ``most`` oldest entries can go,
    so the running sum sees a bounded number of rows; the entry that crosses the mark goes too.
    """
    total = cache.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    oldest = cache.orderBy("last_used", "key").limit(most)
    before = Window.orderBy("last_used", "key").rowsBetween(Window.unboundedPreceding, -1)
    excess = F.col("total") - F.floor(F.col("total") * quota_share * keep_share)
    run = oldest.withColumn("freed_before", F.coalesce(F.sum("size").over(before), F.lit(0))).crossJoin(F.broadcast(total))
    return run.filter(F.col("freed_before") < excess).select("key", "size", (F.col("freed_before") + F.col("size")).alias("freed"))


def queue_claim(queue: DataFrame, status: str, count: int) -> DataFrame:
    """The oldest ``count`` entries of a status, marked as claimed."""
    return queue.filter(F.col("status") == status).orderBy("queue_id").limit(count).withColumn("status", F.lit("claimed"))


def contributor_xp(rows: DataFrame, per_item: int, baseline: int) -> DataFrame:
    """(author, n_docs, xp): XP by contribution, a baseline at least."""
    counts = rows.groupBy("author").agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.select("author", "n_docs", F.greatest(F.col("n_docs") * per_item, F.lit(baseline)).cast("long").alias("xp"))
