"""Embedding near-dedup by a pivot-permutation index.

1. Classes. Vectors with equal components are one class, so a group of copies costs one vector.
2. Pivots. PIVOTS_PER_ROOT * sqrt(classes) reference points, at least MIN_PIVOTS, are taken from a sample of
   vectors of that size, chosen by hash; one whose cosine to an earlier one is APART or more is left out. So a group
   of near copies, however large, has one pivot that all its members share, and not a matching share of the pivots
   that noise puts in order. APART lies below THRESHOLD, as a group whose links are the closer of its pairs only
   needs this too. Every class is then indexed: it is described by its nearest pivots in order, and stands in the
   inverted list of each. Vectors and pivots are centred for that, by the mean of the sample: raw embeddings often lie
   in a narrow cone, where all have the same few pivots. What is a cosine of THRESHOLD between vectors is less between
   centred ones (``shape_of``); how many pivots describe a class grows with that spread and with the fourth root of the
   pivots, from NEAREST on, which keeps the share of links found near THRESHOLD the same (README has figures).
3. Retrieval. Two classes are candidates if they share at least SHARED of those pivots. A pair is looked at in the
   list of the first pivot that they share only, so it counts once.
4. Verification: cosine in double precision, at least THRESHOLD.

A list is cut into blocks of BLOCK vectors by hash, and a task compares one pair of blocks with matrix products, TILE
rows by TILE rows, so a hot list is spread over tasks and no task holds more than two blocks and a tile of products.
From a pair of blocks come sums, not pairs: the links of each vector (weighted by the size of the classes it meets),
and a spanning forest of the links found, of at most one edge a vector and tile. All pairs of a large group of near
copies are compared, as their links are to be counted, but never written. A vector is sent once to each block of its
lists: a list of n vectors sends n * n / BLOCK of them, single precision until a pair comes close to THRESHOLD.

The number of pivots grows with the square root of the classes, as do the lists; work grows with the power 1.75,
and with the square of the largest group of near copies, whose pairs are all compared.

Defined results: a vector that is null, zero, or holds null or non-finite components has n_links 0 and is alone;
rows with equal vectors are linked with each other; rows with equal ids are counted one by one; a null id takes
part, and its component is the smallest id that isn't null; vectors of different length are never linked; other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.graph import connected_components, forest
from quillon.sources.session import materialize

THRESHOLD, APART = 0.9, 0.7
NEAREST, SHARED = 8, 2
#: Pivots up to which NEAREST of them do for vectors that lie in no cone; the squared length of their mean counts up to CONE.
FEW_PIVOTS, CONE = 256, 0.9
PIVOTS_PER_ROOT, MIN_PIVOTS, MAX_PIVOTS = 1.0, 64, 16_384
BLOCK, TILE = 8_192, 1_024
#: Single-precision cosines this far below THRESHOLD are computed again in double precision.
NEAR = 1e-4
#: Close pairs of two blocks from which products count what they share.
MANY = 100_000


def classes(vectors: DataFrame, id_column: str, embedding: str) -> DataFrame:
    """(id, v, ok, key): each row with its vector as doubles, whether it can be linked, and a name of its class."""
    v = F.col(embedding).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    # -0.0 and 0.0 are one value
    clean = F.transform(v, lambda x: F.when(x == 0, 0.0).otherwise(x))
    named = F.md5(F.array_join(F.transform(clean, lambda x: x.cast("string")), ",")).alias("key")
    return vectors.select(F.col(id_column).alias("id"), clean.alias("v"), F.coalesce(ok, F.lit(False)).alias("ok"), named)


def shape_of(points: np.ndarray) -> tuple[np.ndarray, float]:
    """(mean, cosine): the mean of unit vectors, and the centred cosine of two whose cosine is THRESHOLD and which lie as far from
    the mean as most do."""
    mean = points.mean(axis=0)
    cone = min(CONE - 0.05, float(mean @ mean) if len(points) > 1 else 0.0)
    return mean, (THRESHOLD - cone) / (1.0 - cone)


def nearest_of(cosine: float, pivots: int) -> int:
    """How many pivots describe a class: more where links are further apart among the pivots, and where there are more of them."""
    spread = math.sqrt((1.0 - cosine) / (1.0 - THRESHOLD))
    return min(pivots, round(NEAREST * spread * max(1.0, pivots / FEW_PIVOTS) ** 0.25))


def _centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    y = x - mean
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)


def pivots_of(units: DataFrame, count: int) -> dict[int, tuple[int, np.ndarray, np.ndarray, int]]:
    """By vector length: the number of its first reference point, these points, the mean that they are centred by, and how many of
    them describe a vector. MAX_PIVOTS bounds them, and no two of a length are near to each other."""
    n = min(MAX_PIVOTS, max(MIN_PIVOTS, round(PIVOTS_PER_ROOT * math.sqrt(count))))
    by_length: dict[int, list] = {}
    for r in units.select("v", "key").orderBy(F.xxhash64(F.lit("pivot"), "key"), "key").limit(n).collect():
        x = np.array(r["v"]) / max(map(abs, r["v"]))
        by_length.setdefault(len(x), []).append(x / np.linalg.norm(x))
    out, at = {}, 0
    for d, p in by_length.items():
        points = np.stack(p)
        mean, cosine = shape_of(points)
        # chance alone brings points of few dimensions near to each other
        apart = max(cosine - (THRESHOLD - APART), min(APART, 4.0 / math.sqrt(d)))
        points = _thinned(_centred(points, mean), apart)
        out[d] = (at, points, mean, nearest_of(cosine, len(points)))
        at += len(points)
    return out


def _thinned(points: np.ndarray, apart: float = APART) -> np.ndarray:
    """The points in order without those whose cosine to an earlier one that stays is apart or more."""
    kept, n = np.empty_like(points), 0
    for p in points:
        if not (kept[:n] @ p >= apart).any():
            kept[n] = p
            n += 1
    return kept[:n].copy()


def describe(units: DataFrame, pivots: dict[int, tuple[int, np.ndarray, np.ndarray, int]]) -> DataFrame:
    """(node, size, v, near): the nearest pivots of each class, in order. pivots: by vector length, with the number
    of the first; a length without pivots has one list of its own."""
    shared = units.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = shared.value
        for b in batches:
            vs = b.column(2).to_pylist()
            lengths = np.array([len(x) for x in vs])
            out: list = [None] * len(vs)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                if d not in by_length:
                    for i in at:
                        out[i] = [-int(d)]
                    continue
                offset, p, mean, k = by_length[d]
                x = np.array([vs[i] for i in at])
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                order = np.argsort(-(_centred(x, mean) @ p.T), axis=1, kind="stable")[:, :k] + offset
                for i, o in zip(at, order.tolist(), strict=True):
                    out[i] = o
            near = pa.array(out, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, near], names=["node", "size", "v", "near"])

    return units.select("node", "size", "v").mapInArrow(run, "node long, size long, v array<double>, near array<int>")


def _unit(t: pd.DataFrame) -> np.ndarray:
    x = np.stack(t["v"].to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(a: pd.DataFrame, b: pd.DataFrame, pivot: int, same: bool) -> tuple[list, list]:
    """(links, edges) of two blocks of one list: links (node, sum of sizes), edges (node, node)."""
    if len(a["v"].iloc[0]) != len(b["v"].iloc[0]) or len(a["near"].iloc[0]) != len(b["near"].iloc[0]):
        return [], []
    xa, xb = _unit(a), _unit(b)
    na, nb = np.stack(a["near"].to_numpy()), np.stack(b["near"].to_numpy())
    sa, sb, ids_a, ids_b = a["size"].to_numpy(), b["size"].to_numpy(), a["node"].to_numpy(), b["node"].to_numpy()
    la, lb, edges = np.zeros(len(a)), np.zeros(len(b)), []
    for p in range(0, len(a), TILE):
        for q in range(p if same else 0, len(b), TILE):
            i, j = _close(xa[p : p + TILE], xb[q : q + TILE], na[p : p + TILE], nb[q : q + TILE], pivot, same and p == q)
            if len(i):
                i, j = i + p, j + q
                la += np.bincount(i, sb[j], len(a))
                lb += np.bincount(j, sa[i], len(b))
                edges += forest(ids_a[i], ids_b[j])
    links = [(n, int(v)) for ids, sums in ((ids_a, la), (ids_b, lb)) for n, v in zip(ids, sums, strict=True) if v]
    return links, edges


def _close(xa: np.ndarray, xb: np.ndarray, na: np.ndarray, nb: np.ndarray, pivot: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of two tiles that are links, share enough pivots, and pivot as the first of them."""
    close = xa.astype(np.float32) @ xb.astype(np.float32).T >= THRESHOLD - NEAR
    if same:
        close = np.triu(close, 1)
    least = min(SHARED, na.shape[1])
    if np.count_nonzero(close) * na.shape[1] ** 2 > MANY * NEAREST**2:
        # a group of near copies makes most pairs close: what they share comes from products too
        names = np.unique(np.concatenate([na, nb]))
        ia, ib = _marks(na, names), _marks(nb, names)
        before = names < pivot
        close &= (ia @ ib.T >= least) & (ia[:, before] @ ib[:, before].T == 0) & (xa @ xb.T >= THRESHOLD)
        return np.nonzero(close)
    i, j = np.nonzero(close)
    ok = np.einsum("ij,ij->i", xa[i], xb[j]) >= THRESHOLD
    i, j = i[ok], j[ok]
    p, q = na[i], nb[j]
    equal = p[:, :, None] == q[:, None, :]
    first = np.where(equal.any(axis=2), p, np.iinfo(np.int32).max).min(axis=1, initial=np.iinfo(np.int32).max)
    ok = (equal.sum(axis=(1, 2)) >= least) & (first == pivot)
    return i[ok], j[ok]


def _marks(near: np.ndarray, names: np.ndarray) -> np.ndarray:
    """A row for each row of near: 1 at the names that stand in it."""
    out = np.zeros((len(near), len(names)), np.float32)
    np.put_along_axis(out, np.searchsorted(names, near), 1, axis=1)
    return out


def near_links(described: DataFrame) -> DataFrame:
    """(node, other, links): partial sums of links (other null) and edges (links null)."""
    lists = described.select("node", "size", "v", "near", F.explode("near").alias("pivot"))
    counts = lists.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.col("pivot").alias("of"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = lists.join(counts, F.col("pivot") == F.col("of")).withColumn("block", block)
    # block i meets the blocks from i on: a vector goes to the pairs (block, j) for j >= block and (i, block) for i < block
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    dealt = placed.select("pivot", "node", "size", "v", "near", "block", F.explode(pairs).alias("x")).select("pivot", "x.i", "x.j", "block", "node", "size", "v", "near")

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        pivot, i, j = key
        a = rows[rows["block"] == i]
        b = a if i == j else rows[rows["block"] == j]
        links, edges = _compare(a, b, pivot, i == j) if len(a) and len(b) else ([], [])
        return pd.DataFrame(
            {
                "node": pd.array([x for x, _ in links] + [x for x, _ in edges], dtype="Int64"),
                "other": pd.array([None] * len(links) + [y for _, y in edges], dtype="Int64"),
                "links": pd.array([n for _, n in links] + [None] * len(edges), dtype="Int64"),
            }
        )

    return dealt.groupBy("pivot", "i", "j").applyInPandas(run, "node long, other long, links long")


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row a vector: id, n_links, component_id (the smallest id that links reach) and kept (its own id is it)."""
    rows = materialize(classes(vectors, id_column, embedding), "pivot-rows")
    good = rows.filter("ok")
    units = good.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.first("v").alias("v"))
    # numbers, not hashes: no two classes share one
    units = materialize(units.withColumn("node", F.monotonically_increasing_id()), "pivot-classes")
    described = describe(units, pivots_of(units, units.count()))
    found = materialize(near_links(described), "pivot-links")
    sums = found.filter("links is not null").groupBy(F.col("node").alias("ln")).agg(F.sum("links").alias("links"))
    of = connected_components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    per_class = units.select(F.col("key").alias("k"), "node", "size").join(sums, F.col("node") == F.col("ln"), "left").join(of.withColumnRenamed("node", "cn"), F.col("node") == F.col("cn"), "left")
    per_class = per_class.select("k", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    named = good.select("id", "key").join(per_class, F.col("key") == F.col("k")).select("id", "n_links", "c")
    least = named.groupBy("c").agg(F.min("id").alias("least")).withColumnRenamed("c", "c2")
    linked = named.join(least, F.col("c") == F.col("c2")).select("id", "n_links", "least")
    alone = rows.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("least"))
    return linked.unionAll(alone).select(F.col("id").alias(id_column), "n_links", F.col("least").alias("component_id"), F.col("id").eqNullSafe(F.col("least")).alias("kept"))
