"""Links just above the threshold in narrow cones, where raw vectors have all the same pivots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import pivot_index


def cone(rng, n, d, mean_cosine):
    """Unit vectors of which two have that cosine on average."""
    t = rng.normal(size=(n, d))
    t[:, 0] = 0
    t /= np.linalg.norm(t, axis=1, keepdims=True)
    return np.sqrt(mean_cosine) * np.eye(d)[0] + np.sqrt(1 - mean_cosine) * t


def partners(rng, u, mean_cosine, cosine):
    """A vector of the cone for each of u, with that cosine to it."""
    axis = np.eye(u.shape[1])[0]
    a = u - np.outer(u @ axis, axis)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=u.shape)
    r[:, 0] = 0
    r -= (r * a).sum(1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    t = (cosine - mean_cosine) / (1 - mean_cosine)
    return np.sqrt(mean_cosine) * axis + np.sqrt(1 - mean_cosine) * (t * a + np.sqrt(1 - t * t) * r)


@pytest.mark.parametrize("mean_cosine", [0.0, 0.5, 0.75])
@pytest.mark.parametrize("pivots", [256, 4096])
@pytest.mark.parametrize("d", [64, 256])
def test_recall_near_the_threshold(d, pivots, mean_cosine):
    """The rule on its own: what two vectors with a cosine of 0.905 share of so many pivots."""
    rng = np.random.default_rng(d + pivots)
    sample, u = cone(rng, pivots, d, mean_cosine), cone(rng, 1500, d, mean_cosine)
    v = partners(rng, u, mean_cosine, 0.905)
    mean, cosine = pivot_index.shape_of(sample)
    points = pivot_index._centred(sample, mean)
    k = pivot_index.nearest_of(cosine, len(points))
    near = [np.argsort(-(pivot_index._centred(x, mean) @ points.T), axis=1)[:, :k] for x in (u, v)]
    shared = (near[0][:, :, None] == near[1][:, None, :]).sum(axis=(1, 2))
    assert (shared >= pivot_index.SHARED).mean() >= 0.98
    if mean_cosine == 0:
        assert k <= 2 * pivot_index.NEAREST


@pytest.mark.parametrize("mean_cosine", [0.5, 0.75])
def test_cones_are_indexed_not_compared_whole(spark, mean_cosine):
    rng = np.random.default_rng(3)
    u = cone(rng, 4000, 64, mean_cosine)
    x = np.concatenate([u, partners(rng, u[:300], mean_cosine, 0.905)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in pivot_index.near_duplicates(df).collect()}
    cos = x @ x.T
    np.fill_diagonal(cos, 0)
    want = (cos >= pivot_index.THRESHOLD).sum(1)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert all(got[i]["n_links"] <= want[i] for i in range(len(x))) and found >= 0.98 * want.sum() > 0
    units = df.select(F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("size"), F.col("embedding").alias("v"), F.md5(F.col("vec_id").cast("string")).alias("key"))
    lists = pivot_index.describe(units, pivot_index.pivots_of(units, len(x))).select(F.explode("near").alias("p")).groupBy("p").count().collect()
    # no list has all of them
    assert len(lists) >= 50 and max(r["count"] for r in lists) < 0.6 * len(x)
