"""Contest seeds, performances, rating changes, and ratings folded over time."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.rating import fail_penalty, solve_delta, whole
from quillon.sources.session import materialize

#: Halvings, the highest rating, and the whole ratings up to it.
STEPS, HIGHEST, GRID = 50, 4500.0, 4501
#: How near to the middle of two tenths, in tenths, a performance is worked out anew.
NEAR = 1e-5
#: Participants of a contest that one task rates.
PART = 100_000
#: Ratings that are compared with all others of a contest at once.
TILE = 512


def seeds(participants: DataFrame) -> DataFrame:
    """participants (contest, user, rating) with ``seed`` = 1 + the sum of the others' chances to win.

    Equal ratings have equal seeds, so a contest is its counts of distinct ratings: a few thousand rows at most,
    whatever the number of participants, and their chances are products of small matrices.
    """
    counts = participants.groupBy("contest", "rating").agg(F.count(F.lit(1)).alias("n"))

    def of_contest(rows: pd.DataFrame) -> pd.DataFrame:
        r, n = rows["rating"].to_numpy(float), rows["n"].to_numpy(float)
        seed = np.empty(len(r))
        for at in range(0, len(r), TILE):
            difference = r[at : at + TILE, None] - r[None, :]
            seed[at : at + TILE] = (1.0 / (1.0 + 10.0 ** (difference / 400.0))) @ n
        # oneself is among the others' chances with one half
        return rows[["contest", "rating"]].assign(seed=seed + 0.5)

    kinds = [f"{c} {participants.schema[c].dataType.simpleString()}" for c in ("contest", "rating")]
    sums = counts.groupBy("contest").applyInPandas(of_contest, f"{kinds[0]}, {kinds[1]}, seed double")
    return participants.join(sums, ["contest", "rating"])


def _chance(r: np.ndarray, o: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + 10.0 ** np.clip((r - o) / 400.0, -10, 10))


def _sums(r: np.ndarray, others: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The sums of the chances of all others against ratings r, some ratings at once."""
    tile = max(1, (TILE << 12) // max(1, len(others)))
    return np.concatenate([_chance(r[at : at + tile, None], others[None, :]) @ count for at in range(0, len(r), tile)] or [np.empty(0)])


def _halved(rating: np.ndarray, goal: np.ndarray, others: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The rating at which the seed is the goal, by halves on exact seeds."""
    low, high = np.zeros(len(rating)), np.full(len(rating), HIGHEST)
    for _ in range(STEPS):
        mid = (low + high) / 2
        up = 1.0 + _sums(mid, others, count) - _chance(mid, rating) > goal
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def _performance(rating: np.ndarray, rank: np.ndarray, others: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Ratings whose seed is the geometric mean of rank and own seed, rounded to one place.

    Seeds fall smoothly with the rating, over hundreds of points. So they and their slopes are worked out once at every
    whole rating, and between two of these a cubic takes their place, to some 1e-9 points. Participants so near to the
    middle of two roundings that this could matter are rated by halves on exact seeds, as are few of them in all.
    """
    own, at = np.unique(rating, return_inverse=True)
    if len(rating) * STEPS < GRID:
        return np.round(_halved(rating, np.sqrt(rank * (0.5 + _sums(own, others, count)[at])), others, count), 1)
    slope = np.log(10.0) / 400.0
    grid = np.arange(GRID, dtype=float)
    value, fall = np.empty(GRID), np.empty(GRID)
    tile = max(1, (TILE << 12) // max(1, len(others)))
    for k in range(0, GRID, tile):
        p = _chance(grid[k : k + tile, None], others[None, :])
        value[k : k + tile] = p @ count
        fall[k : k + tile] = -slope * ((p * (1 - p)) @ count)
    on = (own >= 0) & (own <= HIGHEST) & (own == np.floor(own))
    seed = np.empty(len(own))
    seed[on], seed[~on] = value[own[on].astype(int)], _sums(own[~on], others, count)
    goal = np.sqrt(rank * (0.5 + seed[at]))
    low, high = np.zeros(len(rating), dtype=int), np.full(len(rating), GRID - 1)
    while (high - low).max() > 1:
        mid = (low + high) // 2
        up = (1.0 + value[mid] - _chance(mid, rating) > goal) & (high - low > 1)
        low, high = np.where(up, mid, low), np.where(up | (high - low <= 1), high, mid)
    a, b, da, db = value[low], value[high], fall[low], fall[high]
    c2, c3 = 3 * (b - a) - 2 * da - db, 2 * (a - b) + da + db
    x = np.full(len(rating), 0.5)
    for _ in range(4):
        p = _chance(low + x, rating)
        y = 1.0 + a + x * (da + x * (c2 + x * c3)) - p - goal
        rate = da + x * (2 * c2 + 3 * x * c3) + slope * p * (1 - p)
        x = np.clip(x - np.divide(y, rate, out=np.where(y > 0, -1.0, 1.0), where=rate < 0), 0.0, 1.0)
    r = low + x
    unsure = np.abs(r * 10 - np.floor(r * 10) - 0.5) < NEAR
    r[unsure] = _halved(rating[unsure], goal[unsure], others, count)
    return np.round(r, 1)


def performances(participants: DataFrame) -> DataFrame:
    """(contest, user, rating, rank, performance). A contest's participants are dealt to parts, each with the counts
    of the contest's distinct ratings; alone in a contest, one performs as rated."""
    # read three times below
    participants = materialize(participants.select("contest", "user", "rating", "rank"), "participants")
    sizes = participants.groupBy("contest").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = participants.join(sizes, "contest").withColumn("part", F.pmod(F.xxhash64("user"), F.col("parts")).cast("int"))
    counts = participants.groupBy("contest", "rating").agg(F.count(F.lit(1)).alias("n")).join(sizes, "contest")
    counts = counts.select(F.col("contest").alias("of"), F.col("rating").alias("rated"), "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"))

    def rate(key, who: pd.DataFrame, hist: pd.DataFrame) -> pd.DataFrame:
        if hist["n"].sum() <= 1:
            p = who["rating"].to_numpy(float)
        else:
            p = _performance(who["rating"].to_numpy(float), who["rank"].to_numpy(float), hist["rated"].to_numpy(float), hist["n"].to_numpy(float))
        return who[["contest", "user", "rating", "rank"]].assign(performance=p)

    cols = dealt.select("contest", "part", "user", "rating", "rank")
    schema = ", ".join(f"{c} {participants.schema[c].dataType.simpleString()}" for c in ("contest", "user", "rating", "rank"))
    return cols.groupBy("contest", "part").cogroup(counts.groupBy("of", "of_part")).applyInPandas(rate, f"{schema}, performance double")


def contest_changes(performed: DataFrame) -> DataFrame:
    """performed with delta and new_rating: half the way to the performance, shifted so that a contest loses one
    point a head in all."""
    # read twice, and rated once
    performed = materialize(performed, "performed")
    raw = (F.col("performance") - F.col("rating")) * 0.5
    shift = performed.groupBy("contest").agg((-F.sum(raw.cast("decimal(18,4)")).cast("double") / F.count(F.lit(1)) - 1.0).alias("shift"))
    met = performed.join(shift, "contest").withColumn("delta", whole(raw + F.col("shift")))
    return met.withColumn("new_rating", F.greatest(F.lit(0), F.col("rating") + F.col("delta"))).drop("shift")


def rating_fold(attempts: DataFrame, start: int = 1200) -> DataFrame:
    """(user, n_attempts, final_rating, peak_rating) from (user, seq, problem, accepted).

    Each step depends on the rating so far, so a user's attempts are folded in order; a user's history is one array.
    """
    line = F.array_sort(F.collect_list(F.struct("seq", "problem", "accepted")))

    def step(acc: Column, x: Column) -> Column:
        now = acc["rating"]
        moved = F.greatest(F.lit(0), now + F.when(x["accepted"], solve_delta(now, x["problem"], F.lit(False))).otherwise(fail_penalty(now, x["problem"], F.lit(False), F.lit(False), F.lit(0.0)))).cast("long")
        return F.struct(moved.alias("rating"), F.greatest(acc["peak"], moved).alias("peak"))

    zero = F.struct(F.lit(start).cast("long").alias("rating"), F.lit(start).cast("long").alias("peak"))
    folded = attempts.groupBy("user").agg(F.count(F.lit(1)).alias("n_attempts"), line.alias("line"))
    return folded.withColumn("r", F.aggregate("line", zero, step)).select("user", "n_attempts", F.col("r.rating").alias("final_rating"), F.col("r.peak").alias("peak_rating"))


