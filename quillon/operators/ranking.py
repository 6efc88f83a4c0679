"""Standings, leaderboards, streaks, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tiers from the lowest: name and least rating (fixed values).
TIERS = (("T8", 0), ("T7", 400), ("T6", 700), ("T5", 1200), ("T4", 1400), ("T3", 1600), ("LT2", 1900), ("MT2", 2100), ("HT2", 2300), ("LT1", 2400), ("MT1", 2600), ("HT1", 3000))


def standing(rows: DataFrame, score: str, buckets: int = 64) -> DataFrame:
    """rows with ``standing`` = 1 + the number of rows strictly ahead, without one task that sorts all rows.

    Scores are cut at approximate quantiles into ranges; each range is ranked by itself and starts after the rows of
    the ranges above it. Equal scores share a range, so ties share a standing. Null scores come last.
    """
    cuts = sorted(set(rows.approxQuantile(score, [i / buckets for i in range(1, buckets)], 0.01)))
    part = sum((F.coalesce(F.col(score) >= c, F.lit(False)).cast("int") for c in cuts), F.when(F.col(score).isNull(), -1).otherwise(0))
    ranged = rows.withColumn("__part", part)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("__part").alias("__p"), ahead.alias("__ahead"))
    within = F.rank().over(Window.partitionBy("__part").orderBy(F.col(score).desc_nulls_last()))
    return ranged.join(F.broadcast(starts), F.col("__part") == F.col("__p")).withColumn("standing", (F.col("__ahead") + within).cast("long")).drop("__part", "__p", "__ahead")


def tier(rating: Column) -> Column:
    """The tier of a rating."""
    out = F.lit(TIERS[0][0])
    for name, least in TIERS[1:]:
        out = F.when(rating >= least, name).otherwise(out)
    return out


def tier_index(rating: Column) -> Column:
    return sum(((rating >= least).cast("int") for _, least in TIERS[1:]), F.lit(0))


def tier_progress(rating: Column) -> tuple[Column, Column, Column]:
    """(tier, percent of the way to the next tier, points that it takes)."""
    i = tier_index(rating)
    least = F.element_at(F.array(*[F.lit(t) for _, t in TIERS]), i + 1)
    after = F.element_at(F.array(*[F.lit(t) for _, t in TIERS[1:]], F.lit(3000)), i + 1)
    top = rating >= 3000
    share = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (rating - least) * 100.0 / F.greatest(after - least, F.lit(1))))
    return tier(rating), F.when(top, 100.0).otherwise(F.bround(share, 1)), F.when(top, 0).otherwise(F.greatest(after - rating, F.lit(0)))


def day_streaks(visits: DataFrame, zone: str = "Asia/Ho_Chi_Minh") -> DataFrame:
    """(user_id, current_streak, max_streak, last_day, xp) from (user_id, ts in UTC): runs of consecutive local days;
    a check-in is worth 50 and 5 more for each day of the run, up to 50 more."""
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts")))
    days = visits.select("user_id", day.alias("day")).distinct()
    by_user = Window.partitionBy("user_id").orderBy("day")
    run = days.withColumn("anchor", F.date_sub("day", F.row_number().over(by_user)))
    placed = run.withColumn("streak", F.row_number().over(Window.partitionBy("user_id", "anchor").orderBy("day")))
    xp = F.sum(F.lit(50) + F.least(F.col("streak") * 5, F.lit(50)))
    return placed.groupBy("user_id").agg(
        F.max_by("streak", "day").cast("long").alias("current_streak"), F.max("streak").cast("long").alias("max_streak"), F.max("day").alias("last_day"), xp.cast("long").alias("xp")
    )


def match_streaks(matches: DataFrame) -> DataFrame:
    """(player, current_streak, max_streak) from (player, seq, outcome): wins since the last loss; a draw changes
    nothing."""
    line = Window.partitionBy("player").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    island = matches.withColumn("losses", F.count(F.when(F.col("outcome") == "LOSS", 1)).over(line))
    wins = island.groupBy("player", "losses").agg(F.count(F.when(F.col("outcome") == "WIN", 1)).alias("wins"))
    return wins.groupBy("player").agg(F.max_by("wins", "losses").alias("current_streak"), F.max("wins").alias("max_streak"))


def first_solves(attempts: DataFrame) -> DataFrame:
    """attempts (user, problem, seq, accepted) with attempt number, solved_before and is_first_solve."""
    line = Window.partitionBy("user", "problem").orderBy("seq")
    before = F.coalesce(F.max(F.col("accepted").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    return attempts.withColumn("attempt", F.row_number().over(line).cast("long")).withColumn("solved_before", before).withColumn("is_first_solve", F.col("accepted") & ~before)


def recent(rows: DataFrame, key: str, order: list[Column], count: int) -> DataFrame:
    """The first ``count`` rows of each key in order, with their place as rn."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).filter(F.col("rn") <= count)


def win_rate(wins: Column, losses: Column) -> Column:
    """Percent of wins, rounded half to even to one place."""
    return F.bround(wins * 100.0 / F.greatest(wins + losses, F.lit(1)), 1)
