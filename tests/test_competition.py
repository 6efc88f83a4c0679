"""Rating formulas against pinned values, folds and quotas against brute force."""

import math
from collections import defaultdict
from datetime import timedelta

from pyspark.sql import functions as F

from quillon.functions import rating
from quillon.operators import bursts, contests, ranking
from quillon.plans import competition
from quillon.sources.session import read_table


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_pinned_ratings(spark):
    lit = F.lit
    assert one(spark, rating.score(lit(1200), lit(True))) == 102.0
    assert one(spark, rating.score(lit(1200), lit(False))) == 120.0
    assert one(spark, rating.solve_delta(lit(1000), lit(1500), lit(False))) == 57
    assert one(spark, rating.solve_delta(lit(1000), lit(1500), lit(True))) == 48
    assert one(spark, rating.solve_delta(lit(2500), lit(800), lit(False))) == 1
    penalty = lambda p, mode1=False: one(spark, rating.fail_penalty(lit(1500), lit(p), lit(mode1), lit(False), lit(0.0)))
    assert [penalty(800), penalty(1500), penalty(2500), penalty(1500, True)] == [-16, -30, -50, -26]


def test_newcomers_lose_nothing_on_events(spark):
    assert one(spark, rating.fail_penalty(F.lit(1399), F.lit(2000), F.lit(False), F.lit(True), F.lit(0.1))) == 0
    assert one(spark, rating.fail_penalty(F.lit(1400), F.lit(2000), F.lit(False), F.lit(True), F.lit(0.1))) == -50


def test_tiers(spark):
    rows = spark.createDataFrame([(-5,), (0,), (399,), (400,), (1900,), (2999,), (3000,), (9999,)], "r int")
    assert [r[0] for r in rows.select(ranking.tier(F.col("r"))).collect()] == ["T8", "T8", "T8", "T7", "LT2", "MT1", "HT1", "HT1"]


def seed(r, others):
    return 1 + sum(1 / (1 + 10 ** max(-10, min(10, (r - o) / 400))) for o in others)


def test_performance_is_the_bisection(spark):
    rows = [("a", i, r, i + 1) for i, r in enumerate([1500, 1200, 1400, 1600, 1800])] + [("b", 9, 1300, 1)]
    df = spark.createDataFrame(rows, "contest string, user long, rating long, rank long")
    got = {(r["contest"], r["user"]): r["performance"] for r in contests.performances(df).collect()}
    for i, (_, u, r, rank) in enumerate(rows[:5]):
        others = [x[2] for j, x in enumerate(rows[:5]) if j != i]
        goal, low, high = math.sqrt(rank * seed(r, others)), 0.0, 4500.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if seed(mid, others) > goal else (low, mid)
        assert abs(got["a", u] - (low + high) / 2) < 0.06
    assert got["b", 9] == 1300.0


def test_contest_changes_lose_one_a_head(spark, sf_dir):
    got = competition.contest_batch(spark, sf_dir).groupBy("contest").agg(F.sum("delta").alias("d"), F.count(F.lit(1)).alias("n")).collect()
    assert got and all(abs(r["d"] + r["n"]) <= r["n"] / 2 + 1 for r in got)


def test_rating_fold(spark, sf_dir):
    got = {r["user"]: (r["final_rating"], r["peak_rating"]) for r in competition.rating_fold(spark, sf_dir).collect()}
    lines = defaultdict(list)
    for r in competition.attempts(spark, sf_dir).collect():
        lines[r["o_custkey"]].append((r["o_orderkey"], r["p"], r["mode1"]))
    for user, line in lines.items():
        now = peak = 1200
        for _, p, ok in sorted(line):
            if ok:
                k = 60 if now < 1200 else 45 if now < 2000 else 35
                now += max(1, round(k * (1 - 1 / (1 + 10 ** max(-10, min(10, (max(800, p) - now) / 400))))))
            else:
                now -= max(5, round(50 * min(1, max(0.25, min(3500, p) / 2500))))
            now = max(0, now)
            peak = max(peak, now)
        assert got[user] == (now, peak)


def test_admission_and_ttl(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    rows = sorted((r["user_id"], r["ts"], r["event_id"]) for r in events.collect())
    log, want = defaultdict(list), set()
    for user, ts, i in rows:
        live = [t for t in log[user] if ts - t < timedelta(hours=24)]
        if len(live) < 3:
            log[user] = [*live, ts]
            want.add(i)
    assert {r["event_id"] for r in competition.rate_limit_admit(spark, sf_dir).collect()} == want


def test_hostility_folds_in_order(spark):
    rows = [("c", 1, "x", "you idiot"), ("c", 2, "y", "haha"), ("c", 3, "y", "moron, worthless"), ("c", 4, "x", "ok"), ("d", 1, "x", "idiot moron pathetic")]
    df = spark.createDataFrame(rows, "channel string, seq int, user string, text string").withColumn("ts", F.timestamp_seconds(F.col("seq") * 15))
    got = {(r["channel"], r["seq"]): (r["score"], r["fires"]) for r in bursts.hostility(df, ("idiot", "moron", "pathetic"), ("worth(less|y)",), r"\b(you)\b", ("haha",)).collect()}
    assert got == {("c", 1): (0, False), ("c", 2): (30, False), ("c", 3): (105, True), ("c", 4): (105, True), ("d", 1): (0, False)}
    # the first message is 30 seconds old at the third
    near = bursts.hostility(df, ("idiot", "moron", "pathetic"), ("worth(less|y)",), r"\b(you)\b", ("haha",), least=50, seconds=20)
    assert {(r["channel"], r["seq"]): r["score"] for r in near.collect()} == {("c", 1): 0, ("c", 2): 30, ("c", 3): 0, ("c", 4): 75, ("d", 1): 0}
    assert [tuple(r) for r in bursts.alerts(near.withColumn("fires", F.col("score") >= 30), 20).orderBy("seq").collect()] == [("c", 2), ("c", 4)]


def test_standing_shares_ties(spark):
    rows = spark.createDataFrame([(i, float(i // 3)) for i in range(300)] + [(999, None)], "id long, s double")
    got = {r["id"]: r["standing"] for r in ranking.standing(rows, "s", 8).collect()}
    assert all(got[i] == 1 + 3 * (99 - i // 3) for i in range(300)) and got[999] == 301
