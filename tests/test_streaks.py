"""Achievements against a fold over each player's matches, with many cells and with one."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.operators import streaks

SCHEMA = "match_id long, ts timestamp, winner long, loser long, start_prob double, min_prob double, loser_max_prob double, loser_led boolean"


def folded(matches):
    """The rules, match by match."""
    state = defaultdict(lambda: {"streak": 0, "fortune": 0, "outclassed": 0, "clutch": 0, "doomed": False})
    out = {}
    for m, _, w, loser, start, low, top, led in sorted(matches, key=lambda x: (x[1], x[0])):
        if w is not None:
            s = state[w]
            s["streak"] += 1
            s["outclassed"] = s["outclassed"] + 1 if start > 80 else 0
            s["fortune"] += start < 15
            s["clutch"] += 5 <= low <= 10
            s["doomed"] = False
            role = None
            if s["streak"] >= 50:
                role = "OVERLORD"
            elif s["fortune"] >= 20:
                role = "GODLY_LUCK"
            elif low < 5 or (low <= 10 and s["clutch"] >= 10):
                role = "CLUTCHMASTER"
            elif s["outclassed"] >= 10:
                role = "OUTCLASSED"
            elif s["fortune"] >= 10:
                role = "FORTUNE"
            out[m, w, True] = (*(s[k] for k in ("streak", "fortune", "outclassed", "clutch", "doomed")), role)
        if loser is not None:
            s = state[loser]
            s.update(streak=0, fortune=0, outclassed=0, clutch=0, doomed=s["doomed"] or ((top >= 85 or led) and low <= 10))
            out[m, loser, False] = (0, 0, 0, 0, s["doomed"], "DOOMED" if s["doomed"] else None)
    return out


def games(r, n):
    """A player in a third of all matches, who seldom loses; times with ties."""
    t0 = datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        hot = r.random() < 0.4
        w, loser = (0, r.randint(1, 6)) if hot and r.random() < 0.99 else (r.randint(1, 6), 0) if hot else r.sample(range(1, 7), 2)
        start = r.choice([3.0, 12.0, 14.9, 15.0, 50.0, 80.0, 81.0, 95.0]) if r.random() < 0.5 else 90.0
        rows.append((k, t0 + timedelta(seconds=r.randint(0, n // 2)), w, loser, start, r.choice([2.0, 5.0, 7.0, 10.0, 30.0, 60.0]), r.choice([40.0, 85.0, 99.0]), r.random() < 0.2))
    return rows


@pytest.mark.parametrize("rows_per_cell", [7, 100, 10**6])
def test_achievements_are_those_of_a_fold(spark, rows_per_cell):
    matches = games(random.Random(rows_per_cell), 1200)
    got = streaks.achievements(spark.createDataFrame(matches, SCHEMA), rows_per_cell).collect()
    shown = {(x["match_id"], x["player"], x["won"]): (x["streak"], x["fortune"], x["outclassed"], x["clutch"], x["doomed"], x["role"]) for x in got}
    want = folded(matches)
    assert shown == want and len(got) == len(want)
    assert {"OVERLORD", "CLUTCHMASTER", "DOOMED"} <= {v[-1] for v in want.values()}


def test_a_hot_player_is_many_groups(spark):
    df = spark.createDataFrame(games(random.Random(1), 3000), SCHEMA)
    cells = streaks.time_cells(streaks.match_events(df), "ts", 300).filter("player = 0").groupBy("__cell").count().collect()
    assert len(cells) >= 10 and max(x["count"] for x in cells) <= 400


def test_nulls_and_nothing(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, t, 1, None, 50.0, 50.0, 50.0, False), (2, None, 1, 2, 50.0, 50.0, 50.0, False), (3, t, 1, 2, None, None, None, None)]
    got = {(x["match_id"], x["player"]): (x["streak"], x["role"]) for x in streaks.achievements(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1): (2, None), (2, 1): (1, None), (2, 2): (0, None), (3, 1): (3, None), (3, 2): (0, None)}
    assert streaks.achievements(spark.createDataFrame([], SCHEMA)).collect() == []
    one = streaks.since_reset(spark.createDataFrame(rows, SCHEMA), "winner", ("ts", "match_id"), {"n": (F.lit(1), F.col("match_id") == 1)}).collect()
    assert {x["match_id"]: x["n"] for x in one} == {2: 1, 1: 0, 3: 1}
