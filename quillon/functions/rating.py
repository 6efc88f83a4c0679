"""Rating formulas as columns. Rounding is half to even throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.operators.ranking import tier_index

MODE1, MODE2 = 0.85, 1.0


def win_probability(own: Column, other: Column) -> Column:
    """Elo probability that a player of rating ``own`` beats one of rating ``other``."""
    diff = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (other - own) / 400.0))
    return 1.0 / (1.0 + F.pow(F.lit(10.0), diff))


def solve_probability(user: Column, problem: Column) -> Column:
    return win_probability(user.cast("double"), F.greatest(F.lit(800), problem).cast("double"))


def whole(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def _mode(mode1: Column) -> Column:
    return F.when(mode1, MODE1).otherwise(MODE2)


def solve_delta(user: Column, problem: Column, mode1: Column, event: Column | None = None) -> Column:
    """Points for a solved problem, 1 at least: more for harder problems, with a K of 60, 45 or 35 by rating."""
    k = F.when(user < 1200, 60.0).when(user < 2000, 45.0).otherwise(35.0)
    boost = F.greatest(F.lit(1.0), event) if event is not None else F.lit(1.0)
    return F.greatest(F.lit(1), whole(k * (1.0 - solve_probability(user, problem)) * boost * _mode(mode1)))


def fail_penalty(user: Column, problem: Column, mode1: Column, is_event: Column, passed: Column) -> Column:
    """Points lost on a wrong solution, from -5 down to -50; none for newcomers below 1400 on event problems."""
    p = F.greatest(F.lit(800), F.least(F.lit(3500), problem))
    raw = 50.0 * F.least(F.lit(1.0), F.greatest(F.lit(0.25), p / 2500.0))
    by_tests = F.when(passed < 0.20, 1.35).when(passed < 0.40, 1.20).otherwise(0.70)
    raw = F.when(is_event, F.least(F.lit(50.0), raw * by_tests)).otherwise(raw)
    return F.when(is_event & (user < 1400), 0).otherwise(-F.greatest(F.lit(5), whole(raw * _mode(mode1))))


def score(problem: Column, mode1: Column) -> Column:
    """Score of a solved problem."""
    p = F.greatest(F.lit(800), F.least(F.lit(3500), problem))
    return F.bround(F.bround(p / 10.0, 1) * _mode(mode1), 1)


def score_penalty(problem: Column, mode1: Column) -> Column:
    p = F.greatest(F.lit(800), F.least(F.lit(3500), problem))
    return -F.greatest(F.lit(15.0), F.bround(p / 10.0 * 0.25 * _mode(mode1), 1))


def two_step(user: Column, problem: Column, passed: Column, total: Column, percentile: Column, participants: Column, is_event: Column) -> dict[str, Column]:
    """rating_delta, score_delta and multiplier: first the share of tests, then the place in the contest. A
    percentile of 0 counts as 0.5, as if it were missing."""
    ratio = passed / F.greatest(F.lit(1), total)
    mode2 = F.lit(False)
    base, base_score = solve_delta(user, problem, mode2), score(problem, mode2)
    ranked = percentile.isNotNull() & participants.isNotNull() & (participants >= 20)
    p = F.when(percentile == 0, 0.5).otherwise(percentile)
    weak = ((user >= problem + 300) & (p <= 0.30)) | (p <= 0.10)
    plain = fail_penalty(user, problem, mode2, F.lit(False), F.lit(0.0))
    down = -F.greatest(F.lit(5), whole(F.abs(plain) * 0.6))
    scaled = lambda m: F.greatest(F.lit(1), whole(base * m))
    cases = [
        (ratio < 0.40, fail_penalty(user, problem, mode2, is_event, ratio), score_penalty(problem, mode2), 0.0),
        (~ranked, base, F.bround(base_score, 1), 1.0),
        (weak, down, F.lit(0.0), -0.5),
        (p > 0.70, scaled(1.40), F.bround(base_score * 1.40, 1), 1.40),
        (p > 0.50, base, F.bround(base_score, 1), 1.0),
        (p > 0.30, scaled(0.50), F.bround(base_score * 0.50, 1), 0.50),
        (F.lit(True), F.lit(0), F.bround(base_score * 0.25, 1), 0.0),
    ]
    out = {}
    for name, i, kind in (("rating_delta", 1, "long"), ("score_delta", 2, "double"), ("multiplier", 3, "double")):
        c = None
        for case in cases:
            value = case[i] if isinstance(case[i], Column) else F.lit(case[i])
            c = F.when(case[0], value) if c is None else c.when(case[0], value)
        out[name] = c.cast(kind)
    return out


def duel_deltas(winner: Column, loser: Column, lives: Column, rounds: Column, partial: Column, streak: Column) -> tuple[Column, Column]:
    """(points of the winner, points of the loser) of a duel between two ratings."""
    wi, li = tier_index(winner), tier_index(loser)
    base = F.when(li > wi, 80).when(li < wi, 50).otherwise(60)
    diff = loser - winner
    bonus = F.greatest(F.lit(-20), F.least(F.lit(20), whole(diff / 25)))
    stamina = F.least(F.lit(15), F.greatest(F.lit(0), rounds - 2) * 5)
    underdog, favourite = (li > wi) | ((li == wi) & (diff > 50)), (li < wi) | ((li == wi) & (diff < -50))
    pool = F.greatest(F.lit(20), base + bonus + F.when(underdog, stamina).when(favourite, -stamina).otherwise(0))
    won = whole(F.when(lives >= 2, pool * 1.0).otherwise(pool * 0.75))
    share = 1.0 - (0.50 + wi / 11.0 * 0.35)
    won = F.when(partial, F.greatest(F.lit(5), whole(won * share))).otherwise(won)
    lost = F.when(partial, F.greatest(F.lit(5), whole(pool * share))).otherwise(pool)
    percent = F.when(streak >= 30, 15).when(streak >= 20, 10).when(streak >= 10, 5).when(streak >= 5, 2).otherwise(0)
    return (won + whole(won * (percent / 100.0))).cast("long"), (-lost).cast("long")
