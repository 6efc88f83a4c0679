"""Counts since the last reset, without one array and without one task for a key, and the achievements that live on them.

Events are cut by time into cells, by quantiles of all events, so a cell holds about ROWS_PER_CELL events whatever their keys.
Within a key's cell windows count; what a cell does to a count is told by two numbers (was it reset, and what stands since),
which compose. A key's cells, a row each, give every cell what it starts from. So a key with a third of all events is as many
groups as there are cells.

Defined results: events without a key are left out; those at the same time are in the order of their ids; equal events count
each. Without events there are no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CELL = 1_000_000
#: Quantiles are right to this share of a cell.
PRECISION = 0.1

# Fixed values of the platform's rules: achievements with what unlocks them, in order of precedence.
STREAK, LUCK, FORTUNE, CLUTCH, OUTCLASSED = 50, 20, 10, 10, 10
LUCKY, CLEAR, EXTREME, NARROW, SAFE = 15.0, 80.0, 5.0, 10.0, 85.0


def time_cells(events: DataFrame, time: str, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """events with __cell, the number of their stretch of time; each has about rows_per_cell rows, and rows of one time share
    one."""
    at = F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    timed = events.select("*", at.alias("__at"))
    n = timed.count()
    cells = max(1, -(-n // rows_per_cell))
    cuts = timed.approxQuantile("__at", [k / cells for k in range(1, cells)], PRECISION / cells) if cells > 1 else []
    cut = F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>")
    # events without a time come first, in a cell of their own
    return timed.withColumn("__cell", F.when(F.col("__at").isNull(), -1).otherwise(F.size(F.filter(cut, lambda c: c <= F.col("__at"))))).drop("__at")


def since_reset(events: DataFrame, key: str, order: tuple[str, ...], counts: dict[str, tuple[Column, Column]], rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """events with a column for each count: (add, reset) give the sum of add from the last row where reset holds on, that row's own
    add left out. order: the time first, then what tells events of one time apart."""
    own = events.filter(F.col(key).isNotNull())
    flags = [c for name, (add, reset) in counts.items() for c in (F.coalesce(add.cast("long"), F.lit(0)).alias(f"__add_{name}"), F.coalesce(reset, F.lit(False)).alias(f"__reset_{name}"))]
    celled = time_cells(own.select("*", *flags), order[0], rows_per_cell)
    line = Window.partitionBy(key, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = celled.select("*", *[F.sum(f"__add_{n}").over(line).alias(f"__sum_{n}") for n in counts])
    at_reset = {n: F.when(F.col(f"__reset_{n}"), F.col(f"__sum_{n}")) for n in counts}
    based = summed.select("*", *[F.max(at_reset[n]).over(line).alias(f"__base_{n}") for n in counts])
    # a cell's effect: the sum since its last reset, and whether it had one
    whole = based.groupBy(key, "__cell").agg(*[c for n in counts for c in ((F.max(f"__sum_{n}") - F.coalesce(F.max(f"__base_{n}"), F.lit(0))).alias(f"__end_{n}"), (F.count(f"__base_{n}") > 0).alias(f"__was_{n}"))])
    cells = Window.partitionBy(key).orderBy("__cell")
    so_far = cells.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = whole.select("*", *[F.sum(f"__end_{n}").over(so_far).alias(f"__total_{n}") for n in counts])
    after = total.select("*", *[(F.col(f"__total_{n}") - F.coalesce(F.max(F.when(F.col(f"__was_{n}"), F.col(f"__total_{n}") - F.col(f"__end_{n}"))).over(so_far), F.lit(0))).alias(f"__after_{n}") for n in counts])
    carried = after.select(F.col(key).alias("__key"), F.col("__cell").alias("__in"), *[F.coalesce(F.lag(f"__after_{n}").over(cells), F.lit(0)).alias(f"__carry_{n}") for n in counts])
    met = based.join(carried, (F.col(key) == F.col("__key")) & (F.col("__cell") == F.col("__in")))
    values = [(F.col(f"__sum_{n}") - F.coalesce(f"__base_{n}", F.lit(0)) + F.when(F.col(f"__base_{n}").isNull(), F.col(f"__carry_{n}")).otherwise(0)).alias(n) for n in counts]
    return met.select(*[f"`{c}`" for c in events.columns], *values)


def match_events(matches: DataFrame) -> DataFrame:
    """Two events of each match (match_id, ts, winner, loser, start_prob, min_prob, loser_max_prob, loser_led): one for each player."""
    who = F.array(F.struct(F.col("winner").alias("player"), F.lit(True).alias("won")), F.struct(F.col("loser").alias("player"), F.lit(False).alias("won")))
    return matches.select("*", F.explode(who).alias("__w")).select(*[f"`{c}`" for c in matches.columns], "__w.*")


def achievements(matches: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """(match_id, player, won, streak, fortune, outclassed, clutch, doomed, role) after each match, for its winner and its loser.

    A loss takes all counts. The winner's are of matches won in a row, of those won against the odds (start_prob below LUCKY), of
    wins in a row from CLEAR on, of comebacks (min_prob of NARROW or less). Who loses a match that was safe to a comeback is
    doomed until the next win.
    """
    won, lost = F.col("won"), ~F.col("won")
    start, low = F.col("start_prob"), F.col("min_prob")
    extreme, narrow = won & (low < EXTREME), won & (low <= NARROW) & ~(low < EXTREME)
    fell = lost & ((F.col("loser_max_prob") >= SAFE) | F.col("loser_led")) & (low <= NARROW)
    counted = since_reset(
        match_events(matches), "player", ("ts", "match_id"),
        {
            "streak": (won, lost), "fortune": (won & (start < LUCKY), lost), "outclassed": (won & (start > CLEAR), lost | ~(start > CLEAR)),
            "clutch": (narrow, lost), "falls": (fell, won),
        }, rows_per_cell,
    )
    unlocked = (
        ("OVERLORD", F.col("streak") >= STREAK), ("GODLY_LUCK", F.col("fortune") >= LUCK), ("CLUTCHMASTER", extreme | (narrow & (F.col("clutch") >= CLUTCH))),
        ("OUTCLASSED", F.col("outclassed") >= OUTCLASSED), ("FORTUNE", F.col("fortune") >= FORTUNE),
    )
    doomed = lost & (F.col("falls") > 0)
    role = reduce(lambda c, r: c.when(won & r[1], r[0]), unlocked, F.when(doomed, "DOOMED"))
    return counted.select("match_id", "player", "won", "streak", "fortune", "outclassed", "clutch", doomed.alias("doomed"), role.alias("role"))
