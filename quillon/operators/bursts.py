"""Detections over event logs: floods, duplicates, raids, cooldowns, quotas. Windows slide with every event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


#: Windows in a cell of time.
CELL = 64


def cell_of(at: Column, seconds: int) -> Column:
    return F.floor(at / (seconds * 1_000_000 * CELL))


def sliding_count(events: DataFrame, keys: list[str], ts: str, seconds: int, name: str = "in_window") -> DataFrame:
    """events with the number of events of the same keys in the last ``seconds``, both ends included. Time is cut into
    cells of many windows, and events of a cell's last window go to the next cell too, so that a hot key is many groups."""
    width, at = seconds * 1_000_000, micros(ts)
    own = cell_of(at, seconds)
    rows = events.withColumn("_cell", F.explode(F.array_distinct(F.array(own, cell_of(at + width, seconds)))))
    w = Window.partitionBy(*keys, "_cell").orderBy(at).rangeBetween(-width, 0)
    return rows.withColumn(name, F.count(F.lit(1)).over(w)).filter(F.col("_cell").eqNullSafe(own)).drop("_cell")


def floods(events: DataFrame, keys: list[str], ts: str, seconds: int, threshold: int) -> DataFrame:
    """The events at which the count reaches the threshold."""
    return sliding_count(events, keys, ts, seconds).filter(F.col("in_window") >= threshold)


def raid_islands(events: DataFrame, scope: str, ts: str, seconds: int, threshold: int) -> DataFrame:
    """(scope, raid, started, ended, members, peak): runs of events at or over the threshold; a gap of more than the
    window ends a raid. Runs are found within cells of time and then strung together: what meets by scope alone is one
    row a run, however many events it has."""
    width = seconds * 1_000_000
    hot = floods(events, [scope], ts, seconds, threshold).withColumn("at", micros(ts)).withColumn("cell", cell_of(F.col("at"), seconds))
    line = Window.partitionBy(scope, "cell").orderBy("at", "event_id")
    new = F.when(F.col("at") - F.lag("at").over(line) <= width, 0).otherwise(1)
    runs = hot.withColumn("new", new).withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(F.col(scope).alias("s"), F.col("cell").alias("c"), F.col("run").alias("r")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy("s").orderBy("first")
    apart = F.when(F.col("first") - F.lag("last").over(order) <= width, 0).otherwise(1)
    strung = spans.withColumn("apart", apart).withColumn("raid", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col(scope).eqNullSafe(F.col("s")) & F.col("cell").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r"))
    return runs.join(strung.select("s", "c", "r", "raid"), same).groupBy(scope, "raid").agg(
        F.min(ts).alias("started"), F.max(ts).alias("ended"), F.countDistinct("user_id").alias("members"), F.max("in_window").alias("peak")
    )


def cooldown_violations(events: DataFrame, key: str, ts: str, seconds: Column) -> DataFrame:
    """Events that come sooner after the one before than their cooldown allows, with the seconds that remained."""
    line = Window.partitionBy(key).orderBy(micros(ts), "event_id")
    gap = (micros(ts) - F.lag(micros(ts)).over(line)) / 1e6
    found = events.withColumn("gap_s", gap).withColumn("remaining_s", seconds - F.col("gap_s"))
    return found.filter(F.col("remaining_s") > 0)


def dedup_ttl(events: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """Events that are kept: the first of each key, and the first after its time to live has run out. A duplicate
    doesn't renew the time, so keys are folded in order."""
    line = F.array_sort(F.collect_list(F.struct(micros(ts).alias("at"), F.col("event_id"))))

    def step(acc: Column, x: Column) -> Column:
        ok = acc["until"].isNull() | (x["at"] >= acc["until"])
        return F.when(ok, F.struct((x["at"] + seconds * 1_000_000).alias("until"), F.concat(acc["kept"], F.array(x["event_id"])).alias("kept"))).otherwise(acc)

    zero = F.struct(F.lit(None).cast("long").alias("until"), F.array().cast("array<bigint>").alias("kept"))
    return events.groupBy(*keys).agg(line.alias("l")).select(*keys, F.explode(F.aggregate("l", zero, step)["kept"]).alias("event_id"))


def admitted(events: DataFrame, key: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """(key, event_id): requests that a sliding log of ``limit`` per ``seconds`` admits; a refused one isn't logged.
    The fold holds the last ``limit`` admissions."""
    line = F.array_sort(F.collect_list(F.struct(micros(ts).alias("at"), F.col("event_id"))))

    def step(acc: Column, x: Column) -> Column:
        live = F.filter(acc["log"], lambda t: x["at"] - t < seconds * 1_000_000)
        ok = F.size(live) < limit
        yes = F.struct(F.concat(live, F.array(x["at"])).alias("log"), F.concat(acc["ids"], F.array(x["event_id"])).alias("ids"))
        return F.when(ok, yes).otherwise(F.struct(live.alias("log"), acc["ids"].alias("ids")))

    zero = F.struct(F.array().cast("array<bigint>").alias("log"), F.array().cast("array<bigint>").alias("ids"))
    return events.groupBy(key).agg(line.alias("l")).select(key, F.explode(F.aggregate("l", zero, step)["ids"]).alias("event_id"))


def hostility(messages: DataFrame, triggers: tuple[str, ...], patterns: tuple[str, ...], pronouns: str, laughter: tuple[str, ...], last: int = 8, least: int = 60, seconds: int | None = None) -> DataFrame:
    """(channel, seq, ts, score, users, fires): at each message a score folded over the last messages of its channel, those
    of the last ``seconds`` where given.

    A trigger adds 40, a pattern 35, a pronoun 15; then laughter takes 25 away, down to 0 at least, message by
    message. It fires at ``least`` if two users or more take part.
    """
    low = F.lower("text")
    plus = sum((F.when(low.contains(t), 40).otherwise(0) for t in triggers), F.lit(0))
    plus = plus + sum((F.when(low.rlike(p), 35).otherwise(0) for p in patterns), F.lit(0)) + F.when(low.rlike(pronouns), 15).otherwise(0)
    laughs = F.lit(False)
    for x in laughter:
        laughs = laughs | low.contains(x)
    marked = messages.select("channel", "seq", "ts", F.struct(plus.alias("plus"), laughs.alias("laughs"), F.col("user").alias("user"), micros("ts").alias("at")).alias("m"))
    line = Window.partitionBy("channel").orderBy("seq").rowsBetween(-(last - 1), 0)
    recent = marked.withColumn("ms", F.collect_list("m").over(line))
    if seconds is not None:
        recent = recent.withColumn("ms", F.filter("ms", lambda m: F.col("m.at") - m["at"] <= seconds * 1_000_000))
    step = lambda s, m: F.when(m["laughs"], F.greatest(F.lit(0), s + m["plus"] - 25)).otherwise(s + m["plus"])
    score = F.aggregate("ms", F.lit(0), step)
    users = F.size(F.array_distinct(F.transform("ms", lambda m: m["user"])))
    scored = recent.select("channel", "seq", "ts", F.when(users >= 2, score).otherwise(0).alias("score"), users.alias("users"))
    return scored.withColumn("fires", (F.col("score") >= least) & (F.col("users") >= 2))


def alerts(scored: DataFrame, cooldown: int) -> DataFrame:
    """(channel, seq) of the scored messages that fire, none within ``cooldown`` seconds of the alert before."""
    fires = scored.filter("fires").select("channel", "ts", F.col("seq").alias("event_id"))
    return dedup_ttl(fires, ["channel"], "ts", cooldown).withColumnRenamed("event_id", "seq")
