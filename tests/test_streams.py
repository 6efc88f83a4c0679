"""Streams against their batch twins, also when the data come in several batches."""

from quillon.plans import competition, inspecting
from quillon.sources.session import read_table
from quillon.streaming import stateful, windows


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_floods_over_several_batches(spark, sf_dir, tmp_path):
    events = read_table(spark, sf_dir, "events")
    days = [("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-03-01")]
    for a, b in days:
        events.filter(f"ts >= '{a}' and ts < '{b}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), events)
    one_by_one = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    one_by_one = one_by_one.withColumn("ts", one_by_one["ts"].cast("timestamp"))
    want = rows(competition.flood_batch(spark, sf_dir).select("user_id", "event_id", "in_window"))
    assert rows(windows.run_available(stateful.floods(stream, "user_id", 4 * 3600, 3), "t1", "append")) == want
    assert rows(windows.run_available(stateful.floods(one_by_one, "user_id", 4 * 3600, 3), "t2", "append")) == want


def test_raids_hold_their_latch(spark, sf_dir):
    got = {r["event_id"]: r["started"] for r in inspecting.stream_raids(spark, sf_dir).collect()}
    times, until, want = {}, {}, {}
    for e in sorted(read_table(spark, sf_dir, "events").collect(), key=lambda r: (r["ts"], r["event_id"])):
        k, at = e["event_type"], e["ts"].timestamp()
        times[k] = [t for t in times.get(k, []) if at - t <= 600] + [at]
        active = at <= until.get(k, 0)
        if active or len(times[k]) >= 3:
            want[e["event_id"]] = not active
            until[k] = at + 3600
    assert got == want


def test_ttl_stream_drops_repeats(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    stream = windows.read_stream(spark, f"{sf_dir}/event[s].parquet", events)
    out = windows.run_available(windows.first_in_ttl(stream.select("ts", "user_id", "event_type"), ["user_id", "event_type"], "60 days"), "ttl", "append")
    assert out.count() == events.select("user_id", "event_type").distinct().count()
