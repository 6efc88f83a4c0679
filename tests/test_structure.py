"""Windows cut into cells against brute force, polls over several batches, and odd questions."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from quillon.operators import bursts, similarity, structure
from quillon.sources.session import read_table
from quillon.streaming import windows

SECONDS = 10
CELL = SECONDS * bursts.CELL


def at_borders(spark):
    """Events around the borders of cells, with ties, a null key and a null time."""
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    start -= timedelta(seconds=start.timestamp() % CELL)
    offsets = [c * CELL + d for c in (1, 2, 3) for d in (-20, -11, -10, -9, -1, 0, 0, 1, 9, 10, 11, 25)] + list(range(4 * CELL - 30, 4 * CELL + 30, 4))
    rows = [(i, start + timedelta(seconds=s), k, i % 5) for i, (s, k) in enumerate((s, k) for s in offsets for k in ("a", None))]
    return rows, spark.createDataFrame([*rows, (10_000, None, "a", 1)], "event_id long, ts timestamp, kind string, user_id long")


def test_counts_at_the_borders_of_cells(spark):
    rows, df = at_borders(spark)
    got = {r["event_id"]: r["in_window"] for r in bursts.sliding_count(df, ["kind"], "ts", SECONDS).collect()}
    want = {i: sum(k == l and 0 <= (t - u).total_seconds() <= SECONDS for _, u, l, _ in rows) for i, t, k, _ in rows}
    assert got == {**want, 10_000: 1}


def test_raids_across_cells(spark):
    rows, df = at_borders(spark)
    got = bursts.raid_islands(df, "kind", "ts", SECONDS, 3).filter("kind = 'a'").orderBy("raid").collect()
    mine = sorted((t, i, u) for i, t, k, u in rows if k == "a")
    hot = [(t, i, u) for t, i, u in mine if sum(0 <= (t - v).total_seconds() <= SECONDS for v, _, _ in mine) >= 3]
    runs = [[hot[0]]]
    for a, b in zip(hot, hot[1:]):
        if (b[0] - a[0]).total_seconds() > SECONDS:
            runs.append([])
        runs[-1].append(b)
    micros = lambda t: int(t.timestamp())
    assert [(r["raid"], micros(r["started"]), micros(r["ended"]), r["members"]) for r in got] == [(n, micros(x[0][0]), micros(x[-1][0]), len({u for _, _, u in x})) for n, x in enumerate(runs, 1)]


def test_polls_over_several_batches(spark, sf_dir, tmp_path):
    events = read_table(spark, sf_dir, "events")
    for a, b in (("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-03-01")):
        events.filter(f"ts >= '{a}' and ts < '{b}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = windows.poll_new(stream, "user_id", ("ts", "event_id"), "t-poll").select("user_id", "event_id").collect()
    want = events.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_streams_without_rows(spark, sf_dir, tmp_path):
    events = read_table(spark, sf_dir, "events")
    events.limit(0).coalesce(1).write.parquet(str(tmp_path / "none"))
    stream = windows.read_stream(spark, str(tmp_path / "none"), events)
    assert windows.run_available(stream, "t-none", "append").count() == 0
    assert windows.poll_new(stream, "user_id", ("ts",), "t-none-poll").count() == 0


def test_whole_names_or_prefixes(spark):
    rows = spark.createDataFrame([(1, "x" * 5000 + "abc", 0), (2, "x" * 5000 + "abd", 0), (3, "y", 0), (4, None, 0)], "id long, name string, g int")
    assert [tuple(r) for r in similarity.similar_names(rows, ["g"], 0.5).collect()] == [(1, 2, round(1 - 1 / 5003, 6))]
    assert [tuple(r) for r in similarity.similar_names(rows, ["g"], 0.5, prefix=4096).collect()] == [(1, 2, 1.0)]


def test_odd_questions(spark):
    schema = "id long, place int, number int, group int, type string, stem string, options array<struct<marker: string, text: string>>, n_statements int, n_blanks int, answer string"
    rows = [
        (1, 1, 5, None, "single_choice", None, [("a", None), ("A", "x")], 0, 0, "AB"),
        (1, 2, 4, None, "true_false", "s", [], 0, 0, None),
        (1, 3, 1, None, "essay", "s", [], 0, 0, "F"),
        (2, 1, None, 1, None, "s", [("B", "Question 2. x")], 1, 1, "b"),
    ]
    got = sorted((r["id"], r["place"], r["problem"]) for r in structure.question_problems(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 1, "answer_not_offered"), (1, 1, "empty_option"), (1, 1, "no_stem"), (1, 1, "repeated_marker"), (1, 2, "no_statements"), (1, 2, "out_of_order")]
    assert structure.question_problems(spark.createDataFrame([], schema)).count() == 0
