"""Rounds of intake against a plain run over all items, also over several batches and after a restart; resumed streams."""

import random
from datetime import datetime, timedelta

import numpy as np

from quillon.sources.session import read_table
from quillon.streaming import intake, windows

SCHEMA = "shard long, source string, item long, ts timestamp"
T0 = datetime(2024, 1, 1)


def plain(items, until, every=45, per_source=3, flush=4):
    """Round by round."""
    out = []
    for shard in {x[0] for x in items}:
        own = [(s, i, t) for sh, s, i, t in items if sh == shard]
        line, taken = [], set()
        first = min(int(t.timestamp()) // every for *_, t in own)
        for k in range(first, until // every):
            for source in sorted({s for s, *_ in own}):
                here = sorted((i for s, i, t in own if s == source and t.timestamp() < (k + 1) * every and (s, i) not in taken), reverse=True)[:per_source]
                taken |= {(source, i) for i in here}
                line += [(source, i) for i in here]
            out += [(shard, k, p, s, i) for p, (s, i) in enumerate(line[:flush])]
            line = line[flush:]
    return sorted(out)


def test_rounds_over_batches_and_a_restart(spark, tmp_path):
    r = random.Random(7)
    items, at = [], 0
    for i in range(160):
        at += r.choice([0, 1, 2, 5, 300 if i % 40 == 0 else 3])
        items.append((r.choice([1, 1, 2]), r.choice(["cloud", "disk"]), i, T0 + timedelta(seconds=at)))
    end = T0 + timedelta(seconds=at + 7200)
    parts = [items[:50], items[50:90], items[90:], [(9, "disk", 999, end)], [(9, "disk", 1000, end + timedelta(seconds=1))]]

    def run(upto, folder):
        for k, part in enumerate(parts[:upto]):
            if not (tmp_path / f"in-{folder}" / f"part={k}").exists():
                spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in-{folder}" / f"part={k}"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in-{folder}" / "part=*"))
        out = windows.run_available(intake.rounds(stream, "shard", per_source=3, flush=4, late="0 seconds"), "intake", "append", str(tmp_path / f"state-{folder}"))
        return sorted(map(tuple, out.collect()))

    whole = run(len(parts), "whole")
    want = [x for x in plain(items, int(end.timestamp())) if x[0] != 9]
    assert [x for x in whole if x[0] != 9] == want and len(want) == len(items)
    # stopped twice, then resumed in the same folder
    some = run(2, "cut")
    assert set(some) < set(whole) and run(3, "cut") != whole
    assert run(len(parts), "cut") == whole


def test_waiting_items_are_sorted_twice_and_packed(monkeypatch):
    r = np.random.default_rng(3)
    ids, ats = r.permutation(20_000), r.integers(-500, 1_500, 20_000)
    sorted_, sort = [], np.sort
    monkeypatch.setattr(np, "sort", lambda x: (sorted_.append(len(x)), sort(x))[1])
    monkeypatch.setattr(intake, "CHUNK", 700)
    half = 11_111
    rows = [("b", False, ids[i:j].tobytes(), ats[i:j].tobytes()) for i, j in ((0, half), (half, 20_000))] + [("a", True, ids[:2].tobytes(), b"")]
    got, left = [], {(int(i), int(a)) for i, a in zip(ids, ats, strict=True)}
    waiting = intake.unpacked(iter(rows))
    assert list(waiting) == ["a", "b"] and waiting["b"].due() == ats.min() and waiting["a"].due() is None
    waiting = waiting["b"]
    for end in range(-400, 1_600, 10):
        want = sorted((x for x in left if x[1] < end), reverse=True)[:3]
        left -= set(want)
        assert waiting.newest(end, 3) == [i for i, _ in want]
        got += want
    # the rounds together sort each item once
    assert sum(sorted_) <= 20_000 + 2 and len(got) == 3 * 200
    packed = list(waiting.packed("b"))
    assert max(len(p[2]) for p in packed) == 700 * 8
    waiting = intake.unpacked(iter(packed))["b"]
    assert waiting.newest(1_600, 50_000) == sorted((i for i, _ in left), reverse=True) and not waiting


def test_polls_and_windows_go_on_where_they_were(spark, sf_dir, tmp_path):
    events = read_table(spark, sf_dir, "events")
    days = [("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-03-01")]
    seen = 0
    for k, (a, b) in enumerate(days):
        events.filter(f"ts >= '{a}' and ts < '{b}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = windows.read_stream(spark, str(tmp_path / "in"), events)
        got = windows.poll_new(stream, "user_id", ("ts", "event_id"), "poll", str(tmp_path / "poll")).collect()
        known = events.filter(f"ts < '{b}'")
        first = {x["user_id"]: x["event_id"] for x in sorted(known.collect(), key=lambda x: (x["ts"], x["event_id"]), reverse=True)}
        assert {x["user_id"]: x["event_id"] for x in got} == first and len(got) == len(first) >= seen
        seen = len(first)
        counts = windows.run_available(windows.window_counts(windows.read_stream(spark, str(tmp_path / "in"), events), "6 hours"), "w", "complete", str(tmp_path / "counts"))
        assert sum(x["n"] for x in counts.collect()) == known.count()
        assert len(windows.batches_of(spark, str(tmp_path / "poll"))) >= k + 1
    # nothing new: the result is still there
    assert len(windows.poll_new(windows.read_stream(spark, str(tmp_path / "in"), events), "user_id", ("ts", "event_id"), "poll", str(tmp_path / "poll")).collect()) == seen
