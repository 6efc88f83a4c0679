"""Snapshots tell what has become of their files."""

import os

from quillon.sources import files


def test_digests_tell_damage(spark, tmp_path):
    root = str(tmp_path)
    assert files.snapshot(spark.range(100).repartition(3), root, "2024-01-01", keep=2) == ["2024-01-01"]
    assert files.damaged(spark, root, "2024-01-01").collect() == []
    assert spark.read.parquet(f"{root}/2024-01-01").count() == 100
    parts = sorted(f for f in os.listdir(f"{root}/2024-01-01") if f.startswith("part-"))
    with open(f"{root}/2024-01-01/{parts[0]}", "ab") as f:
        f.write(b"x")
    os.remove(f"{root}/2024-01-01/.{parts[0]}.crc")  # the local file system's own check
    os.rename(f"{root}/2024-01-01/{parts[1]}", f"{root}/2024-01-01/part-other.parquet")
    got = {x["name"]: x["problem"] for x in files.damaged(spark, root, "2024-01-01").collect()}
    assert got == {parts[0]: "changed", parts[1]: "missing", "part-other.parquet": "foreign"}
    files.snapshot(spark.range(5), root, "2024-01-02", keep=2)
    assert files.snapshot(spark.range(5), root, "2024-01-03", keep=2) == ["2024-01-03", "2024-01-02"]
