"""Pinned values of small functions."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import misc
from quillon.functions import text as tx

CASES = [
    (misc.parse_duration, "90s", 90), (misc.parse_duration, "2d", 172_800), (misc.parse_duration, "x", None),
    (misc.url_norm, '<"example.com/a">', "https://example.com/a"), (misc.url_norm, "http://a.b", "http://a.b"),
    (misc.private_host, "192.168.1.4", True), (misc.private_host, "172.32.0.1", False), (misc.private_host, "db.internal", True),
    (misc.drive_id, "https://x/file/d/AbCdEfGhIjK1/view", "AbCdEfGhIjK1"), (misc.drive_id, "https://x/open?id=AbCdEfGhIjK1", "AbCdEfGhIjK1"), (misc.drive_id, "https://x", None),
    (misc.mention_ids, "<@!123456789012345678> and 123456789012345678, <@&42> 7 7", ["123456789012345678", "42", "7", "7"]),
    (misc.hex_color, "#0f8", 0x00FF88), (misc.hex_color, "0x10ff00", 0x10FF00), (misc.hex_color, "red", None),
    (misc.slug, " Đề Thi: 12 (A) ", "thi-12-a"), (misc.clean_think, "a<think>b</think>c<think>d", "ac"), (misc.dedup_words, "the the The cat cat sat", "the cat sat"),
    (misc.json_block, 'x ```json\n{"a": [1, 2,],}\n``` y', '{"a": [1, 2]}'), (misc.json_block, "none", None),
    (tx.strip_accents, "Đề Thi Toán", "de thi toan"),
]


@pytest.mark.parametrize(("function", "value", "want"), CASES)
def test_pinned(spark, function, value, want):
    assert spark.createDataFrame([(value,)], "x string").select(function(F.col("x")).alias("y")).first()["y"] == want


def test_outputs(spark):
    rows = [("1 2  3", "1 2 3", True), ("3.1415926", "3.1415927", True), ("3.1", "3.2", False), ("1 2", "1 2 3", False), ("", " ", True), ("1000000.5", "1000000", True)]
    df = spark.createDataFrame(rows, "a string, b string, ok boolean")
    assert all(r["ok"] == r["y"] for r in df.withColumn("y", misc.outputs_equal(F.col("a"), F.col("b"))).collect())


def test_nfc(spark):
    assert spark.createDataFrame([("é",), (None,)], "x string").select(tx.nfc("x").alias("y")).collect()[0]["y"] == "é"


def test_private_hosts(spark):
    private = ["localhost", "a.onion", "10.1.2.3", "172.20.0.1", "224.0.0.1", "250.1.1.1", "100.64.0.1", "[::1]", "::1", "[fd00::1]", "fe80::1", "ff02::1", "nas.local", "0.0.0.0"]
    public = ["example.org", "8.8.8.8", "172.32.0.1", "[2606:4700::1]", "10.example.org", "100.128.0.1"]
    df = spark.createDataFrame([(h, True) for h in private] + [(h, False) for h in public], "h string, want boolean")
    assert [r["h"] for r in df.withColumn("y", misc.private_host(F.col("h"))).collect() if r["y"] != r["want"]] == []


def test_files_of_any_charset(spark, tmp_path):
    from quillon.sources import files

    (tmp_path / "a.txt").write_bytes("déjà vu".encode("latin-1"))
    (tmp_path / "b.txt").write_bytes("déjà vu".encode())
    got = [r["text"] for r in files.read_documents(files.list_files(spark, str(tmp_path))).collect()]
    assert got == ["déjà vu"] * 2
