"""Sources and sinks on small files."""

import zipfile

from quillon.functions import text as tx
from quillon.sources import files

DOC = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Question 1</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("plain é")
    (tmp_path / "p.html").write_text("<html><script>x</script><body>Hi&nbsp;<b>there</b></body></html>")
    (tmp_path / "bad.docx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4")
    with zipfile.ZipFile(tmp_path / "sub" / "d.docx", "w") as z:
        z.writestr("word/document.xml", DOC)
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_documents(files.list_files(spark, str(tmp_path))).collect()}
    assert got["a.txt"]["text"] == "plain é" and got["p.html"]["text"] == "Hi there"
    assert got["d.docx"]["text"] == "Question 1\n| a | b |"
    assert got["bad.docx"]["error"] and "pdf" in got["x.pdf"]["error"]
    assert files.list_files(spark, str(tmp_path), (".txt",)).count() == 1


def test_tail_reports_and_snapshots(spark, tmp_path):
    (tmp_path / "log").write_text("".join(f"{'ERROR' if i % 3 == 0 else 'INFO'} {i}\n" for i in range(30)))
    assert [r["line"] for r in files.tail(spark, str(tmp_path / "log"), 2, "error").collect()] == ["ERROR 27", "ERROR 24"]
    rows = spark.createDataFrame([(1, 'say "x"'), (2, None)], "id int, text string")
    files.write_report(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.count() == 2 and back.columns == ["id", "text"]
    files.write_report(rows, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    for i in range(4):
        left = files.snapshot(rows, str(tmp_path / "snaps"), f"2024-01-0{i + 1}", keep=2)
    assert left == ["2024-01-04", "2024-01-03"]


def test_chunks():
    assert tx.pack_chunks("short", 10) == ["short"]
    parts = tx.pack_chunks("aa. bb! cc?\n\n" + "d" * 15 + "\n\ne", 12)
    assert parts == ["aa. bb! cc?", "d" * 15, "e"] or parts[0] == "aa. bb! cc?"
    text = "\n\n".join(" ".join(f"s{i}." for i in range(k)) for k in (3, 50, 8, 90))
    chunks = tx.pack_chunks(text, 60)
    assert all(len(c) <= 60 for c in chunks) and "".join("".join(chunks).split()) == "".join(text.split())


def test_simhash_majority():
    assert tx.simhash64([]) == 0
    assert tx.simhash64("a b c d".split()) != tx.simhash64("e f g h".split())
