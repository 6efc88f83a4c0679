"""File sources and sinks: folders of mixed files, documents, logs, reports, snapshots."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import html_to_text, magic_type

#: Bounds on a document: bytes, members of an archive, and how many times larger its text may be.
MAX_BYTES, MAX_MEMBERS, MAX_RATIO = 50 << 20, 2500, 100


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, modificationTime, content, kind) of the files below a folder, with the format that their first
    bytes tell."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    if extensions:
        files = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions]))
    return files.withColumn("kind", magic_type(F.col("content")))


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX in order; a table row is a line with its cells between bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_RATIO * max(1, len(data)) or len(data) > MAX_BYTES:
            raise ValueError("archive over its bounds")
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    joined = lambda e: "".join(t.text or "" if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else "\n" if t.tag == f"{W}br" else "" for t in e.iter())
    lines = []
    for e in body if body is not None else ():
        if e.tag == f"{W}p":
            lines.append(joined(e))
        elif e.tag == f"{W}tbl":
            lines += ["| " + " | ".join(joined(c).strip() for c in row.iter(f"{W}tc")) + " |" for row in e.iter(f"{W}tr")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def read_documents(files: DataFrame) -> DataFrame:
    """(path, kind, text, error): the text of each file. A file that can't be read has an error instead; it stops
    neither its batch nor its task."""
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for data in batches:
            rows = []
            for x in data:
                try:
                    rows.append((docx_text(bytes(x)), None))
                except Exception as e:  # noqa: BLE001  the file is at fault, and says so in its row
                    rows.append((None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["text", "error"])

    # bytes that aren't UTF-8 are read as Latin-1, in which every byte is a character
    plain = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    page = F.lower(F.substring(plain, 1, 512)).rlike("<(!doctype html|html|body)")
    zipped = files.filter("kind = 'zip'").select("path", F.lit("docx").alias("kind"), extract("content").alias("x")).select("path", "kind", "x.*")
    none = F.lit(None).cast("string")
    texts = files.filter("kind = 'unknown'").select("path", F.when(page, "html").otherwise("text").alias("kind"), F.when(page, html_to_text(plain)).otherwise(plain).alias("text"), none.alias("error"))
    others = files.filter("kind not in ('zip', 'unknown')").select("path", "kind", none.alias("text"), F.concat(F.lit("no reader for "), "kind").alias("error"))
    return zipped.unionByName(texts).unionByName(others)


def tail(spark: SparkSession, path: str, count: int, level: str = "") -> DataFrame:
    """(line_no, line): the last lines of a log that contain the level. Numbers rise along the file."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    kept = lines.filter(F.upper("line").contains(level.upper())) if level else lines
    return kept.orderBy(F.desc("line_no")).limit(count)


def write_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as CSV with a header, or as JSON lines; written by all tasks."""
    if kind == "csv":
        rows.write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)
    else:
        rows.write.mode("overwrite").json(path)


def _digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, sha256) of the data files of a folder, a file a row; a file is read whole by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def snapshot(rows: DataFrame, root: str, stamp: str, keep: int = 10) -> list[str]:
    """Write rows to root/stamp, with the SHA-256 of each of its files in root/stamp/_sha256, and remove all but the newest
    ``keep`` snapshots; returns those left, newest first."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{root}/{stamp}")
    _digests(spark, f"{root}/{stamp}").write.mode("overwrite").json(f"{root}/{stamp}/_sha256")
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()), reverse=True)
    for name in names[keep:]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"), True)
    return names[:keep]


def damaged(spark: SparkSession, root: str, stamp: str) -> DataFrame:
    """(name, problem) of a snapshot's files that are missing, changed, or not its own; none if it is as it was written."""
    told = spark.read.schema("name string, length long, sha256 string").json(f"{root}/{stamp}/_sha256").select("name", F.col("sha256").alias("told"))
    met = told.join(_digests(spark, f"{root}/{stamp}"), "name", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("told").isNull(), "foreign").when(F.col("sha256") != F.col("told"), "changed")
    return met.select("name", problem.alias("problem")).filter("problem IS NOT NULL")
