"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed rows. An insert adds a document's count, a
delete takes it away, a revision takes the old count away and adds the new one, also where the source, language or
version changes. A batch is summed before it is stored, so the ledger grows with the keys a batch touches, and
totals are the sum over committed batches, in whatever order they came.

Commits are idempotent: a batch has an id and is written aside as a whole, and then its folder takes the name of the
id, which a file system does at once and for one of several committers only. A batch that is committed already is
skipped, in whatever run that was; what a broken or late commit has left aside is never read.

Counts of a byte-level BPE vocabulary are a version like the others (``count_bpe``).

Defined results: null sources, languages and texts are values (a null text has no tokens); a key whose documents
all went has totals of 0 and is left out; repeated rows count each; an empty batch commits and changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bpe import Tokenizer
from quillon.llm.common import n_words, text_of
from quillon.sources.session import shared_folder

KEYS = ("source", "lang", "version")
#: Tokenizer versions: name -> tokens of a text.
VERSIONS = {
    "words-1": lambda text: F.regexp_count(text, F.lit("[^ ]+")).cast("long"),
    "words-2": n_words,
    "bytes-1": lambda text: F.octet_length(text).cast("long"),
}


def count_tokens(docs: DataFrame, versions: tuple[str, ...], text: str = "text") -> DataFrame:
    """docs' doc_id, source and lang with the tokens of each text in each version: n_<version>."""
    t: Column = text_of(text)
    return docs.select("doc_id", "source", "lang", *[VERSIONS[v](t).alias(f"n_{v}") for v in versions])


def count_bpe(docs: DataFrame, tokenizer: Tokenizer, version: str, text: str = "text") -> DataFrame:
    """docs' doc_id, source and lang with n_<version>: the ids that the tokenizer makes of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                n = [sum(map(len, t.encode_chunks(x or ""))) // 4 for x in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64())], names=["doc_id", "source", "lang", f"n_{version}"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", "lang", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, source string, lang string, `n_{version}` long")


def inserted(rows: DataFrame, version: str, sign: int = 1) -> DataFrame:
    """Signed rows for the insert (or, with sign -1, the delete) of counted documents."""
    n = F.col(f"`n_{version}`")
    return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).cast("long").alias("docs"), (n * sign).alias("tokens"))


def deleted(rows: DataFrame, version: str) -> DataFrame:
    return inserted(rows, version, -1)


def revised(old: DataFrame, old_version: str, new: DataFrame, new_version: str) -> DataFrame:
    """Signed rows that replace the counts of old by those of new."""
    return deleted(old, old_version).unionAll(inserted(new, new_version))


class Ledger:
    """The committed batches below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, batch: str) -> str:
        return f"{self.path}/batch={batch}"

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath, jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Ids of the committed batches."""
        root, fs = self._fs(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def is_committed(self, batch: str) -> bool:
        folder, fs = self._fs(self._folder(batch))
        return fs.exists(folder)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the signed rows of a batch, once. False if the batch was committed before, or by another meanwhile."""
        if self.is_committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        aside = f"{self.path}/_aside/{batch}-{uuid.uuid4().hex}"
        sums.coalesce(1).write.parquet(aside)
        return self._take_name(aside, batch)

    def _take_name(self, aside: str, batch: str) -> bool:
        """Give a written folder the name of its batch, unless the name is taken."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        here, there = hadoop.Path(aside), hadoop.Path(self._folder(batch))
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(here.toUri(), self.spark._jsc.hadoopConfiguration()).rename(here, there, options)
        except Py4JJavaError:
            if self.is_committed(batch):
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens): the sums over all committed batches."""
        schema = "source string, lang string, version string, docs long, tokens long"
        paths = [self._folder(b) for b in self.committed()]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")


def ledger_of(counted: DataFrame, name: str) -> Ledger:
    """The ledger of these counted documents in the shared folder: another run over the same documents and counts meets
    the same ledger."""
    rows = [F.xxhash64(*[F.col(f"`{c}`") for c in counted.columns]).cast("decimal(38,0)"), F.hash(*[F.col(f"`{c}`") for c in counted.columns]).cast("decimal(38,0)")]
    mark = counted.agg(F.md5(F.concat_ws("/", F.count(F.lit(1)), *[F.sum(r) for r in rows])).alias("mark")).first()["mark"]
    return Ledger(counted.sparkSession, f"{shared_folder(counted.sparkSession)}/{name}-{mark}")


def new_ledger(spark: SparkSession, name: str) -> Ledger:
    """A ledger in a folder of its own within the shared folder."""
    return Ledger(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
