"""A corpus pipeline of five stages: quality rules, line dedup, near-dedup, source mixing, byte-level BPE.

Each stage is written as Parquet into the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, line_dedup, mixing, near_dup, quality
from quillon.llm.common import WORD, text_of
from quillon.llm.queries import byte_bpe
from quillon.sources.session import materialize, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with another text, and its length."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail."""
    return _with_text(quality.quality_rules(docs.select(*COLUMNS)).filter("kept"), "clean_text")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of passages; those of which no word is left go."""
    deduped = line_dedup.line_dedup(docs.select(*COLUMNS))
    return _with_text(deduped.filter(F.col("clean_text").rlike(WORD) | ~text_of().rlike(WORD)), "clean_text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    kept = near_dup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of a document that it takes."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, byte_bpe(), keep=("lang", "source"), with_ids=True)


STAGES = [
    ("quality rules", clean),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can express neither the near-dedup's sketches nor the mix's hashes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
