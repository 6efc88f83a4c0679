"""Sessions and table access."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with the settings that the library expects: UTC, AQE and Arrow."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillon")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task after ``dealt``.
TASK_ROWS = 500_000


def dealt(table: DataFrame, *key: str) -> DataFrame:
    """A table's rows dealt out by a key, into as many partitions as keep a task at some TASK_ROWS rows however large the table is.
    What groups by the key, or by it and more columns, needs no shuffle after that. The rows are counted in Parquet's footers."""
    return table.repartition(max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS)), *key)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is spark.checkpoint.dir. Where that is unset, a temporary folder serves a local session, which is
    one machine, and the warehouse serves a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.startswith("local["):
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
