"""Shared pieces: the folder that driver and executors share, materialised tables, and table access."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a fresh local one, but on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.partition("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: lineage is cut, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Deletes the folders of tables that ``materialise`` made and that nothing reads any more."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def hand_back() -> None:
    """Gives memory that Arrow keeps for later back to the system: a Python worker outlives its task, and the next stage is another's."""
    pa.default_memory_pool().release_unused()


TASK_BYTES, LEAST_BYTES = 128_000_000, 4_000_000


def dealt_by_bytes(rows: DataFrame, *order: str, length: str = "length") -> DataFrame:
    """``rows`` in ``order``, over as many tasks as the summed ``length`` asks for, which is that of what they stand for.

    The number is given, as index rows are small and adaptive execution would deal them by their own size.
    """
    total = rows.agg(F.sum(length)).head()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-total // TASK_BYTES), min(cores, -(-total // LEAST_BYTES)))
    return rows.repartitionByRange(tasks, *order[:2]).sortWithinPartitions(*order)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """The remainder of crc32(doc_id as text), which deals documents to folds; null ids count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of labels that are 0 or 1; of repeated rows that disagree, the larger label counts. Callers join them with ``docs``."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
