"""Files as they arrive in a folder: to documents, sections, passages, and what is refused, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import PassagePreset
from ..operators.ingest import Ingested, ingest_files

TABLES = ("documents", "sections", "passages", "rejected")
TASK_BYTES = 64_000_000
#: Setting under which a batch lists its files again in one task for each of up to so many; Spark's 10,000 are mostly start-up.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """New files below a folder, with their contents."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").options(**options).load(path)


def dealt(batch: DataFrame) -> DataFrame:
    """The files of a batch over as many tasks as the cores and their bytes ask for.

    Small files come a few to a partition, the largest first. They are read in a few tasks, and then dealt by path, since
    neighbours are of one size and a task of the largest would hold up all others.
    """
    cores = batch.sparkSession.sparkContext.defaultParallelism
    total = batch.select("length").coalesce(cores).agg(F.sum("length")).head()[0] or 0
    tasks = max(4 * cores, -(-total // TASK_BYTES))
    return batch.coalesce(tasks).repartition(tasks, "path")


def ingest_sink(spark: SparkSession, path: str, doc_id: Column | None = None, preset: str | PassagePreset = "balanced") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` behind ``file_stream``: takes a batch of files in, and quarantines what it refuses, in tables below ``path``.

    A batch writes its part of each table, then tells that it is done; ``ingested`` reads the parts of such batches only. One
    that runs again writes the same parts again, so every file is taken in or refused once. ``doc_id`` names a file's
    document; without it, a hash of its path does.
    """
    named = doc_id if doc_id is not None else F.xxhash64("path")

    def sink(batch: DataFrame, epoch: int) -> None:
        def keep(df: DataFrame, name: str) -> DataFrame:
            at = f"{path}/work/{name}/batch={epoch}"
            df.write.mode("overwrite").parquet(at)
            return df.sparkSession.read.schema(df.schema).parquet(at)

        files = dealt(batch).withColumn("doc_id", named).select("doc_id", "path", "length", "content").persist()  # each way of ingestion reads them
        try:
            made = ingest_files(files, preset, keep)
            for name in TABLES:
                getattr(made, name).write.mode("overwrite").parquet(f"{path}/{name}/batch={epoch}")
            batch.sparkSession.range(1).write.mode("overwrite").parquet(f"{path}/done/batch={epoch}")
        finally:
            files.unpersist()

    return sink


def ingested(spark: SparkSession, path: str) -> Ingested:
    """What ``ingest_sink`` has put below ``path``, of all batches that are done."""
    done = spark.read.parquet(f"{path}/done").select("batch").distinct()
    return Ingested(*(spark.read.parquet(f"{path}/{name}").join(F.broadcast(done), "batch", "left_semi").drop("batch") for name in TABLES))
