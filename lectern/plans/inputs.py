"""Inputs of the registered queries, made from the given tables: lines, pages, cues, line passages, playback events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import count_words, estimate_seconds, is_blank, pause_after
from ..streaming.live import STATE_STORE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores where it comes in fewer partitions than there are: small files would keep one core busy.

    At scale a table has more partitions than the cluster has cores, and nothing moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > 2 * cores else df.repartition(2 * cores, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder that nothing has used yet, where driver and executors share it: below ``spark.checkpoint.dir``.

    Where that is unset, on a local master, a fresh local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def streamed(df: DataFrame, name: str, halves: str, run, sink=None, mode: str = "append") -> DataFrame | None:
    """What the live job ``run`` makes of ``df`` as a stream that arrives in two halves, those rows first that ``halves`` names.

    Each half is a run to the end of what is there, with one checkpoint, so state, progress and the watermark carry over; a
    last batch without data lets state go that the watermark has passed. Results go to a folder and are read back, or to
    ``sink`` (a function for ``foreachBatch``), and then None is returned.
    """
    spark = df.sparkSession
    at, (store, rocks) = scratch(spark, name), STATE_STORE
    before = spark.conf.get(store, None)
    spark.conf.set(store, rocks)
    try:
        for half in (halves, f"NOT ({halves})"):
            df.where(half).write.mode("append").parquet(f"{at}/in")
            out = run(spark.readStream.schema(df.schema).parquet(f"{at}/in"))
            writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True)
            started = writer.foreachBatch(sink).start() if sink else writer.format("parquet").start(f"{at}/out")
            started.awaitTermination()
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    return None if sink else spark.read.schema(out.schema).parquet(f"{at}/out")


def as_files(rows: DataFrame, path: str) -> None:
    """Rows (name, content) as files below ``path``, for jobs that read files."""

    def put(batches):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write(content or b"")
            yield batch.slice(0, 0)

    rows.select("name", F.col("content").cast("binary")).mapInArrow(put, "name string, content binary").count()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what a stream is joined with is made once, not once a batch."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, start): every line with its offset."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("int"))


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): four lines a page."""
    rows = docs.select("doc_id", F.split("text", "\n", -1).alias("l"))
    rows = rows.select("doc_id", "l", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 4).cast("int"))).alias("page_no"))
    return rows.select("doc_id", "page_no", F.array_join(F.slice("l", F.col("page_no") * 4 + 1, F.lit(4)), "\n").alias("text"))


def cues(docs: DataFrame) -> DataFrame:
    """(track_id, cue_no, start, end, text): lines two seconds apart."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("cue_no", "text"))
    start = F.col("cue_no") * 2.0
    return rows.select(F.col("doc_id").alias("track_id"), "cue_no", start.alias("start"), (start + 1.8).alias("end"), "text")


def line_passages(docs: DataFrame) -> DataFrame:
    """Lines that aren't blank as passages: doc_id, passage_index, text, start, end, section_id, section_title, words, est_seconds.

    A section is five passages.
    """
    rows = lines(docs).where(~is_blank(F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    index = (F.row_number().over(w) - 1).cast("int")
    words = count_words(F.col("line"))
    rows = rows.select("doc_id", index.alias("passage_index"), F.col("line").alias("text"), "start", (F.col("start") + F.length("line")).cast("int").alias("end"), words.alias("words"))
    section = F.floor(F.col("passage_index") / 5).cast("int")
    return rows.withColumns({
        "section_id": F.concat(F.lit("sec-"), section.cast("string")), "section_title": F.concat(F.lit("Section "), (section + 1).cast("string")),
        "est_seconds": estimate_seconds(F.col("words")) + pause_after(F.col("text")),
    })


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_id, title, start): one at the beginning of every line whose number divides by ten, but the first."""
    rows = lines(docs).where("line_no % 10 = 0 AND line_no > 0")
    return rows.select("doc_id", F.concat(F.lit("sec-"), F.col("line_no").cast("string")).alias("section_id"), F.concat(F.lit("From line "), F.col("line_no").cast("string")).alias("title"), "start")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playback events from ``events``: session, event_id, epoch, ts, elapsed, rate, resumed, key."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("session"), "event_id", (F.col("event_id") / 7 % 5).cast("int").alias("epoch"), "ts", F.col("value").alias("elapsed"), F.lit(1.0).alias("rate"),
        F.col("event_type").isin("error").alias("resumed"), "event_type",
    )
