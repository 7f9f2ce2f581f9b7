"""The corpus pipeline: toxicity, language ID, near-duplicate removal, packing. Each stage reads what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import langid, neardup, packing, toxicity
from lectern.llm.common import fold, materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model learns from labelled documents outside the held-out fold.

    Rows with null or empty texts are scored as texts without hits; where labels of both kinds are missing every score is
    0.5 and no row is kept by its score, so then all stay. Repeated rows are judged alike.
    """
    rows = toxicity.scored(docs, table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0), COLUMNS)
    return docs.select(*COLUMNS) if rows is None else rows.where("score < 0.5").select(*COLUMNS)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject: they have letters, and fit a language that was learned.

    Null texts and texts without letters go, unless there was nothing to learn from: then all stay.
    """
    models = langid.train(docs.where(fold(F.col("doc_id"), 4) != 2))
    return langid.accepted(docs, models, COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id.

    Rows of one doc_id are one document, and stay or go together. Rows without doc_id can't be named and stay. Null and empty
    texts are linked with nothing.
    """
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document in token sequences of 4096 ids; null and empty texts are their end id alone."""
    packed = packing.pack_documents(docs, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("language_id", keep_known_language), ("near_duplicates", drop_near_duplicates), ("packing", pack)]
#: Learned models and packing are beyond SQL; tests/llm/test_methods.py holds what run() decides against planted documents, and each operator
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
