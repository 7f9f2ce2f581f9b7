"""The registered queries of this package: thin digests over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, langid, media, neardup, packing, quality, sharding, spelling, topk, toxicity, warc
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents")))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op4_odd_sketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_language(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op7_media_tar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = media.store_payloads(table(spark, sf_dir, "documents"))
    features = media.read_features(media.one_place(index)).drop("shard", "offset", "length")
    return index.select("doc_id", "n_bytes", "digest").join(features, "digest").drop("digest")


def op8_norm_bucketed_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve_revisits(warc.pages_to_warc(table(spark, sf_dir, "pages"), version=None))


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op11_identity_map_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.score_alignment(table(spark, sf_dir, "documents"), keep_groups=False)


def op12_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.histogram_shards(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")).alias("text_crc32")
    return sharded.select("row.doc_id", "size", crc, "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_composed_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


OP8_SQL = """
WITH fine AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM f
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_quadratic_discriminant, op3_bpe_chunk_reuse, op4_odd_sketch_near_duplicates, op5_noisy_channel_toxicity, op6_kneser_ney_language,
        op7_media_tar_shards, op8_norm_bucketed_top_k, op9_arc_to_warc, op10_perspective_rotation, op11_identity_map_alignment,
        op12_histogram_sort_shards, op13_composed_spelling_variants,
    )
}
ORACLES: dict[str, str] = {"op8_norm_bucketed_top_k": OP8_SQL, "op9_arc_to_warc": OP9_SQL, "op10_perspective_rotation": chat.ORACLE}
