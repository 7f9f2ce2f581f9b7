"""Operators 7, 8 and 9, and the pipeline, against brute force."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import media, topk, warc
from lectern.llm.common import new_path

pytest.importorskip("pyarrow")


def test_png_and_payload():
    for data in (b"", b"x", b"a" * 64, bytes(range(256)) * 3 + b"z"):
        payload = media.to_payload(data)
        assert len(payload) % 64 == 0 and payload and payload.startswith(data)
        png = media.to_png(payload)
        assert media.from_png(png) == payload and media.png_header(png[:33]) == (64, len(payload) // 64, 8, 0)
    with pytest.raises((ValueError, struct.error, zlib.error)):
        media.from_png(png[:-6] + b"xxxxxx")


def test_media_rows(spark):
    texts = ["hello", None, "", "é" * 100, "hello", "long " * 9000]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, digest string, `offset` int")
    index = media.store_payloads(docs, shard_bytes=2000)
    found = {bytes(r.digest): r for r in media.read_features(media.one_place(index)).collect()}
    rows = {r.doc_id: (r, found[bytes(r.digest)]) for r in index.collect()}
    for i, t in enumerate(texts):
        payload = media.to_payload((t or "").encode())
        r, f = rows[i]
        assert (r.n_bytes, f.payload_bytes, f.payload_sha256, f.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[0][1].feature == rows[4][1].feature and len(found) == 4
    assert {(r.width, r.depth) for r in media.read_metadata(media.one_place(index)).collect()} == {(64, 8)}
    assert media.store_payloads(docs.where("doc_id < 0")).count() == 0


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 12)) * rng.lognormal(0, 1, (700, 1))
    vectors[100:140] = vectors[100]  # ties
    rows = [(i, [float(np.float32(x)) for x in v], 0, 1.0) for i, v in enumerate(vectors)]
    rows += [(1000, None, 0, 1.0), (1050, [float("nan")] * 12, 0, 1.0), (1100, [float("inf")] + [0.0] * 11, 0, 1.0), (1150, [None] + [0.0] * 11, 0, 1.0), (1200, [0.0] * 12, 0, 1.0), (1250, [1.0, 2.0], 0, 1.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, norm double")
    got = {}
    for r in topk.top_k(table, bucket_rows=64).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ints = {i: np.floor(np.array(v, np.float32).astype(np.float64) * 256).astype(np.int64) for i, v, *_ in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:5]
        assert [got.get(q, {}).get(k + 1) for k in range(len(best))] == [(i, -s) for s, i in best], q
    assert topk.top_k(table.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(spark, version):
    big = "<html>" + "x" * 1200 + "é</html>"
    rows = [(1, "http://a/ b", big), (2, "http://b", big), (3, None, "small"), (4, "http://c", "small"), (5, "http://d", None), (6, "http://e\n", big + "!"), (7, "http://f", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = warc.pages_to_warc(pages, version)
    got = {r.page_id: r for r in warc.resolve_revisits(records).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {**{i: ("response", None) for i in range(2, 8)}, 1: ("revisit", 2)}
    assert {r.target for r in records.where("page_id = 1").collect()} == {"http://a/%20b"} and {r.date for r in records.collect()} == {"2024-01-01T00:00:00Z"}
    assert warc.pages_to_warc(pages.where("page_id < 0"), version).count() == 0


def test_responses_are_not_dealt_by_a_null_key(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    rows = [(i, f"r{i}", "response", "u", "d", i, "x", None) for i in range(400)] + [(400, "r400", "revisit", "u", "d", None, "x", "r7"), (401, "r401", "revisit", "u", "d", None, "x", "gone")]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        resolved = warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORDS).repartition(4))
        got = resolved.selectExpr("*", "spark_partition_id() AS at").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.page_id: (r.payload_bytes, r.refers_to) for r in got} == {**{i: (i, None) for i in range(400)}, 400: (7, 7), 401: (None, None)} and len(got) == 402
    assert max(Counter(r["at"] for r in got).values()) < 201


def test_arc_errors(spark):
    fields = warc.ARC_FIELDS[1]
    good = warc.arc_record(1, "http://x", "20240101000000", "text/html", b"body", "n", 0)
    assert warc.parse_arc_record(fields, good)[1] == b"body"
    with pytest.raises(ValueError):
        warc.parse_arc_record(fields, good[:-3])
    with pytest.raises(ValueError):
        warc.parse_version_block(b"filedesc://x 0 0 text/plain 3\n9 0 x\nURL\n")
    assert warc.iso_date("2024") == "2024-01-01T00:00:00Z" and new_path(spark, "x") != new_path(spark, "x")


def test_pipeline_keeps_what_each_stage_keeps(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = pipeline.materialise(stage(spark, before, sf), name)
        assert after.columns == pipeline.COLUMNS and after.join(before, "doc_id", "left_anti").count() == 0 and after.count() > 0.5 * before.count()
        before = after
    packed = pipeline.STAGES[-1][1](spark, before, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
