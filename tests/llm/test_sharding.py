import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm.sharding import histogram_shards, keyed, splitters

SCHEMA = "doc_id long, text string, shard string, slot int"  # columns with names that the result has too


def rows_of(kind: str) -> list[tuple]:
    rng = random.Random(3)
    if kind == "hot":  # a third of all rows is one text, a third one text without doc_id
        return [(i, "same text " * 9, "x", 0) for i in range(100)] + [(None, "no id", "y", 1)] * 100 + [(i, f"own {i} " * rng.randint(1, 40), "z", 2) for i in range(500, 600)]
    if kind == "odd":
        return [(None, None, None, None), (1, None, "a", 0), (1, "", "a", 0), (1, "é" * 50_000, "a", 0), (2, "b", "a", 0), (2, "b", "a", 0), (-(1 << 63), "low", "", 1), ((1 << 63) - 1, "high", "", 1)]
    return [(i, "word " * rng.randint(0, 60), "a", 0) for i in range(400)]


@pytest.mark.parametrize("kind", ["hot", "odd", "plain"])
@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards_against_a_sorted_list(spark, kind, law):
    given = rows_of(kind)
    docs = spark.createDataFrame(given, SCHEMA).repartition(5)
    found = histogram_shards(docs, 6, law, tolerance=0.0, run_rows=40).collect()
    assert Counter(tuple(r["row"]) for r in found) == Counter(given)
    assert all(r["size"] == len((r["row"]["text"] or "").encode()) + 8 and r["law"] == law for r in found)
    for s in range(6):
        own = sorted(r["slot"] for r in found if r["shard"] == s)
        assert own == list(range(len(own)))
    # brute force: the whole order in one list, each cut at the bound nearest to its target
    rows, slim = keyed(docs, 40)
    order = sorted((r["h"], r["d"], r["lot"], r["size"]) for r in slim.collect())
    assert len(order) == len(given)
    weight = [r[3] if law == "bytes" else 1 for r in order]
    total, bounds, at = sum(weight), [0], 0
    for i, w in enumerate(weight):
        at += w
        if i + 1 == len(order) or order[i][:3] != order[i + 1][:3]:
            bounds.append(at)
    cuts, sums = splitters(slim, 6, law, tolerance=0.0)
    m = 0 if law == "bytes" else 1
    assert sums[m] == total
    for i, c in enumerate(cuts, 1):
        assert abs(c.before[m] - total * i / 6) == min(abs(b - total * i / 6) for b in bounds)
        assert sum(w for r, w in zip(order, weight) if r[:3] < c.key) == c.before[m]
    got = Counter()
    for r in found:
        got[r["shard"]] += r["size"] if law == "bytes" else 1
    ends = [0, *(c.before[m] for c in cuts), total]
    # rows told apart by a number of their own get another one each time, so shards are held by size alone
    assert sorted(got.values()) == sorted(b - a for a, b in zip(ends, ends[1:]) if b > a)


def test_equal_texts_side_by_side_and_empty_table(spark):
    docs = spark.createDataFrame(rows_of("hot"), SCHEMA)
    found = histogram_shards(docs, 6).select("row.text", "shard").distinct().groupBy("text").agg(F.collect_set("shard").alias("s")).collect()
    assert all(max(r["s"]) - min(r["s"]) + 1 == len(r["s"]) for r in found)
    assert histogram_shards(docs.limit(0), 6).count() == 0


def test_registered_query_on_a_small_table(spark, tmp_path):
    from lectern.llm.queries import op12_histogram_sort_shards

    given = rows_of("hot")
    spark.createDataFrame(given, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = op12_histogram_sort_shards(spark, str(tmp_path)).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in given)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)} and {r["shard"] for r in found} <= set(range(24))
