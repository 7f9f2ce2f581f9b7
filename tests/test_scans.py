"""Scans in two levels against plain Python, how a hot document is dealt, and the search of a table of queries."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import documents as D
from lectern.operators import scans
from lectern.operators import timeline as L


def table(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for group in (1, 2, None, 3):
        places = sorted(rng.sample(range(-50, 900), n if group == 1 else n // 8))
        rows += [(group, p, rng.randint(0, 2), rng.choice([None, None, rng.randint(1, 99)]), float(rng.randint(0, 9))) for p in places]
    return rows


@pytest.mark.parametrize("width", [1, 7, 100, 5000])
def test_scans_against_plain_loops(spark, width):
    rows = table(1)
    df = spark.createDataFrame(rows, "g long, p int, q int, v int, x double").repartition(5)
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    sums = {(r.g, r.p): (r.total, r.n) for r in scans.running_totals(df, ["g"], ["p", "q"], {"total": F.col("x"), "n": F.lit(1)}, width).collect()}
    last = {(r.g, r.p): r.v for r in scans.last_known(df, ["g"], ["p", "q"], "v", width).collect()}
    near = {(r.g, r.p): (r.before, r.after) for r in scans.neighbours(df, ["g"], ["p", "q"], {"before": "v"}, {"after": "p"}, width).collect()}
    assert len(sums) == len(last) == len(near) == len(rows)
    for group, own in by.items():
        total, known = 0.0, None
        for i, (_, p, _, v, x) in enumerate(own):
            total, known = total + x, known if v is None else v
            assert sums[group, p] == (total, i + 1) and last[group, p] == known
            assert near[group, p] == (own[i - 1][3] if i else None, own[i + 1][1] if i + 1 < len(own) else None)


def test_scans_of_nothing_and_of_null_places(spark):
    none = spark.createDataFrame([], "g long, p int, v int")
    assert scans.running_totals(none, ["g"], ["p"], {"s": F.col("v")}).count() == scans.last_known(none, ["g"], ["p"], "v").count() == 0
    odd = spark.createDataFrame([(1, None, 5), (1, 3, None), (1, 4, 2)], "g long, p int, v int")
    assert [r.v for r in scans.last_known(odd, ["g"], ["p"], "v").orderBy("p").collect()] == [5, 5, 2]
    assert [r.s for r in scans.running_totals(odd, ["g"], ["p"], {"s": F.col("v")}).orderBy("p").collect()] == [5, 5, 7]


def test_a_hot_document_is_dealt_over_all_tasks(spark):
    """One document has a third of all rows; no task gets more than a fraction of it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        hot = spark.range(150_000).select(F.lit(0).cast("long").alias("doc_id"), F.col("id").cast("int").alias("passage_index"))
        cold = spark.range(300_000).select((F.col("id") % 300 + 1).alias("doc_id"), F.floor(F.col("id") / 300).cast("int").alias("passage_index"))
        p = hot.unionByName(cold).withColumns({"est_seconds": F.lit(2.0), "seconds": F.lit(2.0), "start": F.col("passage_index") * 100, "text": F.lit("x" * 90), "section_id": F.lit("sec-0")})
        sections = p.where("passage_index % 50 = 10").select("doc_id", F.concat(F.lit("s"), "passage_index").alias("section_id"), F.lit("t").alias("title"), "start")
        made = {
            "w1": L.estimated_cues(p), "w2": L.rendered_cues(p), "j1": D.section_of_passage(p.drop("section_id"), sections),
            "j3": L.passage_at_time(p, p.select("doc_id", (F.col("passage_index") * 2.0).alias("seconds"))),
        }
        for name, df in made.items():
            whole = F.max(F.xxhash64(*df.columns))  # else the scan would be pruned
            tasks = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n"), whole).collect()]
            assert sum(tasks) == 450_000 and max(tasks) < 0.13 * 450_000, (name, tasks)
        ends = L.estimated_cues(p).groupBy("doc_id").agg(F.max("cue_end").alias("e"), F.count("*").alias("n")).where("e <> 2 * n")
        assert ends.count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)


def test_search_of_a_table_of_queries(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeÉß") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [(d, i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for d in range(6) for i in range(20)] + [(9, 0, None), (9, 1, ""), (9, 2, "ab")]
    p = spark.createDataFrame(texts, "doc_id long, passage_index int, text string")
    asked = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 2)))[:: rng.choice([1, 1, -1])] for _ in range(10_000)] + [None, "", "ab", "  ab ", "ABC", "abc", " Abc\n", "no such"]
    got = sorted(tuple(r) for r in L.search_passages(p, spark.createDataFrame([(q,) for q in asked], "query string"), 5).collect())
    want = []
    for q in sorted({q.strip().lower() for q in asked if q and len(q.strip()) >= 3}):
        for d in {d for d, _, _ in texts}:
            found = [(i, t.lower().find(q), t) for e, i, t in texts if e == d and t and q in t.lower()]
            want += [(q, d, i, t[max(0, at - 42) : at + 90]) for i, at, t in sorted(found)[:5]]
    assert got == sorted(want) and len(got) > 1000
    some = ["abc", "ed", words[0], words[1] + " " + words[2]]
    a, b = (sorted(L.search_passages(p, x).collect()) for x in (some, spark.createDataFrame([(q,) for q in some], "query string")))
    assert a == b
