"""Containers of documents, e-books as a source, files that arrive, and clips in blocks."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import clips as A
from lectern.plans import queries as plans
from lectern.sources import containers as B
from lectern.sources import files as S
from lectern.streaming import arrivals as W


def test_many_documents_in_few_containers(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    docs = spark.range(5_000).select(F.concat(F.lit("a/b: "), F.floor(F.col("id") / 2).cast("string"), F.lit(".doc")).alias("title"), F.concat(F.lit("text é "), F.col("id").cast("string")).alias("content")).repartition(4)
    B.write_documents(docs, path, "txt", containerfiles="1000")
    got = B.read_documents(spark, path).collect()
    assert sorted(r.content for r in got) == sorted(f"text é {i}" for i in range(5_000))
    assert 5 <= len({r.container for r in got}) <= 12 and len(list((tmp_path / "out").glob("*.zip"))) == len({r.container for r in got})
    assert len({(r.container, r.name) for r in got}) == 5_000 and all(r.name.startswith("a-b- ") and r.name.endswith(".txt") for r in got)
    odd = spark.createDataFrame([(None, None), ("", "x"), ("t", "")], "title string, content string")
    B.write_documents(odd, path, "txt", "append")
    assert B.read_documents(spark, path).count() == 5_003
    B.write_documents(odd, path, "txt", "overwrite")
    assert sorted((r.name, r.content) for r in B.read_documents(spark, path).collect()) == [("narration.txt", ""), ("narration.txt", "x"), ("t.txt", "")] or {r.content for r in B.read_documents(spark, path).collect()} == {"", "x"}
    assert len(list((tmp_path / "out").glob("*.zip"))) == len({r.container for r in B.read_documents(spark, path).collect()})
    B.write_documents(odd.limit(0), path, "txt", "overwrite")
    assert B.read_documents(spark, path).count() == 0 and not list((tmp_path / "out").glob("*.zip"))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    good = spark.createDataFrame([("kept", "1")], "title string, content string")
    B.write_documents(good, path, "txt")
    before = sorted(p.name for p in (tmp_path / "out").rglob("*"))
    bad = spark.range(100).select(F.lit("t").alias("title"), F.when(F.col("id") == 70, F.raise_error(F.lit("no"))).otherwise("x").alias("content")).repartition(3)
    with pytest.raises(Exception, match="no"):
        B.write_documents(bad, path, "txt")
    assert sorted(p.name for p in (tmp_path / "out").rglob("*")) == before and B.read_documents(spark, path).count() == 1


class Counted(io.BytesIO):
    """Counts the bytes that are read."""

    total = 0

    def read(self, n=-1):
        data = super().read(n)
        self.total += len(data)
        return data


def book(pages, images=0):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{i}" href="{i}.xhtml"/>' for i in range(len(pages) + 1))
        z.writestr("p.opf", f"<package><metadata><title>T</title></metadata><manifest>{items}</manifest><spine>{''.join(f'<itemref idref="i{i}"/>' for i in range(len(pages) + 1))}</spine></package>")
        for i in range(images):
            z.writestr(f"{i}.png", bytes(1_000_000))
        for i, x in enumerate(pages):
            z.writestr(f"{i}.xhtml", x)
    return out.getvalue()


def test_books_as_a_source(spark, tmp_path):
    given = {"a": book(["<h1>One</h1><p>x</p>", "<p>y</p>"]), "b": b"PK not a book", "c": book([]), "d": book(["<p>last</p>"], 3)}
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for k, content in given.items():
        (tmp_path / "in" / ("deep" if k == "a" else "") / f"{k}.epub").write_bytes(content)
    (tmp_path / "in" / "other.txt").write_text("no book")
    for size in (1, B.TASK_BYTES):
        rows = B.read_books(spark, f"file://{tmp_path}/in", taskbytes=str(size)).collect()
        got = {(r.path[-6], r.part_no, r.title, r.text, r.book_title) for r in rows if r.part_no is not None}
        about = {r.path[-6]: (r.warnings, r.error) for r in rows if r.part_no is None}
        whole = S.epub_parts(spark.createDataFrame(list(given.items()), "path string, content binary")).collect()
        assert got == {(r.path, r.part_no, r.title, r.text, r.book_title) for r in whole if r.part_no is not None}
        assert about == {r.path: (r.warnings, r.error) for r in whole} and len(about["a"][0]) == 1
    assert B.read_books(spark, f"file://{tmp_path}/none").count() == 0
    f = Counted(given["d"])
    assert len(list(S.book_parts(f, S.Book()))) == 1 and f.total < 20_000  # of three megabytes of pictures nothing is read


def test_files_that_arrive_in_two_lots(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sink = W.ingest_sink(spark, f"{tmp_path}/tables")

    for lot in ({"a.txt": "One. Two.", "b.zip": "PK\x03\x04"}, {"c.md": "# Head\n\nSome *words*.", "d.txt": " "}):
        for name, text in lot.items():
            (tmp_path / "in" / name).write_text(text)
        q = W.file_stream(spark, f"{tmp_path}/in").writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        q.awaitTermination(120)
    made = W.ingested(spark, f"{tmp_path}/tables")
    assert sorted((r["name"], r["kind"], r["text"]) for r in made.documents.collect()) == [("a.txt", "txt", "One. Two."), ("c.md", "md", "Head.\n\nSome words.")]
    assert sorted(r["name"] for r in made.rejected.collect()) == ["b.zip", "d.txt"] and made.passages.count() == 2
    (tmp_path / "tables" / "documents" / "batch=99").mkdir()  # a batch that has failed halfway
    made.documents.write.parquet(f"{tmp_path}/tables/documents/batch=98")
    assert W.ingested(spark, f"{tmp_path}/tables").documents.count() == 2


def clips(spark):
    rng = np.random.default_rng(3)
    made = [(i, [float(x) for x in np.float32(rng.normal(0, 0.2, n))], 1000) for i, n in enumerate((0, 1, 2, 9, 10, 11, 64, 301))]
    made += [(20, [0.0] * 50, 1000), (21, [0.0] * 20 + [0.9] + [0.0] * 29, 1000), (22, [0.001] * 15 + [0.5, 0.4] + [0.002] * 40, 1000), (23, None, 1000), (None, [0.5] * 12, 1000), (24, [2.0, -3.0] * 8, 1000)]
    return spark.createDataFrame(made, "clip_id long, samples array<float>, sample_rate int")


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_blocks_of_clips_equal_clips(spark, size):
    given = clips(spark)
    for whole, blocks in (
        (A.trim_silence(given, -20.0, 3.0), A.trim_silence_blocks(A.split_clips(given, size), -20.0, 3.0)), (A.normalize_peak(given), A.normalize_peak_blocks(A.split_clips(given, size))),
        (A.edge_fades(given), A.edge_fades_blocks(A.split_clips(given, size))), (A.to_pcm16(given), A.to_pcm16(A.split_clips(given, size))), (given, A.split_clips(given, size)),
    ):
        want = {r.clip_id: r.samples for r in whole.collect()}
        got = {r.clip_id: r.samples for r in A.join_clips(blocks).collect()}
        assert got == want
        assert all(len(r.samples or ()) <= size for r in blocks.collect())


def test_a_long_clip_in_blocks(spark):
    """A clip of which no row or group ever holds all."""
    n, size = 15 * 44_100, 1 << 12
    starts = spark.range(0, n, size).select(F.lit(1).cast("long").alias("clip_id"), F.col("id").alias("start"), F.lit(44_100).alias("sample_rate"))
    quiet, total = 100_000, F.lit(n)
    at = F.sequence(F.col("start"), F.least(F.col("start") + size, total) - 1)
    loud = lambda i: F.when((i < quiet) | (i >= n - quiet), 0.0).otherwise(((i % 100) / 400).cast("double"))
    blocks = starts.withColumn("samples", F.transform(at, lambda i: loud(i).cast("float")))
    made = A.edge_fades_blocks(A.normalize_peak_blocks(A.trim_silence_blocks(blocks)))
    sizes = made.select("start", F.size("samples").alias("n"), F.array_max("samples").alias("m")).orderBy("start").collect()
    keep = int(0.03 * 44_100 + 0.5)
    assert sizes[0].start == 0 and all(a.start + a.n == b.start for a, b in zip(sizes, sizes[1:])) and max(r.n for r in sizes) <= size
    assert sizes[-1].start + sizes[-1].n == (n - quiet - 1) - (quiet + 3) + 2 * keep  # the first samples of the tone are too low
    assert max(r.m for r in sizes) == pytest.approx(10 ** (-1.5 / 20), abs=1e-6)


def test_ingestion_reads_each_text_once(spark):
    plan = plans.QUERIES["ingest_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [step for step in ("EvalPython", "MapInPandas", "Window") if step in plan]  # every stage before the last is written


def test_arriving_files_are_dealt_by_their_bytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(600):
        (tmp_path / "in" / f"{i}.txt").write_bytes(b"x" * (20_000 if i < 60 else 10))
    seen = []

    def sink(batch, epoch):
        part = F.spark_partition_id().alias("p")
        seen.extend(r.b for r in W.dealt(batch).select(part, "length").groupBy("p").agg(F.sum("length").alias("b")).collect())

    stream = W.file_stream(spark, str(tmp_path / "in")).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "progress"))
    stream.trigger(availableNow=True).start().awaitTermination(120)
    assert sum(seen) == 60 * 20_000 + 540 * 10
    assert max(seen) < sum(seen) / 4  # in order of size they would share a task or two
