"""The registered queries: every operator over whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

import base64
import gzip
import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as T
from ..operators import captions as C
from ..operators import clips as A
from ..operators import documents as D
from ..operators import ingest
from ..operators import reading as R
from ..operators import timeline as L
from ..sources import containers as B
from ..sources import files as S
from ..sources import markup as M
from ..sources import sinks as K
from ..streaming import arrivals as W
from ..streaming import live as V
from . import inputs as I
from . import sql as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.line_passages(I.documents(spark, sf_dir))


def middle(p: DataFrame) -> DataFrame:
    """(doc_id, passage_index, char): a position in every document."""
    at = F.floor(F.count("*") / 2).cast("int")
    return p.groupBy("doc_id").agg(at.alias("passage_index")).withColumn("char", F.lit(7))


MIDDLE = "middle AS (SELECT doc_id, CAST(count(*) // 2 AS INTEGER) AS passage_index, 7 AS char FROM passages GROUP BY doc_id)"


RAW = "given AS (SELECT doc_id, text AS body FROM documents)"
CLEAN = f"given AS (SELECT doc_id, {Q.normalize('text')} AS body FROM documents)"
BALANCED = Q.packed("given", 900, 320, D.ABBREVIATIONS)


# The flagship: estimated narration time and passages of every document.
@query(
    f"""WITH RECURSIVE {CLEAN}, {BALANCED}, s AS (SELECT doc_id, count(*) AS passages, sum(est_seconds) AS est FROM packed GROUP BY 1)
SELECT g.doc_id, CAST({Q.words("g.body")} AS INTEGER) AS words, CAST(length(g.body) AS INTEGER) AS characters, coalesce(passages, 0) AS passages,
  round(coalesce(est, {Q.seconds(Q.words("g.body"))}), 6) AS est_seconds, round(est, 6) AS timeline_end FROM given g LEFT JOIN s USING (doc_id)"""
)
def narration_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = D.narration_time(I.documents(spark, sf_dir))
    return made.withColumns({"est_seconds": F.round("est_seconds", 6), "timeline_end": F.round("timeline_end", 6)})


# Files through to timed passages: every document as a text file.
INGESTED = f"""
WITH RECURSIVE {RAW.replace("given", "files")}, {Q.plain_parts("files")},
clean AS (SELECT doc_id, part_no, coalesce(title, doc_id || '.txt') AS title, {Q.trim(r"regexp_replace(" + Q.normalize("body") + r", '(?m)^[ \t]*[-\[(]?[ \t]*[0-9]{1,4}[ \t]*[-\])]?[ \t]*$', '', 'g')")} AS body FROM plain_parts),
seams AS (SELECT *, lag(body) OVER (PARTITION BY doc_id ORDER BY part_no) AS earlier FROM clean WHERE body <> ''),
flows AS (SELECT *, earlier IS NOT NULL AND NOT regexp_matches(right(earlier, 1), '[.!?:;"'')\\]]') AND regexp_matches(left(body, 1), '[a-z(]') AS flows FROM seams),
fused AS (SELECT *, flows AND regexp_matches(earlier, '[a-z]-$') AS fused FROM flows),
grown AS (SELECT *, length(body) + CASE WHEN earlier IS NULL THEN 0 WHEN fused THEN -1 WHEN flows THEN 1 ELSE 2 END AS size, coalesce(lead(fused) OVER (PARTITION BY doc_id ORDER BY part_no), FALSE) AS cut FROM fused),
sections AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(body) AS starts FROM grown),
given AS (SELECT doc_id, string_agg(CASE WHEN earlier IS NULL OR fused THEN '' WHEN flows THEN ' ' ELSE chr(10) || chr(10) END || CASE WHEN cut THEN left(body, length(body) - 1) ELSE body END, '' ORDER BY part_no) AS body FROM grown GROUP BY 1),
{BALANCED},
named AS (SELECT p.*, 'sec-' || s.part_no AS section_id, s.title AS section_title FROM packed p ASOF LEFT JOIN sections s ON s.doc_id = p.doc_id AND p.start >= s.starts)
SELECT doc_id, passage_index, section_id, section_title, start, stop AS "end", words, round(sum(est_seconds) OVER (PARTITION BY doc_id ORDER BY passage_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cue_end FROM named
"""


@query(INGESTED)
def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.documents(spark, sf_dir)
    name = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = docs.select("doc_id", name.alias("path"), F.col("text").cast("binary").alias("content")).withColumn("length", F.length("content").cast("long"))
    made = ingest.ingest_files(files, keep=I.written).passages
    return made.select("doc_id", "passage_index", "section_id", "section_title", "start", "end", F.col("words").cast("long").alias("words"), F.round("cue_end", 6).alias("cue_end"))


@query(INGESTED)
def ingest_arriving_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from files that arrive in two lots, as a stream that runs twice."""
    docs, at = I.documents(spark, sf_dir), I.scratch(spark, "arrivals")
    sink = W.ingest_sink(spark, f"{at}/tables", F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long"))
    before = spark.conf.get(W.LISTING, None)
    spark.conf.set(W.LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        for lot in ("doc_id % 2 = 0", "doc_id % 2 = 1"):
            I.as_files(docs.where(lot).select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content")), f"{at}/in")
            stream = W.file_stream(spark, f"{at}/in").writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/progress")
            stream.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(W.LISTING) if before is None else spark.conf.set(W.LISTING, before)
    made = W.ingested(spark, f"{at}/tables").passages
    return made.select("doc_id", "passage_index", "section_id", "section_title", "start", "end", F.col("words").cast("long").alias("words"), F.round("cue_end", 6).alias("cue_end"))


# 2.1 sources and sinks
@query(
    r"""
WITH f AS (SELECT page_id, CAST(page_id % 8 AS INTEGER) AS k, html FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'epub' WHEN 3 THEN NULL WHEN 4 THEN 'captions' WHEN 5 THEN 'captions' WHEN 6 THEN 'md' ELSE 'txt' END AS kind,
       CASE WHEN k = 3 THEN 'a ZIP archive that is no EPUB' END AS reason FROM f
"""
)
def s1_classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "pages")
    k = F.col("page_id") % 8
    ext = F.when(k == 0, "html").when(k == 1, "bin").when(k == 2, "epub").when(k == 3, "zip").when(k == 4, "srt").when(k == 5, "log").when(k == 6, "md").otherwise("log")
    front = F.when(k == 1, "%PDF-1.7").when(k.isin(2, 3), "PK\x03\x04").when(k == 5, "1\n00:00:01,000 --> 00:00:02,000\n").otherwise("")
    files = p.select("page_id", F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.lit("."), ext).alias("path"), F.concat(front, F.col("html")).cast("binary").alias("content"))
    return S.classify_files(files.withColumn("length", F.length("content").cast("long"))).select("page_id", "kind", "reason")


@query("SELECT page_id, html AS text FROM pages")
def s2_decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    mark = lambda b: F.lit(bytearray(b))
    html = F.col("html")
    content = F.when(k == 1, F.concat(mark(b"\xff\xfe"), F.encode(html, "UTF-16LE"))).when(k == 2, F.concat(mark(b"\xfe\xff"), F.encode(html, "UTF-16BE"))).when(k == 3, F.concat(mark(b"\xef\xbb\xbf"), F.encode(html, "UTF-8"))).otherwise(F.encode(html, "UTF-8"))
    return I.table(spark, sf_dir, "pages").select("page_id", S.decode_text(content).alias("text"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a page each as an e-book; one in five is damaged."""

    @pandas_udf("binary")
    def book(title: pd.Series, html: pd.Series) -> pd.Series:
        def one(t: str, h: str) -> bytes:
            out = io.BytesIO()
            if int(t) % 5 == 4:
                return b"PK\x03\x04 and nothing else"
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
                z.writestr("o/p.opf", f'<package><metadata><title>Book {t}</title><creator>Writer {int(t) % 3}</creator></metadata><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
                z.writestr("o/a.xhtml", h)
            return out.getvalue()

        return pd.Series([one(t, h) for t, h in zip(title, html, strict=True)])

    return I.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), book(F.col("page_id").cast("string"), F.coalesce("html", F.lit(""))).alias("content"))


@query()
def s3_epub_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.epub_parts(books(spark, sf_dir))


@query()
def s3_read_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same books as files, read member by member: their parts, and a row about each."""
    path = I.scratch(spark, "books")
    I.as_files(books(spark, sf_dir).select(F.concat("path", F.lit(".epub")).alias("name"), "content"), path)
    return B.read_books(spark, path).withColumn("path", F.regexp_extract("path", r"([0-9]+)\.epub$", 1))



@query(
    """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
r AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM l),
f AS (SELECT doc_id, line_no, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM r),
w AS (SELECT doc_id, CAST(line_no // 40 AS INTEGER) AS page_no, line_no, generate_subscripts(ws, 1) - 1 AS n, unnest(ws) AS word FROM f),
b AS (SELECT *, lag(word) OVER k AS before, lag(line_no) OVER k AS from_line FROM w WINDOW k AS (PARTITION BY doc_id, page_no ORDER BY line_no, n)),
j AS (SELECT *, CASE WHEN before IS NULL THEN '' WHEN line_no - from_line > 1 THEN chr(10) || chr(10) WHEN line_no > from_line THEN chr(10)
  WHEN 200 - length(before) * 6.0 > 12 * 0.28 THEN ' ' ELSE '' END || word AS said FROM b)
SELECT doc_id, page_no, string_agg(said, '' ORDER BY line_no, n) AS text FROM j GROUP BY 1, 2
"""
)
def s4_reflow_text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.lines(I.documents(spark, sf_dir)).select("doc_id", "line_no", F.posexplode(F.filter(F.split("line", " ", -1), lambda w: w != "")).alias("n", "str"))
    at = F.length("str") * 6.0
    items = rows.select("doc_id", F.floor(F.col("line_no") / 40).cast("int").alias("page_no"), (F.col("line_no") * 100_000 + F.col("n")).alias("item_no"), "str", (F.col("n") * 200.0).alias("x"), (F.col("line_no") * -14.4).alias("y"), F.lit(12.0).alias("size"), at.alias("width"), F.lit(False).alias("has_eol"))
    return S.reflow_text_items(items)


def handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payload_id, payload): dialogues as handoffs, some of another version or with a bad video id."""
    turns = I.table(spark, sf_dir, "conversations")
    cues = F.sort_array(F.collect_list(F.struct((F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + 1.5).alias("end"), "text")))
    conv = turns.groupBy("conv_id").agg(cues.alias("cues"))
    version = F.when(F.col("conv_id") % 5 == 1, 2).otherwise(1)
    video = F.when(F.col("conv_id") % 5 == 2, "short").otherwise(F.lpad(F.col("conv_id").cast("string"), 11, "x"))
    payload = F.to_json(F.struct(version.alias("v"), video.alias("videoId"), F.lit(" ").alias("title"), F.lit("en").alias("lang"), "cues"))
    return conv.select(F.col("conv_id").alias("payload_id"), payload.alias("payload"))


def validated(payloads: DataFrame, encoded: bool) -> DataFrame:
    good, bad = S.validate_handoffs(payloads, encoded)
    return good.select("payload_id", "video_id", "title", F.size("cues").alias("cues"), F.lit(None).cast("string").alias("reason")).unionByName(bad, allowMissingColumns=True)


HANDOFFS = """
WITH c AS (SELECT conv_id AS payload_id, count(*) FILTER (WHERE regexp_matches(text, '[^{SPACE}]')) AS used, lpad(CAST(conv_id AS VARCHAR), 11, 'x') AS video FROM conversations GROUP BY 1),
r AS (SELECT *, CASE WHEN payload_id % 5 = 1 THEN 'unknown version' WHEN payload_id % 5 = 2 THEN 'bad video id' WHEN used = 0 THEN 'no usable cues' END AS reason FROM c)
SELECT payload_id, CASE WHEN reason IS NULL THEN video END AS video_id, CASE WHEN reason IS NULL THEN 'Untitled video' END AS title, CASE WHEN reason IS NULL THEN CAST(used AS INTEGER) END AS cues, reason FROM r
""".replace("{SPACE}", Q.SPACE)


@query(HANDOFFS)
def s5_validate_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(handoffs(spark, sf_dir), False)


@query(HANDOFFS)
def s5_validate_packed_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    @pandas_udf("string")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda t: base64.urlsafe_b64encode(gzip.compress(t.encode(), 1)).decode().rstrip("="))

    return validated(handoffs(spark, sf_dir).withColumn("payload", pack("payload")), True)


@query(
    f"""WITH RECURSIVE {RAW}, {Q.plain_parts("given")} SELECT doc_id, part_no, coalesce(title, 'Pasted text') AS title, body AS text FROM plain_parts"""
)
def s6_route_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = I.documents(spark, sf_dir).withColumn("name", F.lit("Pasted text"))
    panels, parts = S.route_text(texts)
    return S.union_routes(panels.select("doc_id", F.lit(0).alias("part_no"), F.lit("panel").alias("title"), "text"), parts)


@query(
    f"""
WITH {Q.CUES},
b AS (SELECT track_id, cue_no, CAST(cue_no + 1 AS VARCHAR) || chr(10) || {Q.timecode("start", ",")} || ' --> ' || {Q.timecode("stop", ",")} || chr(10) || {Q.wrap("body")} || chr(10) AS block FROM cues)
SELECT track_id AS doc_id, string_agg(block, chr(10) ORDER BY cue_no) AS content FROM b GROUP BY track_id
"""
)
def s7_write_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.cues(I.documents(spark, sf_dir)).withColumnsRenamed({"track_id": "doc_id", "cue_no": "cue_index"})
    return K.subtitle_documents(c, "srt")


@query(
    f"""
WITH {Q.CUES},
b AS (SELECT track_id, cue_no, CAST(cue_no + 1 AS VARCHAR) || chr(10) || {Q.timecode("start", ".")} || ' --> ' || {Q.timecode("stop", ".")} || chr(10) || {Q.wrap("body")} || chr(10) AS block FROM cues)
SELECT track_id AS doc_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY cue_no) AS content FROM b GROUP BY track_id
"""
)
def s7_write_web_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.cues(I.documents(spark, sf_dir)).withColumnsRenamed({"track_id": "doc_id", "cue_no": "cue_index"})
    return K.subtitle_documents(c, "vtt")


@query(
    f"""
WITH {Q.CUES},
b AS (SELECT track_id, cue_no, CAST(cue_no + 1 AS VARCHAR) || chr(10) || {Q.timecode("start", ",")} || ' --> ' || {Q.timecode("stop", ",")} || chr(10) || {Q.wrap("body")} || chr(10) AS block FROM cues)
SELECT 'Document - ' || track_id || '.srt' AS name, string_agg(block, chr(10) ORDER BY cue_no) AS content FROM b GROUP BY track_id
"""
)
def s7_write_subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written into containers under their titles, and read back."""
    c = I.cues(I.documents(spark, sf_dir)).withColumnsRenamed({"track_id": "doc_id", "cue_no": "cue_index"})
    titles = I.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Document : "), F.col("doc_id").cast("string"), F.lit(".old")).alias("title"))
    path = I.scratch(spark, "subtitles")
    K.write_subtitles(c, titles, "srt", path)
    return B.read_documents(spark, path).select(F.regexp_replace("name", " +", " ").alias("name"), "content")


def transcribed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, passages, sections) for transcripts; every third document has an author."""
    p = L.estimated_cues(passages(spark, sf_dir)).withColumn("cue_start", F.col("cue_start") + 1e-9)
    number = F.col("doc_id").cast("string")
    docs = p.groupBy("doc_id").agg(F.sum("words").alias("words"), F.sum(F.length("text")).alias("characters"))
    author = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Writer "), number))
    docs = docs.select("doc_id", F.concat(F.lit("Document "), number).alias("title"), author.alias("author"), "words", "characters", F.concat(number, F.lit(".txt")).alias("name"), F.lit("txt").alias("kind"))
    sections = L.section_outline(p).select("doc_id", (F.floor(F.col("first") / 5) + 1).cast("int").alias("section_index"), "title")
    return docs, p, sections


@query(
    f"""
WITH {Q.PASSAGES},
marked AS (SELECT *, CASE WHEN section_title IS DISTINCT FROM lag(section_title) OVER (PARTITION BY doc_id ORDER BY passage_index) THEN '## ' || section_title || chr(10) || chr(10) ELSE '' END
   || '<sub>`' || {Q.clock("cue_end - est_seconds + 1e-9")} || '`</sub>' || chr(10) || chr(10) || body || chr(10) || chr(10) AS block FROM timed),
d AS (SELECT doc_id, string_agg(block, '' ORDER BY passage_index) AS body, count(*) AS n, max(cue_end) AS duration, sum(words) AS words FROM marked GROUP BY doc_id)
SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '*by Writer ' || doc_id || '*' || chr(10) || chr(10) ELSE '' END || '| | |' || chr(10) || '|---|---|' || chr(10)
  || '| **Words** | ' || format('{{:,}}', CAST(words AS BIGINT)) || ' |' || chr(10) || '| **Passages** | ' || format('{{:,}}', n) || ' |' || chr(10) || '| **Duration** | ' || {Q.clock("duration")} || ' *(estimated)* |' || chr(10)
  || '| **Source** | `' || doc_id || '.txt` |' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || body || '---' || chr(10) AS content FROM d
"""
)
def s8_write_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, p, _ = transcribed(spark, sf_dir)
    return K.transcript_documents(docs, p, "md")


@query(
    f"""
WITH {Q.PASSAGES}, d AS (SELECT doc_id, count(*) AS n, sum(words) AS words, sum(length(body)) AS characters, count(DISTINCT section_id) AS sections FROM passages GROUP BY 1)
SELECT doc_id, 'Document ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 'Writer ' || doc_id END AS author, doc_id || '.txt' AS source, CAST(d.words AS BIGINT) AS words, CAST(d.characters AS BIGINT) AS characters,
  CAST(20000 AS BIGINT) AS passages, TRUE AS estimates, CAST(d.sections AS INTEGER) AS sections, t.passage_index AS cue, t.body AS text, t.section_title AS section, round(t.cue_end, 3) AS "end" FROM d JOIN timed t USING (doc_id)
"""
)
def s8_write_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON transcripts, parsed again: a row a cue. The totals are told, as a preview's are."""
    docs, p, sections = transcribed(spark, sf_dir)
    totals = docs.select("doc_id", F.lit(20_000).cast("long").alias("passages"), F.lit(None).cast("double").alias("duration"))
    made = K.transcript_documents(docs, p, "json", sections=sections, totals=totals)
    kind = """title string, author string, source struct<name:string,kind:string>, stats struct<words:long,characters:long,passages:long,timingsAreEstimates:boolean>,
      sections array<struct<index:int,title:string>>, cues array<struct<index:int,start:double,end:double,text:string,sectionTitle:string>>"""
    j = made.select("doc_id", F.from_json("content", kind).alias("j")).select("doc_id", "j.*", F.explode("j.cues").alias("c"))
    return j.select(
        "doc_id", "title", "author", F.col("source.name").alias("source"), "stats.words", "stats.characters", "stats.passages", F.col("stats.timingsAreEstimates").alias("estimates"),
        F.size("sections").alias("sections"), F.col("c.index").alias("cue"), "c.text", F.col("c.sectionTitle").alias("section"), "c.end",
    )


@query(
    f"""
WITH {Q.PASSAGES},
marked AS (SELECT *, CASE WHEN section_title IS DISTINCT FROM lag(section_title) OVER (PARTITION BY doc_id ORDER BY passage_index) THEN chr(10) || '--- ' || section_title || ' ---' || chr(10) || chr(10) ELSE '' END
   || '[' || {Q.clock("cue_end - est_seconds + 1e-9")} || '] ' || body || chr(10) || chr(10) AS block FROM timed),
d AS (SELECT doc_id, string_agg(block, '' ORDER BY passage_index) AS body, count(*) AS n, max(cue_end) AS duration, sum(words) AS words FROM marked GROUP BY doc_id),
h AS (SELECT doc_id, 'Document ' || doc_id AS title, * EXCLUDE (doc_id) FROM d)
SELECT doc_id, regexp_replace(regexp_replace(title || chr(10) || repeat('=', least(72, greatest(length(title), 24))) || chr(10) || format('{{:,}}', CAST(words AS BIGINT)) || ' words - ' || format('{{:,}}', n) || ' passages - '
   || {Q.clock("duration")} || ' (estimated)' || chr(10) || chr(10) || body, '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\s+$', '') || chr(10) AS content FROM h
"""
)
def s8_write_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = L.estimated_cues(passages(spark, sf_dir)).withColumn("cue_start", F.col("cue_start") + 1e-9)
    docs = p.groupBy("doc_id").agg(F.sum("words").alias("words")).select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.lit(None).cast("string").alias("author"), "words")
    return K.transcript_documents(docs, p, "txt")


# 2.2 text preparation
@query(f"SELECT doc_id, {Q.normalize('text')} AS text FROM documents")
def t1_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.documents(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query(
    f"""
WITH {Q.PAGES},
ink AS (SELECT doc_id, page_no, line_no, {Q.trim("line")} AS t FROM page_lines WHERE {Q.trim("line")} <> ''),
pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS a, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no DESC) AS z FROM ink),
edges AS (SELECT DISTINCT doc_id, page_no, t FROM pos WHERE a <= 2 OR z <= 2),
keys AS (SELECT doc_id, regexp_replace(t, '[0-9]+', '#', 'g') AS key FROM edges),
tally AS (SELECT doc_id, key, count(*) AS n FROM keys WHERE length(key) BETWEEN 2 AND 90 GROUP BY 1, 2),
sizes AS (SELECT doc_id, max(page_no) + 1 AS pages FROM page_lines GROUP BY 1),
known AS (SELECT doc_id, key FROM tally JOIN sizes USING (doc_id) WHERE pages >= 4 AND n >= greatest(3, floor(pages * 0.35))),
raw AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS a, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no DESC) AS z FROM page_lines),
kept AS (SELECT r.* FROM raw r LEFT JOIN known k ON k.doc_id = r.doc_id AND k.key = regexp_replace({Q.trim("r.line")}, '[0-9]+', '#', 'g') WHERE NOT ((a <= 2 OR z <= 2) AND k.key IS NOT NULL))
SELECT p.doc_id, CAST(p.page_no AS INTEGER) AS page_no, coalesce(string_agg(k.line, chr(10) ORDER BY k.line_no), '') AS text
FROM (SELECT DISTINCT doc_id, page_no FROM page_lines) p LEFT JOIN kept k ON k.doc_id = p.doc_id AND k.page_no = p.page_no GROUP BY 1, 2
"""
)
def t2_strip_running_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.strip_running_furniture(I.pages(I.documents(spark, sf_dir)))


@query(r"SELECT doc_id, regexp_replace(text, '(?m)^[ \t]*[-\[(]?[ \t]*[0-9]{1,4}[ \t]*[-\])]?[ \t]*$', '', 'g') AS text FROM documents")
def t3_strip_orphan_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.documents(spark, sf_dir).select("doc_id", T.strip_orphan_page_numbers(F.col("text")).alias("text"))


@query()
def t4_html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "pages").select("page_id", M.html_to_text(F.col("html")).alias("text"))


@query(
    f"""
WITH s AS (SELECT doc_id, substring(text, 1, 20000) AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) = len(string_split(t, chr(10))) AS final FROM s),
b AS (SELECT *, ltrim(line, {Q.BLANKS}) AS bare, ltrim(line, '#') AS title FROM l),
m AS (SELECT *, length(line) - length(bare) <= 3 AS near, ltrim(title, ' ') AS title_text, substring(bare, 2) AS rest, ltrim(substring(bare, 2), ' ') AS rest_text, rtrim(bare, {Q.BLANKS}) AS cells FROM b),
k AS (SELECT *, ltrim(title_text, {Q.BLANKS}) = title_text AND title_text <> '' AS titled, ltrim(rest_text, {Q.BLANKS}) = rest_text AND rest_text <> '' AS said FROM m),
by_line AS (SELECT doc_id, max(CASE WHEN length(line) - length(title) BETWEEN 1 AND 6 AND length(title_text) < length(title) AND titled THEN 3 ELSE 0 END)
  + max(CASE WHEN near AND left(bare, 1) IN ('-', '*', '+') AND length(rest_text) < length(rest) AND said THEN 1 ELSE 0 END)
  + max(CASE WHEN near AND left(bare, 1) = '>' AND (rest = '' AND NOT final OR ltrim(rest, {Q.BLANKS}) <> rest) THEN 1 ELSE 0 END)
  + max(CASE WHEN near AND length(cells) >= 3 AND left(cells, 1) = '|' AND right(cells, 1) = '|' THEN 1 ELSE 0 END) AS points FROM k GROUP BY 1),
links AS (SELECT doc_id, unnest(string_split(t, '](')) AS part, unnest(range(1, len(string_split(t, '](')) + 1)) AS i FROM s),
seen AS (SELECT *, lead(part) OVER w AS target, max(CASE WHEN contains(part, ')') THEN i ELSE 0 END) OVER (PARTITION BY doc_id) AS closing, string_split(part, ']')[-1] AS label FROM links WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
linked AS (SELECT doc_id, max(CASE WHEN target IS NOT NULL AND NOT starts_with(target, ')') AND closing > i AND instr(label, '[') BETWEEN 1 AND length(label) - 1 THEN 2 ELSE 0 END) AS points FROM seen GROUP BY 1),
strong AS (SELECT doc_id, CASE WHEN len(list_filter(string_split(t, '**')[2:-2], lambda x: length(x) BETWEEN 2 AND 82 AND trim(x, {Q.BLANKS}) = x)) > 0 THEN 1 ELSE 0 END + CASE WHEN contains(t, '```') THEN 2 ELSE 0 END AS points FROM s)
SELECT doc_id, coalesce(a.points + b.points + c.points >= 3, FALSE) AS markdown FROM s LEFT JOIN by_line a USING (doc_id) LEFT JOIN linked b USING (doc_id) LEFT JOIN strong c USING (doc_id)
"""
)
def t5_looks_like_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.documents(spark, sf_dir).select("doc_id", T.looks_like_markdown(F.col("text")).alias("markdown"))


@query()
def t6_markdown_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.documents(spark, sf_dir).select("doc_id", M.markdown_to_text(F.col("text")).alias("text"))


@query(
    f"""WITH RECURSIVE {RAW}, {Q.plain_parts("given")} SELECT doc_id, part_no, coalesce(title, 'Document') AS title, body AS text FROM plain_parts"""
)
def t7_split_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.split_plain_text(I.documents(spark, sf_dir).withColumn("name", F.lit("Document")))


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches(lang, '(?i)^en([-_]|$)')")
def t8_english_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").where(T.english_only(F.col("lang"))).select("doc_id", "lang")


@query(
    """
SELECT page_id, CASE page_id % 4 WHEN 3 THEN NULL ELSE lpad(CAST(page_id AS VARCHAR), 11, 'v') END AS video_id,
  CAST(CASE page_id % 4 WHEN 0 THEN 90.0 WHEN 1 THEN 3723.0 ELSE NULL END AS DOUBLE) AS start FROM pages
"""
)
def t9_parse_video_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.lpad(F.col("page_id").cast("string"), 11, "v")
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), v, F.lit("&t=90"))).when(k == 1, F.concat(F.lit("youtu.be/"), v, F.lit("?t=1h2m3s"))).when(k == 2, F.concat(F.lit("https://m.youtube.com/shorts/"), v)).otherwise(F.col("url"))
    return I.table(spark, sf_dir, "pages").select("page_id", T.parse_video_url(url).alias("u")).select("page_id", "u.video_id", "u.start")


@query(f"SELECT doc_id, regexp_matches(text, '[^{Q.SPACE}]') AS readable FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN ' ' || chr(160) ELSE text END AS text FROM documents)")
def t10_drop_empty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.documents(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.col("text")))
    good, bad = D.drop_empty_documents(docs)
    return good.select("doc_id", F.lit(True).alias("readable")).unionByName(bad.select("doc_id", F.lit(False).alias("readable")))


# 2.3 captions
def caption_file(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(track_id, text): the lines of every document as a caption file."""
    c = I.cues(I.documents(spark, sf_dir)).where(~T.is_blank(F.col("text")))
    a, b = F.col("start"), F.col("end")
    if kind == "json3":
        seg = F.array_join(F.sort_array(F.collect_list(F.struct("cue_no", F.to_json(F.struct((a * 1000).cast("long").alias("tStartMs"), F.lit(1800).alias("dDurationMs"), F.array(F.struct(F.col("text").alias("utf8"))).alias("segs"))).alias("b"))))["b"], ",")
        return c.groupBy("track_id").agg(F.concat(F.lit('{"events":['), seg, F.lit("]}")).alias("text"))
    if kind == "ttml":
        body = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        block = F.concat(F.lit('<p begin="'), T.timecode(a, "."), F.lit('" end="'), T.timecode(b, "."), F.lit('">'), body, F.lit("</p>"))
        front, join, back = "<tt><body>", "", "</body></tt>"
    elif kind == "panel":
        block, front, join, back = F.concat(T.format_stamp(a), F.lit("\n"), F.concat(F.lit("x "), F.col("text"))), "", "\n", ""
    elif kind == "sbv":
        block, front, join, back = F.concat(T.timecode(a, "."), F.lit(","), T.timecode(b, "."), F.lit("\n"), F.col("text")), "", "\n\n", ""
    else:
        sep = "." if kind == "vtt" else ","
        block = F.concat(T.timecode(a, sep), F.lit(" --> "), T.timecode(b, sep), F.lit("\n"), F.col("text"))
        front, join, back = ("WEBVTT\n\n" if kind == "vtt" else ""), "\n\n", ""
    blocks = F.array_join(F.sort_array(F.collect_list(F.struct("cue_no", block.alias("b"))))["b"], join)
    return c.groupBy("track_id").agg(F.concat(F.lit(front), blocks, F.lit(back)).alias("text"))


def _clean(x: str) -> str:
    """Cue text for DuckDB: lines have no karaoke stamps or numbered entities."""
    x = rf"regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '\{{\\[^}}]*\}}', '', 'g')"
    for a, b in (("&quot;", '"'), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return Q.trim(rf"regexp_replace({x}, '[ \t]+', ' ', 'g')")


FILE_CUES = (
    Q.CUES
    + f""",
full_cues AS (SELECT * FROM cues WHERE regexp_matches(body, '[^{Q.SPACE}]')),
cleaned AS (SELECT track_id, cue_no, start, stop, {_clean("body")} AS body FROM full_cues),
filed AS (SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY cue_no) - 1 AS INTEGER) AS cue_no, start, stop, body FROM cleaned WHERE body <> '')
"""
)
CUE_ROWS = f'WITH {FILE_CUES} SELECT track_id, cue_no, start, round(stop, 6) AS "end", body AS text FROM filed'


def rounded(cues: DataFrame) -> DataFrame:
    return cues.select("track_id", "cue_no", "start", F.round("end", 6).alias("end"), "text")


@query(
    """
WITH k AS (SELECT doc_id AS track_id, doc_id % 6 AS k FROM documents)
SELECT track_id, CASE k WHEN 0 THEN 'vtt' WHEN 1 THEN 'srt' WHEN 2 THEN 'sbv' WHEN 3 THEN 'ttml' WHEN 4 THEN 'json3' ELSE NULL END AS format FROM k
"""
)
def c1_detect_caption_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    front = F.when(k == 0, "WEBVTT\n\n").when(k == 1, "1\n00:00:01,000 --> 00:00:02,000\n").when(k == 2, "0:00:01.000,0:00:02.000\n").when(k == 3, "<tt xml:lang='en'><p>").when(k == 4, '{"events": [').otherwise("")
    return I.documents(spark, sf_dir).select(F.col("doc_id").alias("track_id"), T.detect_caption_format(F.concat(front, F.col("text"))).alias("format"))


@query(CUE_ROWS)
def c2_parse_vtt_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.parse_vtt_srt(caption_file(spark, sf_dir, "vtt")))


@query(CUE_ROWS)
def c3_parse_sbv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.parse_sbv(caption_file(spark, sf_dir, "sbv")))


@query(CUE_ROWS)
def c4_parse_ttml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.parse_ttml(caption_file(spark, sf_dir, "ttml"))[0])


@query(CUE_ROWS)
def c5_parse_json3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.parse_json3(caption_file(spark, sf_dir, "json3")))


@query(
    f"""WITH {FILE_CUES},
panel AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY cue_no) - 1 AS cue_no, start, {_clean("'x ' || body")} AS body FROM full_cues)
SELECT track_id, CAST(cue_no AS INTEGER) AS cue_no, start, coalesce(lead(start) OVER (PARTITION BY track_id ORDER BY cue_no), start) AS "end", body AS text FROM panel"""
)
def c6_parse_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.parse_panel(caption_file(spark, sf_dir, "panel")))


@query(f"SELECT doc_id, {_clean('line')} AS text FROM (SELECT doc_id, replace(text, chr(10), ' ') AS line FROM documents)")
def c7_clean_cue_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.documents(spark, sf_dir).select("doc_id", C.clean_cue_text(F.replace(F.col("text"), F.lit("\n"), F.lit(" "))).alias("text"))


@query()
def c8_dedupe_rolling_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedupe_rolling_cues(I.cues(I.documents(spark, sf_dir)))


@query(
    f"""
WITH {Q.CUES}, s AS (SELECT track_id, CAST(sum(len(regexp_extract_all(body, '[^{Q.SPACE}]+'))) AS BIGINT) AS words, CAST(sum(len(regexp_extract_all(body, '[.!?](?:["'')\\]]|[{Q.SPACE}]|$)'))) AS BIGINT) AS terminals FROM cues GROUP BY 1)
SELECT *, words >= 25 AND terminals / words < 0.01 AS reconstructed FROM s
"""
)
def c9_track_punctuation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.track_punctuation_stats(I.cues(I.documents(spark, sf_dir)))


@query()
def c10_repair_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repair_captions(I.cues(I.documents(spark, sf_dir)))


@query()
def c11_captions_to_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.captions_to_parts(I.cues(I.documents(spark, sf_dir)))


@query(
    """
WITH t AS (SELECT source AS video_id, CAST(doc_id AS BIGINT) AS track_no, lang AS language_code, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'asr' END AS kind, 'de-DE' AS want FROM documents)
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN kind IS NULL AND language_code = 'de' THEN 0 WHEN language_code = 'de' THEN 1 WHEN kind IS NULL THEN 2 ELSE 3 END, track_no) = 1
"""
)
def c12_pick_caption_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).otherwise("asr")
    d = I.table(spark, sf_dir, "documents")
    return C.pick_caption_track(d.select(F.col("source").alias("video_id"), F.col("doc_id").alias("track_no"), F.col("lang").alias("language_code"), kind.alias("kind"), F.lit("de-DE").alias("want")))


# 2.4 documents, sentences, passages
_PARTS = f"""
page_text AS (SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY line_no) AS body FROM page_lines GROUP BY 1, 2),
clean0 AS (SELECT doc_id, page_no, {Q.normalize("body")} AS body FROM page_text),
clean1 AS (SELECT doc_id, page_no, {Q.trim(r"regexp_replace(body, '(?m)^[ \t]*[-\[(]?[ \t]*[0-9]{1,4}[ \t]*[-\])]?[ \t]*$', '', 'g')")} AS body FROM clean0),
clean2 AS (SELECT * FROM clean1 WHERE body <> ''),
seams AS (SELECT *, lag(body) OVER w AS before, row_number() OVER w AS section_index FROM clean2 WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)),
flows AS (SELECT *, before IS NOT NULL AND NOT regexp_matches(right(before, 1), '[.!?:;"'')\\]]') AND regexp_matches(left(body, 1), '[a-z(]') AS flows FROM seams),
fused AS (SELECT *, flows AND regexp_matches(before, '[a-z]-$') AS fused FROM flows),
grown AS (SELECT *, length(body) + CASE WHEN before IS NULL THEN 0 WHEN fused THEN -1 WHEN flows THEN 1 ELSE 2 END AS size FROM fused)
"""


@query(
    f"""
WITH {Q.PAGES}, {_PARTS},
ends AS (SELECT *, CAST(sum(size) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS stop FROM grown)
SELECT doc_id, 'sec-' || CAST(page_no AS VARCHAR) AS section_id, CAST(section_index AS INTEGER) AS section_index, 'Page ' || CAST(page_no AS VARCHAR) AS title, CAST(stop - length(body) AS INTEGER) AS start, stop AS "end" FROM ends
"""
)
def p1_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = I.pages(I.documents(spark, sf_dir)).select("doc_id", F.col("page_no").alias("part_no"), F.concat(F.lit("Page "), F.col("page_no").cast("string")).alias("title"), "text")
    return D.assemble(parts).drop("piece")


_ABBREVIATED = ", ".join(f"'{a}'" for a in D.ABBREVIATIONS)


@query(
    rf"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?s).*?(?:[.!?]+["'')\]]*(?:[{Q.SPACE}]+|$)|\n{{2,}})|.+$') AS l FROM documents),
p AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS piece FROM m),
w AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS stop, regexp_extract({Q.trim("piece")}, '([\p{{L}}.]+)\.$', 1) AS word FROM p),
a AS (SELECT *, word <> '' AND (regexp_replace(lower(word), '\.$', '') IN ({_ABBREVIATED}) OR regexp_matches(word, '^\p{{Lu}}$')) AS abbreviated FROM w),
o AS (SELECT *, CASE WHEN coalesce(lag(abbreviated) OVER (PARTITION BY doc_id ORDER BY i), FALSE) THEN 0 ELSE 1 END AS opens FROM a),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM o),
s AS (SELECT doc_id, n, CAST(min(stop - length(piece)) AS INTEGER) AS start, max(stop) AS "end", bool_or(regexp_matches(piece, '[^{Q.SPACE}]')) AS inked FROM g GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS sentence_no, start, "end" FROM s WHERE inked
"""
)
def p2_segment_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.segment_sentences(I.documents(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {RAW}, {Q.sentences("given", D.ABBREVIATIONS)}, {Q.units("given", 120)},
s AS (SELECT doc_id, start, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS sentence_no FROM spans)
SELECT u.doc_id, sentence_no, CAST(row_number() OVER (PARTITION BY u.doc_id, sentence_no ORDER BY a) - 1 AS INTEGER) AS piece_no, a AS start, b AS "end" FROM units u JOIN s ON s.doc_id = u.doc_id AND s.start = u.whole_start"""
)
def p3_split_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.documents(spark, sf_dir)
    return D.split_oversized(docs, D.segment_sentences(docs), 120)


@query(f"""WITH RECURSIVE {RAW}, {BALANCED} SELECT doc_id, passage_index, body AS text, start, stop AS "end", sentences, CAST(words AS INTEGER) AS words, round(est_seconds, 6) AS est_seconds FROM packed""")
def p4_build_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.build_passages(I.documents(spark, sf_dir)).withColumns({"sentences": F.size("sentences"), "est_seconds": F.round("est_seconds", 6)})


def _inner(ctes: str, name: str) -> str:
    """The CTEs of ``packed`` as one of their own, so that two presets can stand in one query."""
    return f"{name} AS (WITH RECURSIVE {ctes} SELECT doc_id, count(*) AS n FROM packed GROUP BY 1)"


@query(
    f"""WITH {RAW}, {_inner(BALANCED, "old")}, {_inner(Q.packed("given", 480, 160, D.ABBREVIATIONS), "new")}
SELECT old.doc_id, CAST(old.n // 2 AS INTEGER) AS old_index, CAST(floor(CAST(old.n // 2 AS DOUBLE) / greatest(1, old.n) * new.n) AS INTEGER) AS passage_index FROM old JOIN new USING (doc_id)"""
)
def p5_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.documents(spark, sf_dir)
    old, new = D.build_passages(docs, "balanced"), D.build_passages(docs, "responsive")
    return D.rechunk_positions(old, new, middle(old).drop("char"))


@query()
def p6_synthesis_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.synthesis_segments(D.build_passages(I.documents(spark, sf_dir)))


@query(
    f"""WITH {Q.PASSAGES}
SELECT doc_id, passage_index, start + CASE WHEN passage_index % 10 = 3 THEN 1 ELSE 0 END AS start, stop AS "end" FROM passages p JOIN documents d USING (doc_id)
WHERE substring(d.text, p.start + CASE WHEN passage_index % 10 = 3 THEN 2 ELSE 1 END, p.stop - p.start - CASE WHEN passage_index % 10 = 3 THEN 1 ELSE 0 END) <> p.body"""
)
def p7_passage_offset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.documents(spark, sf_dir)
    wrong = (F.col("passage_index") % 10 == 3).cast("int")
    return D.passage_offset_audit(docs, I.line_passages(docs).withColumn("start", F.col("start") + wrong))


# 2.5 joins
@query(
    f"""
WITH {Q.PASSAGES}, sections AS (SELECT doc_id, 'sec-' || line_no AS section_id, 'From line ' || line_no AS title, start FROM lines WHERE line_no % 10 = 0 AND line_no > 0)
SELECT p.doc_id, p.passage_index, coalesce(s.section_id, 'sec-0') AS section_id, coalesce(s.title, 'Document') AS section_title FROM passages p ASOF LEFT JOIN sections s ON p.doc_id = s.doc_id AND p.start >= s.start
"""
)
def j1_section_of_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.documents(spark, sf_dir)
    p = I.line_passages(docs).drop("section_id", "section_title")
    return D.section_of_passage(p, I.sections(docs)).select("doc_id", "passage_index", "section_id", "section_title")


@query(
    f"""
WITH {Q.PASSAGES}, asked AS (SELECT doc_id, CAST(length(text) * f // 10 AS BIGINT) AS "offset" FROM documents, (SELECT unnest([0, 3, 7, 11]) AS f)),
hit AS (SELECT a.doc_id, a."offset", p.passage_index, p.start, length(p.body) AS n FROM asked a ASOF LEFT JOIN passages p ON a.doc_id = p.doc_id AND a."offset" >= p.start),
f AS (SELECT doc_id, start, length(body) AS n FROM passages WHERE passage_index = 0)
SELECT hit.doc_id, hit."offset", coalesce(passage_index, 0) AS passage_index, CAST(greatest(0, least(hit."offset" - coalesce(hit.start, f.start), coalesce(hit.n, f.n) - 1)) AS INTEGER) AS char FROM hit JOIN f ON f.doc_id = hit.doc_id
"""
)
def j2_passage_at_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.documents(spark, sf_dir)
    asked = docs.select("doc_id", F.explode(F.array(*(F.floor(F.length("text") * F.lit(f) / 10).cast("long") for f in (0, 3, 7, 11)))).alias("offset"))
    return L.passage_at_char(I.line_passages(docs), asked)


@query(
    f"""
WITH {Q.PASSAGES}, clock AS (SELECT doc_id, passage_index, round(cue_end - est_seconds, 6) AS before FROM timed),
asked AS (SELECT doc_id, CAST(s AS DOUBLE) AS seconds FROM (SELECT DISTINCT doc_id FROM passages), (SELECT unnest([0.0001, 10.0001, 33.3333, 100000]) AS s))
SELECT a.doc_id, a.seconds, coalesce(c.passage_index, 0) AS passage_index FROM asked a ASOF LEFT JOIN clock c ON a.doc_id = c.doc_id AND a.seconds * 1.25 >= c.before
"""
)
def j3_passage_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    asked = p.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, (0.0001, 10.0001, 33.3333, 100000.0)))).alias("seconds"))
    return L.passage_at_time(p, asked, rate=1.25)


WORD_TOKENS = f"RECURSIVE {Q.PASSAGES}, {Q.word_tokens(D.ABBREVIATIONS)}"


@query(
    f"""WITH {WORD_TOKENS}, n AS (SELECT doc_id, start, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS token_no FROM word_tokens),
asked AS (SELECT doc_id, CAST(length(text) * f // 10 AS BIGINT) AS "offset" FROM documents, (SELECT unnest([0, 3, 7]) AS f))
SELECT a.doc_id, a."offset", CASE WHEN a.doc_id IN (SELECT doc_id FROM n) THEN coalesce(n.token_no, 0) ELSE -1 END AS token_no FROM asked a ASOF LEFT JOIN n ON a.doc_id = n.doc_id AND a."offset" >= n.start"""
)
def j4_token_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.documents(spark, sf_dir)
    tokens = R.tokenize_words(I.line_passages(docs))
    numbered = tokens.select("doc_id", "start", (F.row_number().over(L.Window.partitionBy("doc_id").orderBy("start")) - 1).alias("token_no"))
    asked = docs.select("doc_id", F.explode(F.array(*(F.floor(F.length("text") * F.lit(f) / 10).cast("long") for f in (0, 3, 7)))).alias("offset"))
    return L.token_at_offset(numbered, asked)


def halved(p: DataFrame) -> DataFrame:
    """Line passages with two sentence spans each, but for the last tenth of their text."""
    n = F.length("text")
    a, b = F.floor(n / 2).cast("int"), F.floor(n * 0.9).cast("int")
    spans = F.array(F.struct(F.lit(0).alias("start"), a.alias("end")), F.struct(a.alias("start"), b.alias("end")))
    return p.withColumn("sentences", spans)


@query(
    f"""
WITH {Q.PASSAGES}, q AS (SELECT doc_id, passage_index, length(body) AS n, f FROM passages, (SELECT unnest([0, 6, 19]) AS f)),
l AS (SELECT doc_id, passage_index, n, CAST(floor(n * f / 20) AS INTEGER) AS local FROM q)
SELECT doc_id, passage_index, local, CAST(CASE WHEN local < n // 2 THEN 0 WHEN local < floor(n * 0.9) THEN n // 2 ELSE 0 END AS INTEGER) AS sentence_start,
  CAST(CASE WHEN local < n // 2 THEN n // 2 WHEN local < floor(n * 0.9) THEN floor(n * 0.9) ELSE n END AS INTEGER) AS sentence_end FROM l
"""
)
def j5_active_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = halved(passages(spark, sf_dir))
    at = p.select("doc_id", "passage_index", F.explode(F.array(*(F.floor(F.length("text") * F.lit(f) / 20).cast("int") for f in (0, 6, 19)))).alias("local"))
    return L.active_sentence(p, at)


def measured(p: DataFrame) -> DataFrame:
    return p.where("passage_index % 3 = 1").select("doc_id", "passage_index", (F.col("est_seconds") * 1.5).alias("seconds"))


@query(
    f"""WITH {Q.PASSAGES} SELECT doc_id, passage_index, CASE WHEN passage_index % 3 = 1 THEN round(est_seconds * 1.5, 6) END AS measured, round(CASE WHEN passage_index % 3 = 1 THEN est_seconds * 1.5 ELSE est_seconds END, 6) AS seconds FROM passages"""
)
def j6_apply_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    return L.apply_measurements(p, measured(p)).select("doc_id", "passage_index", F.round("measured", 6).alias("measured"), F.round("seconds", 6).alias("seconds"))


@query(
    f"""
WITH {Q.PASSAGES}, d AS (SELECT doc_id % 50 AS reader_id, 'doc ' || doc_id || '|' || length(text) || '|' || length(text) AS place_key, doc_id, text FROM documents),
n AS (SELECT doc_id, count(*) AS passages FROM passages GROUP BY 1)
SELECT reader_id, place_key, passages, CAST(CASE WHEN doc_id % 3 > 0 AND doc_id % 17 > 0 AND doc_id % 17 < passages THEN doc_id % 17 ELSE 0 END AS INTEGER) AS passage_index FROM d JOIN n USING (doc_id)
"""
)
def j7_recall_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.documents(spark, sf_dir)
    key = L.place_key(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.length("text"), F.length("text"))
    keyed = docs.select("doc_id", (F.col("doc_id") % 50).alias("reader_id"), key.alias("place_key"))
    n = I.line_passages(docs).groupBy("doc_id").agg(F.count("*").alias("passages"))
    saved = keyed.where("doc_id % 3 > 0").select("reader_id", "place_key", (F.col("doc_id") % 17).cast("int").alias("passage_index"))
    return L.recall_places(keyed.join(n, "doc_id").drop("doc_id"), saved).select("reader_id", "place_key", "passages", "passage_index")


@query(f"WITH {Q.PASSAGES}, {MIDDLE} SELECT p.doc_id, p.passage_index, p.section_id FROM passages p JOIN middle m ON m.doc_id = p.doc_id AND m.passage_index // 5 = p.passage_index // 5")
def j8_export_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    return L.export_scope(p, middle(p), "section").select("doc_id", "passage_index", "section_id")


@query(f"WITH {Q.PASSAGES}, {MIDDLE} SELECT p.doc_id, p.passage_index, p.section_id FROM passages p JOIN middle m ON m.doc_id = p.doc_id AND p.passage_index >= m.passage_index")
def j8_export_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    return L.export_scope(p, middle(p), "rest").select("doc_id", "passage_index", "section_id")


# 2.6 aggregations
@query(
    f"""WITH {Q.PASSAGES}, s AS (SELECT doc_id, count(*) AS passages, sum(est_seconds) AS est FROM passages GROUP BY 1)
SELECT d.doc_id, {Q.words("d.text")} AS words, CAST(length(d.text) AS BIGINT) AS characters, coalesce(passages, 0) AS passages, round(coalesce(est, {Q.seconds(Q.words("d.text"))}), 6) AS est_seconds FROM documents d LEFT JOIN s USING (doc_id)"""
)
def a1_document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.documents(spark, sf_dir)
    stats = L.document_stats(docs, I.line_passages(docs), T.count_words(F.col("text")).cast("long"))
    return stats.withColumns({"est_seconds": F.round("est_seconds", 6), "characters": F.col("characters").cast("long")})


@query(f"""WITH {Q.PASSAGES} SELECT doc_id, section_id, any_value(section_title) AS title, min(passage_index) AS first, max(passage_index) AS last, round(sum(est_seconds), 6) AS seconds, CAST(sum(words) AS BIGINT) AS words FROM passages GROUP BY 1, 2""")
def a2_section_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.section_outline(passages(spark, sf_dir)).withColumn("seconds", F.round("seconds", 6))


@query(f"""WITH {Q.PASSAGES} SELECT doc_id, round(sum(est_seconds) / 1.25, 6) AS seconds, CAST(sum(length(body)) AS BIGINT) AS characters, count(*) AS requests, round(64000.0 * (sum(est_seconds) / 1.25) / 8, 3) AS bytes FROM passages GROUP BY 1""")
def a3_export_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.export_estimate(passages(spark, sf_dir), 1.25, 64).withColumns({"seconds": F.round("seconds", 6), "bytes": F.round("bytes", 3)})


@query(f"""WITH {Q.PASSAGES} SELECT doc_id, round(avg(CASE WHEN passage_index % 3 = 1 THEN 1.0 ELSE 0.0 END), 9) AS confidence FROM passages GROUP BY 1""")
def a4_timeline_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    return L.timeline_confidence(L.apply_measurements(p, measured(p))).withColumn("confidence", F.round("confidence", 9))


@query(
    f"""WITH {WORD_TOKENS}, w AS (SELECT *, {Q.weight()} AS weight FROM word_tokens), d AS (SELECT *, weight * (60000.0::DOUBLE / 400) / avg(weight) OVER (PARTITION BY doc_id, passage_index) AS dwell FROM w),
s AS (SELECT doc_id, count(*) AS words, sum(dwell) AS total, min(dwell) AS shortest, max(dwell) AS longest FROM d GROUP BY 1)
SELECT doc_id, words, round(words * 60000 / total, 6) AS effective_wpm, abs(words * 60000 / total - 400) <= 8 AS within, round(shortest, 6) AS shortest, round(longest, 6) AS longest FROM s"""
)
def a5_pacing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = R.dwell_schedule(R.tokenize_words(passages(spark, sf_dir)), 400)
    return R.pacing_report(tokens, 400).withColumns({c: F.round(c, 6) for c in ("effective_wpm", "shortest", "longest")})


@query(
    f"""WITH {Q.PAGES}, t AS (SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY line_no) AS body FROM page_lines GROUP BY 1, 2), c AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE length({Q.trim("body")}) < 8) AS thin FROM t GROUP BY 1)
SELECT *, thin > pages * 0.4 AS warning FROM c"""
)
def a6_scan_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scan_warnings(I.pages(I.documents(spark, sf_dir)))


@query(f"""SELECT doc_id AS track_id, CASE WHEN doc_id % 4 = 0 THEN 'No caption lines were found in that file.' WHEN doc_id % 4 = 1 THEN 'That caption track had timings but no text.' END AS warning FROM documents""")
def a7_caption_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.cues(I.documents(spark, sf_dir))
    files = c.select("track_id").distinct()
    return L.caption_warnings(files, c.where("track_id % 4 <> 0"), c.where("track_id % 4 > 1 AND cue_no = 0"))


@query(f"""WITH {Q.PASSAGES} SELECT 'engine' AS provider, 'af' AS voice, 3.0::DOUBLE AS speed, body AS text, count(*) AS uses FROM passages GROUP BY body""")
def a8_distinct_synthesis_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.distinct_synthesis_requests(passages(spark, sf_dir), "engine", "af", 4.0).drop("fnv")


@query(
    f"""WITH {Q.PASSAGES}, t AS (SELECT DISTINCT body AS text FROM passages)
SELECT text, CAST(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, length(text) + 1), lambda i: CAST(unicode(substring(text, i, 1)) AS UBIGINT))), lambda h, x: (xor(h, x) * 16777619) % 4294967296) AS BIGINT) AS fnv FROM t"""
)
def a8_synthesis_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.distinct_synthesis_requests(passages(spark, sf_dir), "engine", "af", 4.0).select("text", "fnv")


@query(
    f"""WITH {WORD_TOKENS}, n AS (SELECT doc_id, passage_index, count(*) AS n FROM word_tokens GROUP BY 1, 2)
SELECT doc_id, passage_index, CAST(CASE WHEN passage_index % 7 = 3 AND n > 2 THEN 1 ELSE 0 END AS BIGINT) AS mismatched,
  CAST(CASE WHEN passage_index % 7 = 3 AND n > 2 OR passage_index % 7 = 5 AND n > 1 THEN 1 ELSE 0 END AS BIGINT) AS lost FROM n"""
)
def a9_token_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In some passages the third token begins one late; in some the second is missing."""
    p = passages(spark, sf_dir)
    k = F.col("passage_index") % 7
    tokens = R.tokenize_words(p).where(~((k == 5) & (F.col("token_no") == 1)))
    return R.token_round_trip(tokens.withColumn("start", F.col("start") + ((k == 3) & (F.col("token_no") == 2)).cast("int")), p)


# 2.7 windows
@query(f"""WITH {Q.PASSAGES} SELECT doc_id, passage_index, round(cue_end - est_seconds, 6) AS cue_start, round(cue_end, 6) AS cue_end FROM timed""")
def w1_estimated_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.estimated_cues(passages(spark, sf_dir)).select("doc_id", "passage_index", F.round("cue_start", 6).alias("cue_start"), F.round("cue_end", 6).alias("cue_end"))


def _rendered(gap: float, section_gap: float) -> str:
    return f"""WITH {Q.PASSAGES}, g AS (SELECT *, CASE WHEN lead(section_id) OVER w IS NULL THEN 0 WHEN lead(section_id) OVER w <> section_id THEN {section_gap} ELSE {gap} END AS gap FROM passages WINDOW w AS (PARTITION BY doc_id ORDER BY passage_index)),
s AS (SELECT *, sum(est_seconds + gap) OVER (PARTITION BY doc_id ORDER BY passage_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM g)
SELECT doc_id, passage_index, CAST(gap AS DOUBLE) AS gap, round(total - est_seconds - gap, 6) + 0.0 AS cue_start, round(total - gap, 6) AS cue_end FROM s"""


def rendered(spark: SparkSession, sf_dir: str, **gaps: float) -> DataFrame:
    p = passages(spark, sf_dir).withColumn("seconds", F.col("est_seconds"))
    return L.rendered_cues(p, **gaps).select("doc_id", "passage_index", "gap", (F.round("cue_start", 6) + 0.0).alias("cue_start"), F.round("cue_end", 6).alias("cue_end"))


@query(_rendered(0.32, 0.9))
def w2_rendered_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir)


@query(_rendered(**L.LIVE_GAPS))
def w2_live_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir, **L.LIVE_GAPS)


@query(
    f"""WITH {Q.PASSAGES}, {MIDDLE}, tot AS (SELECT doc_id, sum(est_seconds) AS total FROM passages GROUP BY 1)
SELECT m.doc_id, m.passage_index, m.char, round((t.cue_end - t.est_seconds) / 1.5 + t.est_seconds / 1.5 * least(1.0, 7.0 / length(t.body)), 6) AS position, round(tot.total / 1.5, 6) AS total
FROM middle m JOIN timed t ON t.doc_id = m.doc_id AND t.passage_index = m.passage_index JOIN tot ON tot.doc_id = m.doc_id"""
)
def w3_position_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    return L.position_clock(p, middle(p), 1.5).withColumns({"position": F.round("position", 6), "total": F.round("total", 6)})


@query(
    f"""WITH {Q.PASSAGES}, {MIDDLE}, o AS (SELECT doc_id, section_id, min(passage_index) AS a, max(passage_index) AS z FROM passages GROUP BY 1, 2)
SELECT o.doc_id, o.section_id, round(CASE WHEN m.passage_index > z THEN 1.0 WHEN m.passage_index < a THEN 0.0 ELSE (m.passage_index - a + 1) / (z - a + 1) END, 9) AS progress FROM o JOIN middle m USING (doc_id)"""
)
def w4_section_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    return L.section_progress(L.section_outline(p), middle(p)).withColumn("progress", F.round("progress", 9))


# Plain words as tokens, for the schedule's oracles: passages split at blanks.
def plain_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    rows = p.select("doc_id", "passage_index", F.posexplode(F.filter(F.split("text", " ", -1), lambda w: w != "")).alias("token_no", "display"))
    return rows.withColumns({
        "ends_sentence": F.col("display").rlike(r"[.!?]\z"), "ends_clause": F.col("display").rlike(r"[,;:]\z"), "ends_paragraph": F.lit(False), "numeric": F.col("display").rlike("[0-9]"), "continued": F.lit(False),
        "start": F.col("token_no"),
    })


TOKENS = (
    Q.PASSAGES
    + """,
split AS (SELECT doc_id, passage_index, list_filter(string_split(body, ' '), lambda x: x <> '') AS l FROM passages),
tokens AS (SELECT doc_id, passage_index, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS token_no, unnest(l) AS display FROM split),
weighed AS (SELECT *, (1 + CASE WHEN length(display) > 8 THEN least(0.6::DOUBLE, (length(display) - 8) * 0.04::DOUBLE) ELSE 0 END)
   * CASE WHEN regexp_matches(display, '[.!?]$') THEN 2.1::DOUBLE WHEN regexp_matches(display, '[,;:]$') THEN 1.45::DOUBLE ELSE 1 END * CASE WHEN regexp_matches(display, '[0-9]') THEN 1.3::DOUBLE ELSE 1 END AS weight FROM tokens),
paced AS (SELECT *, weight * (60000.0::DOUBLE / 397) / avg(weight) OVER (PARTITION BY doc_id, passage_index) AS dwell_ms FROM weighed)
"""
)


@query(f"""WITH {TOKENS} SELECT doc_id, passage_index, token_no, round(dwell_ms, 6) AS dwell_ms FROM paced""")
def w5_dwell_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dwell_schedule(plain_tokens(spark, sf_dir), 397).select("doc_id", "passage_index", "token_no", F.round("dwell_ms", 6).alias("dwell_ms"))


@query(f"""WITH {TOKENS} SELECT doc_id, passage_index, token_no, round(CASE WHEN token_no < 12 THEN dwell_ms / (0.7::DOUBLE + 0.3::DOUBLE * (token_no / 12)) ELSE dwell_ms END, 6) AS dwell_ms FROM paced""")
def w6_ramp_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = R.dwell_schedule(plain_tokens(spark, sf_dir), 397)
    return R.ramp_up(tokens, ["doc_id", "passage_index"], ["token_no"]).select("doc_id", "passage_index", "token_no", F.round("dwell_ms", 6).alias("dwell_ms"))


@query(
    f"""WITH {TOKENS}, s AS (SELECT *, sum(greatest(1, dwell_ms)) OVER (PARTITION BY doc_id, passage_index ORDER BY token_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM paced)
SELECT doc_id, passage_index, token_no, round(done - greatest(1, dwell_ms), 4) AS show_at, round(done, 4) AS done_at FROM s"""
)
def w7_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = R.dwell_schedule(plain_tokens(spark, sf_dir), 397)
    made = R.deadlines(tokens, ["doc_id", "passage_index"], ["token_no"])
    return made.select("doc_id", "passage_index", "token_no", F.round("show_at", 4).alias("show_at"), F.round("done_at", 4).alias("done_at"))


@query(
    f"""WITH {TOKENS} SELECT doc_id, passage_index, token_no, coalesce(lag(token_no) OVER d, token_no) AS previous_start, coalesce(lead(token_no) OVER d, token_no) AS next_start, coalesce(lag(token_no, 10) OVER p, 0) AS replay_start
FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY passage_index, token_no), p AS (PARTITION BY doc_id, passage_index ORDER BY token_no)"""
)
def w8_step_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.step_words(plain_tokens(spark, sf_dir))


@query(
    f"""WITH {Q.PASSAGES}, q AS (SELECT doc_id, passage_index, start, length(body) AS n, f FROM passages, (SELECT unnest([0, 6, 11, 19]) AS f)),
l AS (SELECT doc_id, passage_index, start, n // 2 AS a, CAST(floor(n * 0.9) AS INTEGER) AS b, CAST(floor(n * f / 20) AS INTEGER) AS local FROM q),
k AS (SELECT *, CASE WHEN local < a THEN 0 WHEN local < b THEN 1 ELSE -1 END AS pos FROM l)
SELECT doc_id, passage_index, local, CAST(CASE WHEN pos = 0 AND local > 1 THEN start WHEN pos = 0 THEN NULL WHEN pos = 1 AND local > a + 1 THEN start + a WHEN pos = 1 THEN start END AS INTEGER) AS back,
  CAST(CASE WHEN pos = 0 THEN start + a WHEN pos = 1 THEN NULL ELSE start END AS INTEGER) AS forward FROM k"""
)
def w9_step_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = halved(passages(spark, sf_dir))
    at = p.select("doc_id", "passage_index", F.explode(F.array(*(F.floor(F.length("text") * F.lit(f) / 20).cast("int") for f in (0, 6, 11, 19)))).alias("local"))
    return R.step_sentences(p, at)


@query(
    """WITH v AS (SELECT c_custkey % 40 AS machine_id, 'v' || c_custkey AS voice_id, CASE c_custkey % 5 WHEN 0 THEN 'Microsoft Natural ' WHEN 1 THEN 'Google ' WHEN 2 THEN 'Compact ' WHEN 3 THEN 'Premium ' ELSE 'Voice ' END || c_custkey AS name,
  CASE c_custkey % 3 WHEN 0 THEN 'en-US' WHEN 1 THEN 'de' ELSE 'enm' END AS lang, c_custkey % 2 = 0 AS local, c_custkey % 7 = 0 AS is_default FROM customer),
s AS (SELECT *, CASE WHEN NOT local THEN 40 ELSE 0 END + CASE WHEN regexp_matches(lower(name), 'natural|neural|premium|enhanced|siri|wavenet|studio') THEN 60 ELSE 0 END + CASE WHEN contains(lower(name), 'google') THEN 25 ELSE 0 END
  + CASE WHEN contains(lower(name), 'microsoft') THEN 15 ELSE 0 END - CASE WHEN contains(lower(name), 'compact') THEN 40 ELSE 0 END + CASE WHEN is_default THEN 5 ELSE 0 END AS score FROM v)
SELECT machine_id, voice_id, CAST(row_number() OVER (PARTITION BY machine_id ORDER BY lang = 'en-US' DESC, score DESC, name, voice_id) AS INTEGER) AS rank, CASE WHEN score >= 60 THEN 'premium' WHEN local THEN 'offline' ELSE 'network' END AS quality FROM s"""
)
def w10_rank_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 5 == 0, "Microsoft Natural ").when(k % 5 == 1, "Google ").when(k % 5 == 2, "Compact ").when(k % 5 == 3, "Premium ").otherwise("Voice "), k.cast("string"))
    lang = F.when(k % 3 == 0, "en-US").when(k % 3 == 1, "de").otherwise("enm")
    v = c.select((k % 40).alias("machine_id"), F.concat(F.lit("v"), k.cast("string")).alias("voice_id"), name.alias("name"), lang.alias("lang"), (k % 2 == 0).alias("local"), (k % 7 == 0).alias("is_default"))
    return R.rank_voices(v).select("machine_id", "voice_id", "rank", "quality")


@query(
    """WITH g AS (SELECT user_id AS session, event_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000 AS gap FROM events),
s AS (SELECT *, CASE WHEN gap IS NULL THEN 0 WHEN gap > 250 THEN 16 ELSE gap END AS step FROM g)
SELECT session, event_id, round(sum(CAST(step AS DOUBLE)) OVER (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS elapsed_ms FROM s"""
)
def w11_rebase_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.events(spark, sf_dir).select("session", "event_id", "ts")
    return R.rebase_stalls(e).select("session", "event_id", F.round("elapsed_ms", 4).alias("elapsed_ms"))


# 2.8 search, sets, scalar and array functions
@query(
    f"""WITH {Q.PASSAGES}, hits AS (SELECT q AS query, doc_id, passage_index, body, instr(lower(body), q) - 1 AS pos FROM passages, (SELECT unnest(['the', 'ing', 'ment']) AS q) WHERE contains(lower(body), q))
SELECT query, doc_id, passage_index, substring(body, greatest(0, pos - 42) + 1, pos + 90 - greatest(0, pos - 42)) AS snippet FROM hits QUALIFY row_number() OVER (PARTITION BY query, doc_id ORDER BY passage_index) <= 60"""
)
def k1_search_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.search_passages(passages(spark, sf_dir), ["the", "ING", " ment ", "ab"])


@query(
    f"""WITH {Q.PASSAGES}, asked AS (SELECT DISTINCT lower({Q.trim("substring(text, 3, 7)")}) AS query FROM benchmark),
hits AS (SELECT query, doc_id, passage_index, body, instr(lower(body), query) - 1 AS pos FROM passages JOIN asked ON length(query) >= 3 AND contains(lower(body), query))
SELECT query, doc_id, passage_index, substring(body, greatest(0, pos - 42) + 1, pos + 90 - greatest(0, pos - 42)) AS snippet FROM hits QUALIFY row_number() OVER (PARTITION BY query, doc_id ORDER BY passage_index) <= 60"""
)
def k1_search_query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each benchmark item begins with, looked up in all passages."""
    asked = I.table(spark, sf_dir, "benchmark").select(F.substring("text", 3, 7).alias("query"))
    return L.search_passages(passages(spark, sf_dir), asked)


@query(f"""WITH {Q.PASSAGES} SELECT DISTINCT doc_id, section_id, section_title AS title FROM passages WHERE contains(lower(section_title), 'ion 2')""")
def k2_filter_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.filter_outline(L.section_outline(passages(spark, sf_dir)), " ION 2").select("doc_id", "section_id", "title")


PLACES = "places AS (SELECT user_id AS reader_id, 'k' || (event_id % 60) AS place_key, CAST(event_id % 13 AS INTEGER) AS passage_index, ts AS moment FROM events)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("reader_id"), F.concat(F.lit("k"), (F.col("event_id") % 60).cast("string")).alias("place_key"), (F.col("event_id") % 13).cast("int").alias("passage_index"), F.col("ts").alias("at"))


@query(
    f"""WITH {PLACES}, l AS (SELECT * FROM places QUALIFY row_number() OVER (PARTITION BY reader_id, place_key ORDER BY moment DESC, passage_index DESC) = 1)
SELECT reader_id, place_key, passage_index, CAST(row_number() OVER (PARTITION BY reader_id ORDER BY moment DESC, place_key) AS INTEGER) AS recency FROM l QUALIFY row_number() OVER (PARTITION BY reader_id ORDER BY moment DESC, place_key) <= 20"""
)
def k3_recent_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recent_places(places(spark, sf_dir)).select("reader_id", "place_key", "passage_index", "recency")


@query("SELECT doc_id, 0 AS part_no, 'document' AS title, text FROM documents UNION ALL SELECT page_id, 1, url, html FROM pages UNION ALL SELECT conv_id, CAST(turn AS INTEGER), role, text FROM conversations")
def k4_union_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = I.documents(spark, sf_dir).select("doc_id", F.lit(0).alias("part_no"), F.lit("document").alias("title"), "text")
    b = I.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("part_no"), F.col("url").alias("title"), F.col("html").alias("text"))
    c = I.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part_no"), F.col("role").alias("title"), "text")
    return S.union_routes(a, b, c)


@query(f"SELECT doc_id, {Q.words('text')} AS words FROM documents")
def f1_count_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.documents(spark, sf_dir).select("doc_id", T.count_words(F.col("text")).cast("long").alias("words"))


@query(f"SELECT doc_id, round({Q.seconds(Q.words('text'))} / 1.5, 6) AS seconds, CAST({Q.pause('text')} AS DOUBLE) AS pause, round(330 / 165.0::DOUBLE, 9) AS rate FROM documents")
def f2_estimate_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return I.documents(spark, sf_dir).select("doc_id", F.round(T.estimate_seconds(T.count_words(c), 1.5), 6).alias("seconds"), T.pause_after(c).alias("pause"), T.wpm_to_rate(F.lit(330)).alias("rate"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN round((event_id % 90) * 3600 + (event_id % 60) * 60 + (event_id % 50) + 0.25, 6) WHEN 1 THEN (event_id % 60) * 60 + 7.0 WHEN 2 THEN (event_id % 50) * 1.0 ELSE CAST('nan' AS DOUBLE) END AS seconds FROM events")
def f3_parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("event_id") % 4
    stamp = F.when(k == 0, F.concat_ws(":", (e % 90).cast("string"), (e % 60).cast("string"), F.concat((e % 50).cast("string"), F.lit(",25")))).when(k == 1, F.concat((e % 60).cast("string"), F.lit(":07"))).when(k == 2, F.concat(F.lit(":"), (e % 50).cast("string"))).otherwise("1:xx")
    return I.table(spark, sf_dir, "events").select("event_id", F.round(T.parse_timestamp(stamp), 6).alias("seconds"))


@query(
    f"""SELECT event_id, {Q.timecode("value * 997.3", ",")} AS srt, {Q.timecode("value * 997.3", ".")} AS vtt, {Q.clock("value * 997.3")} AS clock, CASE WHEN event_id % 5 = 0 THEN '0:00' ELSE {Q.clock("value")} END AS stamp,
CASE WHEN CAST(event_id * 997 AS BIGINT) < 1024 THEN (event_id * 997) || ' B' WHEN event_id * 997 < 1048576 THEN CAST(CAST(floor(event_id * 997 / 1024 + 0.5) AS BIGINT) AS VARCHAR) || ' KB' ELSE printf('%.1f MB', floor(event_id * 997 / 1048576 * 10 + 0.5) / 10) END AS size FROM events"""
)
def f4_timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("value") * 997.3
    stamp = T.format_stamp(F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return I.table(spark, sf_dir, "events").select("event_id", T.timecode(t, ",").alias("srt"), T.timecode(t, ".").alias("vtt"), T.format_clock(t).alias("clock"), stamp.alias("stamp"), T.format_bytes(F.col("event_id") * 997).alias("size"))


@query(f"""WITH {Q.LINES} SELECT doc_id, line_no, {Q.wrap("line")} AS wrapped FROM lines""")
def f5_wrap_for_subtitle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.lines(I.documents(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.wrap_for_subtitle(F.col("line")).alias("wrapped"))


@query()
def f6_split_for_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.cues(I.documents(spark, sf_dir)).withColumnsRenamed({"track_id": "doc_id", "cue_no": "cue_index"})
    return K.split_for_subtitles(c).withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@query(
    r"""SELECT page_id, coalesce(nullif(left(trim(regexp_replace(regexp_replace(regexp_replace(url, '\.[^.]+$', ''), '[\\/:*?"<>|]+', '-', 'g'), '\s+', ' ', 'g')), 120), ''), 'narration') || '.mp3' AS name FROM pages"""
)
def f7_safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "pages").select("page_id", T.safe_filename(F.col("url"), "mp3").alias("name"))


@query(
    f"""WITH {WORD_TOKENS} SELECT doc_id, passage_index, token_no, body AS text, display, start, stop AS "end", {Q.pivot("display")} AS pivot,
  ends_sentence, ends_clause, ends_paragraph, numeric_word AS numeric, continued FROM word_tokens"""
)
def f8_tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tokenize_words(passages(spark, sf_dir))


@query(
    f"""WITH {TOKENS}, c AS (SELECT doc_id, passage_index, token_no, display, length(regexp_extract(display, '^[^\\p{{L}}\\p{{N}}]*')) AS lead FROM tokens), e AS (SELECT *, CASE WHEN lead = length(display) THEN 0 ELSE lead END AS l FROM c),
f AS (SELECT *, length(regexp_extract(substring(display, l + 1), '^[\\p{{L}}\\p{{N}}]*')) AS core FROM e)
SELECT doc_id, passage_index, token_no, CAST(least(length(display) - 1, l + CASE WHEN core <= 1 THEN 0 WHEN core <= 5 THEN 1 WHEN core <= 9 THEN 2 WHEN core <= 13 THEN 3 ELSE 4 END) AS INTEGER) AS pivot FROM f"""
)
def f9_pivot_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_tokens(spark, sf_dir).select("doc_id", "passage_index", "token_no", T.pivot_for(F.col("display")).alias("pivot"))


@query(f"""WITH {TOKENS} SELECT doc_id, passage_index, token_no, round(weight, 9) AS weight FROM weighed""")
def f10_dwell_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_tokens(spark, sf_dir).select("doc_id", "passage_index", "token_no", F.round(R.token_weight(), 9).alias("weight"))


@query(
    f"""WITH {Q.PASSAGES}, q AS (SELECT doc_id, passage_index, f, body, length(body) AS n, CAST(greatest(0, least(CAST(floor(f * length(body)) AS INTEGER), length(body) - 1)) AS INTEGER) AS i FROM passages, (SELECT unnest([0.0, 0.31, 0.77, 1.0]::DOUBLE[]) AS f)),
s AS (SELECT *, length(regexp_extract(substring(body, i + 1), '^[{Q.SPACE}]*')) AS skip, length(regexp_replace(body, '[{Q.SPACE}]+$', '')) AS inked FROM q),
a AS (SELECT *, CASE WHEN i + skip >= n THEN greatest(0, inked - 1) ELSE i + skip END AS pos FROM s),
b AS (SELECT *, pos - length(regexp_extract(substring(body, 1, pos), '[^{Q.SPACE}]*$')) AS start FROM a)
SELECT doc_id, passage_index, f, CAST(start AS INTEGER) AS char_index, CAST(greatest(1, length(regexp_extract(substring(body, start + 1), '^[^{Q.SPACE}]*'))) AS INTEGER) AS char_length FROM b"""
)
def f11_snap_to_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir).withColumn("f", F.explode(F.array(*map(F.lit, (0.0, 0.31, 0.77, 1.0)))))
    return p.select("doc_id", "passage_index", "f", T.snap_to_word(F.col("text"), F.col("f")).alias("s")).select("doc_id", "passage_index", "f", "s.*")


@query(
    f"""WITH {Q.PASSAGES}, a AS (SELECT doc_id, passage_index, body, CAST(least(length(body) - 1, floor(3.0::DOUBLE * (165 * 1.25::DOUBLE * 5.6::DOUBLE) / 60)) AS INTEGER) AS pos FROM passages)
SELECT doc_id, passage_index, pos AS char_index, CAST(length(regexp_extract(substring(body, pos + 1), '^[^{Q.SPACE}]*')) AS INTEGER) AS char_length FROM a"""
)
def f12_estimate_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("doc_id", "passage_index", T.estimate_cursor(F.col("text"), F.lit(3.0), 1.25).alias("c")).select("doc_id", "passage_index", "c.*")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").alias("samples"), F.lit(1000).alias("sample_rate"))


def _samples(clips: DataFrame) -> DataFrame:
    return clips.select("clip_id", F.posexplode("samples").alias("i", "x")).select("clip_id", "i", (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x"))


def _block_samples(blocks: DataFrame) -> DataFrame:
    rows = blocks.select("clip_id", "start", F.posexplode("samples").alias("k", "x"))
    return rows.select("clip_id", (F.col("start") + F.col("k")).cast("int").alias("i"), (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x"))


SAMPLES = "s AS (SELECT vec_id AS clip_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x, len(embedding) AS n FROM embeddings)"


@query(
    f"""WITH {SAMPLES}, l AS (SELECT clip_id, min(i) FILTER (WHERE loud) AS a, max(i) FILTER (WHERE loud) AS z FROM (SELECT *, abs(CAST(x AS FLOAT)) >= 0.1::FLOAT AS loud FROM s) GROUP BY 1),
k AS (SELECT s.clip_id, s.i, s.x FROM s JOIN l USING (clip_id) WHERE a IS NULL OR a >= z OR i >= a - 1 AND i < z + 1)
SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY i) - 1 AS INTEGER) AS i, round(x, 5) + 0.0 AS x FROM k"""
)
def f13_trim_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(A.trim_silence(clips(spark, sf_dir), threshold_db=-20.0, keep_ms=1.0))


@query(
    f"""WITH {SAMPLES}, l AS (SELECT clip_id, min(i) FILTER (WHERE loud) AS a, max(i) FILTER (WHERE loud) AS z FROM (SELECT *, abs(CAST(x AS FLOAT)) >= 0.1::FLOAT AS loud FROM s) GROUP BY 1),
k AS (SELECT s.clip_id, s.i, s.x FROM s JOIN l USING (clip_id) WHERE a IS NULL OR a >= z OR i >= a - 1 AND i < z + 1)
SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY i) - 1 AS INTEGER) AS i, round(x, 5) + 0.0 AS x FROM k"""
)
def f13_trim_silence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_samples(A.trim_silence_blocks(A.split_clips(clips(spark, sf_dir), 10), threshold_db=-20.0, keep_ms=1.0))


@query(
    f"""WITH {SAMPLES}, p AS (SELECT clip_id, least(pow(10, -1.5 / 20) / max(abs(x)), 4) AS gain FROM s GROUP BY 1)
SELECT s.clip_id, i, round(CAST(CAST(x * CASE WHEN abs(gain - 1) < 0.01 THEN 1 ELSE gain END AS FLOAT) AS DOUBLE), 5) AS x FROM s JOIN p USING (clip_id)"""
)
def f14_normalize_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(A.normalize_peak(clips(spark, sf_dir)))


@query(
    f"""WITH {SAMPLES}, p AS (SELECT clip_id, least(pow(10, -1.5 / 20) / max(abs(x)), 4) AS gain FROM s GROUP BY 1)
SELECT s.clip_id, i, round(CAST(CAST(x * CASE WHEN abs(gain - 1) < 0.01 THEN 1 ELSE gain END AS FLOAT) AS DOUBLE), 5) AS x FROM s JOIN p USING (clip_id)"""
)
def f14_normalize_peak_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_samples(A.normalize_peak_blocks(A.split_clips(clips(spark, sf_dir), 10)))


@query(
    f"""WITH {SAMPLES}, e AS (SELECT *, least(i, n - 1 - i) AS edge, least(5, n // 2) AS f FROM s)
SELECT clip_id, i, round(CAST(CAST(x * CASE WHEN f > 1 AND edge < f THEN 0.5 - 0.5 * cos(pi() * edge / f) ELSE 1 END AS FLOAT) AS DOUBLE), 5) + 0.0 AS x FROM e"""
)
def f15_edge_fades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(A.edge_fades(clips(spark, sf_dir)))


@query(
    f"""WITH {SAMPLES}, e AS (SELECT *, least(i, n - 1 - i) AS edge, least(5, n // 2) AS f FROM s)
SELECT clip_id, i, round(CAST(CAST(x * CASE WHEN f > 1 AND edge < f THEN 0.5 - 0.5 * cos(pi() * edge / f) ELSE 1 END AS FLOAT) AS DOUBLE), 5) + 0.0 AS x FROM e"""
)
def f15_edge_fades_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_samples(A.edge_fades_blocks(A.split_clips(clips(spark, sf_dir), 3)))


@query(f"""WITH {SAMPLES} SELECT clip_id, i, CAST(CASE WHEN x * 3 < -1 THEN -32768 WHEN x * 3 > 1 THEN 32767 ELSE floor(x * 3 * 32767 + 0.5) END AS DOUBLE) AS x FROM s""")
def f16_to_pcm16(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = clips(spark, sf_dir).withColumn("samples", F.transform("samples", lambda x: x.cast("double") * 3))
    return _samples(A.to_pcm16(loud))


# 2.9 live jobs: those with state or a sink run as streams, the others as their batch twins
@query(f"""WITH RECURSIVE {CLEAN}, {BALANCED} SELECT doc_id, passage_index, start, stop AS "end", CAST(words AS INTEGER) AS words FROM packed""")
def r1_stream_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = I.streamed(I.documents(spark, sf_dir), "r1", "doc_id % 2 = 0", V.stream_passages)
    return made.select("doc_id", "passage_index", "start", "end", "words")


BOUNDARY = f"{Q.PASSAGES}, {Q.EVENTS}, b AS (SELECT *, epoch % 3 AS pi, 40 AS char_index FROM ev)"


def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.events(spark, sf_dir)
    return e.select("session", "event_id", F.col("session").alias("doc_id"), (F.col("epoch") % 3).alias("passage_index"), F.lit(40).alias("char_index"), "elapsed", "rate", "resumed", F.col("ts").cast("timestamp").alias("ts"))


# Events arrive in two runs: those of the first six tenths of the time, but for one in 25 of its first fifth, which come with
# the second run and are late by then.
ARRIVALS = """reach AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events),
arrivals AS (SELECT e.*, epoch_us(ts) AS us, epoch_us(ts) < low + (high - low) * 6 // 10 AND NOT (event_id % 25 = 3 AND epoch_us(ts) < low + (high - low) * 2 // 10) AS first_run FROM {EV} e, reach)"""


def first_run(events: DataFrame) -> str:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.coalesce(F.min(us), F.lit(0)), F.coalesce(F.max(us), F.lit(0))).head()
    at = "unix_micros(CAST(ts AS timestamp))"
    return f"{at} < {low + (high - low) * 6 // 10} AND NOT (event_id % 25 = 3 AND {at} < {low + (high - low) * 2 // 10})"


@query(
    f"""WITH {BOUNDARY} SELECT b.event_id, CAST(t.start + least(40, length(t.body)) AS INTEGER) AS cursor, round(t.cue_end - t.est_seconds + b.elapsed, 6) AS position FROM b JOIN timed t ON t.doc_id = b.session AND t.passage_index = b.pi"""
)
def r2_stream_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.written(L.prefix(passages(spark, sf_dir)), "passages")
    given = boundary(spark, sf_dir)
    live = I.streamed(given, "r2", first_run(given), lambda stream: V.stream_cursor(stream, p))
    return live.select("event_id", "cursor", F.round("position", 6).alias("position"))


@query(
    f"""WITH {BOUNDARY}, {ARRIVALS.replace("{EV}", "b")}, mark AS (SELECT max(us) // 1000 * 1000 - 600000000 AS mark FROM arrivals WHERE first_run AND NOT resumed),
l AS (SELECT session, pi, elapsed FROM arrivals, mark WHERE NOT resumed AND (first_run OR (us // 86400000000 + 1) * 86400000000 > mark) QUALIFY row_number() OVER (PARTITION BY session, pi ORDER BY us DESC, elapsed DESC) = 1)
SELECT l.session, l.session AS doc_id, l.pi AS passage_index, l.elapsed AS seconds FROM l JOIN passages p ON p.doc_id = l.session AND p.passage_index = l.pi WHERE elapsed > 0.05 AND elapsed <= est_seconds * 8 AND elapsed >= est_seconds / 8"""
)
def r3_stream_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.written(passages(spark, sf_dir).select("doc_id", "passage_index", "est_seconds"), "passages")
    given, path = boundary(spark, sf_dir), I.scratch(spark, "measured")
    I.streamed(given, "r3", first_run(given), V.live_elapsed, V.measurement_sink(spark, path, p, 8), "update")
    return V.measurements(spark, path)


@query(f"""WITH {PLACES} SELECT reader_id, place_key, passage_index FROM places QUALIFY row_number() OVER (PARTITION BY reader_id, place_key ORDER BY moment DESC, passage_index DESC) = 1""")
def r4_stream_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = places(spark, sf_dir)
    path = I.scratch(spark, "places")
    first = "reader_id % 2 = 0 OR passage_index < 6"
    I.streamed(given, "r4", first, lambda stream: stream, V.upsert(spark, path, ["reader_id", "place_key"], "at", 8))
    return V.upserted(spark, path, given.schema).drop("at")


@query(
    f"""WITH {ARRIVALS.replace("{EV}", "events")}, mark AS (SELECT max(us) FILTER (WHERE first_run) // 1000 * 1000 - 3600000000 AS mark, max(us) // 1000 * 1000 - 3600000000 AS last_mark FROM arrivals),
e AS (SELECT user_id AS session, us, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS before FROM arrivals, mark WHERE first_run OR us + 21600000000 > mark),
s AS (SELECT *, sum(CASE WHEN us - before <= 21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM e)
SELECT session, min(us) AS started, max(us) AS ended, count(*) AS events FROM s, mark GROUP BY session, n, last_mark HAVING max(us) + 21600000000 <= last_mark"""
)
def r5_reading_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that are closed when the stream has been read: an hour of watermark beyond the gap."""
    given = I.events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    made = I.streamed(given, "r5", first_run(given), lambda stream: V.reading_sessions(stream, "1 hour", "6 hours"))
    return made.select("session", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "events")


@query(
    f"""WITH {Q.EVENTS}, n AS (SELECT *, max(epoch) OVER (PARTITION BY session, event_id // 2000 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newest FROM ev)
SELECT session * 1000000 + event_id // 2000 AS session, event_id, epoch FROM n WHERE epoch >= newest"""
)
def r6_reject_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.events(spark, sf_dir).withColumn("session", F.col("session") * 1_000_000 + F.floor(F.col("event_id") / 2000))
    e = e.select("session", "event_id", "epoch", "ts")
    half = e.agg(F.expr("percentile_approx(unix_micros(CAST(ts AS timestamp)), 0.5)")).head()[0] or 0
    live = I.streamed(e, "r6", f"unix_micros(CAST(ts AS timestamp)) < {half}", lambda stream: V.reject_stale(stream, "30 days"))
    return live.select("session", "event_id", "epoch")


@query("""SELECT user_id || '|' || event_type AS key, min(event_id) AS event_id FROM (SELECT *, min(ts) OVER (PARTITION BY user_id, event_type) AS first FROM events) WHERE ts = first GROUP BY 1""")
def r7_dedupe_inflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.events(spark, sf_dir).select(F.concat_ws("|", F.col("session").cast("string"), "event_type").alias("key"), "ts", "event_id")
    return V.dedupe_inflight(e).select("key", "event_id")


@query("""SELECT DISTINCT user_id || '|' || event_type AS key FROM events""")
def r7_dedupe_inflight_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a stream whose watermark reaches over all of it: each key once, whichever request came first."""
    e = I.events(spark, sf_dir).select(F.concat_ws("|", F.col("session").cast("string"), "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return I.streamed(e, "r7", "event_id % 2 = 0", lambda stream: V.dedupe_inflight(stream, "36500 days")).select("key")


@query()
def r8_dedupe_live_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues as live cues, their first two turns first."""
    t = I.table(spark, sf_dir, "conversations")
    c = t.select(F.col("conv_id").alias("track_id"), F.col("turn").cast("int").alias("cue_no"), (F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + 1.8).alias("end"), F.coalesce("text", F.lit("")).alias("text"))
    began = 1_704_067_200  # tracks that go on at one time; event time 0 would be behind the first watermark
    return I.streamed(c.withColumn("ts", F.timestamp_seconds(F.col("start") + began)), "r8", "cue_no < 2", lambda stream: V.stream_dedupe_cues(stream, "1 day"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narration_time(spark, sf_dir)
