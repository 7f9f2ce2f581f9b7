"""Timelines over passages: as-of lookups, measured and estimated durations, outlines, search, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BASE_WPM, fnv1a, js_trim
from .documents import as_of
from .scans import neighbours, running_totals

PASSAGE = ["doc_id"]


INDEX = ["passage_index"]
HOUR = 3600.0  # seconds of a block when places are times


def prefix(passages: DataFrame, seconds: str = "est_seconds") -> DataFrame:
    """Passages with ``before``, the seconds ahead of each at rate 1."""
    summed = running_totals(passages, PASSAGE, INDEX, {"before": F.col(seconds)})
    return summed.withColumn("before", F.col("before") - F.col(seconds))


def passage_at_char(passages: DataFrame, offsets: DataFrame) -> DataFrame:
    """offsets (doc_id, offset) with passage_index and char: the last passage that starts at or before it, else the first."""
    rows = passages.select("doc_id", "passage_index", F.col("start").alias("p_start"), F.length("text").alias("p_length"))
    found = as_of(offsets, rows, PASSAGE, "offset", "p_start", ["passage_index", "p_start", "p_length"])
    first = rows.where("passage_index = 0").select("doc_id", F.col("p_start").alias("f_start"), F.col("p_length").alias("f_length"))
    found = found.join(first, "doc_id")
    start, length = F.coalesce("p_start", "f_start"), F.coalesce("p_length", "f_length")
    char = F.greatest(F.lit(0), F.least(F.col("offset") - start, length - 1)).cast("int")
    return found.select(*offsets.columns, F.coalesce("passage_index", F.lit(0)).alias("passage_index"), char.alias("char"))


def passage_at_time(passages: DataFrame, times: DataFrame, rate: float = 1.0, seconds: str = "est_seconds") -> DataFrame:
    """times (doc_id, seconds) with the last passage whose start on the clock is at or before it."""
    rows = prefix(passages, seconds).select("doc_id", "passage_index", "before")
    asked = times.withColumn("_target", F.col("seconds") * rate)
    found = as_of(asked, rows, PASSAGE, "_target", "before", ["passage_index"], HOUR)
    return found.select(*times.columns, F.coalesce("passage_index", F.lit(0)).alias("passage_index"))


def token_at_offset(tokens: DataFrame, offsets: DataFrame) -> DataFrame:
    """offsets (doc_id, offset) with token_no: the last token that starts at or before it; 0 before the first, -1 without any."""
    found = as_of(offsets, tokens.select("doc_id", "token_no", F.col("start").alias("t_start")), PASSAGE, "offset", "t_start", ["token_no"])
    some = tokens.select("doc_id").distinct().withColumn("_some", F.lit(True))
    found = found.join(some, "doc_id", "left")
    return found.select(*offsets.columns, F.when(F.col("_some"), F.coalesce("token_no", F.lit(0))).otherwise(-1).alias("token_no"))


def active_sentence(passages: DataFrame, positions: DataFrame) -> DataFrame:
    """positions (doc_id, passage_index, local) with the sentence span that holds it, else the whole passage's."""
    p = passages.select("doc_id", "passage_index", "sentences", F.length("text").alias("_n"))
    hit = F.get(F.filter("sentences", lambda s: (s["start"] <= F.col("local")) & (F.col("local") < s["end"])), F.lit(0))
    found = positions.join(p, ["doc_id", "passage_index"]).withColumn("hit", hit)
    return found.select(*positions.columns, F.coalesce("hit.start", F.lit(0)).alias("sentence_start"), F.coalesce("hit.end", "_n").alias("sentence_end"))


def apply_measurements(passages: DataFrame, measured: DataFrame) -> DataFrame:
    """Passages with ``seconds``: the measured ones where there are any, else the estimate."""
    m = measured.select("doc_id", "passage_index", F.col("seconds").alias("measured"))
    return passages.join(m, ["doc_id", "passage_index"], "left").withColumn("seconds", F.coalesce("measured", "est_seconds"))


def place_key(name: Column, size: Column, characters: Column) -> Column:
    return F.concat_ws("|", name, size.cast("string"), characters.cast("string"))


def recall_places(documents: DataFrame, places: DataFrame) -> DataFrame:
    """documents (reader_id, place_key, passages) with the saved passage where it lies within, else 0.

    Of places saved more than once the latest (by ``at``, where there is such a column) counts, of those the last passage.
    """
    order = F.struct("at", "passage_index") if "at" in places.columns else F.col("passage_index")
    saved = places.groupBy("reader_id", "place_key").agg(F.max_by("passage_index", order).alias("_saved"))
    ok = (F.col("_saved") > 0) & (F.col("_saved") < F.col("passages"))
    return documents.join(saved, ["reader_id", "place_key"], "left").withColumn("passage_index", F.when(ok, F.col("_saved")).otherwise(0)).drop("_saved")


def export_scope(passages: DataFrame, positions: DataFrame, scope: str) -> DataFrame:
    """Passages to export: "all", the "rest" from the current one, or those of its "section"."""
    if scope == "all":
        return passages
    at = positions.select("doc_id", F.col("passage_index").alias("_at"))
    if scope == "rest":
        return passages.join(at, "doc_id").where("passage_index >= _at").drop("_at")
    current = passages.join(at, "doc_id").where("passage_index = _at").select("doc_id", "section_id")
    return passages.join(current, ["doc_id", "section_id"], "left_semi")


def document_stats(docs: DataFrame, passages: DataFrame, words: Column) -> DataFrame:
    """(doc_id, words, characters, passages, est_seconds); without passages the seconds follow from the words."""
    sums = passages.groupBy("doc_id").agg(F.count("*").alias("passages"), F.sum("est_seconds").alias("s"))
    counted = docs.select("doc_id", words.alias("words"), F.length("text").alias("characters")).join(sums, "doc_id", "left")
    seconds = F.coalesce(F.nullif("s", F.lit(0.0)), F.col("words") / BASE_WPM * 60)
    return counted.select("doc_id", "words", "characters", F.coalesce("passages", F.lit(0)).alias("passages"), seconds.alias("est_seconds"))


def section_outline(passages: DataFrame) -> DataFrame:
    return passages.groupBy("doc_id", "section_id").agg(
        F.min_by("section_title", "passage_index").alias("title"), F.min("passage_index").alias("first"), F.max("passage_index").alias("last"),
        F.sum("est_seconds").alias("seconds"), F.sum("words").alias("words"),
    )


def export_estimate(passages: DataFrame, rate: float = 1.0, kbps: int = 128) -> DataFrame:
    sums = passages.groupBy("doc_id").agg((F.sum("est_seconds") / rate).alias("seconds"), F.sum(F.length("text")).alias("characters"), F.count("*").alias("requests"))
    return sums.withColumn("bytes", F.lit(float(kbps * 1000)) * F.col("seconds") / 8)


def timeline_confidence(measured: DataFrame) -> DataFrame:
    """Share of passages with a measurement, by document, from the result of ``apply_measurements``."""
    return measured.groupBy("doc_id").agg(F.avg(F.col("measured").isNotNull().cast("double")).alias("confidence"))


def distinct_synthesis_requests(passages: DataFrame, provider: str, voice: str, speed: float) -> DataFrame:
    """One row for each text to speak, with how often it recurs and its cache key; counts combine before the shuffle."""
    clamped = min(3.0, max(0.5, speed))
    counted = passages.groupBy(F.xxhash64("text").alias("hash"), "text").agg(F.count("*").alias("uses")).drop("hash")
    key = fnv1a(F.col("text"))
    return counted.select(F.lit(provider).alias("provider"), F.lit(voice).alias("voice"), F.lit(clamped).alias("speed"), "text", "uses", key.alias("fnv"))


def estimated_cues(passages: DataFrame) -> DataFrame:
    summed = running_totals(passages, PASSAGE, INDEX, {"cue_end": F.col("est_seconds")})
    return summed.withColumn("cue_start", F.col("cue_end") - F.col("est_seconds"))


def rendered_cues(passages: DataFrame, gap: float = 0.32, section_gap: float = 0.9) -> DataFrame:
    """Cues on the rendered timeline: ``seconds`` of each passage, then a gap, longer where the section changes, none at the end."""
    beside = neighbours(passages, PASSAGE, INDEX, after={"_after": "section_id"})
    pause = F.when(F.col("_after").isNull(), 0.0).when(F.col("_after") != F.col("section_id"), section_gap).otherwise(gap)
    spaced = beside.withColumn("gap", pause).drop("_after")
    spaced = running_totals(spaced, PASSAGE, INDEX, {"cue_start": F.col("seconds") + F.col("gap")})
    spaced = spaced.withColumn("cue_start", F.col("cue_start") - F.col("seconds") - F.col("gap"))
    return spaced.withColumn("cue_end", F.col("cue_start") + F.col("seconds"))


LIVE_GAPS = {"gap": 0.18, "section_gap": 0.63}


def position_clock(passages: DataFrame, positions: DataFrame, rate: float = 1.0) -> DataFrame:
    """positions (doc_id, passage_index, char) with the seconds on the clock and the document's total."""
    totals = passages.groupBy("doc_id").agg(F.sum("est_seconds").alias("total"))
    p = prefix(passages).select("doc_id", "passage_index", "before", "est_seconds", F.length("text").alias("_n"))
    within = F.when((F.col("char") <= 0) | (F.col("_n") == 0), 0.0).otherwise(F.col("est_seconds") / rate * F.least(F.lit(1.0), F.col("char") / F.col("_n")))
    found = positions.join(p, ["doc_id", "passage_index"]).join(totals, "doc_id")
    return found.select(*positions.columns, (F.col("before") / rate + within).alias("position"), (F.col("total") / rate).alias("total"))


def section_progress(outline: DataFrame, positions: DataFrame) -> DataFrame:
    """How much of each section lies behind a position: its share within, 1 if passed, 0 if ahead."""
    at = positions.select("doc_id", F.col("passage_index").alias("_at"))
    share = (F.col("_at") - F.col("first") + 1) / (F.col("last") - F.col("first") + 1)
    done = F.when(F.col("_at") > F.col("last"), 1.0).when(F.col("_at") < F.col("first"), 0.0).otherwise(share)
    return outline.join(at, "doc_id").select("doc_id", "section_id", done.alias("progress"))


def _snippets(hits: DataFrame, most: int) -> DataFrame:
    """(query, doc_id, passage_index, snippet) of hits (query, doc_id, passage_index, text, at), the first ``most`` of a document."""
    start = F.greatest(F.lit(0), F.col("at") - 1 - 42)
    snippet = F.substr("text", start + 1, F.col("at") - 1 + 90 - start)
    w = Window.partitionBy("query", "doc_id").orderBy("passage_index")
    rows = hits.select("query", "doc_id", "passage_index", snippet.alias("snippet"))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def search_passages(passages: DataFrame, queries: list[str] | DataFrame, most: int = 60) -> DataFrame:
    """(query, doc_id, passage_index, snippet): for each query of three letters or more, a document's first ``most`` hits.

    A few queries may be a list: then each is an expression over one scan. Any number may be a table with a column ``query``.
    """
    if isinstance(queries, DataFrame):
        return _search_by_grams(passages, queries, most)
    wanted = [q.strip().lower() for q in queries if len(q.strip()) >= 3]
    lower = F.lower("text")
    hits = F.filter(F.array(*(F.struct(F.lit(q).alias("query"), F.instr(lower, q).alias("at")) for q in wanted)) if wanted else F.array().cast("array<struct<query:string,at:int>>"), lambda h: h["at"] > 0)
    found = passages.select("doc_id", "passage_index", "text", F.explode(hits).alias("h"))
    return _snippets(found.select("h.query", "doc_id", "passage_index", "text", "h.at"), most)


GRAM, SLOTS = 3, 1 << 16


def grams(c: Column) -> Column:
    """The distinct runs of GRAM characters in a text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _search_by_grams(passages: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """The search of a table of queries: passages listed by gram, each query met at the rarest of its grams, then verified.

    Grams that no query has go at once, by a table of hash slots that is sent to all tasks and never has more than SLOTS
    rows. A query with a gram that no passage has has no hits. What is joined are numbers of passages; the texts of
    those that may hold a query move once.
    """
    wanted = queries.select(F.lower(js_trim(F.col("query"))).alias("query")).where(F.length("query") >= GRAM).distinct()
    parts = wanted.select("query", F.explode(grams(F.col("query"))).alias("gram"))
    slot = F.pmod(F.xxhash64("gram"), F.lit(SLOTS)).cast("int")
    slots = F.broadcast(parts.select(slot.alias("slot")).distinct())
    listed = passages.select("doc_id", "passage_index", F.explode(grams(F.lower("text"))).alias("gram")).withColumn("slot", slot)
    listed = listed.join(slots, "slot", "left_semi").drop("slot")
    counted = listed.groupBy("gram").agg(F.count("*").alias("passages"))
    met = parts.join(counted, "gram", "left").groupBy("query").agg(
        F.min(F.struct("passages", "gram")).alias("rarest"), F.count_if(F.col("passages").isNull()).alias("unknown")
    )
    met = met.where("unknown = 0").select("query", F.col("rarest.gram").alias("gram"))
    near = listed.join(met, "gram").select("doc_id", "passage_index", "query")
    held = passages.select("doc_id", "passage_index", "text").join(near, ["doc_id", "passage_index"])
    hits = held.withColumn("at", F.instr(F.lower("text"), F.col("query"))).where("at > 0")
    return _snippets(hits, most)


def filter_outline(outline: DataFrame, query: str) -> DataFrame:
    return outline.where(F.contains(F.lower("title"), F.lit(query.strip().lower())))


def recent_places(places: DataFrame, most: int = 20) -> DataFrame:
    """Each reader's latest place in every document, the ``most`` most recent."""
    latest = places.groupBy("reader_id", "place_key").agg(F.max(F.struct("at", "passage_index")).alias("l")).select("reader_id", "place_key", "l.at", "l.passage_index")
    w = Window.partitionBy("reader_id").orderBy(F.desc("at"), "place_key")
    return latest.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= most)


def scan_warnings(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, thin, warning): documents of which over 40 % of pages hold fewer than 8 characters."""
    thin = F.count_if(F.length(js_trim(F.coalesce("text", F.lit("")))) < 8)
    counted = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), thin.alias("thin"))
    return counted.withColumn("warning", F.col("thin") > F.col("pages") * 0.4)


def caption_warnings(files: DataFrame, cues: DataFrame, parts: DataFrame) -> DataFrame:
    """(track_id, warning) of caption files without cues, or with cues but no text."""
    n = cues.groupBy("track_id").agg(F.count("*").alias("cues"))
    m = parts.groupBy("track_id").agg(F.count("*").alias("parts"))
    rows = files.select("track_id").join(n, "track_id", "left").join(m, "track_id", "left")
    said = F.when(F.col("cues").isNull(), "No caption lines were found in that file.").when(F.col("parts").isNull(), "That caption track had timings but no text.")
    return rows.select("track_id", said.alias("warning"))
