"""Subtitles and transcripts: one text a document, from cues and passages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import format_clock, timecode, wrap_for_subtitle
from ..operators.documents import BLANKS, PY_WS
from .containers import write_documents


SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*")


def folded(line: str, most: int) -> list[str]:
    """A line in lines of at most ``most`` characters, cut at the last blank that fits, or else at full length."""
    lines = [line.strip(BLANKS)]
    while len(lines[-1]) > most:
        rest = lines.pop()
        cut = rest.rfind(" ", 1, most + 1)
        cut = most if cut < 0 else cut
        lines += [rest[:cut].strip(BLANKS), rest[cut:].strip(BLANKS)]
    return lines


def subtitle_pieces(text: str, most: int = 84) -> list[str]:
    """A cue's text in pieces of at most ``most`` characters, by sentence, then by word."""
    flat = re.sub(rf"[{PY_WS}]+", " ", text).strip(" ")
    if len(flat) <= most:
        return [flat]
    pieces = [""]
    for sentence in SENTENCE.findall(flat) or [flat]:
        if pieces[-1] and len(pieces[-1]) + len(sentence) > most:
            pieces.append("")
        pieces[-1] += sentence
        if len(sentence) > most:
            pieces[-1:] = folded(pieces[-1], most)  # what follows joins its last line
    return [p for p in (p.strip(BLANKS) for p in pieces) if p]


def split_for_subtitles(cues: DataFrame, most: int = 84) -> DataFrame:
    """Cues (doc_id, cue_index, start, end, text) in short ones, each with its share of the time; short cues keep their text."""

    @pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: p if len(p := subtitle_pieces(t, most)) > 1 else [t])

    rows = cues.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("pieces", cut("text"))
    total = F.aggregate("pieces", F.lit(0), lambda a, p: a + F.length(p))
    rows = rows.withColumn("span", F.greatest(F.lit(0.001), F.col("end") - F.col("start"))).withColumn("total", F.greatest(F.lit(1), total))
    rows = rows.select("doc_id", "cue_index", "start", "end", "span", "total", F.size("pieces").alias("n"), F.posexplode("pieces").alias("piece_no", "piece"))
    w = Window.partitionBy("doc_id", "cue_index").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = F.sum(F.length("piece") / F.col("total") * F.col("span")).over(w)
    rows = rows.withColumn("_end", F.col("start") + done).withColumn("_start", F.col("_end") - F.length("piece") / F.col("total") * F.col("span"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("cue_index", "piece_no")) - 1
    whole = F.col("n") == 1
    return rows.select("doc_id", index.alias("cue_index"), F.when(whole, F.col("start")).otherwise(F.col("_start")).alias("start"), F.when(whole, F.col("end")).otherwise(F.col("_end")).alias("end"), F.col("piece").alias("text"))


def subtitle_documents(cues: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, content): SubRip or WebVTT of short cues (doc_id, cue_index, start, end, text)."""
    sep = "," if fmt == "srt" else "."
    block = F.concat((F.col("cue_index") + 1).cast("string"), F.lit("\n"), timecode(F.col("start"), sep), F.lit(" --> "), timecode(F.col("end"), sep), F.lit("\n"), wrap_for_subtitle(F.col("text")), F.lit("\n"))
    blocks = F.sort_array(F.collect_list(F.struct("cue_index", block.alias("b"))))
    body = F.array_join(F.transform(blocks, lambda x: x["b"]), "\n")
    return cues.groupBy("doc_id").agg((body if fmt == "srt" else F.concat(F.lit("WEBVTT\n\n"), body)).alias("content"))


def write_subtitles(cues: DataFrame, titles: DataFrame, fmt: str, path: str, mode: str = "append") -> None:
    """The subtitle text of every document, under its title (doc_id, title), in containers below ``path``."""
    made = subtitle_documents(cues, fmt).join(titles.select("doc_id", "title"), "doc_id", "left")
    write_documents(made, path, fmt, mode)


def _grouped_number(n: Column) -> Column:
    return F.format_number(n, 0)


def _or_empty(made: Column) -> Column:
    """A piece of text that is left out where a value in it is null."""
    return F.coalesce(made, F.lit(""))


def transcript_documents(
    docs: DataFrame, passages: DataFrame, fmt: str, sections: bool | DataFrame = True, timestamps: bool = True, estimated: bool = True, generated: str = "", totals: DataFrame | None = None
) -> DataFrame:
    """(doc_id, content) of docs (doc_id, title, author, words) and passages with cue_start, cue_end and section_title.

    ``fmt`` is txt, md or json. A section's title stands before its first passage. ``docs`` may have name, kind, pages and
    characters, which Markdown (name) and JSON tell; JSON lists ``sections`` (doc_id, section_index, title) where that is a
    table. ``generated`` says when, if it is to be said. ``totals`` (doc_id, passages, duration) stand for what ``passages``
    hold where those are but the beginning of a document, as in a preview.
    """
    w = Window.partitionBy("doc_id").orderBy("passage_index")
    p = passages.withColumn("opens", ~F.lag("section_title").over(w).eqNullSafe(F.col("section_title")))
    clock = format_clock(F.col("cue_start"))
    marked = F.col("opens") & F.lit(sections is not False)
    if fmt == "txt":
        mark = F.when(marked, F.concat(F.lit("\n--- "), "section_title", F.lit(" ---\n\n"))).otherwise("")
        stamp = F.concat(F.lit("["), clock, F.lit("] ")) if timestamps else F.lit("")
        block = F.concat(_or_empty(mark), stamp, "text", F.lit("\n\n"))
    elif fmt == "md":
        mark = F.when(marked, F.concat(F.lit("## "), "section_title", F.lit("\n\n"))).otherwise("")
        stamp = F.concat(F.lit("<sub>`"), clock, F.lit("`</sub>\n\n")) if timestamps else F.lit("")
        block = F.concat(_or_empty(mark), stamp, "text", F.lit("\n\n"))
    else:
        cue = F.struct(F.col("passage_index").alias("index"), F.round("cue_start", 3).alias("start"), F.round("cue_end", 3).alias("end"), "text", F.col("section_title").alias("sectionTitle"))
        block = F.to_json(cue)
    made = p.withColumn("block", block).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("passage_index", "block"))).alias("b"), F.count("*").alias("n"), F.max("cue_end").alias("duration")
    )
    rows = docs.join(made, "doc_id").withColumn("blocks", F.transform("b", lambda x: x["block"]))
    if totals is not None:
        told = totals.select("doc_id", F.col("passages").alias("_n"), F.col("duration").alias("_duration"))
        rows = rows.join(told, "doc_id", "left").withColumns({"n": F.coalesce("_n", "n"), "duration": F.coalesce("_duration", "duration")})
    known = lambda name, kind: F.col(name) if name in docs.columns else F.lit(None).cast(kind)
    length = format_clock(F.col("duration"))
    if fmt == "txt":
        said = F.lit(" (estimated)" if estimated else "")
        rule = F.repeat(F.lit("="), F.least(F.lit(72), F.greatest(F.length("title"), F.lit(24))))
        line = F.concat(_grouped_number(F.col("words")), F.lit(" words - "), _grouped_number(F.col("n")), F.lit(" passages - "), length, said)
        by = _or_empty(F.concat(F.lit("\nby "), "author"))
        head = F.concat("title", by, F.lit("\n"), rule, F.lit("\n"), line, F.lit(f"\nTranscribed on {generated}" if generated else ""), F.lit("\n\n"))
        body = F.regexp_replace(F.concat(head, F.array_join("blocks", "")), r"\n{3,}", "\n\n")
        content = F.concat(F.regexp_replace(body, r"\s+\z", ""), F.lit("\n"))
    elif fmt == "md":
        said = F.lit(" *(estimated)*" if estimated else "")
        facts = F.concat(
            F.lit("| | |\n|---|---|\n| **Words** | "), _grouped_number(F.col("words")), F.lit(" |\n| **Passages** | "), _grouped_number(F.col("n")),
            F.lit(" |\n| **Duration** | "), length, said, F.lit(" |\n"), _or_empty(F.concat(F.lit("| **Source** | `"), known("name", "string"), F.lit("` |\n"))),
        )
        made_at = F.lit(f"| **Generated** | {generated} |\n" if generated else "")
        by = _or_empty(F.concat(F.lit("*by "), "author", F.lit("*\n\n")))
        content = F.concat(F.lit("# "), "title", F.lit("\n\n"), by, facts, made_at, F.lit("\n---\n\n"), F.array_join("blocks", ""), F.lit("---\n"))
    else:
        listed = F.array().cast("array<struct<index:int,title:string>>")
        if isinstance(sections, DataFrame):
            entry = F.struct(F.col("section_index").cast("int").alias("index"), "title")
            own = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("_sections"))
            rows, listed = rows.join(own, "doc_id", "left"), F.coalesce("_sections", listed)
        source = F.struct(known("name", "string").alias("name"), known("kind", "string").alias("kind"), known("pages", "int").alias("pages"))
        stats = F.struct(
            "words", known("characters", "long").alias("characters"), F.col("n").alias("passages"), F.round("duration", 3).alias("durationSeconds"),
            F.lit(estimated).alias("timingsAreEstimates"),
        )
        front = F.to_json(F.struct("title", "author", source.alias("source"), stats.alias("stats"), listed.alias("sections")))
        content = F.concat(F.expr("left(_front, length(_front) - 1)"), F.lit(',"cues":['), F.array_join("blocks", ","), F.lit("]}"))
        rows = rows.withColumn("_front", front)
    return rows.select("doc_id", content.alias("content"))
