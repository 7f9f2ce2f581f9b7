"""Documents from parts: running furniture, assembly, sentences, passages, and checks on offsets.

Offsets count code points from 0. Sentences and passages are sequential within a document and are made by small functions over
one text, in Arrow batches; all else is DataFrame code.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import BLANKS, count_words, estimate_seconds, is_blank, js_trim, normalize_text, pause_after, strip_orphan_page_numbers
from .scans import SPAN, last_known

PY_WS = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Words whose full stop doesn't end a sentence.
ABBREVIATIONS = tuple(
    """mr mrs ms dr prof sr jr st rev hon pres gen col capt lt sgt gov sen rep supt det inc ltd co corp dept est fig vol no
    op cit ed eds trans approx etc vs viz cf al ca circa i.e e.g a.m p.m u.s u.k u.n jan feb mar apr jun jul aug sep sept
    oct nov dec mon tue wed thu fri sat sun""".split()
)
_ABBREVIATIONS = frozenset(ABBREVIATIONS)
# Sentences end in these, closing quotes and brackets included. A run of marks is tried from its first one only.
SENTENCE_END = re.compile(rf"""(?<![.!?])[.!?]++["')\]]*+(?:[{PY_WS}]++|\Z)|\n{{2,}}""")
LAST_WORD = re.compile(r"([^\W\d_.]|\.)+\.\Z")
SPANS = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class PassagePreset:
    max_chars: int
    min_chars: int
    respect_paragraphs: bool


PRESETS = {"responsive": PassagePreset(480, 160, True), "balanced": PassagePreset(900, 320, True), "economical": PassagePreset(2400, 900, False)}


def strip_running_furniture(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no, text) without header and footer lines that recur; documents under four pages stay as they are.

    A line is known by its trimmed text with digits as ``#``. It counts on a page when it is among the first or last two lines
    that aren't blank, and is removed from the first and last two lines of a page when it counts on three pages and 35 % of
    them. Two edge lines of a page that differ only in digits count twice.
    """
    lines = pages.withColumn("lines", F.split("text", "\n", -1))
    trimmed = F.filter(F.transform("lines", js_trim), lambda x: x != "")
    n = F.size(trimmed)
    edges = F.array_distinct(F.concat(F.slice(trimmed, 1, 2), F.slice(trimmed, F.greatest(F.lit(1), n - 1), F.lit(2))))
    key = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    counted = lines.select("doc_id", F.explode(edges).alias("line")).select("doc_id", key(F.col("line")).alias("key"))
    counted = counted.where(F.length("key").between(2, 90)).groupBy("doc_id", "key").count()
    size = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    known = counted.join(size, "doc_id").where("pages >= 4 AND count >= greatest(3, floor(pages * 0.35))")
    known = known.groupBy("doc_id").agg(F.collect_set("key").alias("furniture"))
    joined = lines.join(known, "doc_id", "left")
    numbered = F.transform("lines", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    edge = lambda r: (r["i"] < 2) | (r["i"] >= F.size("lines") - 2)
    kept = F.filter(numbered, lambda r: ~(edge(r) & F.array_contains("furniture", key(js_trim(r["x"])))))
    text = F.when(F.col("furniture").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda r: r["x"]), "\n"))
    return joined.select("doc_id", "page_no", text.alias("text"))


def assemble(parts: DataFrame) -> DataFrame:
    """Sections (doc_id, section_id, section_index, title, start, end, piece) of parts (doc_id, part_no, title, text).

    ``piece`` is what the part adds to the document's text, its joiner included; ``text_of`` joins them. Where a word is
    hyphenated over two parts, the hyphen goes and the earlier section's end stays one past the later one's start.
    """
    w = Window.partitionBy("doc_id").orderBy("part_no")
    cleaned = js_trim(strip_orphan_page_numbers(normalize_text(F.col("text"))))
    # Parts without text are passed over by the windows and dropped behind them: a filter before them would be pushed to the
    # scan and clean every text twice. What windows carry of a text is its last two characters and its first.
    rows = parts.select("doc_id", "part_no", "title", cleaned.alias("clean")).withColumn("inked", F.col("clean") != "")
    rows = rows.withColumns({"tail": F.when(F.col("inked"), F.right("clean", F.lit(2))), "head": F.left("clean", F.lit(1))})
    rows = rows.withColumn("before", F.last("tail", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    flows = ~F.right("before", F.lit(1)).rlike(r"""[.!?:;"')\]]""") & F.col("head").rlike("[a-z(]")
    fused = flows & F.col("before").rlike(r"[a-z]-\z")
    joiner = F.when(F.col("before").isNull() | fused, "").when(flows, " ").otherwise("\n\n")
    rows = rows.withColumns({"joiner": joiner, "fused": F.when(F.col("inked"), F.coalesce(fused, F.lit(False)))})
    back = Window.partitionBy("doc_id").orderBy(F.desc("part_no")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("cut", F.coalesce(F.last("fused", ignorenulls=True).over(back), F.lit(False)))
    grown = F.when(F.col("inked"), F.length("joiner") + F.length("clean") - F.col("fused").cast("int")).otherwise(0)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"end": F.sum(grown).over(so_far).cast("int"), "section_index": F.sum(F.col("inked").cast("int")).over(so_far).cast("int")})
    body = F.when(F.col("cut"), F.expr("left(clean, length(clean) - 1)")).otherwise(F.col("clean"))
    return rows.where("inked").select(
        "doc_id", F.concat(F.lit("sec-"), F.col("part_no").cast("string")).alias("section_id"), "section_index", "title",
        (F.col("end") - F.length("clean")).cast("int").alias("start"), "end", F.concat("joiner", body).alias("piece"),
    )


def text_of(sections: DataFrame) -> DataFrame:
    """(doc_id, text) from the pieces of ``assemble``."""
    pieces = F.sort_array(F.collect_list(F.struct("section_index", "piece")))
    return sections.groupBy("doc_id").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"))


def ends_with_abbreviation(s: str) -> bool:
    m = LAST_WORD.search(s.rstrip(BLANKS))
    if not m:
        return False
    word = m[0][:-1]
    return word.lower().removesuffix(".") in _ABBREVIATIONS or (len(word) == 1 and word.isupper())


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Spans that end at sentence punctuation or blank lines; one that ends in an abbreviation takes in the next."""
    merged: list[list[int]] = []
    last, joined = 0, False
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        if end == last and merged:
            continue
        if joined:
            merged[-1][1] = end
        elif end > last:
            merged.append([last, end])
        joined = bool(merged) and ends_with_abbreviation(text[max(last, end - 60) : end])
        last = end
    return [(a, b) for a, b in merged if text[a:b].strip(BLANKS)]


def split_span(text: str, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """A span in pieces of at most ``most`` characters: after the last of ``;:,)-`` in the back half, else at a blank there."""
    cuts = [start]
    while end - cuts[-1] > most:
        half, full = cuts[-1] + most // 2, cuts[-1] + most
        clause = max(text.rfind(c, half, full) for c in ";:,)-")
        cuts.append(clause + 1 if clause >= 0 else max(text.rfind(" ", half, full), half))
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], end], strict=True) if a < b]


SEAM = re.compile(rf"\n[{PY_WS}]*\n[{PY_WS}]*\Z")


def pack_passages(text: str, preset: PassagePreset, intent: bool = False) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Passages (start, end, sentences) of one text: whole sentences up to ``max_chars``; offsets are those of the trimmed text,
    and sentences count from there.

    A paragraph ends a passage of ``min_chars`` or more only when the next sentence itself begins with two blanks or line ends,
    as the literal rule has it; with ``intent`` the gap between the sentences decides.
    """
    units = [u for s in sentence_spans(text) for u in split_span(text, *s, preset.max_chars)]
    starts, ends = [a for a, _ in units], [b for _, b in units]
    # With unit k, a passage holds what it held up to unit k - 1, and unit k: it fits while that is at most reach[k].
    reach = [(ends[k - 1] if k else a) + b - a for k, (a, b) in enumerate(units)]
    seams = []
    if preset.respect_paragraphs:
        gaps = (text[max(0, ends[k - 1] - 4) : starts[k] + (0 if intent else 2)] for k in range(1, len(units)))
        seams = [k for k, gap in enumerate(gaps, 1) if "\n" in gap and SEAM.search(gap)]
    out, i = [], 0
    while i < len(units):
        after = bisect_right(reach, starts[i] + preset.max_chars, i + 1)
        for k in seams[bisect_right(seams, i) : bisect_left(seams, after)]:
            if ends[k - 1] - starts[i] >= preset.min_chars:
                after = k
                break
        whole = text[starts[i] : ends[after - 1]]
        body = whole.strip(BLANKS)
        if body:
            at = starts[i] + len(whole) - len(whole.lstrip(BLANKS))
            spans = [(max(0, a - at), min(len(body), b - at)) for a, b in units[i:after]]
            out.append((at, at + len(body), [(a, b) for a, b in spans if a < b]))
        i = after
    return out


def sentence_column(text: Column) -> Column:
    @pandas_udf(SPANS)
    def spans(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": a, "end": b} for a, b in sentence_spans(t)] if t else [])

    return spans(text)


def segment_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, start, end) of documents; null texts have none."""
    return docs.select("doc_id", F.posexplode(sentence_column(F.col("text"))).alias("sentence_no", "s")).select("doc_id", "sentence_no", "s.start", "s.end")


def split_oversized(docs: DataFrame, sentences: DataFrame, most: int) -> DataFrame:
    """(doc_id, sentence_no, piece_no, start, end): sentences longer than ``most`` in pieces."""

    @pandas_udf(SPANS)
    def pieces(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([[{"start": int(a + x), "end": int(a + y)} for x, y in split_span(t, 0, int(b - a), most)] for t, a, b in zip(text, start, end, strict=True)])

    body = F.expr("substring(text, start + 1, end - start)")
    cut = docs.select("doc_id", "text").join(sentences, "doc_id").withColumn("p", pieces(body, F.col("start"), F.col("end")))
    return cut.select("doc_id", "sentence_no", F.posexplode("p").alias("piece_no", "p")).select("doc_id", "sentence_no", "piece_no", "p.start", "p.end")


def packed_passages(docs: DataFrame, preset: str | PassagePreset, intent: bool, carried: list[str], outer: bool = False) -> DataFrame:
    """(carried..., passage_index, text, start, end, sentences) of documents (text, carried...), as flat columns.

    With ``outer``, a document without passages has one row, of which all else is null.
    """
    chosen = PRESETS[preset] if isinstance(preset, str) else preset
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    names = ["passage_index", "text", "start", "end", "sentences"]

    def pack(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                of, index, body, start, end, sizes, spans = [], [], [], [], [], [], []
                for row, text in enumerate(part.column(0)):
                    text = text.as_py()
                    made = pack_passages(text, chosen, intent) if text else []
                    of += [row] * (len(made) or outer)
                    index += range(len(made))
                    for a, b, sentences in made:
                        body.append(text[a:b])
                        start.append(a)
                        end.append(b)
                        sizes.append(len(sentences))
                        spans += sentences
                    if outer and not made:
                        for column in (index, body, start, end, sizes):
                            column.append(None)
                flat = [pa.array([s[k] for s in spans], pa.int32()) for k in (0, 1)]
                offsets = np.concatenate([[0], np.cumsum([n or 0 for n in sizes])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(flat, fields=list(span)))
                made = [pa.array(index, pa.int32()), pa.array(body, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of, pa.int64())) for c in part.columns[1:]), *made], [*carried, *names])

    given = docs.select("text", *carried)
    fields = "".join(f"`{c}` {given.schema[c].dataType.simpleString()}, " for c in carried)
    return given.mapInArrow(pack, f"{fields}passage_index int, text string, start int, end int, sentences {SPANS}")


def with_estimates(passages: DataFrame) -> DataFrame:
    words = count_words(F.col("text"))
    return passages.withColumns({"words": words, "est_seconds": estimate_seconds(words) + pause_after(F.col("text"))})


def build_passages(docs: DataFrame, preset: str | PassagePreset = "balanced", intent: bool = False) -> DataFrame:
    """(doc_id, passage_index, text, start, end, sentences, words, est_seconds) of documents; null and blank texts have none."""
    return with_estimates(packed_passages(docs, preset, intent, ["doc_id"]))


def narration_time(docs: DataFrame, preset: str | PassagePreset = "balanced") -> DataFrame:
    """(doc_id, words, characters, passages, est_seconds, timeline_end) of documents (doc_id, text) as they are read.

    One pass over the texts and one aggregate by document. Without passages the seconds follow from the words.
    """
    clean = docs.select("doc_id", normalize_text(F.col("text")).alias("text"))
    counted = clean.withColumns({"_words": count_words(F.col("text")), "_characters": F.length("text")})
    made = with_estimates(packed_passages(counted, preset, False, ["doc_id", "_words", "_characters"], outer=True))
    sums = made.groupBy("doc_id", "_words", "_characters").agg(F.count("passage_index").alias("passages"), F.sum("est_seconds").alias("timeline_end"))
    seconds = F.coalesce(F.nullif("timeline_end", F.lit(0.0)), estimate_seconds(F.col("_words")))
    return sums.select("doc_id", F.col("_words").alias("words"), F.col("_characters").alias("characters"), "passages", seconds.alias("est_seconds"), "timeline_end")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, start: str, values: list[str], width: float = SPAN) -> DataFrame:
    """``left`` with ``values`` of the last ``right`` row of its group whose ``start`` is at most ``at``; else nulls.

    Both sides go through one scan along the group, in blocks of ``width`` places, rather than through a join on a range.
    """
    keep = [c for c in left.columns if c not in values]
    packed = F.struct(*values)
    up = left.select(*by, F.col(at).cast("double").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_value"), F.struct(*keep).alias("_row"))
    down = right.select(*by, F.col(start).cast("double").alias("_at"), F.lit(0).alias("_side"), packed.alias("_value"), F.lit(None).cast(left.select(F.struct(*keep).alias("x")).schema["x"].dataType).alias("_row"))
    both = up.unionByName(down).withColumn("_first", F.col(f"_value.{values[0]}"))
    both = last_known(both, by, ["_at", "_side", "_first"], "_value", width).where("_side = 1")
    return both.select("_row.*", *(F.col(f"_value.{v}").alias(v) for v in values))


def section_of_passage(passages: DataFrame, sections: DataFrame) -> DataFrame:
    """Passages with section_id and section_title of the last section that starts at or before them, else sec-0, Document."""
    found = as_of(passages, sections.withColumnRenamed("title", "section_title"), ["doc_id"], "start", "start", ["section_id", "section_title"])
    return found.withColumns({"section_id": F.coalesce("section_id", F.lit("sec-0")), "section_title": F.coalesce("section_title", F.lit("Document"))})


def rechunk_positions(old: DataFrame, new: DataFrame, positions: DataFrame) -> DataFrame:
    """(doc_id, passage_index): a position in ``old`` passages carried over to ``new`` ones in proportion."""
    n_old = old.groupBy("doc_id").agg(F.count("*").alias("n_old"))
    n_new = new.groupBy("doc_id").agg(F.count("*").alias("n_new"))
    at = F.floor(F.col("passage_index") / F.greatest(F.lit(1), F.col("n_old")) * F.col("n_new")).cast("int")
    return positions.join(n_old, "doc_id").join(n_new, "doc_id").select("doc_id", F.col("passage_index").alias("old_index"), at.alias("passage_index"))


def passage_offset_audit(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages whose text isn't the slice of their document at their offsets."""
    p = passages.select("doc_id", "passage_index", F.col("text").alias("passage"), "start", "end")
    return p.join(docs.select("doc_id", F.col("text").alias("doc")), "doc_id").where("NOT (substring(doc, start + 1, end - start) <=> passage)").select("doc_id", "passage_index", "start", "end")


def drop_empty_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with readable text, rejected ones with their reason)."""
    empty = F.col("text").isNull() | is_blank(F.col("text"))
    return docs.where(~empty), docs.where(empty).withColumn("reason", F.lit("no readable text"))


def pack_segments(text: str, most: int = 300) -> list[str]:
    """A passage in pieces for synthesis: sentences, over-long ones by clause (its delimiter is lost), then by word."""

    def pack(pieces: list[str]) -> list[str]:
        out, held = [], ""
        for p in filter(None, pieces):
            joined = f"{held} {p}" if held else p
            if len(joined) <= most:
                held = joined
            else:
                if held:
                    out.append(held)
                held = p
        return [*out, held] if held else out

    out: list[str] = []
    for s in (x.strip(BLANKS) for x in re.split(rf"(?<=[.!?\u2026])[{PY_WS}]+", text)):
        if not s:
            continue
        for clause in [s] if len(s) <= most else pack(re.split(rf"[;:,\u2014\u2013)\]][{PY_WS}]+", s)):
            out += [clause] if len(clause) <= most else pack(re.split(rf"[{PY_WS}]+", clause))
    return [x for x in out if x.strip(BLANKS)]


def synthesis_segments(passages: DataFrame, most: int = 300) -> DataFrame:
    """(doc_id, passage_index, segment_no, segment) of passages; a token longer than ``most`` passes whole."""

    @pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: pack_segments(t, most) if t else [])

    return passages.select("doc_id", "passage_index", F.posexplode(cut("text")).alias("segment_no", "segment"))
