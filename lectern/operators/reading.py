"""Paced reading: word tokens with exact offsets, dwell weights, schedules, steps back and forth."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, pivot_for
from .documents import BLANKS, PY_WS, ends_with_abbreviation
from .scans import neighbours, running_totals

WIDTH, SLACK = 13, 3
RAMP_WORDS, RAMP_FROM = 12, 0.7
STALL_MS, FRAME_MS = 250, 16
REPLAY_WORDS = 10
PASSAGES_A_BLOCK = 64
WORD, DIGIT, THREE_LETTERS = re.compile(rf"[^{PY_WS}]+"), re.compile("[0-9]"), re.compile(r"[^\W\d_]{3,}")
PARAGRAPH = re.compile(rf"[{PY_WS}]*\n[{PY_WS}]*\n")
CLOSERS = "\"')]"
FLAGS = ("last", "ends_sentence", "ends_clause", "ends_paragraph", "numeric")


def balanced_pieces(word: str, width: int = WIDTH) -> list[tuple[int, int]]:
    """A word wider than ``width`` and some slack in about equal pieces, cut after a hyphen of its own where it has one."""
    if len(word) <= width + SLACK:
        return [(0, len(word))]
    even = -(-len(word) // -(-len(word) // (width - 1)))
    cuts = [0]
    while len(word) - cuts[-1] > even:
        hyphen = word.rfind("-", cuts[-1] + max(2, even // 2), cuts[-1] + even + 1)
        cuts.append(hyphen + 1 if hyphen >= 0 else cuts[-1] + even)
    return list(zip(cuts, [*cuts[1:], len(word)], strict=True))


def word_tokens(text: str, width: int = WIDTH) -> list[tuple]:
    """(start, end, FLAGS...) of one passage's tokens; flags are those of the word, and only its last piece ends anything."""
    body_end = len(text.rstrip(BLANKS))
    out = []
    for m in WORD.finditer(text):
        word, start, end = m[0], m.start(), m.end()
        numeric = DIGIT.search(word) is not None and THREE_LETTERS.search(word) is None
        sign = word.rstrip(CLOSERS)[-1:]
        sentence = sign in (".", "!", "?") and not numeric and not ends_with_abbreviation(word)
        clause = sign in (",", ";", ":")
        paragraph = end >= body_end or PARAGRAPH.match(text[end : end + 8]) is not None
        if len(word) <= width:
            out.append((start, end, True, sentence, clause, paragraph, numeric))
            continue
        for a, b in balanced_pieces(word, width):
            last = b == len(word)
            out.append((start + a, start + b, last, last and sentence, last and clause, last and paragraph, numeric))
    return out


def tokenize_words(passages: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, passage_index, token_no, text, display, start, end, pivot, flags...) of passages; start and end are the document's.

    ``token_no`` counts within the passage. What is shown of a cut word ends in a hyphen; ``text`` stays the exact slice.
    A null text has no tokens.
    """
    made = ("token_no", "text", "start", "end", *FLAGS)

    def cut(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                of, no, words, tokens = [], [], [], []
                for row, (text, base) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    found = word_tokens(text, width) if text else []
                    of += [row] * len(found)
                    no += range(len(found))
                    words += [text[t[0] : t[1]] for t in found]
                    tokens += [(base + t[0], base + t[1], *t[2:]) for t in found]
                columns = list(zip(*tokens, strict=True)) if tokens else [()] * (2 + len(FLAGS))
                kinds = [pa.int32(), pa.int32(), *[pa.bool_()] * len(FLAGS)]
                flat = [pa.array(no, pa.int32()), pa.array(words, pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of, pa.int64())) for c in part.columns[2:]), *flat], ["doc_id", "passage_index", *made])

    given = passages.select("text", F.coalesce(F.col("start").cast("int"), F.lit(0)).alias("start"), "doc_id", "passage_index")
    kinds = [f"`{c}` {given.schema[c].dataType.simpleString()}" for c in ("doc_id", "passage_index")]
    flags = ", ".join(f"{c} boolean" for c in FLAGS)
    rows = given.mapInArrow(cut, f"{', '.join(kinds)}, token_no int, text string, start int, end int, {flags}")
    display = F.when(F.col("last"), F.col("text")).otherwise(F.concat("text", F.lit("-")))
    rows = rows.withColumn("display", display)
    return rows.select(
        "doc_id", "passage_index", "token_no", "text", "display", "start", "end", pivot_for(F.col("display")).alias("pivot"),
        "ends_sentence", "ends_clause", "ends_paragraph", "numeric", (~F.col("last")).alias("continued"),
    )


def dwell_weight(display: Column, paragraph: Column, sentence: Column, clause: Column, numeric: Column, continued: Column, first: Column | None = None) -> Column:
    """How long a token stays, relative to a plain one."""
    n = F.length(display)
    w = F.lit(1.0) + F.when(n > 8, F.least(F.lit(0.6), (n - 8) * 0.04)).otherwise(0.0)
    w = w * F.when(paragraph, 2.6).when(sentence, 2.1).when(clause, 1.45).otherwise(1.0)
    factors = [F.when(numeric, 1.3).otherwise(1.0), F.when(continued, 0.8).otherwise(1.0)]
    if first is not None:
        factors.append(F.when(first, 3.0).otherwise(1.0))
    return reduce(lambda a, b: a * b, factors, w)


def token_weight(first: Column | None = None) -> Column:
    """The weight of a token row; ``first``: whether it opens a section, which then counts."""
    return dwell_weight(*(F.col(c) for c in ("display", "ends_paragraph", "ends_sentence", "ends_clause", "numeric", "continued")), first)


def dwell_schedule(tokens: DataFrame, wpm: float, first: Column | None = None) -> DataFrame:
    """Tokens with ``weight`` and ``dwell_ms``, whose mean in each passage is that of the asked pace."""
    weighted = tokens if "weight" in tokens.columns else tokens.withColumn("weight", token_weight(first))
    mean = F.avg("weight").over(Window.partitionBy("doc_id", "passage_index"))
    pace = 60000.0 / max(1.0, wpm)
    return weighted.withColumn("dwell_ms", F.col("weight") * F.when(mean > 0, F.lit(pace) / mean).otherwise(pace))


def ramp_up(tokens: DataFrame, by: list[str], order: list[str], words: int = RAMP_WORDS, start: float = RAMP_FROM) -> DataFrame:
    """The first ``words`` dwells of each group drawn out: from 70 % of the pace up to all of it."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return tokens.withColumn("_i", i).withColumn("dwell_ms", F.when(F.col("_i") < words, F.col("dwell_ms") / (start + (1 - start) * (F.col("_i") / words))).otherwise(F.col("dwell_ms"))).drop("_i")


def deadlines(tokens: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Tokens with show_at and done_at, in milliseconds from the group's beginning; each stays one at least."""
    least = F.greatest(F.lit(1.0), "dwell_ms")
    summed = running_totals(tokens, by, order, {"done_at": least})
    return summed.withColumn("show_at", F.col("done_at") - least)


def pacing_report(tokens: DataFrame, wpm: float) -> DataFrame:
    """(doc_id, words, effective_wpm, within, shortest, longest): whether the schedule keeps the asked pace to 2 %."""
    sums = tokens.groupBy("doc_id").agg(F.count("*").alias("words"), F.sum("dwell_ms").alias("total"), F.min("dwell_ms").alias("shortest"), F.max("dwell_ms").alias("longest"))
    effective = F.col("words") * 60000 / F.col("total")
    return sums.select("doc_id", "words", effective.alias("effective_wpm"), (F.abs(effective - wpm) <= wpm * 0.02).alias("within"), "shortest", "longest")


def token_round_trip(tokens: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, passage_index, mismatched, lost): tokens that aren't their slice; gaps and tails with more than white space."""
    p = passages.select("doc_id", "passage_index", F.col("text").alias("passage"), F.col("start").alias("base"))
    w = Window.partitionBy("doc_id", "passage_index").orderBy("token_no")
    rows = tokens.join(p, ["doc_id", "passage_index"]).withColumns({"a": F.col("start") - F.col("base"), "b": F.col("end") - F.col("base")})
    rows = rows.withColumns({"before": F.coalesce(F.lag("b").over(w), F.lit(0)), "final": F.lead("a").over(w).isNull()})
    inked = lambda c: c.rlike(f"[^{WS}]")
    gap = F.expr("substring(passage, before + 1, a - before)")
    tail = F.expr("substring(passage, b + 1)")
    return rows.groupBy("doc_id", "passage_index").agg(
        F.count_if(F.expr("substring(passage, a + 1, b - a)") != F.col("text")).alias("mismatched"),
        (F.count_if(inked(gap)) + F.count_if(F.col("final") & inked(tail))).alias("lost"),
    )


def step_words(tokens: DataFrame) -> DataFrame:
    """(doc_id, passage_index, token_no, previous_start, next_start, replay_start): neighbours over passage seams; ten back within."""
    passage = Window.partitionBy("doc_id", "passage_index").orderBy("token_no")
    replay = F.coalesce(F.lag("start", REPLAY_WORDS).over(passage), F.first("start").over(passage))
    rows = tokens.select("doc_id", "passage_index", "token_no", "start", replay.alias("replay_start"))
    # a passage has some hundred tokens at most, so a block takes fewer of them
    rows = neighbours(rows, ["doc_id"], ["passage_index", "token_no"], {"_earlier": "start"}, {"_later": "start"}, PASSAGES_A_BLOCK)
    return rows.select("doc_id", "passage_index", "token_no", F.coalesce("_earlier", "start").alias("previous_start"), F.coalesce("_later", "start").alias("next_start"), "replay_start")


def step_sentences(passages: DataFrame, positions: DataFrame) -> DataFrame:
    """positions (doc_id, passage_index, local) with the offsets that a step back and a step forward lead to; null at seams."""
    found = positions.join(passages.select("doc_id", "passage_index", F.col("start").alias("_base"), "sentences"), ["doc_id", "passage_index"])
    inside = F.transform("sentences", lambda s: (s["start"] <= F.col("local")) & (F.col("local") < s["end"]))
    found = found.withColumn("_at", F.array_position(inside, True).cast("int") - 1)
    span = lambda i: F.when(i >= 0, F.get("sentences", i)["start"])
    here = span(F.col("_at"))
    back = F.when(F.col("local") > here + 1, here).otherwise(span(F.col("_at") - 1))
    return found.select(*positions.columns, (F.col("_base") + back).alias("back"), (F.col("_base") + span(F.col("_at") + 1)).alias("forward"))


def rebase_stalls(frames: DataFrame) -> DataFrame:
    """frames (session, ts) with ``elapsed_ms``: gaps above 250 ms count as one frame of 16 ms."""
    w = Window.partitionBy("session").orderBy("ts")
    ms = F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0
    timed = frames.withColumn("_ms", ms)
    gap = F.col("_ms") - F.lag("_ms").over(w)
    timed = timed.withColumn("_step", F.when(gap.isNull(), 0.0).when(gap > STALL_MS, float(FRAME_MS)).otherwise(gap))
    elapsed = F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return timed.withColumn("elapsed_ms", elapsed).drop("_ms", "_step")


def rank_voices(voices: DataFrame, remembered: DataFrame | None = None) -> DataFrame:
    """Each machine's voices by rank: English first, then quality, then name; and which is chosen."""
    from ..functions.text import english_only

    n = F.lower("name")
    score = (
        F.when(~F.col("local"), 40).otherwise(0) + F.when(n.rlike("natural|neural|premium|enhanced|siri|wavenet|studio"), 60).otherwise(0) + F.when(n.contains("google"), 25).otherwise(0)
        + F.when(n.contains("microsoft"), 15).otherwise(0) - F.when(n.rlike("compact|novelty|eloquence|espeak"), 40).otherwise(0) + F.when(F.col("is_default"), 5).otherwise(0)
    )
    rows = voices.withColumns({"score": score, "english": english_only(F.col("lang"))})
    w = Window.partitionBy("machine_id").orderBy(F.desc("english"), F.desc("score"), "name", "voice_id")
    rows = rows.withColumn("rank", F.row_number().over(w))
    rows = rows.withColumn("quality", F.when(F.col("score") >= 60, "premium").when(F.col("local"), "offline").otherwise("network"))
    rows = rows.withColumn("shown", F.regexp_replace("name", r"^(Microsoft|Google)\s+", ""))
    if remembered is not None:
        rows = rows.join(remembered.select("machine_id", F.col("voice_id").alias("_kept")), "machine_id", "left")
        here = F.max(F.col("voice_id").eqNullSafe(F.col("_kept")).cast("int")).over(Window.partitionBy("machine_id"))
        chosen = F.when(here == 1, F.col("voice_id").eqNullSafe(F.col("_kept"))).otherwise(F.col("rank") == 1)
        return rows.withColumn("chosen", chosen).drop("_kept")
    return rows.withColumn("chosen", F.col("rank") == 1)
