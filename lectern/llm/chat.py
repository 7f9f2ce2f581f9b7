"""Chat formatting by perspective rotation (operator 10).

For every participant of a dialogue, the whole dialogue is rendered with that speaker as assistant and the others as named
users. The result is a row for each turn and perspective: the rendered piece, its place in the perspective's whole text, and
the span that a loss mask leaves open. Joined by ``start``, a perspective's pieces are its text. Rows stay apart because one
dialogue may hold a large share of all turns; offsets come from sums by block of turns, then by group of turns within a
block, then within a group. Turns of one number are dealt over groups by a digest, and turns that repeat are counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# How a name is written, so that it holds neither blanks nor line ends nor bars; in this order.
NAME_ESCAPES = (("\\", "\\\\"), (" ", "\\s"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("|", "\\|"))


def safe(text: Column) -> Column:
    """Text without the template's own marks: one more backslash between ``<`` and ``|``, which ``unsafe`` takes out again."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unsafe(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def safe_name(name: Column) -> Column:
    for found, put in NAME_ESCAPES:
        name = F.replace(name, F.lit(found), F.lit(put))
    return name


def rotate_perspectives(turns: DataFrame, system: str = "system") -> DataFrame:
    """(conv_id, perspective, turn, role, name, rendered, start, mask_start, mask_end, supervised) for each turn and participant.

    Participants are a conversation's speakers but ``system``, whose turns stay system turns in every perspective; a
    conversation of system turns alone has none and gives no rows, nor does an empty table. A null speaker is a participant
    of its own, rendered without a name; a null text is empty, a null conv_id a conversation of its own. Turns go by number
    (null first), then by the MD5 of speaker and text; rows that repeat are turns that repeat, and other columns play no
    part. Masks cover the assistant's text and its end mark, and are null elsewhere. Offsets count characters. Texts and
    names are escaped (``safe``, ``safe_name``), so that neither can open or close a turn.
    """
    digest = F.md5(F.concat(F.coalesce("speaker", F.lit("")), F.lit("\n"), F.col("text")).cast("binary"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").alias("speaker"), safe(F.col("text")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "speaker", "text").agg(F.count("*").alias("n")).withColumn("digest", digest)
    people = rows.select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).where(~F.col("perspective").eqNullSafe(F.lit(system))).distinct()
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    role = F.when(F.col("speaker").eqNullSafe(F.lit(system)), "system").when(own, "assistant").otherwise("user")
    seen = seen.withColumns({"role": role, "name": F.when(role == "user", safe_name(F.col("speaker")))})
    head = F.concat(F.lit(OPEN), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))
    seen = seen.withColumns({"head": F.length(head), "rendered": F.concat(head, "text", F.lit(CLOSE))}).drop("text")
    seen = seen.withColumns({"block": F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / BLOCK), "group": F.substring("digest", 1, 4), "at": F.coalesce("turn", F.lit(-(1 << 62)))})
    dialogue = ["conv_id", "perspective"]
    size = F.length("rendered") * F.col("n")
    groups = seen.groupBy(*dialogue, "block", "at", "group").agg(F.sum(size).alias("size"))
    blocks = groups.groupBy(*dialogue, "block").agg(F.sum("size").alias("size"))
    # a window over blocks, one over a block's groups, one over a group's turns: none holds more than its level
    before = F.sum("size").over(Window.partitionBy(*dialogue).orderBy("block")) - F.col("size")
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("block").alias("_b"), before.alias("blocks_before"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("perspective").eqNullSafe(F.col("_p")) & (F.col("block") == F.col("_b"))
    within = F.sum("size").over(Window.partitionBy(*dialogue, "block").orderBy("at", "group")) - F.col("size")
    groups = groups.withColumn("groups_before", within).join(blocks, same)
    groups = groups.select("_c", "_p", F.col("at").alias("_at"), F.col("group").alias("_g"), (F.col("blocks_before") + F.col("groups_before")).alias("before"))
    inside = Window.partitionBy(*dialogue, "at", "group").orderBy("digest", "speaker", "rendered").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumn("inside", F.sum(size).over(inside) - size)
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("perspective").eqNullSafe(F.col("_p")) & (F.col("at") == F.col("_at")) & (F.col("group") == F.col("_g"))
    seen = seen.join(groups, same).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start = F.col("before") + F.col("inside") + F.col("copy") * F.length("rendered")
    own = F.col("role") == "assistant"
    return seen.select(
        *dialogue, "turn", "role", "name", "rendered", start.alias("start"),
        F.when(own, start + F.col("head")).alias("mask_start"), F.when(own, start + F.length("rendered")).alias("mask_end"), own.alias("supervised"),
    )


def dialogues(rotated: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, masks): whole texts, for dialogues that fit one row."""
    parts = F.sort_array(F.collect_list(F.struct("start", "rendered", "mask_start", "mask_end")))
    whole = rotated.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    masks = F.transform(F.filter("parts", lambda p: p["mask_start"].isNotNull()), lambda p: F.struct(p["mask_start"].alias("start"), p["mask_end"].alias("end")))
    return whole.select("conv_id", "perspective", F.array_join("parts.rendered", "").alias("text"), masks.alias("masks"))


def _sql_name(x: str) -> str:
    shown = {"\n": "chr(10)", "\r": "chr(13)", "\t": "chr(9)"}
    for found, put in NAME_ESCAPES:
        x = f"replace({x}, {shown.get(found, repr(found) if found != '\\' else chr(39) + found + chr(39))}, '{put}')"
    return x


ORACLE = rf"""
WITH rows AS (SELECT conv_id, turn, role AS speaker, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS body FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM rows WHERE speaker IS DISTINCT FROM 'system'),
seen AS (
  SELECT r.conv_id, p.perspective, r.turn, r.speaker, r.body, md5(coalesce(r.speaker, '') || chr(10) || r.body) AS digest,
         CASE WHEN speaker IS NOT DISTINCT FROM 'system' THEN 'system' WHEN speaker IS NOT DISTINCT FROM perspective THEN 'assistant' ELSE 'user' END AS role
  FROM rows r JOIN people p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
named AS (SELECT *, CASE WHEN role = 'user' THEN {_sql_name("speaker")} END AS name FROM seen),
made AS (SELECT *, '{OPEN}' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM named),
full_rows AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS rendered FROM made),
placed AS (
  SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, digest, speaker, rendered
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(rendered) AS BIGINT) AS start FROM full_rows)
SELECT conv_id, perspective, turn, role, name, rendered, start,
       CASE WHEN role = 'assistant' THEN start + length(head) END AS mask_start,
       CASE WHEN role = 'assistant' THEN start + length(rendered) END AS mask_end,
       role = 'assistant' AS supervised
FROM placed
"""
