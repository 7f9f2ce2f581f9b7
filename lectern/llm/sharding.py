"""Sharding by histogram sort (operator 12), in DataFrame functions alone.

Rows are sorted by a key: a hash of the text, then doc_id, so that equal texts lie side by side. The places where the order
is cut into shards are found by counting. Each round lays probes over the key intervals in which cuts still lie, counts the
exact bytes and rows between probes over all partitions, and goes on within the one gap that holds the cut, until the bytes
below a probe are close enough to the cut's target or the gap holds one key. Only keys and sizes are read for that; the rows
themselves move once, straight to their shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

PROBES = 256  # laid over an interval each round
RUN_ROWS = 20_000  # rows of one text and doc_id beyond which they are told apart by a number of their own
LOT_BYTES = 32_000_000  # of a shard's rows that one task puts in order
KEY = ("h", "d", "lot")
LEAST = -(1 << 63)


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text; none for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def keyed(docs: DataFrame, run_rows: int = RUN_ROWS) -> tuple[DataFrame, DataFrame]:
    """(``docs`` as a struct ``row`` with ``size`` and the key, the same without ``row`` as a written table).

    Rows that share text and doc_id have equal keys. Where those are more than ``run_rows``, they are written once with a
    number of their own as the last part of the key, so that a cut may fall between them.
    """
    names = {"h": F.xxhash64("text"), "d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), "size": text_bytes() + 8}
    rows = docs.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in names.items()))
    slim = materialise(rows.select("h", "d", "size"), "keys")
    runs = materialise(slim.groupBy("h", "d").count().where(F.col("count") > run_rows).select("h", "d"), "runs")
    if not runs.head(1):
        return rows.withColumn("lot", F.lit(0).cast("long")), slim.withColumn("lot", F.lit(0).cast("long"))
    numbered = rows.hint("merge").join(runs, ["h", "d"]).withColumn("lot", F.xxhash64(F.monotonically_increasing_id()))
    numbered = materialise(numbered.select("row", "h", "d", "size", "lot"), "numbered")
    rows = rows.hint("merge").join(runs, ["h", "d"], "left_anti").select("row", "h", "d", "size", F.lit(0).cast("long").alias("lot")).unionByName(numbered)
    return rows, materialise(rows.drop("row"), "keys")


@dataclass(frozen=True)
class Gap:
    """Keys from ``low`` to ``high``, both held by some row, and what lies before them."""

    low: tuple[int, int, int]
    high: tuple[int, int, int]
    before: tuple[int, int]  # bytes, rows
    within: tuple[int, int]

    @property
    def part(self) -> int:
        """The first part of the key in which low and high differ; 3 for one key."""
        return next((i for i in range(3) if self.low[i] != self.high[i]), 3)


@dataclass(frozen=True)
class Cut:
    """Rows with a key of at least ``key`` come after it."""

    key: tuple[int, int, int]
    before: tuple[int, int]


def _after(key: tuple[int, int, int]) -> tuple[int, int, int]:
    return (*key[:2], key[2] + 1)


def at_least(key: tuple[int, int, int]) -> Column:
    """Whether a row's key is ``key`` or more."""
    h, d, lot = (F.lit(k) for k in key)
    return (F.col("h") > h) | ((F.col("h") == h) & ((F.col("d") > d) | ((F.col("d") == d) & (F.col("lot") >= lot))))


def _choice(number: Column, values: list[int]) -> Column:
    """The value of each number, as a chain of conditions: there is one for each cut at most."""
    out = F.lit(None).cast("long")
    for i, v in enumerate(values):
        out = F.when(number == i, F.lit(v).cast("long")).otherwise(out)
    return out


def _probed(slim: DataFrame, gaps: list[Gap], probes: int) -> dict[int, list[Gap]]:
    """The parts into which probes cut each gap, in order; parts without rows are left out."""
    number = F.lit(None).cast("int")
    for i, g in enumerate(gaps):
        number = F.when(at_least(g.low) & ~at_least(_after(g.high)), F.lit(i)).otherwise(number)
    found = slim.withColumn("gap", number).where("gap IS NOT NULL")
    chosen = _choice(F.col("gap"), [g.part for g in gaps])
    part = F.when(chosen == 0, F.col("h")).when(chosen == 1, F.col("d")).otherwise(F.col("lot"))
    lows, widths = [g.low[g.part] for g in gaps], [max(1, -(-(g.high[g.part] - g.low[g.part] + 1) // probes)) for g in gaps]
    # differences of 64-bit numbers may pass 63 bits, so they are taken as decimals
    wide = "decimal(20,0)"
    place = F.floor((part.cast(wide) - _choice(F.col("gap"), lows).cast(wide)) / _choice(F.col("gap"), widths).cast(wide)).cast("int")
    key = F.struct(*KEY)
    counted = found.groupBy("gap", place.alias("place")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    out: dict[int, list[Gap]] = {}
    for r in sorted(counted.collect(), key=lambda r: (r["gap"], r["place"])):  # at most ``probes`` for each cut
        held = out.setdefault(r["gap"], [])
        before = gaps[r["gap"]].before if not held else tuple(a + b for a, b in zip(held[-1].before, held[-1].within))
        held.append(Gap(tuple(r["low"]), tuple(r["high"]), before, (r["bytes"], r["rows"])))
    return out


def splitters(slim: DataFrame, shards: int, law: str = "bytes", tolerance: float = 0.0005, probes: int = PROBES) -> tuple[list[Cut], tuple[int, int]]:
    """The cuts between ``shards`` shards, and the total bytes and rows.

    Law "bytes" aims at equal bytes: a cut lies within ``tolerance`` of a shard's share of its target, or at the nearest
    bound of the one key that holds the target. Law "rows" aims at equal counts in the same way.
    """
    key = F.struct(*KEY)
    whole = slim.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.sum("size").alias("bytes"), F.count("*").alias("rows")).head()
    if not whole["rows"]:
        return [], (0, 0)
    total, m = (whole["bytes"], whole["rows"]), ("bytes", "rows").index(law)
    targets = [total[m] * i / shards for i in range(1, shards)]
    allowed = tolerance * total[m] / shards
    root = Gap(tuple(whole["low"]), tuple(whole["high"]), (0, 0), total)
    open_, cuts = dict.fromkeys(range(len(targets)), root), {}
    while open_:
        gaps = list(dict.fromkeys(g for g in open_.values() if g.part < 3))
        parts = _probed(slim, gaps, probes) if gaps else {}
        for t, g in list(open_.items()):
            own = parts[gaps.index(g)] if g.part < 3 else [g]
            hit = next((p for p in own if p.before[m] + p.within[m] >= targets[t]), own[-1])
            after = tuple(a + b for a, b in zip(hit.before, hit.within))
            below, above = targets[t] - hit.before[m], after[m] - targets[t]
            if min(below, above) <= allowed or hit.part == 3:
                cuts[t] = Cut(hit.low, hit.before) if below <= above else Cut(_after(hit.high), after)
                del open_[t]
            else:
                open_[t] = hit
    return [cuts[t] for t in range(len(targets))], total


def histogram_shards(docs: DataFrame, shards: int = 24, law: str = "bytes", tolerance: float = 0.0005, lot_bytes: int = LOT_BYTES, run_rows: int = RUN_ROWS) -> DataFrame:
    """All columns of ``docs`` as a struct ``row``, with size (UTF-8 bytes and 8), law, shard and slot (from 0, without gaps).

    Shards are ranges of the key order, so equal texts share a shard or lie in neighbouring ones. A shard's slots number its
    rows by lot, and within it by key; a shard has as many lots as its bytes ask for, so no task gets a shard whole. Null
    texts have no bytes, and null doc_ids sort first; rows that repeat are placed each. Fewer rows than shards leave shards
    empty, and an empty table gives no rows. Names of other columns can't clash, as they stay within ``row``.
    """
    rows, slim = keyed(docs, run_rows)
    cuts, total = splitters(slim, shards, law, tolerance)
    lots = max(8, -(-total[0] // shards // lot_bytes))
    shard = sum((at_least(c.key).cast("int") for c in cuts), F.lit(0)) if cuts else F.lit(0)
    # a chain of comparisons, one for each cut; all are cheap beside the hash of the text
    dealt = {"shard": shard.cast("int"), "deal": F.pmod(F.xxhash64(*KEY), F.lit(lots)).cast("int")}
    sizes = slim.withColumns(dealt).groupBy("shard", "deal").agg(F.count("*").alias("n"))
    w = Window.partitionBy("shard").orderBy("deal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sizes.select("shard", "deal", (F.sum("n").over(w) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "deal").orderBy(*KEY))
    placed = rows.withColumns(dealt).withColumn("place", place)
    found = placed.join(before, ["shard", "deal"])
    return found.select("row", "size", F.lit(law).alias("law"), "shard", (F.col("before") + F.col("place") - 1).alias("slot"))
