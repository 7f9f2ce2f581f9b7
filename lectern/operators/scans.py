"""Scans along a document in two levels: within blocks of it, and over what the blocks amount to.

A window over a whole document puts it into one task. Here a window goes over a block, which is a stretch of the order that
a fixed width bounds; another goes over one row a block, and its result is joined back by block. A document that holds a
third of all rows is then spread like any other. Both levels read one exchange by (group, block), and only a row a block
moves once more. Groups may have null keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096  # numbers of the order that make a block: passages, tokens
SPAN = 65_536.0  # characters that make a block


def blocked(rows: DataFrame, at: str, width: float = BLOCK) -> DataFrame:
    """``rows`` with the block in which their place ``at`` lies; null places come first, in a block of their own."""
    return rows.withColumn("_block", F.coalesce(F.floor(F.col(at) / F.lit(float(width))).cast("long"), F.lit(-(1 << 62))))


def _back(rows: DataFrame, blocks: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """``rows`` with ``values`` of their block."""
    keys = [*by, "_block"]
    named = blocks.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *values)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return rows.join(named, same).drop(*(f"_of_{k}" for k in keys))


def _in_block(by: list[str], order: list[str]):
    return Window.partitionBy(*by, "_block").orderBy(*order)


def _so_far(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_totals(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], width: float = BLOCK) -> DataFrame:
    """``rows`` with, by name, each of ``sums`` added up along its group in ``order``, the row's own included.

    The first column of ``order`` is a number, and blocks are stretches of it.
    """
    held = blocked(rows, order[0], width).withColumns({f"_x_{k}": x for k, x in sums.items()})
    inner = held.withColumns({f"_in_{k}": F.sum(f"_x_{k}").over(_so_far(_in_block(by, order))) for k in sums})
    blocks = inner.groupBy(*by, "_block").agg(*(F.sum(f"_x_{k}").alias(f"_sum_{k}") for k in sums))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"_before_{k}": F.sum(f"_sum_{k}").over(earlier) for k in sums})
    found = _back(inner, blocks, by, [f"_before_{k}" for k in sums])
    # a group's first block adds nothing, so its sums stay what one window gives
    total = {k: F.when(F.col(f"_before_{k}").isNull(), F.col(f"_in_{k}")).otherwise(F.col(f"_before_{k}") + F.coalesce(f"_in_{k}", F.lit(0))) for k in sums}
    return found.withColumns(total).drop("_block", *(f"{p}_{k}" for p in ("_x", "_in", "_before") for k in sums))


def last_known(rows: DataFrame, by: list[str], order: list[str], value: str, width: float = SPAN) -> DataFrame:
    """``rows`` with ``value`` replaced by the last one along its group that isn't null, the row's own included."""
    held = blocked(rows, order[0], width)
    inner = held.withColumn("_in", F.last(value, ignorenulls=True).over(_so_far(_in_block(by, order))))
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    blocks = inner.groupBy(*by, "_block").agg(F.max_by(value, place).alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier))
    return _back(inner, blocks, by, ["_before"]).withColumn(value, F.coalesce("_in", "_before")).drop("_block", "_in", "_before")


def neighbours(rows: DataFrame, by: list[str], order: list[str], before: dict[str, str] | None = None, after: dict[str, str] | None = None, width: float = BLOCK) -> DataFrame:
    """``rows`` with columns of the row before and of the row after along their group: {new name: column}; null at its ends."""
    before, after = before or {}, after or {}
    held, w = blocked(rows, order[0], width), _in_block(by, order)
    inner = held.withColumns({f"_lag_{k}": F.lag(F.struct(c)).over(w) for k, c in before.items()} | {f"_lead_{k}": F.lead(F.struct(c)).over(w) for k, c in after.items()})
    place = F.struct(*order)
    ends = [F.max_by(F.struct(c), place).alias(f"_out_{k}") for k, c in before.items()] + [F.min_by(F.struct(c), place).alias(f"_out_{k}") for k, c in after.items()]
    over = Window.partitionBy(*by).orderBy("_block")
    blocks = inner.groupBy(*by, "_block").agg(*ends)
    blocks = blocks.withColumns({f"_near_{k}": F.lag(f"_out_{k}").over(over) for k in before} | {f"_near_{k}": F.lead(f"_out_{k}").over(over) for k in after})
    found = _back(inner, blocks, by, [f"_near_{k}" for k in (*before, *after)])
    taken = {k: F.coalesce(f"_lag_{k}", f"_near_{k}")[c] for k, c in before.items()} | {k: F.coalesce(f"_lead_{k}", f"_near_{k}")[c] for k, c in after.items()}
    return found.withColumns(taken).drop("_block", *(f"{p}_{k}" for p in ("_lag", "_lead", "_near") for k in (*before, *after)))
