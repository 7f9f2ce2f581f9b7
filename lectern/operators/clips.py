"""Conditioning of audio clips (clip_id, samples array<float>, sample_rate): silence, level, fades, 16-bit samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def trim_one(x: np.ndarray, rate: int, threshold_db: float = -45.0, keep_ms: float = 30.0) -> np.ndarray:
    loud = np.flatnonzero(np.abs(x) >= 10 ** (threshold_db / 20))
    keep = int(np.floor(keep_ms / 1000 * rate + 0.5))
    if len(loud) == 0 or loud[0] >= loud[-1]:
        return x
    return x[max(0, loud[0] - keep) : min(len(x), loud[-1] + keep)]


def trim_silence(clips: DataFrame, threshold_db: float = -45.0, keep_ms: float = 30.0) -> DataFrame:
    """Clips without silence at both ends but for ``keep_ms``; clips of silence alone stay."""

    @pandas_udf("array<float>")
    def trim(s: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else trim_one(np.asarray(x, np.float32), int(r), threshold_db, keep_ms) for x, r in zip(s, rate, strict=True)])

    return clips.withColumn("samples", trim("samples", "sample_rate"))


def normalize_peak(clips: DataFrame, target_db: float = -1.5) -> DataFrame:
    """Clips with ``gain`` applied: to the target peak, four times at most, not at all within 1 % or for silence."""
    peak = F.array_max(F.transform("samples", lambda x: F.abs(x.cast("double"))))
    gain = F.least(F.lit(10 ** (target_db / 20)) / peak, F.lit(4.0))
    gain = F.when(peak.isNull() | (peak == 0) | (F.abs(gain - 1) < 0.01), 1.0).otherwise(gain)
    return clips.withColumn("gain", gain).withColumn("samples", F.transform("samples", lambda x: (x * F.col("gain")).cast("float")))


def edge_fades(clips: DataFrame, ms: float = 5.0) -> DataFrame:
    """Clips with a cosine fade at both edges, at most half a clip long."""
    n = F.least(F.floor(F.lit(ms / 1000) * F.col("sample_rate") + 0.5), F.floor(F.size("samples") / 2))

    def gain(i: Column) -> Column:
        edge = F.least(i, F.size("samples") - 1 - i)
        return F.when((n > 1) & (edge < n), 0.5 - 0.5 * F.cos(F.lit(np.pi) * edge / n)).otherwise(1.0)

    return clips.withColumn("samples", F.transform("samples", lambda x, i: (x * gain(i)).cast("float")))


def to_pcm16(clips: DataFrame) -> DataFrame:
    """Clips as 16-bit samples: below -1 is -32768, above 1 is 32767, else 32767 times the sample, halves up."""
    d = lambda x: x.cast("double")
    scaled = lambda x: F.when(d(x) < -1, -32768).when(d(x) > 1, 32767).otherwise(F.floor(d(x) * 32767 + 0.5).cast("int"))
    return clips.withColumn("samples", F.transform("samples", scaled))


# Long clips as blocks (clip_id, start, samples, sample_rate): a row is a stretch of a clip that begins at its sample ``start``.
# Hours of audio are then many rows of a bounded size. What a step must know of the whole clip is aggregated first.
BLOCK_SAMPLES = 1 << 16


def split_clips(clips: DataFrame, size: int = BLOCK_SAMPLES) -> DataFrame:
    """Clips as blocks of at most ``size`` samples; one without samples, or with null ones, is a block too."""
    last = F.greatest(F.lit(0), F.coalesce(F.size("samples"), F.lit(0)) - 1)
    starts = F.explode(F.sequence(F.lit(0), F.floor(last / size).cast("int") * size, F.lit(size)))
    rows = clips.select("*", starts.alias("_start"))
    return rows.withColumn("samples", F.slice("samples", F.col("_start") + 1, F.lit(size))).withColumn("start", F.col("_start").cast("long")).drop("_start")


def join_clips(blocks: DataFrame) -> DataFrame:
    """(clip_id, samples, sample_rate) of clips short enough to be a row; a clip of null blocks has null samples."""
    held = F.sort_array(F.collect_list(F.when(F.col("samples").isNotNull(), F.struct("start", "samples"))))
    made = blocks.groupBy("clip_id").agg(held.alias("b"), F.first("sample_rate").alias("sample_rate"))
    return made.select("clip_id", F.when(F.size("b") > 0, F.flatten(F.transform("b", lambda x: x["samples"]))).alias("samples"), "sample_rate")


def _with(blocks: DataFrame, whole: DataFrame, names: list[str]) -> DataFrame:
    """Blocks with what was found of their whole clip; null ids are one clip."""
    found = whole.select(F.col("clip_id").alias("_clip"), *names)
    return blocks.join(found, F.col("clip_id").eqNullSafe(F.col("_clip"))).drop("_clip")


def trim_silence_blocks(blocks: DataFrame, threshold_db: float = -45.0, keep_ms: float = 30.0) -> DataFrame:
    """As ``trim_silence``: each block tells its first and last loud sample; the blocks between stay whole, those at the ends are cut."""
    loud = F.transform("samples", lambda x: F.abs(x.cast("float")) >= F.lit(10 ** (threshold_db / 20)).cast("float"))
    first, back = (F.nullif(F.array_position(a, F.lit(True)), F.lit(0)) for a in (loud, F.reverse(loud)))
    size = F.coalesce(F.size("samples"), F.lit(0))
    told = blocks.select("clip_id", "sample_rate", (F.col("start") + first - 1).alias("_a"), (F.col("start") + size - back).alias("_z"), (F.col("start") + size).alias("_n"))
    keep = F.floor(F.lit(keep_ms / 1000) * F.first("sample_rate") + 0.5)
    whole = told.groupBy("clip_id").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"), F.max("_n").alias("_n"), keep.alias("_keep"))
    inner = F.col("_a") < F.col("_z")
    begin = F.when(inner, F.greatest(F.lit(0), F.col("_a") - F.col("_keep"))).otherwise(0)
    end = F.when(inner, F.least("_n", F.col("_z") + F.col("_keep"))).otherwise(F.col("_n"))
    rows = _with(blocks, whole.select("clip_id", begin.alias("_begin"), end.alias("_end")), ["_begin", "_end"])
    low, high = F.greatest(F.lit(0), F.col("_begin") - F.col("start")), F.least(F.col("_end") - F.col("start"), size)
    rows = rows.withColumns({"_low": low.cast("int"), "_high": high.cast("int")}).where("samples IS NULL OR _low < _high OR _end = 0")
    cut = F.slice("samples", F.col("_low") + 1, F.greatest(F.lit(0), F.col("_high") - F.col("_low")))
    moved = (F.col("start") + F.col("_low") - F.col("_begin")).cast("long")
    return rows.withColumn("samples", cut).withColumn("start", moved).drop("_begin", "_end", "_low", "_high")


def normalize_peak_blocks(blocks: DataFrame, target_db: float = -1.5) -> DataFrame:
    """As ``normalize_peak``: the clip's peak is the highest of its blocks'."""
    peak = F.max(F.array_max(F.transform("samples", lambda x: F.abs(x.cast("double")))))
    gain = F.least(F.lit(10 ** (target_db / 20)) / F.col("_peak"), F.lit(4.0))
    gain = F.when(F.col("_peak").isNull() | (F.col("_peak") == 0) | (F.abs(gain - 1) < 0.01), 1.0).otherwise(gain)
    whole = blocks.groupBy("clip_id").agg(peak.alias("_peak")).select("clip_id", gain.alias("gain"))
    return _with(blocks, whole, ["gain"]).withColumn("samples", F.transform("samples", lambda x: (x * F.col("gain")).cast("float")))


def edge_fades_blocks(blocks: DataFrame, ms: float = 5.0) -> DataFrame:
    """As ``edge_fades``, by each sample's place in its clip."""
    whole = blocks.groupBy("clip_id").agg(F.max(F.col("start") + F.coalesce(F.size("samples"), F.lit(0))).alias("_n"))
    n = F.least(F.floor(F.lit(ms / 1000) * F.col("sample_rate") + 0.5), F.floor(F.col("_n") / 2))

    def gain(i: Column) -> Column:
        edge = F.least(F.col("start") + i, F.col("_n") - 1 - F.col("start") - i)
        return F.when((n > 1) & (edge < n), 0.5 - 0.5 * F.cos(F.lit(np.pi) * edge / n)).otherwise(1.0)

    return _with(blocks, whole, ["_n"]).withColumn("samples", F.transform("samples", lambda x, i: (x * gain(i)).cast("float"))).drop("_n")
