"""Read-only quality warnings on cue tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions import text as tx
from cuespan.functions.ordered import with_neighbours
from cuespan.operators.align import first_per_key
from cuespan.operators.intervals import overlap_pairs


def lint_cues(cues: DataFrame, cps: float = K.CPS_LIMIT, shortest_ms: int = K.MIN_CUE_MS,
              longest_ms: int = K.MAX_CUE_MS) -> DataFrame:
    """One row per warning; a threshold of zero switches its rule off."""
    duration = F.col("end_ms") - F.col("start_ms")
    speed = tx.visible_chars(F.col("text")) * 1000 / duration

    def warn(rule: str, condition: Column, value: Column) -> Column:
        return F.when(condition, F.struct(F.lit(rule).alias("rule"), value.cast("double").alias("value")))

    rules = []
    if cps > 0:
        rules.append(warn("cps", speed > cps, speed))
    if shortest_ms > 0:
        rules.append(warn("short", duration < shortest_ms, duration))
    if longest_ms > 0:
        rules.append(warn("long", duration > longest_ms, duration))
    if not rules:
        rules = [F.lit(None).cast("struct<rule:string,value:double>")]
    return (cues.select("episode_id", "cue_index", F.explode(F.array_compact(F.array(*rules))).alias("w"))
            .select("episode_id", "cue_index", "w.*"))


def chronology(cues: DataFrame) -> DataFrame:
    """Cues that start before the cue in front of them in file order."""
    near = with_neighbours(cues, ["episode_id"], ["cue_index"], ["cue_index", "start_ms"])
    return near.where(F.col("start_ms") < F.col("prev.start_ms")).select(
        "episode_id", "cue_index", F.col("prev.cue_index").alias("previous_index"), "start_ms",
        F.col("prev.start_ms").alias("previous_start_ms"))


def overlap_report(cues: DataFrame, detail: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(overlapping pairs, exact totals). ``detail`` keeps so many pairs per file
    for a short report; without it every pair is returned."""
    pairs = overlap_pairs(cues)
    order = [F.col(c) for c in ("second_start_ms", "second_index", "first_start_ms", "first_index")]
    totals = pairs.groupBy("episode_id").agg(F.count("*").alias("overlap_pairs"))
    if detail is None:
        return pairs, totals.withColumn("not_detailed", F.lit(0).cast("bigint"))
    return first_per_key(pairs, ["episode_id"], order, detail), totals.withColumn(
        "not_detailed", F.greatest(F.col("overlap_pairs") - detail, F.lit(0)))


def end_clamp(blocks: DataFrame, fps: Column | float, keys: Sequence[str] = ("video_id",),
              order: str = "block_no") -> DataFrame:
    """Emitted times of the writer: a cue ends at the latest where the next starts."""
    fps = F.lit(fps) if isinstance(fps, (int, float)) else fps
    near = with_neighbours(blocks, keys, [order], ["start_f"])
    start, raw = F.col("start_f") / fps, (F.col("end_f") + 1) / fps
    ms = lambda seconds: F.bround(seconds * 1000).cast("bigint")
    emitted = F.least(raw, F.col("next.start_f") / fps)
    return near.select(
        *blocks.columns, ms(start).alias("start_ms"), ms(emitted).alias("end_ms"), ms(raw).alias("raw_end_ms"),
        F.when(raw > emitted, F.bround((raw - emitted) * 1000, 3)).alias("clamp_delta_ms"))
