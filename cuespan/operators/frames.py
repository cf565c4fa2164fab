"""Segments from frame features: bit masks and fill counts, not pixels.

A mask is an array of 60-bit words, one row per frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions.ordered import adjacent_islands, fold_sorted, with_neighbours
from cuespan.operators.cleanup import upper_median


def _bits(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w))


def fill(mask: Column) -> Column:
    return _bits(mask)


def xor_ratio(a: Column, b: Column) -> Column:
    union = _bits(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    differs = _bits(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)))
    return F.when(union > 0, differs / union).otherwise(F.lit(0.0))


def frame_segments(frames: DataFrame, limit: float, min_fill: int = K.FRAME_MIN_FILL, min_frames: int = 1,
                   keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Runs of filled frames, cut where the mask moves away from the frame before
    or from the first frame of the segment: (keys, start_f, end_f).

    The first cut needs neighbours only; the second is folded inside those runs.
    """
    keys = list(keys)
    n = len(keys)
    filled = frames.withColumn("fill", fill(F.col("mask"))).where(F.col("fill") >= min_fill)
    together = lambda a, b: (b["frame_no"] == a["frame_no"] + 1) & (xor_ratio(b["mask"], a["mask"]) <= limit)
    runs = adjacent_islands(filled, keys, ["frame_no"], ["frame_no", "mask"], together, "_run")

    def close(state: list) -> list[tuple]:
        _, row = state
        return [tuple(row)] if row[n + 1] - row[n] + 1 >= min_frames else []

    def fold(rows: list[tuple], state: list | None) -> tuple[list[tuple], list]:
        out = []
        for row in rows:  # state: the first mask of the segment, and the segment so far
            frame, mask = row[n], row[n + 1]
            if state is not None:
                union = sum((int(x) | int(y)).bit_count() for x, y in zip(mask, state[0]))
                moved = sum((int(x) ^ int(y)).bit_count() for x, y in zip(mask, state[0]))
                if union and moved / union > limit:
                    out += close(state)
                    state = None
            if state is None:
                state = [mask, [*row[:n], frame, frame]]
            state[1][n + 1] = frame
        return out, state

    types = dict(frames.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "start_f bigint, end_f bigint"])
    return fold_sorted(runs.select(*keys, "frame_no", "mask", "_run"), [*keys, "_run"], ["frame_no"], fold, schema, close)


def fade_refine(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Move a segment's start to its first well-filled frame.

    ``frames``: ``keys`` (of a segment), ``frame_no, fill``. Only segments of three
    frames or more that begin below 0.7 of their upper median move.
    """
    keys = list(keys)
    stats = frames.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("frame_no").alias("start_f"), F.min_by("fill", "frame_no").alias("first_fill"),
        upper_median("fill").cast("double").alias("median"))
    late = stats.where((F.col("n") >= 3) & (F.col("median") > 0) & (F.col("first_fill") < K.FADE_SHARE * F.col("median")))
    reached = (frames.join(late.select(*keys, "median"), keys).where(F.col("fill") >= K.FADE_SHARE * F.col("median"))
               .groupBy(*keys).agg(F.min("frame_no").alias("refined_f")))
    return stats.join(reached, keys, "left").select(
        *keys, F.coalesce("refined_f", "start_f").alias("start_f"), F.col("refined_f").isNotNull().alias("moved"))


def static_pixels(frames: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Bits that were set at some time and never changed: (keys, word_no, static)."""
    keys = list(keys)
    near = with_neighbours(frames.select(*keys, "frame_no", "mask"), keys, ["frame_no"], ["mask"])
    words = near.select(*keys, F.posexplode(F.zip_with(
        "mask", F.coalesce("prev.mask", "mask"), lambda x, y: F.struct(x.alias("w"), x.bitwiseXOR(y).alias("d")))).alias("word_no", "s"))
    folded = words.groupBy(*keys, "word_no").agg(F.bit_or("s.w").alias("seen"), F.bit_or("s.d").alias("changed"))
    return folded.select(*keys, "word_no", F.col("seen").bitwiseAND(F.bitwise_not("changed")).alias("static"))
