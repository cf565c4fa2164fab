"""Interval joins over cue and block times.

A bare overlap predicate has no equality to shuffle on, and equality on the
episode alone compares all cues of an episode with each other. Intervals are
therefore spread over time buckets and joined on (key, bucket); a pair is kept
only in the first bucket both sides share, so no ``distinct`` is needed.

Buckets have dyadic levels. An interval is at home on the level whose buckets
are about as long as it is, where it fills one or two (up to eight on the lowest
level). Of a pair the longer interval is at home and the shorter one visits its
level, again in one or two buckets; only levels on which the other side has
intervals are visited. All short intervals of an episode visit the bucket of one
that is as long as the episode, so visitors are dealt out by their start and the
interval at home stands in every part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.functions.times import overlap_ms

BUCKET_MS = 10_000
BASE, PARTS = 8, 256
_PLACE = ["_role", "_level", "_bucket", "_part"]


def _fine(start: str, end: str, width: int) -> tuple[Column, Column]:
    return F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)


def _level(start: str, end: str, width: int) -> Column:
    first, last = _fine(start, end, width)
    return F.greatest(F.ceil(F.log2((last - first + 1) / BASE)), F.lit(0)).cast("int")


def _levels(df: DataFrame, span: tuple[str, str], width: int) -> Column:
    """The levels on which a table has intervals: a few numbers."""
    return df.where(F.col(span[1]) > F.col(span[0])).select(F.collect_set(_level(*span, width))).scalar()


def _parts(level: Column) -> Column:
    return F.when(level == 0, F.lit(1)).otherwise(F.least(F.lit(BASE) * F.pow(F.lit(2.0), level), F.lit(PARTS)).cast("int"))


def _spread(df: DataFrame, span: tuple[str, str], width: int, others: Column, leads: bool) -> DataFrame:
    """One row per place. In role 0 the left side is at home and the right side
    visits, on its own level too; in role 1 the right side is at home."""
    start, end = span
    first, _ = _fine(start, end, width)
    home, guest = (0, 1) if leads else (1, 0)

    def filled(level: Column, part) -> Column:
        size = F.when(level == 0, F.lit(width).cast("double")).otherwise(F.lit(width * BASE).cast("double") * F.pow(F.lit(2.0), level))
        begin = F.floor(F.col(start) / size)
        return F.transform(F.sequence(begin, F.floor((F.col(end) - 1) / size)), lambda b: part(level, b, begin))

    def place(role: int, level: Column, bucket: Column, part: Column, begin: Column) -> Column:
        return F.struct(F.lit(role).alias("_role"), level.alias("_level"), bucket.alias("_bucket"),
                        part.cast("int").alias("_part"), begin.alias("_first"))

    own = F.col("_own")
    wanted = F.exists("_others", (lambda o: o <= own) if leads else (lambda o: o < own))
    at_home = F.flatten(filled(own, lambda level, b, begin: F.transform(
        F.sequence(F.lit(0), _parts(own) - 1), lambda part: place(home, level, b, part, begin))))
    visited = F.filter("_others", (lambda o: o > own) if leads else (lambda o: o >= own))
    visits = F.flatten(F.transform(visited, lambda o: filled(o, lambda level, b, begin: place(
        guest, level, b, F.pmod(first, _parts(level)), begin))))
    none = F.filter(at_home, lambda _: F.lit(False))
    return (df.where(F.col(end) > F.col(start)).withColumns({"_own": _level(start, end, width), "_others": others})
            .withColumn("_stand", F.explode(F.concat(F.when(wanted, at_home).otherwise(none), visits)))
            .select(*df.columns, "_stand.*"))


def _short(df: DataFrame, span: tuple[str, str], width: int) -> bool:
    """Whether every interval of a table is of the lowest level."""
    first, last = _fine(*span, width)
    most = df.where(F.col(span[1]) > F.col(span[0])).agg(F.max(last - first + 1)).first()[0]
    return most is None or most <= BASE


def _filled(df: DataFrame, span: tuple[str, str], width: int) -> DataFrame:
    """One row per bucket of the lowest level."""
    first, last = _fine(*span, width)
    return (df.where(F.col(span[1]) > F.col(span[0])).withColumns({"_first": first, "_last": last})
            .select(*df.columns, "_first", F.explode(F.sequence("_first", "_last")).alias("_bucket")))


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                  left_span: tuple[str, str], right_span: tuple[str, str],
                  width: int = BUCKET_MS) -> DataFrame:
    """All pairs with equal ``keys`` whose half-open spans overlap, once each.

    Apart from the keys, both sides must use different column names. Spans that
    are empty or have a null end meet nothing.
    """
    if _short(left, left_span, width) and _short(right, right_span, width):
        place = ["_bucket"]
        a, b = _filled(left, left_span, width), _filled(right, right_span, width)
    else:
        place = _PLACE
        a = _spread(left, left_span, width, _levels(right, right_span, width), True)
        b = _spread(right, right_span, width, _levels(left, left_span, width), False)
    a, b = a.withColumnRenamed("_first", "_a_first"), b.withColumnRenamed("_first", "_b_first")
    return (a.join(b, [*keys, *place])
            .where((F.col("_bucket") == F.greatest("_a_first", "_b_first"))
                   & (F.col(left_span[0]) < F.col(right_span[1]))
                   & (F.col(right_span[0]) < F.col(left_span[1])))
            .drop(*place, "_a_first", "_b_first"))


def renamed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns])


def overlap_candidates(pred: DataFrame, ref: DataFrame, keys: Sequence[str] = ("episode_id",),
                       share_of: str = "pred", min_share: tuple[int, int] = (1, 2)) -> DataFrame:
    """Cue pairs that overlap by at least half of one side's duration.

    Quality reports divide by the predicted cue, evaluations by the reference
    cue; ``share_of`` says which. Columns come back as ``p_*`` and ``r_*``.
    """
    p, r = renamed(pred, "p_", keys), renamed(ref, "r_", keys)
    pairs = interval_join(p, r, keys, ("p_start_ms", "p_end_ms"), ("r_start_ms", "r_end_ms"))
    overlap = overlap_ms(F.col("p_start_ms"), F.col("p_end_ms"), F.col("r_start_ms"), F.col("r_end_ms"))
    side = "p" if share_of == "pred" else "r"
    duration = F.col(f"{side}_end_ms") - F.col(f"{side}_start_ms")
    up, down = min_share
    return pairs.withColumn("overlap_ms", overlap).where(F.col("overlap_ms") * down >= duration * up)


def overlap_pairs(cues: DataFrame, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Every overlapping pair of cues of one file, adjacent or not."""
    a, b = renamed(cues, "a_", keys), renamed(cues, "b_", keys)
    pairs = interval_join(a, b, keys, ("a_start_ms", "a_end_ms"), ("b_start_ms", "b_end_ms"))
    earlier = (F.col("a_start_ms") < F.col("b_start_ms")) | (
        (F.col("a_start_ms") == F.col("b_start_ms")) & (F.col("a_cue_index") < F.col("b_cue_index")))
    return pairs.where(earlier).select(
        *keys, F.col("a_cue_index").alias("first_index"), F.col("b_cue_index").alias("second_index"),
        F.col("a_start_ms").alias("first_start_ms"), F.col("b_start_ms").alias("second_start_ms"),
        (F.least("a_end_ms", "b_end_ms") - F.col("b_start_ms")).alias("overlap_ms"))


def overlap_count(blocks: DataFrame, others: DataFrame, keys: Sequence[str], block_id: Sequence[str],
                  span: tuple[str, str], other_span: tuple[str, str], width: int = BUCKET_MS) -> DataFrame:
    """How many ``others`` overlap each block; zero is reported too."""
    o = renamed(others.select(*keys, *other_span), "o_", keys)
    hits = interval_join(blocks.select(*keys, *block_id, *span), o, keys, span,
                         ("o_" + other_span[0], "o_" + other_span[1]), width)
    counted = hits.groupBy(*keys, *block_id).agg(F.count("*").alias("n_overlaps"))
    return (blocks.join(counted, [*keys, *block_id], "left")
            .withColumn("n_overlaps", F.coalesce("n_overlaps", F.lit(0).cast("bigint"))))


def started_in(df: DataFrame, ranges: DataFrame, at: Column, keys: Sequence[str],
               row_id: Sequence[str], width: int = BUCKET_MS) -> tuple[DataFrame, DataFrame]:
    """Split rows by whether they start inside any of the half-open ranges.

    ``ranges`` holds the keys and ``range_start_ms``, ``range_end_ms``.
    """
    points = df.select(*keys, *row_id, at.alias("_at")).withColumn("_to", F.col("_at") + 1)
    inside = interval_join(points, ranges, keys, ("_at", "_to"), ("range_start_ms", "range_end_ms"), width)
    marked = inside.select(*keys, *row_id).distinct()
    return df.join(marked, [*keys, *row_id], "left_anti"), df.join(marked, [*keys, *row_id], "left_semi")
