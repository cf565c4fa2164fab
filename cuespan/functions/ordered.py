"""Order-dependent operators that do not need a whole key in one task.

A window over ``PARTITION BY episode ORDER BY ...`` sorts an entire episode in
one task, which fails when one episode holds a third of the table. Running
values are associative, so they are computed in two levels instead: inside
chunks of the key, then over one summary row per chunk, then combined.

Folds whose state feeds the next step run over groups that were cut at places
no state can cross; groups are streamed out of sorted partitions, so a Python
call handles a whole Arrow batch of groups and holds one group at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespan.session import cut_lineage, spread

CHUNK_ROWS = 4096


def chunk_of(order: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a unique integer position: at most ``rows`` rows each."""
    return F.floor(F.col(order) / rows)


_WINDOWED: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "max": F.max, "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _order(order: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in order]


def _before(part: Sequence[str], order: Sequence[str], inclusive: bool = False):
    return (Window.partitionBy(*part).orderBy(*_order(order))
            .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))


def _latest(value: Column, order: Sequence[str]) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def prefix_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                scans: dict[str, tuple[str, Column]], *, chunk: Column | None = None,
                inclusive: bool = False) -> DataFrame:
    """Add running values per key without gathering the key in one task.

    ``order`` must be unique per key and ``chunk`` must not decrease along it.
    ``scans`` maps an output name to (sum | max | min | last, value); ``last``
    skips nulls.
    """
    names = list(scans)
    part = [*keys, "_chunk"]
    base = df.withColumn("_chunk", chunk_of(order[-1]) if chunk is None else chunk)
    base = base.withColumns({f"_v_{n}": value for n, (_, value) in scans.items()})
    inside = _before(part, order, inclusive)
    local = base.withColumns({
        f"_l_{n}": _WINDOWED[kind](F.col(f"_v_{n}")).over(inside) for n, (kind, _) in scans.items()})

    def total(name: str, kind: str) -> Column:
        value = F.col(f"_v_{name}")
        return _latest(value, order) if kind == "last" else _WINDOWED[kind](value)

    totals = base.groupBy(*part).agg(*[total(n, kind).alias(f"_t_{n}") for n, (kind, _) in scans.items()])
    earlier = _before(keys, ["_chunk"])
    carried = totals.select(*part, *[
        _WINDOWED[kind](F.col(f"_t_{n}")).over(earlier).alias(f"_c_{n}") for n, (kind, _) in scans.items()])
    # the first chunk of a key carries nothing: most keys leave no row here
    carried = carried.where(reduce(lambda a, b: a | b, [F.col(f"_c_{n}").isNotNull() for n in names]))

    def combine(name: str, kind: str) -> Column:
        carry, own = F.col(f"_c_{name}"), F.col(f"_l_{name}")
        if kind == "sum":
            return F.when(carry.isNull(), own).otherwise(carry + F.coalesce(own, F.lit(0)))
        return {"max": F.greatest, "min": F.least}.get(kind, lambda c, o: F.coalesce(o, c))(carry, own)

    out = local.join(carried, part, "left")
    return out.select(*df.columns, *[combine(n, kind).alias(n) for n, (kind, _) in scans.items()])


def with_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    columns: Sequence[str], *, chunk: Column | None = None) -> DataFrame:
    """Add structs ``prev`` and ``next`` of the neighbouring rows of a key."""
    part = [*keys, "_chunk"]
    base = df.withColumn("_chunk", chunk_of(order[-1]) if chunk is None else chunk)
    row = F.struct(*columns)
    along = Window.partitionBy(*part).orderBy(*_order(order))
    local = base.withColumns({"_prev": F.lag(row).over(along), "_next": F.lead(row).over(along)})
    ends = base.groupBy(*part).agg(F.min_by(row, F.struct(*order)).alias("_first"),
                                   F.max_by(row, F.struct(*order)).alias("_last"))
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    edges = (ends.select(*part, F.lag("_last").over(chunks).alias("_from_left"),
                         F.lead("_first").over(chunks).alias("_from_right"))
             .where("_from_left IS NOT NULL OR _from_right IS NOT NULL"))
    return (local.join(edges, part, "left")
            .select(*df.columns, F.coalesce("_prev", "_from_left").alias("prev"),
                    F.coalesce("_next", "_from_right").alias("next")))


def adjacent_islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                     joined: Callable[[Column, Column], Column], name: str = "island",
                     chunk: Column | None = None) -> DataFrame:
    """Label runs of consecutive rows; a run is named by its first position.

    ``joined(previous, current)`` says whether two neighbours belong together;
    both are structs of ``columns``. The label is the last order column.
    """
    part = [*keys, "_chunk"]
    base = df.withColumn("_chunk", chunk_of(order[-1]) if chunk is None else chunk)
    row, position = F.struct(*columns), F.col(order[-1])
    along = Window.partitionBy(*part).orderBy(*_order(order))
    base = base.withColumn("_before", F.lag(row).over(along))
    starts = F.when(F.col("_before").isNotNull()
                    & ~F.coalesce(joined(F.col("_before"), row), F.lit(False)), position)
    base = base.withColumn("_start", starts)
    local = base.withColumn("_local", F.last("_start", ignorenulls=True).over(_before(part, order, True)))
    ends = base.groupBy(*part).agg(
        F.min_by(row, F.struct(*order)).alias("_first"), F.min_by(position, F.struct(*order)).alias("_first_at"),
        F.max_by(row, F.struct(*order)).alias("_last"), _latest(F.col("_start"), order).alias("_own"))
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    left = F.lag("_last").over(chunks)
    opened = ends.withColumn("_left", left).withColumn(
        "_opens", F.when(F.col("_left").isNull() | ~F.coalesce(joined(F.col("_left"), F.col("_first")), F.lit(False)),
                         F.col("_first_at")))
    carried = opened.select(*part, F.coalesce(
        "_opens", F.last(F.coalesce("_own", "_opens"), ignorenulls=True).over(_before(keys, ["_chunk"]))).alias("_carry"))
    return (local.join(carried, part)
            .select(*df.columns, F.coalesce("_local", "_carry").alias(name)))


def interval_islands(df: DataFrame, keys: Sequence[str], start: str, end: str, ties: Sequence[str],
                     chunk: Column, name: str = "island", slack: Column | int = 0) -> DataFrame:
    """Label groups of rows that time gaps separate; a group is named by its start.

    A row opens a group when it starts at or after every earlier end plus
    ``slack``. Starts grow along the order, so of all rows of a chunk that open
    a group locally, those after the carried end open one globally.
    """
    part, order = [*keys, "_chunk"], [start, *ties]
    base = df.withColumn("_chunk", chunk).withColumn("_reach", F.col(end) + slack)
    base = base.withColumn("_local_reach", F.max("_reach").over(_before(part, order)))
    opens = F.when(F.col("_local_reach").isNull() | (F.col(start) >= F.col("_local_reach")), F.col(start))
    base = base.withColumn("_open", opens)
    local = base.withColumn("_local", F.max("_open").over(_before(part, order, True)))
    totals = base.groupBy(*part).agg(F.max("_reach").alias("_far"), F.max("_open").alias("_own"))
    earlier = _before(keys, ["_chunk"])
    reached = totals.withColumn("_max", F.max("_far").over(earlier))
    own = F.when(F.col("_max").isNull() | (F.col("_own") >= F.col("_max")), F.col("_own"))
    carried = (reached.withColumn("_group", own)
               .select(*part, "_max", F.last("_group", ignorenulls=True).over(earlier).alias("_carry"))
               .where("_max IS NOT NULL"))
    here = F.when(F.col("_max").isNull() | (F.col("_local") >= F.col("_max")), F.col("_local"))
    return local.join(carried, part, "left").select(*df.columns, F.coalesce(here, "_carry").alias(name))


def total_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the place, from 1, of every row in one order over the whole table.

    Rows are dealt out by ranges of ``order`` (Spark samples the splitters), then
    numbered inside their range; ranges are counted and summed up before them.
    Rows that are equal in ``order`` are split too, so a value that holds a third
    of the table fills no task. Ranks of equal rows are in no stated order: give
    an order that tells rows apart where that matters.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tagged.repartitionByRange(width, *order, F.col("_tie")).sortWithinPartitions(*order, "_tie")
    numbered = cut_lineage(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id())
                           .withColumn("_range", F.shiftright("_at", 33)))
    counts = numbered.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_start"))  # one row per range
    place = F.col("_at") - F.shiftleft(F.col("_range"), 33) + F.col("_start") + 1
    return numbered.join(starts, "_range").select(*df.columns, place.alias(name))


QUANTILE_BINS = 1_024


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str = "quantile") -> DataFrame:
    """The interpolated quantile of each key, from counts in narrowing ranges.

    A round counts the values of a range in 1,024 bins and goes on with the bin
    that holds the wanted rank, from its least to its greatest value, until both
    are equal. State is 1,024 counts per key, however many values a key has.
    Nulls are left out; a key without values gives null. Values must be numbers.
    """
    keys = list(keys)
    values = df.select(*keys, F.col(value).cast("double").alias("_x"))
    ends = values.groupBy(*keys).agg(F.count("_x").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    place = F.lit(float(share)) * (F.col("_n") - 1)
    ends = cut_lineage(ends.withColumn("_place", place))
    ranks = F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))
    wanted = cut_lineage(ends.where("_n > 0").select(*keys, F.explode(ranks).alias("_rank"), "_lo", "_hi").withColumn("_left", F.col("_rank")))
    same = reduce(lambda a, b: a & b, [F.col(f"_v.{k}").eqNullSafe(F.col(f"_w.{k}")) for k in keys], F.lit(True))
    while not wanted.where("_lo < _hi").isEmpty():
        open_ = wanted.where("_lo < _hi")
        inside = values.alias("_v").join(open_.alias("_w"), same & F.col("_x").between(F.col("_lo"), F.col("_hi"))).select(
            *[F.col(f"_w.{k}").alias(k) for k in keys], "_rank", "_left", "_x", "_lo", "_hi")
        # halves, so that a range wider than the largest double has bins too; the
        # greatest value has a bin of its own, so every round narrows the range
        part = F.try_divide(F.col("_x") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
        bin_ = F.when(F.col("_x") == F.col("_hi"), QUANTILE_BINS).otherwise(F.coalesce(F.floor(part * (QUANTILE_BINS - 1)), F.lit(0)))
        bins = inside.withColumn("_bin", bin_).groupBy(*keys, "_rank", "_left", "_bin").agg(
            F.count("*").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        before = F.coalesce(F.sum("_c").over(_before([*keys, "_rank"], ["_bin"])), F.lit(0))
        hit = (bins.withColumn("_b", before).where((F.col("_left") >= F.col("_b")) & (F.col("_left") < F.col("_b") + F.col("_c")))
               .select(*keys, "_rank", "_lo", "_hi", (F.col("_left") - F.col("_b")).alias("_left")))
        wanted = cut_lineage(wanted.where("_lo = _hi").unionByName(hit))
    found = wanted.groupBy(*keys).agg(F.min("_lo").alias("_one"), F.max("_lo").alias("_two"))
    both = ends.alias("_v").join(found.alias("_w"), same, "left").select(*[F.col(f"_v.{k}").alias(k) for k in keys], "_place", "_one", "_two")
    up = F.col("_place") - F.floor("_place")
    return both.select(*keys, F.when(up == 0, F.col("_one")).otherwise((1 - up) * F.col("_one") + up * F.col("_two")).alias(name))


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Callable, schema: str,
                close: Callable[[object], list[tuple]] | None = None) -> DataFrame:
    """Run ``fold`` over the rows of each group, in order.

    Rows arrive as tuples in column order. Groups stream out of partitions that
    are sorted by key. With ``close``, a group streams too: ``fold(rows, state)``
    gets the rows of one Arrow batch and returns its output and the state for the
    next (None at first), and ``close(state)`` ends the group, so a group of any
    size is held as a batch and a state. Without it, ``fold(rows)`` gets the whole
    group.
    """
    keys, columns = list(keys), df.columns
    at = [columns.index(k) for k in keys]
    names = [field.split()[0].strip("`") for field in _fields(schema)]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame.from_records(rows, columns=names)

    def run(batches):
        current, group, done, state = None, [], [], None

        def end():
            if close is None:
                return fold(group)
            out, last = fold(group, state) if group else ([], state)
            return [*out, *close(last)]

        for pdf in batches:
            lists = [pdf[c].array.tolist() if hasattr(pdf[c].array, "tolist") else list(pdf[c]) for c in columns]
            for row in zip(*lists):
                key = tuple(row[i] for i in at)
                if key != current:
                    if current is not None:
                        done.extend(end())
                    current, group, state = key, [], None
                group.append(row)
            if close is not None and group:
                out, state = fold(group, state)
                done.extend(out)
                group = []
            if done:
                yield frame(done)
                done = []
        if current is not None:
            done = end()
            if done:
                yield frame(done)

    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL schema string."""
    fields, depth, piece = [], 0, ""
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            fields.append(piece.strip())
            piece = ""
        else:
            piece += ch
    return [*fields, piece.strip()]
