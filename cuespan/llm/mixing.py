"""Mixing sources to target weights by pivotal dependent rounding.

Sources share the words of the corpus by weight; no source is taken more than
``most`` times, and what it leaves goes to the others by weight. Every document
of a source then has the same fractional number of copies: a whole part, taken
by all, and a part between 0 and 1 that is rounded.

Rounding is pivotal. Two documents with open parts meet; words move from one to
the other, in the direction that a coin weighted for unchanged expectations
tells, until one of the two is taken or left. The sum of the words of a source
is thereby kept, and at most one document stays open. Leaves of a few thousand
documents, dealt out by hash, are rounded at once, large documents first, so
that what stays open is small; the open ones of 256 leaves meet in the next
level, until one document of each source is left, which is rounded to the
nearer side. The words taken from a source are off its target by no more than
half of that document.

Rows that are equal in source, doc_id, size and text are one bundle with a
count, so that a row that repeats for a third of a table is one row here.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.functions.ordered import total_rank
from cuespan.llm.common import stage

LEAF, FAN, CHUNK = 4_096, 256, 4_096
NEAR = 1e-12
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST = (1, 2, 3), 3


def _exact(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(27,0)")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to (source, source_size, ...), one row per source.

    Sources in order of their code points, null last, take ``weights`` in turn.
    A source above ``most`` times its size gives the excess to the others, until
    none is above: with x words per unit of weight, the sources above are those
    with weight * x > most * size, and x only grows from round to round.
    Comparisons are exact.
    """
    ranked = stage(total_rank(sizes, [F.col("source").asc_nulls_last()], "turn"), "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("turn") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight)
    cap = (F.col("source_size") * most).cast("decimal(27,0)")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    words, units, found = 0, 1, 0
    while True:
        full = F.col("weight").cast("decimal(11,0)") * _exact(words) > cap * F.lit(units).cast("decimal(11,0)")
        seen = ranked.agg(F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("units"),
                          F.count_if(full).alias("n")).first()
        if words and seen.n == found or not seen.units:
            break
        words, units, found = int(total - (seen.capped or 0)), int(seen.units), seen.n
        if not words:
            break
    share = F.lit(0.0)
    for w in sorted(set(weights)):
        share = F.when(F.col("weight") == w, F.lit(float(Fraction(w * words, units)))).otherwise(share)
    return ranked.withColumn("target", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(share))


def pivot(size: np.ndarray, part: np.ndarray, coin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Round open parts one after another. Returns 1 (taken), 0 (left) or -1
    (open, at most one) for each document, and the parts as they end."""
    size, part, coin = size.astype(float).tolist(), part.astype(float).tolist(), coin.tolist()
    out = [-1] * len(size)
    held = -1
    for j in range(len(size)):
        if held >= 0:
            a, b = size[held], size[j]
            x, y = part[held], part[j]
            gain, loss = min((1 - x) * a, y * b), min(x * a, (1 - y) * b)
            if coin[j] * (gain + loss) < loss:
                x, y = (1.0, y - gain / b) if gain == (1 - x) * a else (x + gain / a, 0.0)
            else:
                x, y = (0.0, y + loss / b) if loss == x * a else (x - loss / a, 1.0)
            part[held], part[j] = x, y
            if NEAR < x < 1 - NEAR:
                out[j] = round(y)
                continue
            out[held] = round(x)
        held = j if NEAR < part[j] < 1 - NEAR else -1
        if held < 0:
            out[j] = round(part[j])
    return np.array(out, np.int64), np.array(part)


def _meet(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # large ones first, in an order that does not depend on how rows arrived
        pdf = pdf.sort_values(["size", "coin", "part"], ascending=[False, True, True], ignore_index=True)
        up, part = pivot(pdf["size"].to_numpy(), pdf["part"].to_numpy(), pdf["coin"].to_numpy())
        if last:
            up = np.where(up < 0, part >= 0.5, up)
        return pdf.assign(up=up.astype("int64"), part=part)

    return run


def _coin(*columns) -> Column:
    """A number from 0 to below 1 by hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0 ** -53)


def bundles(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0,
            text: str = "text") -> DataFrame:
    """One row per (source, doc_id, size, sig): ``m`` equal rows, of which
    ``extra`` take ``base + 1`` copies and the others ``base``."""
    sized = docs.select("source", "doc_id", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                        F.xxhash64(text).alias("sig"))
    kinds = stage(sized.groupBy("source", "doc_id", "size", "sig").agg(F.count("*").alias("m")), "bundles")
    sizes = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("kinds"))
    per = stage(targets(sizes, weights, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.select(F.col("source").alias("_s"), "turn", "source_size", "target", F.floor(rate).alias("base"),
                     (rate - F.floor(rate)).alias("rest"), F.ceil(F.col("kinds") / LEAF).alias("leaves"))
    rows = kinds.join(per, kinds["source"].eqNullSafe(per["_s"])).drop("_s")
    mass = F.col("rest") * F.col("m")
    key = F.xxhash64(F.lit(seed), "source", "doc_id", "size", "sig")
    rows = (rows.withColumn("extra", F.floor(mass + NEAR)).withColumn("part", F.greatest(mass - F.col("extra"), F.lit(0.0)))
            .withColumn("leaf", F.pmod(key, F.col("leaves"))).withColumn("coin", _coin(key, F.lit("coin"))))
    is_open = (F.col("size") > 0) & (F.col("part") > NEAR)
    whole = rows.where(~is_open).withColumn("up", F.lit(0).cast("long"))
    started = rows.where(is_open)
    met = stage(started.groupBy("turn", "leaf").applyInPandas(
        _meet(False), ", ".join(f"`{n}` {t}" for n, t in started.dtypes) + ", up long"), "leaves")

    now, done, level = met.where("up < 0").select("turn", "leaf", "size", "part", "coin"), None, 0
    most_leaves = per.agg(F.max("leaves")).first()[0] or 1
    while True:  # each level, 256 open documents of a source meet
        level += 1
        last = FAN ** level >= most_leaves
        group = F.floor(F.col("leaf") / FAN ** level) if not last else F.lit(0)
        turned = now.withColumn("coin", _coin(F.col("coin"), F.lit(level))).withColumn("group", group)
        now = stage(turned.groupBy("turn", "group").applyInPandas(
            _meet(last), "turn long, leaf long, size long, part double, coin double, group long, up long"), "residuals").drop("group")
        settled = now.where("up >= 0").select("turn", "leaf", "up")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        now = now.where("up < 0").drop("up")
    met = met.where("up >= 0").unionByName(met.where("up < 0").drop("up").join(done, ["turn", "leaf"]))
    return (whole.unionByName(met).withColumn("extra", F.col("extra") + F.col("up"))
            .select("source", "doc_id", "size", "sig", "m", "source_size", "target", "base", "extra"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0, text: str = "text") -> DataFrame:
    """How often each document is taken: doc_id, size, source_size, target, taken
    (words, repeats counted), source, copies; one row per row of ``docs``.

    Null or wordless texts have size 0 and take nothing. A null source is a
    source, the last one. Equal rows are rows of their own; which of them take
    the copy more is one result, as they cannot be told apart. A null doc_id is
    a value. Only doc_id, source and the text are read, so other columns may
    have any name. An empty table gives no rows. Another run gives the same
    rows, however the table is split into files.
    """
    rows = bundles(docs, weights, most, seed, text)
    few = rows.where(F.col("m") <= CHUNK).withColumn("chunk", F.lit(0).cast("long"))
    many = (rows.where(F.col("m") > CHUNK).withColumn("chunk", F.explode(F.expr(f"sequence(0L, (m - 1) div {CHUNK})")))
            .repartition("sig", "chunk"))
    each = few.unionByName(many).withColumn(
        "i", F.explode(F.expr(f"sequence(chunk * {CHUNK} + 1, least(m, (chunk + 1) * {CHUNK}))")))
    copies = F.col("base") + (F.col("i") <= F.col("extra")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source",
                       copies.alias("copies"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0, text: str = "text") -> DataFrame:
    """The mixed corpus itself: the rows of ``docs``, each as often as it is taken,
    with all their columns. Rows of a bundle are told apart by nothing that is
    read here, so ``extra`` more copies are spread over whichever of them come first."""
    plan = bundles(docs, weights, most, seed, text).select(
        F.struct("source", "doc_id", "size", "sig").alias("_kind"), "base", "extra", "m")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"), F.struct("source", "doc_id", size.alias("size"), F.xxhash64(text).alias("sig")).alias("_kind"))
    one = F.expr("explode(array_repeat(0, CAST(base AS int)))")
    every = rows.join(plan, rows["_kind"].eqNullSafe(plan["_kind"])).select("_row", rows["_kind"].alias("_kind"), "base", "extra")
    taken = every.select("_row", one.alias("_n")).select("_row")
    more = (every.where("extra > 0").groupBy("_kind").agg(F.first("_row").alias("_row"), F.first("extra").alias("extra"))
            .withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (extra - 1) div {CHUNK})")))
            .select("_row", F.explode(F.expr(f"sequence(_chunk * {CHUNK} + 1, least(extra, (_chunk + 1) * {CHUNK}))")).alias("_n")))
    return taken.unionByName(more.select("_row")).select("_row.*")
