"""Alignment of episodes whose cues are small enough for one row.

The cues of an episode are gathered into two arrays of one row and matched there:
nothing is shuffled but what brings an episode together, and tables that already
lie by episode, as those that are cut out of documents, are not shuffled at all.
The result is that of :mod:`cuespan.operators.align`, which never holds a whole
episode and is the one for episodes of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.operators.align import match_largest

CUE = ("cue_index", "text", "start_ms", "end_ms")
#: Cues of a slice of episodes, and candidate pairs of a slice of predictions.
SLICE = 1 << 19


def episodes(pred: DataFrame, ref: DataFrame, engines: Sequence[str] = ()) -> DataFrame:
    """``episode_id`` with the arrays ``refs`` and ``preds`` of its cues. With
    ``engines`` a prediction has ``run``, the place of its ``engine_id`` there."""
    # a left join would leave out null ids on one side and so read the documents of both sides apart
    run = F.array_position(F.array(*map(F.lit, engines)), F.col("engine_id")) - 1 if engines else F.lit(0)
    preds = pred.select("episode_id", run.cast("int").alias("run"), *CUE).where("run >= 0")
    gather = lambda df, name, *more: df.groupBy("episode_id").agg(F.collect_list(F.struct(*more, *CUE)).alias(name))
    both = gather(ref, "refs").join(gather(preds, "preds", "run"), "episode_id", "full_outer")
    none = lambda name: F.coalesce(name, F.filter(F.array(F.lit(None).cast(both.schema[name].dataType.elementType)), lambda x: x.isNotNull()))
    return both.select("episode_id", none("refs").alias("refs"), none("preds").alias("preds"))


def _numbers(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array of lists, and where each list begins; null is the least number."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.int64()).fill_null(np.iinfo(np.int64).min)
    return values.to_numpy(zero_copy_only=False), offsets - offsets[0]


def _edges(row_r, start_r, end_r, row_p, start_p, end_p, of_pred: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prediction, reference, overlap) of the cues of a row that share half of one's duration."""
    null = np.iinfo(np.int64).min
    rs = np.flatnonzero((start_r != null) & (end_r != null) & (end_r > start_r))
    ps = np.flatnonzero((start_p != null) & (end_p != null) & (end_p > start_p))
    empty = np.zeros(0, np.int64)
    if not len(rs) or not len(ps):
        return empty, empty, empty
    times = [start_r[rs], end_r[rs], start_p[ps], end_p[ps]]
    least, most = min(int(t.min()) for t in times), max(int(t.max()) for t in times)
    rows = int(max(row_r[-1], row_p[-1])) + 1
    if (most - least + 2) * rows < 1 << 62:
        span, at = most - least + 2, [t - least for t in times]
    else:  # places of the times among all of them stand for the times
        known = np.unique(np.concatenate(times))
        span, at = len(known) + 1, [np.searchsorted(known, t) for t in times]
    base_r, base_p = row_r[rs] * span, row_p[ps] * span
    order = np.argsort(base_r + at[0], kind="stable")
    begins, reach = (base_r + at[0])[order], np.maximum.accumulate((base_r + at[1])[order])
    low, high = np.searchsorted(reach, base_p + at[2], "right"), np.searchsorted(begins, base_p + at[3], "left")
    size = np.maximum(high - low, 0)
    ends, out, done = np.cumsum(size), [], 0
    while done < len(size):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SLICE, "right")))
        n = size[done:upto]
        p = np.repeat(np.arange(done, upto), n)
        r = order[np.repeat(low[done:upto] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        overlap = np.minimum(times[1][r], times[3][p]) - np.maximum(times[0][r], times[2][p])
        whole = times[3][p] - times[2][p] if of_pred else times[1][r] - times[0][r]
        ok = np.flatnonzero((overlap > 0) & (2 * overlap >= whole))
        out.append((ps[p[ok]], rs[r[ok]], overlap[ok]))
        done = upto
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _greedy(edges: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int]]:
    used_p, used_r, out = set(), set(), []
    for _, _, _, p, r in sorted(edges):
        if p not in used_p and r not in used_r:
            used_p.add(p)
            used_r.add(r)
            out.append((p, r))
    return out


def _largest(edges: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int]]:
    options: dict[tuple[int, int], list[int]] = {}
    for _, _, index, p, r in sorted(edges):
        options.setdefault((index, r), []).append(p)
    served = {r: preds for (_, r), preds in sorted(options.items(), key=lambda x: (len(x[1]), x[0]))}
    return [(p, r) for r, p in match_largest(served).items()]


def _matched(p: np.ndarray, r: np.ndarray, overlap: np.ndarray, index_p: np.ndarray, index_r: np.ndarray,
             island: np.ndarray, largest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a matching. Where a cue and its partners meet no others the first
    partner is taken; the rest is matched edge by edge, an ``island`` at a time."""
    ids_p, p_at = np.unique(p, return_inverse=True)
    ids_r, r_at = np.unique(r, return_inverse=True)
    deg_p, deg_r = np.bincount(p_at), np.bincount(r_at)
    most_of = lambda at, degree, n: np.maximum.reduceat(degree[np.argsort(at, kind="stable")], np.cumsum(n) - n) if len(n) else n
    one_r, one_p = most_of(r_at, deg_p[p_at], deg_r)[r_at] == 1, most_of(p_at, deg_r[r_at], deg_p)[p_at] == 1
    one_p &= ~one_r
    first_of = lambda which, at, *order: which[np.lexsort((*order[::-1], at[which]))]
    kept = []
    for which, at, by_overlap in ((np.flatnonzero(one_r), r_at, True), (np.flatnonzero(one_p), p_at, not largest)):
        size = [-overlap[which]] if by_overlap else []
        order = first_of(which, at, *size, index_p[p[which]], index_r[r[which]])
        new = np.ones(len(order), bool)
        new[1:] = at[order][1:] != at[order][:-1]
        kept.append(order[new])
    kept = np.concatenate(kept)
    out_p, out_r = [p[kept]], [r[kept]]
    rest = np.flatnonzero(~one_r & ~one_p)
    if len(rest):
        rest = rest[np.argsort(island[rest], kind="stable")]
        cuts = np.flatnonzero(np.diff(island[rest])) + 1
        solve: Callable = _largest if largest else _greedy
        for part in np.split(rest, cuts):
            pairs = solve(list(zip((-overlap[part]).tolist(), index_p[p[part]].tolist(), index_r[r[part]].tolist(), p[part].tolist(), r[part].tolist(), strict=True)))
            out_p.append(np.array([x for x, _ in pairs], np.int64))
            out_r.append(np.array([x for _, x in pairs], np.int64))
    return np.concatenate(out_p), np.concatenate(out_r)


def places(refs: Sequence[pa.Array], preds: Sequence[pa.Array], runs: int, share_of: str, how: str) -> pa.Array:
    """For every run and reference of a row, run by run, the place of its partner or null.

    ``refs`` are lists of numbers, starts and ends, ``preds`` of runs, numbers, starts and ends."""
    (index_r, first_r), (from_r, _), (to_r, _) = map(_numbers, refs)
    (run_p, first_p), (index_p, _), (from_p, _), (to_p, _) = map(_numbers, preds)
    slots = np.full(first_r[-1] * runs, -1, np.int32)
    total, low, rows = first_r + first_p, 0, len(first_r) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(total, total[low] + SLICE, "right")) - 1)
        a, b = (slice(f[low], f[high]) for f in (first_r, first_p))
        row_r, row_p = (np.repeat(np.arange(high - low), np.diff(f[low:high + 1])) for f in (first_r, first_p))
        if len(row_r) and len(row_p):
            run, index = run_p[b], index_p[b]
            p, r, overlap = _edges(row_r, from_r[a], to_r[a], row_p, from_p[b], to_p[b], share_of == "pred")
            if how == "indexed":
                same = index[p] == index_r[a][r]
                p, r, overlap = p[same], r[same], overlap[same]
            # a reference stands once for each run
            p, r = _matched(p, r * runs + run[p], overlap, index, np.repeat(index_r[a], runs), row_p[p] * runs + run[p], how == "largest")
            r, own_run = r // runs, r % runs
            own, size = row_r[r], np.diff(first_r[low:high + 1])
            at = first_r[low + own] * runs + own_run * size[own] + (r + first_r[low] - first_r[low + own])
            slots[at] = p + first_p[low] - first_p[low + own]
        low = high
    return pa.ListArray.from_arrays(pa.array(first_r * runs, pa.int32()), pa.array(slots, mask=slots < 0))


def partners(runs: int, share_of: str, how: str) -> Column:
    """``places`` of the arrays ``refs`` and ``preds``: by the largest matching (``largest``),
    by the largest overlap first (``greedy``) or by equal numbers (``indexed``)."""

    @F.arrow_udf("array<int>")
    def run(ri: pa.Array, rs: pa.Array, re: pa.Array, pg: pa.Array, pi: pa.Array, ps: pa.Array, pe: pa.Array) -> pa.Array:
        return places((ri, rs, re), (pg, pi, ps, pe), runs, share_of, how)

    return run("refs.cue_index", "refs.start_ms", "refs.end_ms", "preds.run", "preds.cue_index", "preds.start_ms", "preds.end_ms")


def scored_cues(both: DataFrame, engines: Sequence[str], how: str) -> DataFrame:
    """A row for every engine and reference cue, with its partner's columns or nulls,
    and how many predictions the engine has in the episode."""
    placed = both.withColumn("places", partners(len(engines), "ref", how))

    def cues(place: int) -> Column:
        partner = lambda i: F.get("preds", F.get("places", F.size("refs") * place + i))
        return F.transform("refs", lambda x, i: F.struct(F.lit(engines[place]).alias("engine_id"), x.alias("r"), partner(i).alias("p")))

    def count(place: int) -> Column:
        return F.size(F.filter("preds.run", lambda x: x == place))

    every = range(len(engines))
    # what a row repeats is made before it is many rows: these would carry both arrays else
    lists = placed.select("episode_id", F.flatten(F.array(*map(cues, every))).alias("cues"), F.array(*map(count, every)).alias("counts"))
    # not explode(), which would have the list made once more for a filter on its size
    rows = lists.select("episode_id", F.explode_outer("cues").alias("c"), "counts").where("c IS NOT NULL")
    counts = F.get("counts", F.array_position(F.array(*map(F.lit, engines)), F.col("c.engine_id")).cast("int") - 1)
    return rows.select("episode_id", "c.engine_id", *[F.col(f"c.r.{c}").alias(f"r_{c}") for c in CUE],
                       *[F.col(f"c.p.{c}").alias(f"p_{c}") for c in CUE], counts.cast("bigint").alias("prediction_cues"))


def greedy_pairs(both: DataFrame) -> DataFrame:
    """A row for every matched pair by the largest overlap first, as ``attach_pairs``
    gives it, and ``p_place``, its place from 0 among the episode's pairs by prediction.
    An episode without a pair is a row of nulls. ``n_preds`` and ``n_refs`` count its cues."""
    placed = both.withColumn("places", partners(1, "pred", "greedy"))
    pairs = F.array_sort(F.filter(F.transform("refs", lambda x, i: F.struct(
        F.get("preds", F.get("places", i)).getField("cue_index").alias("at"), F.get("places", i).alias("place"), x.alias("r"))), lambda x: x["place"].isNotNull()))
    lists = placed.select(
        "episode_id", F.size("preds").cast("bigint").alias("n_preds"), F.size("refs").cast("bigint").alias("n_refs"),
        F.transform(pairs, lambda x: F.struct(F.get("preds", x["place"]).alias("p"), x["r"].alias("r"))).alias("cues"))
    rows = lists.select("episode_id", "n_preds", "n_refs", F.posexplode_outer("cues").alias("p_place", "c"))
    return rows.select("episode_id", "n_preds", "n_refs", "p_place", *[F.col(f"c.p.{c}").alias(f"p_{c}") for c in CUE],
                       *[F.col(f"c.r.{c}").alias(f"r_{c}") for c in CUE])
