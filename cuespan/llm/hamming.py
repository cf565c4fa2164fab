"""Exact top-k search in Hamming space by incremental multi-index hashing.

A code of 64 bits is cut into segments, and each segment is an index of its own.
If two codes differ in at most r bits, some segment differs in at most r divided
by the number of segments. So all segments are probed at radius 0, 1, 2, ... :
after radius a every code within segments * (a + 1) - 1 bits has been met, and a
query is done once its k-th verified distance lies within that.

Rows are cut into blocks, and queries into groups. Each task builds the indexes of
one block and answers one group on it; the nearest of all blocks are then ranked.
What is held at once is a block, its indexes and the probes of a slice of queries.

Of rows with the same code only the k + 1 smallest ids can be among the k nearest
of any row, so the others go first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespan.llm.common import stage, width

BITS = 64
BLOCK_ROWS = 1 << 20
GROUP_QUERIES = 512
#: Probes, and met codes, of a slice of queries.
SLICE = 1 << 20


def sign_code(vector: str) -> Column:
    """Bit i is set where the sum of components i, i + 64, i + 128, ... is
    positive; null for a null vector and for one with a null or NaN component."""
    clean = f"NOT exists({vector}, x -> x IS NULL OR isnan(x))"
    bits = (f"aggregate(sequence(0, {BITS - 1}), 0L, (code, i) -> code | shiftleft(cast(coalesce(aggregate("
            f"filter({vector}, (x, j) -> j % {BITS} = i), 0D, (s, x) -> s + x), 0D) > 0 AS bigint), i))")
    return F.expr(f"CASE WHEN {vector} IS NOT NULL AND {clean} THEN {bits} END")


def cuts(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def best_segments(rows: int, k: int) -> int:
    """The number of segments whose probes and candidates are expected to be
    fewest, for codes spread evenly: the radius is where k of them are met."""
    near, radius = 0.0, 0
    while near < k and radius < BITS:
        near, radius = near + rows * comb(BITS, radius) / 2 ** BITS, radius + 1

    def cost(segments: int) -> float:
        width, reach = BITS / segments, ceil(radius / segments)
        probes = sum(comb(ceil(width), i) for i in range(reach))
        return segments * probes * (1 + rows / 2 ** width)

    return min(range(3, 17), key=cost)  # at most 22 bits: a query far from all rows has bounded probes


def masks(width: int, radius: int) -> np.ndarray:
    return np.fromiter((sum(1 << b for b in bits) for bits in combinations(range(width), radius)), np.uint64, comb(width, radius))


class Block:
    """The rows of a block, by id, and an index of them for each segment."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, segments: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes, self.places = ids[order], codes[order], cuts(segments)
        self.rows, self.values, self.starts = [], [], []
        for at in range(segments):
            value = self.segment(at, self.codes)
            rows = np.argsort(value, kind="stable").astype(np.int32)
            held, first = np.unique(value[rows], return_index=True)
            self.rows.append(rows)
            self.values.append(held)
            self.starts.append(np.append(first, len(rows)))

    def segment(self, at: int, codes: np.ndarray) -> np.ndarray:
        shift, bits = self.places[at]
        return codes >> np.uint64(shift) & np.uint64((1 << bits) - 1)

    def met(self, at: int, radius: int, codes: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, distance) of the rows within ``bound`` whose segment differs in just ``radius`` bits."""
        flips = masks(self.places[at][1], radius)
        own = self.segment(at, codes)
        for first in range(0, len(flips), SLICE):
            part = flips[first:first + SLICE]
            step = max(1, SLICE // len(part))
            for low in range(0, len(codes), step):
                asked = (own[low:low + step, None] ^ part).ravel()
                place = np.minimum(np.searchsorted(self.values[at], asked), len(self.values[at]) - 1)
                hit = np.flatnonzero(self.values[at][place] == asked)
                place, query = place[hit], low + hit // len(part)
                begin, size = self.starts[at][place], self.starts[at][place + 1] - self.starts[at][place]
                ends = np.cumsum(size)
                done = 0
                while done < len(size):  # a common value meets many rows
                    upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SLICE, "right")))
                    n, at_once = size[done:upto], slice(done, upto)
                    row = self.rows[at][np.repeat(begin[at_once] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    asker = np.repeat(query[at_once], n)
                    far = np.bitwise_count(self.codes[row] ^ codes[asker])
                    near = np.flatnonzero(far <= bound[asker])
                    yield asker[near], row[near], far[near]
                    done = upto

    def nearest(self, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the ``n`` nearest rows of each code, ties by id."""
        need = min(n, len(self.ids))
        best = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint8)]
        open_, bound = np.arange(len(codes)), np.full(len(codes), BITS, np.uint8)
        ready: list[list[np.ndarray]] = []
        for radius in range(max(bits for _, bits in self.places) + 1):
            for at, (_, bits) in enumerate(self.places):
                if radius > bits:
                    continue
                for query, row, far in self.met(at, radius, codes[open_], bound[open_]):
                    best = self._first(*[np.concatenate(x) for x in zip(best, (open_[query], row, far), strict=True)], n)
                    size = np.bincount(best[0], minlength=len(codes))
                    full = np.flatnonzero(size >= need)
                    bound[full] = best[2][np.cumsum(size)[full] - 1]
            done = np.zeros(len(codes), bool)
            done[open_] = (np.bincount(best[0], minlength=len(codes))[open_] >= need) & (bound[open_] < len(self.places) * (radius + 1))
            out = done[best[0]]
            ready.append([x[out] for x in best])
            best, open_ = [x[~out] for x in best], open_[~done[open_]]
            if not len(open_):
                break
        return tuple(np.concatenate(x) for x in zip(*ready, best, strict=True))

    @staticmethod
    def _first(query: np.ndarray, row: np.ndarray, far: np.ndarray, n: int) -> list[np.ndarray]:
        """The ``n`` first rows of each query by distance and id, each once."""
        order = np.lexsort((row, far, query))
        query, row, far = query[order], row[order], far[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (row[1:] != row[:-1])
        query, row, far = query[new], row[new], far[new]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        return [x[place < n] for x in (query, row, far)]


def search(rows: DataFrame, queries: DataFrame, k: int = 10, segments: int | None = None,
           block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and distance of the k nearest rows of
    every query by id, the query's own id left out; ties go to smaller ids.

    ``rows`` and ``queries`` hold ``vec_id`` and ``code``. Rows with a null id
    or code take no part. With fewer than k other rows, all are returned. A
    repeated id counts once. Empty tables give no rows. The join of both sides
    has as many rows as blocks times queries and groups times rows; a block of
    ``block_rows`` and a group of about ``group_queries`` make a task.
    """
    rows, queries = (d.where("vec_id IS NOT NULL AND code IS NOT NULL").select("vec_id", "code").distinct() for d in (rows, queries))
    first = Window.partitionBy("code").orderBy("vec_id")
    # the limit applies in every task before the shuffle, so a hot code is small
    kept = stage(rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("vec_id", "code"), "rows")
    own = stage(queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")), "queries")
    asked = own.select("q").distinct()
    n_rows, n_asked = kept.count(), asked.count()
    blocks = max(1, ceil(n_rows / block_rows))
    groups = max(1, min(ceil(n_asked / group_queries), ceil(width(rows) / blocks)))
    parts = segments or best_segments(max(n_rows // blocks, 2), k)

    def cells(df: DataFrame, place: Column, among: int, others: int, along: Column, asks: bool, *columns: Column) -> DataFrame:
        mine, every = F.pmod(F.xxhash64(place), F.lit(among)), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.select(*columns, mine.alias("_mine"), every.alias("_other")).select(
            along.cast("int").alias("cell"), F.lit(asks).alias("asks"), "id", "code")

    both = cells(kept, F.col("vec_id"), blocks, groups, F.col("_mine") * groups + F.col("_other"), False, F.col("vec_id").alias("id"), F.col("code")).unionByName(
        cells(asked, F.col("q"), groups, blocks, F.col("_other") * groups + F.col("_mine"), True, F.lit(None).cast("long").alias("id"), F.col("q").alias("code")))

    def answer(cell: pa.Table) -> pa.Table:
        asks, code = (cell[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("asks", "code"))
        held = cell.filter(pa.array(~asks))["id"].combine_chunks().to_numpy(zero_copy_only=False)
        schema = pa.schema([("q", pa.int64()), ("d", pa.int32()), ("vec_id", pa.int64())])
        if not len(held) or not asks.any():
            return schema.empty_table()
        code = code.view(np.uint64)
        block = Block(held.astype(np.int64), code[~asks], parts)
        query, row, far = block.nearest(code[asks], k + 1)
        return pa.table([code[asks][query].view(np.int64), far.astype(np.int32), block.ids[row]], schema=schema)

    # one task for each cell: a few of them are all of the work
    met = both.repartition(blocks * groups, "cell").groupBy("cell").applyInArrow(answer, "q long, d int, vec_id long")
    nearest = Window.partitionBy("q").orderBy("d", "vec_id")
    answers = met.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).drop("n")
    rank = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return (own.join(answers, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.col("d").cast("long").alias("distance")))
