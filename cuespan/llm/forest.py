"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are fitted on a bounded sample: a node splits its points at the median
of their projections on the difference of two of them. All trees of a query are
searched through one priority queue that holds the branches not taken, nearest
splitting plane first, until the leaves taken out hold a set share of the
sample. The rows of those leaves are then ranked by exact distance.

Rows are dealt to blocks by hash and queries are sent to blocks in chunks, so
neither a full leaf nor a group of copies gathers anywhere.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespan.llm.common import stage, width

TREES, LEAF_ROWS, SAMPLE_ROWS, SHARE = 8, 64, 20_000, 1.2
BLOCK_ROWS, CHUNK_QUERIES = 50_000, 4_096


class Forest:
    """Trees as arrays: plane, threshold and children per node; leaves by number."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 0):
        rng = np.random.default_rng(seed)
        planes, limits, children, weight, roots = [], [], [], [], []

        def grow(rows: np.ndarray) -> int:
            at = len(planes)
            planes.append(np.zeros(sample.shape[1]))
            limits.append(0.0)
            children.append((-1, -1))
            weight.append(len(rows))
            if len(rows) > leaf_rows:
                a, b = sample[rng.choice(rows, 2, replace=False)]
                plane = a - b if np.any(a != b) else rng.normal(size=len(a))
                plane = plane / np.linalg.norm(plane)
                side = sample[rows] @ plane
                limit = float(np.median(side))
                low = side < limit
                if low.any() and not low.all():
                    planes[at], limits[at] = plane, limit
                    children[at] = grow(rows[low]), grow(rows[~low])
            return at

        for _ in range(trees):
            roots.append(grow(np.arange(len(sample))))
        self.planes, self.limits = np.array(planes), np.array(limits)
        self.children, self.weight, self.roots = np.array(children), np.array(weight), roots
        self.total = len(sample)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree."""
        out = np.empty((len(self.roots), len(vectors)), np.int64)
        for tree, root in enumerate(self.roots):
            now = np.full(len(vectors), root)
            live = np.arange(len(vectors))
            while len(live := live[self.children[now[live], 0] >= 0]):
                node = now[live]
                high = (vectors[live] * self.planes[node]).sum(1) >= self.limits[node]
                now[live] = self.children[node, high.astype(int)]
            out[tree] = now
        return out

    def visit(self, vector: np.ndarray, share: float) -> list[int]:
        """Leaves in order of the shared queue, until they hold ``share`` of the sample."""
        side = (self.planes @ vector - self.limits).tolist()
        children, weight = self.children, self.weight
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        out, held = [], 0
        while queue and held < share * self.total:
            far, node = heapq.heappop(queue)  # distance from the planes crossed so far
            while children[node, 0] >= 0:
                high = side[node] >= 0
                heapq.heappush(queue, (max(far, abs(side[node])), int(children[node, 0 if high else 1])))
                node = int(children[node, 1 if high else 0])
            out.append(node)
            held += int(weight[node])
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: an id, and a vector
    without null or non-finite components that is not zero."""
    ok = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(
        "NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(embedding, x -> x <> 0)")
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = TREES, leaf_rows: int = LEAF_ROWS,
           sample_rows: int = SAMPLE_ROWS, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance in double precision)
    of the k nearest rows found for every query, ties to smaller ids.

    Both tables hold ``vec_id`` and ``embedding``; see ``usable`` for the rows
    that take part. A row with the query's own id is no candidate. Of repeated
    ids each row is a candidate of its own; a query that is repeated with its
    vector is asked once. Distances are between vectors of one length: with
    several lengths, each has a forest of its own, and a query finds rows of its
    own length. The trees are fitted on about ``sample_rows`` rows by hash of id
    and vector; every row is indexed.
    """
    rows, asked = stage(usable(vectors), "vectors"), stage(usable(queries).distinct(), "queries")
    size = F.size("embedding")
    lengths = sorted(r[0] for r in asked.select(size).distinct().collect())  # a few numbers
    found = None
    for n in lengths or [0]:
        own = _search(rows.where(size == n), asked.where(size == n), k, trees, leaf_rows, sample_rows, share)
        found = own if found is None else found.unionByName(own)
    return found


def _search(rows: DataFrame, asked: DataFrame, k: int, trees: int, leaf_rows: int, sample_rows: int, share: float) -> DataFrame:
    """The search among vectors of one length."""
    spark = rows.sparkSession
    n, q = rows.count(), asked.count()
    span = 1 << 30
    fit = rows.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(span)) < int(span * min(1.0, sample_rows / max(n, 1))))
    sample = fit.orderBy("vec_id", F.xxhash64("embedding")).toArrow()["embedding"].to_pylist()
    points = np.array(sample, np.float64) if sample else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(Forest(points, trees, leaf_rows))  # bounded by the sample
    blocks, chunks = max(width(rows), -(-n // BLOCK_ROWS)), max(1, -(-q // CHUNK_QUERIES))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            own = [forest.visit(np.array(v, np.float64), share) for v in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int32()))], ["query_id", "vector", "leaves"])

    kind = dict(rows.dtypes)["embedding"]
    sent = (asked.repartition(width(rows)).mapInArrow(visits, f"query_id long, vector {kind}, leaves array<int>")
            .withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    held = (rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding", F.lit(1)), F.lit(blocks)).cast("int"))
            .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))))

    def rank(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(one) and len(two):
            forest, ids = shared.value, one["vec_id"].to_numpy()
            points = np.stack(one["embedding"].to_list()).astype(np.float64)
            index = []  # per tree: rows in order of their leaves, and where leaves begin
            for leaf in forest.leaves(points):
                order = np.argsort(leaf, kind="stable")
                index.append((order, leaf[order]))
            for query, vector, leaves in zip(two["query_id"], two["vector"], two["leaves"], strict=True):
                leaves = np.asarray(leaves)
                mask = np.zeros(len(ids), bool)
                for order, sorted_ in index:
                    lo, hi = np.searchsorted(sorted_, leaves, "left"), np.searchsorted(sorted_, leaves, "right")
                    size = hi - lo
                    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    mask[order[at]] = True
                near = np.flatnonzero(mask & (ids != query))
                if not len(near):
                    continue
                far = np.sqrt(((points[near] - np.asarray(vector, np.float64)) ** 2).sum(1))
                if len(near) > k:
                    keep = far <= np.partition(far, k - 1)[k - 1]
                    near, far = near[keep], far[keep]
                best = np.lexsort((ids[near], far))[:k]
                out += zip([query] * len(best), ids[near[best]].tolist(), far[best].tolist(), strict=True)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = (held.groupBy("block", "chunk").cogroup(sent.groupBy("block", "chunk"))
             .applyInPandas(rank, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
