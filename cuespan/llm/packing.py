"""Sum-of-squares packing of documents into sequences of fixed length.

Every document is cut only where it is longer than a sequence. A piece goes
where the sum, over all residual gaps, of the squared number of open sequences
with that gap becomes smallest; this keeps gaps of every size in stock and so
leaves little of them over. Pieces are dealt to shards by hash and packed shard
by shard; a shard's state is one counter per gap, whatever the number of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.llm.common import slices, stage
from cuespan.llm.library_ids import library_ids

SHARD_PIECES = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocab_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """The pieces of every document (null text: empty) with their checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = library_ids(vocab_path), np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for part in slices(batches):
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(),
                                coder.encode([t or "" for t in part.column(1).to_pylist()], end), strict=True):
                for number, at in enumerate(range(0, len(ids), step)):
                    own = ids[at:at + step]
                    rows.append((doc, number, at // 4, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(
                columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and place of each size, in the given order, and the number of bins.

    Filling a gap g with s changes the sum by 2 (N[g-s] - N[g] + 1), a gap that
    s fills by 1 - 2 N[s], a new bin by 2 N[capacity-s] + 1; ties go to the
    smaller gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, places, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    never = np.int64(1) << 40
    for at, size in enumerate(sizes.tolist()):
        gaps = count[size:]
        change = 2 * (count[:capacity + 1 - size] - gaps + 1)
        change[gaps == 0] = never
        if gaps[0]:
            change[0] = 1 - 2 * gaps[0]
        change[-1] = 2 * count[capacity - size] + 1 if size < capacity else 0
        gap = int(change.argmin()) + size
        if gap == capacity:
            bin_, made = made, made + 1
        else:
            bin_ = open_bins[gap].pop()
            count[gap] -= 1
        bins[at], places[at] = bin_, capacity - gap
        if gap > size:
            count[gap - size] += 1
            open_bins[gap - size].append(bin_)
    return bins, places, made


def orders(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Orders of arrival: largest first, and as dealt with the smallest tenth,
    fifth or third last, largest of them first, to fill what is still open."""
    down = np.argsort(-sizes, kind="stable")
    yield down
    rank = np.empty(len(sizes), np.int64)
    rank[down] = np.arange(len(sizes))
    for late in (10, 5, 3):
        first = len(sizes) - len(sizes) // late
        yield np.concatenate([np.flatnonzero(rank < first), down[first:]])


def pack(parts: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of ``pieces``.

    Shards hold about ``shard_pieces`` pieces, by a hash of id, piece and
    checksum, so a repeated row or a hot source is nothing special. Within a
    shard rows are put in the order of that hash before packing: a task that
    runs again gives the same rows. The best of four orders is kept.
    """
    shards = max(1, -(-parts.count() // shard_pieces))
    schema = parts.drop("_mix", "_shard").schema.add("sequence_id", "long").add("offset", "long")
    names = parts.columns

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_mix", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        sizes = rows["length"].to_numpy(np.int64)
        best = None
        for order in orders(sizes):
            bins, places, made = sum_of_squares(sizes[order], capacity)
            if best is None or made < best[0]:
                best = made, order, bins, places
        _, order, bins, places = best
        out = rows[names].copy()
        out.loc[order, "sequence_id"] = (int(key[0]) << 32) + bins
        out.loc[order, "offset"] = places
        return out.astype({"sequence_id": "int64", "offset": "int64"})

    mix = F.xxhash64("doc_id", "piece", "ids_crc32")
    return (parts.withColumn("_mix", mix).withColumn("_shard", F.pmod("_mix", F.lit(shards)))
            .groupBy("_shard").applyInPandas(run, schema))


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents: one row per piece with its sequence and offset.

    Null and empty texts are one piece holding the end id. A null doc_id is
    kept. Repeated rows are packed each; an empty table gives no rows; other
    columns of ``docs`` are ignored.
    """
    return pack(stage(pieces(docs, vocab_path, capacity, end_id), "pieces"), capacity)
