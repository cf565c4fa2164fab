"""Words of many texts at once, and counts combined inside a task.

Texts are cut by classes of bytes: every byte is part of a word, a space between
words, or a break that no phrase crosses. Bytes from 0x80 on have one class, so
letters of several bytes stay whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, SPACE, BREAK = 0, 1, 2
FILTER_BITS = 1 << 24
COMBINE_ROWS = 700_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_classes(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    out = np.full(256, WORD, np.uint8)
    out[list(spaces)] = SPACE
    out[list(breaks)] = BREAK
    return out


def cut(texts: list[str | None], classes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, the text each is from, the piece each is from).

    A-Z are lowered. Pieces are numbered over all texts; a break, or the end of
    a text, ends one.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    kind = classes[data]
    ends = np.cumsum([len(r) + 1 for r in raw])
    kind[ends - 1] = BREAK
    solid = kind == WORD
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[solid]]))
    owner = np.searchsorted(ends, start, "right")
    piece = np.searchsorted(np.flatnonzero(kind == BREAK), start, "right")
    return words, owner, piece


def digests(words: Iterable[str], seed: int) -> np.ndarray:
    """64-bit digests of words: ``F.xxhash64(seed text, word)`` has the same values."""
    seed &= (1 << 64) - 1
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64).view(np.int64)


class Combined:
    """Rows of keys and counts, combined whenever they pass a bound, so that a
    task sends each key about once. Counts are summed, texts keep the first."""

    def __init__(self, keys: list[str], sums: list[str], rows: int = COMBINE_ROWS):
        self.keys, self.sums, self.rows, self.parts, self.held, self.least = keys, sums, rows, [], 0, 0

    def _merged(self) -> pa.Table:
        table = pa.concat_tables(self.parts).group_by(self.keys, use_threads=False).aggregate([(s, "sum") for s in self.sums])
        return table.rename_columns([c.removesuffix("_sum") if c not in self.keys else c for c in table.column_names])

    def add(self, columns: dict) -> Iterator[pa.RecordBatch]:
        """Rows that no longer fit, if any."""
        self.parts.append(pa.table(columns))
        self.held += self.parts[-1].num_rows
        if self.held > self.rows + self.least:
            merged = self._merged()
            if merged.num_rows > self.rows:
                yield from self._out(merged)
                merged = merged.slice(0, 0)
            self.parts, self.held = [merged], merged.num_rows
            self.least = self.held

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from self._out(self._merged())

    def _out(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from table.select([*self.keys, *self.sums]).to_batches(max_chunksize=65_536)


def bit_of(digest: Column) -> Column:
    return F.pmod(digest, F.lit(FILTER_BITS))


def filter_of(digest: DataFrame) -> np.ndarray:
    """One bit for each value of a single long column, of fixed size whatever the
    number of rows: it tells most rows that are not wanted before they are
    shuffled. When it is full it tells none, and the exact join behind it gives
    the same rows."""
    place = bit_of(F.col(digest.columns[0])) + 1
    rows = (digest.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())  # at most 512 rows of 4 KB
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        own = np.frombuffer(r.bits, np.uint8)
        bits[(r.bucket - 1) * 4096:(r.bucket - 1) * 4096 + len(own)] = own
    return bits


def held_by(bits: np.ndarray, digest: np.ndarray) -> np.ndarray:
    place = digest.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
