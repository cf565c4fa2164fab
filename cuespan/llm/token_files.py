"""Token ids in binary files: one zstandard frame per document.

A dictionary trained on serialized id arrays is shared by all frames, so short
documents compress as well as long ones and each can be read alone. A file is

    magic, sha256 of the dictionary, bytes per id
    one frame per document, in ascending doc_id order
    index: has_id u1[n], then doc_id, start, n_ids, offset, length as i8[n] each
    place of the index u8, number of documents u8, magic

``start`` counts ids before a document inside its file; the manifest holds the
ids before each file. A task writes to a name of its own and returns it, so the
manifest names the files of tasks that ended; a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan.llm.common import shared_path, slices, stage, width
from cuespan.llm.library_ids import library_ids

MAGIC = b"IDFRAME1"
HEAD, FOOT = len(MAGIC) + 33, 16 + len(MAGIC)
SAMPLE_DOCS, SAMPLE_BLOCK, SAMPLE_BLOCKS, DICTIONARY_BYTES = 1_000, 4_096, 4, 65_536
INDEX = ("doc_id", "start", "n_ids", "offset", "length")
MANIFEST = "part int, file string, docs long, ids long"


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def load(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def save(uri: str, data: bytes) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(data)


def serialize(ids: bytes, size: int) -> bytes:
    """Little-endian ids of 32 bits, narrowed to ``size`` bytes each."""
    return ids if size == 4 else np.frombuffer(ids, "<u4").astype(f"<u{size}").tobytes()


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"\0" * 8


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


@dataclass
class TokenFile:
    """One file, opened for reading single documents or all of them."""

    uri: str
    dictionary: bytes
    index: dict[str, np.ndarray] = field(init=False)

    def __post_init__(self):
        fs, path = filesystem(self.uri)
        self.input = fs.open_input_file(path)
        end = self.input.size()
        foot = self.input.read_at(FOOT, end - FOOT)
        head = self.input.read_at(HEAD, 0)
        if foot[-len(MAGIC):] != MAGIC or head[:len(MAGIC)] != MAGIC:
            raise ValueError(f"{self.uri} is not a token file")
        if head[len(MAGIC):-1] != hashlib.sha256(self.dictionary).digest():
            raise ValueError(f"{self.uri} was written with another dictionary")
        self.size = head[-1]
        place, docs = (int(x) for x in np.frombuffer(foot[:16], "<u8"))
        raw = self.input.read_at(end - FOOT - place, place)
        self.index = {"has_id": np.frombuffer(raw[:docs], "u1").astype(bool)}
        for at, name in enumerate(INDEX):
            self.index[name] = np.frombuffer(raw, "<i8", docs, docs + 8 * docs * at)
        self.reader = zstandard.ZstdDecompressor(dict_data=dictionary(self.dictionary))

    def ids(self, row: int) -> np.ndarray:
        """The ids of the document in row ``row`` of the index, by one seek."""
        frame = self.input.read_at(int(self.index["length"][row]), int(self.index["offset"][row]))
        return np.frombuffer(self.reader.decompress(frame), f"<u{self.size}")

    def close(self):
        self.input.close()


@dataclass
class TokenStore:
    """The files of a corpus: their folder, key bounds, and ids before each."""

    spark: SparkSession
    folder: str
    bounds: list[int]
    files: list[tuple]  # part, file, documents, ids, ids of all files before

    def documents(self) -> DataFrame:
        """Read every file back: doc_id, start, n_tokens, ids_crc32."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = load(f"{folder}/dictionary")
            for batch in batches:
                for file, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist(), strict=True):
                    own = TokenFile(f"{folder}/{file}", words)
                    docs = len(own.index["start"])
                    for at in range(0, docs, 10_000):
                        rows = range(at, min(at + 10_000, docs))
                        crc = [zlib.crc32(own.ids(r).astype("<u4").tobytes()) for r in rows]
                        part = slice(at, at + len(crc))
                        yield pa.record_batch([
                            pa.array(own.index["doc_id"][part], pa.int64(), mask=~own.index["has_id"][part]),
                            pa.array(own.index["start"][part] + base), pa.array(own.index["n_ids"][part]),
                            pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    own.close()

        return self._manifest().mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """doc_id and ids of the wanted doc_ids only: one index and one seek per
        document are read from the files whose key range holds them."""
        folder, bounds = self.folder, np.array(self.bounds, np.int64)
        files = {part: file for part, file, *_ in self.files}

        def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = b.column(0).to_numpy(zero_copy_only=False)
                yield pa.record_batch([b.column(0), pa.array(np.searchsorted(bounds, own, "right"), pa.int32())], ["doc_id", "part"])

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            if key[0] not in files:
                return pd.DataFrame({"doc_id": [], "ids": []})
            own = TokenFile(f"{folder}/{files[key[0]]}", load(f"{folder}/dictionary"))
            at = np.flatnonzero(np.isin(own.index["doc_id"], rows["doc_id"]) & own.index["has_id"])
            out = pd.DataFrame({"doc_id": own.index["doc_id"][at], "ids": [own.ids(r).astype(np.int64) for r in at]})
            own.close()
            return out

        keys = wanted.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
        return (keys.mapInArrow(part_of, "doc_id long, part int")
                .groupBy("part").applyInPandas(run, "doc_id long, ids array<long>"))

    def _manifest(self) -> DataFrame:
        rows = self.spark.createDataFrame(self.files, "part int, file string, docs long, ids long, base long")
        # one task per file: the numbers of the parts are the numbers of the tasks
        return rows.repartitionById(len(self.bounds) + 1, F.col("part"))


def write(docs: DataFrame, vocab_path: str, end_id: int = 0) -> TokenStore:
    """Encode every text (null: empty), append ``end_id``, write the files.

    Ranges of doc_id are cut at quantiles of the ids alone, one range per
    shuffle partition; texts are encoded and compressed before the shuffle, so
    only frames move. Null ids come first. Repeated ids keep all their rows, in
    the order of their frames. An empty table has no files.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = width(docs)
    cuts = docs.agg(F.percentile_approx("doc_id", [(i + 1) / parts for i in range(parts - 1)] or [0.5], 10_000).alias("q"),
                    F.count("*").alias("n")).first()
    bounds = sorted(set(cuts.q or []))
    size = 2 if max(library_ids(vocab_path).vocab.tokens) < 1 << 16 else 4
    end = np.array([end_id], "<u4").tobytes()
    folder = shared_path(spark, "token-files")

    # the dictionary is fitted on blocks of a bounded sample of documents
    share = min(1.0, SAMPLE_DOCS / max(cuts.n, 1))
    mix = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_ids(vocab_path)
        for part in slices(batches):
            out = []
            for ids in coder.encode([t or "" for t in part.column(0).to_pylist()], end):
                data = serialize(ids, size)
                starts = list(range(0, len(data), SAMPLE_BLOCK))
                keep = starts[::max(1, -(-len(starts) // SAMPLE_BLOCKS))]
                out += [data[at:at + SAMPLE_BLOCK] for at in keep]
            yield pa.record_batch([pa.array(out, pa.binary())], ["block"])

    picked = docs.where(mix < int(share * (1 << 30))).select("text").mapInArrow(blocks, "block binary")
    words = train(sorted(bytes(r.block) for r in picked.collect()))
    save(f"{folder}/dictionary", words)
    edges = np.array(bounds, np.int64)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_ids(vocab_path)
        tool = zstandard.ZstdCompressor(level=3, dict_data=dictionary(words))
        for part in slices(batches):
            ids = coder.encode([t or "" for t in part.column(1).to_pylist()], end)
            key = part.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            yield pa.record_batch([
                part.column(0), pa.array(np.searchsorted(edges, key, "right"), pa.int32()),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([tool.compress(serialize(i, size)) for i in ids], pa.binary())],
                ["doc_id", "part", "n_ids", "frame"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sink, seen, has, part = f"{uuid.uuid4().hex}.ids", None, [[], [], []], [], None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if sink is None:
                fs, path = filesystem(f"{folder}/{name}")
                sink = fs.open_output_stream(path)
                sink.write(MAGIC + hashlib.sha256(words).digest() + bytes([size]))
                part = batch["part"][0].as_py()
            for frame in batch["frame"]:
                sink.write(frame.as_py())
            has.append(batch["doc_id"].is_valid().to_numpy(zero_copy_only=False))
            seen[0].append(batch["doc_id"].fill_null(0).to_numpy())
            seen[1].append(batch["n_ids"].to_numpy())
            seen[2].append(np.array([len(f.as_py()) for f in batch["frame"]], np.int64))
        if sink is None:
            return
        doc_id, n_ids, length = (np.concatenate(x).astype("<i8") for x in seen)
        start, offset = np.cumsum(n_ids) - n_ids, HEAD + np.cumsum(length) - length
        index = np.concatenate(has).astype("u1").tobytes() + b"".join(
            x.astype("<i8").tobytes() for x in (doc_id, start, n_ids, offset, length))
        sink.write(index + np.array([HEAD + length.sum(), len(doc_id)], "<u8").tobytes() + MAGIC)
        sink.close()
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(doc_id)], pa.int64()),
                               pa.array([int(n_ids.sum())], pa.int64())], ["part", "file", "docs", "ids"])

    written = (docs.mapInArrow(compress, "doc_id long, part int, n_ids long, frame binary")
               .repartitionById(len(bounds) + 1, F.col("part"))
               .sortWithinPartitions("doc_id", "frame").mapInArrow(put, MANIFEST))
    files, base = [], 0
    for row in stage(written, "token-manifest").orderBy("part").collect():  # a row per file
        files.append((row.part, row.file, row.docs, row.ids, base))
        base += row.ids
    return TokenStore(spark, folder, bounds, files)
