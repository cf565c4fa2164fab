"""Byte-pair encoding through a minimal acyclic transducer, and decoding.

Frequent words of the corpus, counted over all of it, are compiled with their
ids into one shared-suffix automaton. Arcs carry how many words sort before, so
the sum along a path numbers the word, and the number finds its ids. The
automaton is a flat file that every Python worker maps into memory. A word that
it does not hold is merged by rank, so the ids are the same with any lexicon.

Texts are cut at white space, where no merge can cross; every distinct piece of
a slice of texts is resolved once, all of them walking the automaton together.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan.llm.common import shared_path, slices, stage

LEXICON_WORDS = 131_072
SHORT, NO_PAIR = 24, 1 << 62
BLOCK = 4_096  # words of one length that are merged side by side
FORMS = 180_000  # pieces of texts whose forms a worker keeps from slice to slice
# fixed value: the split pattern of byte-level vocabularies that name none
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# fixed value: a split pattern by which a run of letters, and one other character behind it, are a word each
LETTER_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Only these characters have the same classes in every library used here; a text
# with any other is normalised and split by the tokenizers library itself.
ODD = re.compile("[^\t-\r -~\u00a0-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
SPACE = "\t-\r \u00a0"
BYTE_CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a vocabulary file."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A BPE file of the tokenizers library: ids, merge ranks, added tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        letters = byte_letters()
        self.library = Tokenizer.from_file(path)
        self.byte_of = {letter: byte for byte, letter in enumerate(letters)}
        self.suffix = model["end_of_word_suffix"] or ""
        self.first = [ids[c] for c in letters]
        self.last = [ids[c + self.suffix] for c in letters]
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.ranked = {pair: rank << 32 | whole for pair, (rank, whole) in self.merges.items()}
        pairs = sorted((a << 32 | b, value) for (a, b), value in self.ranked.items())
        self.pair_keys, self.pair_values = (np.array(column, np.int64) for column in zip(*pairs or [(-1, NO_PAIR)], strict=True))
        self.ends_of = np.array([self.first, self.last], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.added.items()}
        self.numerals = {i: str(i) for i in self.tokens}
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self.lowers = spec["normalizer"] is not None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if self.lowers else BYTE_PATTERN
        self.pattern, self.by_letters = regex.compile(pattern), pattern == LETTER_PATTERN

    def chunks(self, text: str) -> list:
        """Pieces whose ids do not depend on each other: a text between white
        space, the id of an added token, or (odd texts) one word in a tuple."""
        if any(t in text for t in self.added):
            out: list = []
            for part in self.special.split(text):
                out += [self.added[part]] if part in self.added else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list:
        if ODD.search(text):
            norm = self.library.normalizer.normalize_str(text) if self.lowers else text
            return [(word,) for word, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        # NFC and lower case by character are the identity and str.lower() here
        return text.lower().split() if self.lowers else BYTE_CHUNKS.findall(text)

    def words(self, chunk) -> list[bytes]:
        if isinstance(chunk, str):
            if self.by_letters:  # most chunks, and the pattern would say the same
                if chunk.isalpha():
                    return [chunk.encode()]
                if chunk[:-1].isalpha() and not chunk[-1].isalpha():
                    return [chunk[:-1].encode(), chunk[-1].encode()]
            return [w.encode() for w in self.pattern.findall(chunk)]
        return [bytes(self.byte_of[c] for c in chunk[0])]

    def merge(self, word: bytes) -> list[int]:
        """Join the adjacent pair of lowest rank, leftmost first, until none is left."""
        ids = [self.first[b] for b in word]
        if ids:
            ids[-1] = self.last[word[-1]]
        return self._join_short(ids) if len(ids) <= SHORT else self._join(ids)

    def _join_short(self, ids: list[int]) -> list[int]:
        """All pairs of a short word stand in one list, and its least is looked for anew."""
        get = self.ranked.get
        pairs = [get(p, NO_PAIR) for p in zip(ids, ids[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == NO_PAIR:
                break
            at = pairs.index(best)
            ids[at:at + 2] = [best & 0xFFFFFFFF]
            del pairs[at]
            if at:
                pairs[at - 1] = get((ids[at - 1], ids[at]), NO_PAIR)
            if at < len(pairs):
                pairs[at] = get((ids[at], ids[at + 1]), NO_PAIR)
        return ids

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` of every word; short ones of equal length are merged side by side."""
        out: list = [None] * len(words)
        lengths: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            lengths.setdefault(len(word), []).append(at)
        for size, places in lengths.items():
            if 2 <= size <= SHORT:
                for lo in range(0, len(places), BLOCK):
                    self._merge_block(words, places[lo:lo + BLOCK], size, out)
            else:
                for at in places:
                    out[at] = self.merge(words[at])
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What ``ranked`` has for pairs of ids, NO_PAIR where it has nothing."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, pair), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == pair, self.pair_values[at], NO_PAIR)

    def _merge_block(self, words: list[bytes], places: list[int], size: int, out: list) -> None:
        """A round joins one pair in each word, so all words left are equally long."""
        raw = np.frombuffer(b"".join([words[at] for at in places]), np.uint8).reshape(-1, size)
        ids, rows = self.ends_of[0][raw], np.array(places)
        ids[:, -1] = self.ends_of[1][raw[:, -1]]
        pairs = self._ranks(ids[:, :-1], ids[:, 1:])
        while True:
            wide = ids.shape[1]
            at = pairs.argmin(1) if wide > 1 else np.zeros(len(rows), np.int64)  # the leftmost of equal ones
            best = pairs[np.arange(len(rows)), at] if wide > 1 else np.full(len(rows), NO_PAIR)
            ended = best == NO_PAIR
            for row, own in zip(rows[ended].tolist(), ids[ended].tolist(), strict=True):
                out[row] = own
            rows, ids, pairs, at, best = (x[~ended] for x in (rows, ids, pairs, at, best))
            if not len(rows):
                return
            ids[np.arange(len(rows)), at] = best & 0xFFFFFFFF
            ids = ids[np.arange(wide) != at[:, None] + 1].reshape(len(rows), wide - 1)
            pairs = pairs[np.arange(wide - 1) != at[:, None]].reshape(len(rows), wide - 2)
            for edge, side in ((np.flatnonzero(at > 0), -1), (np.flatnonzero(at < wide - 2), 0)):
                place = at[edge] + side
                pairs[edge, place] = self._ranks(ids[edge, place], ids[edge, place + 1])

    def _join(self, ids: list[int]) -> list[int]:
        """A heap of pairs over linked places, for words of any length."""
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*merges[pair], at, *pair) for at in range(n - 1) if (pair := (ids[at], ids[at + 1])) in merges]
        heapq.heapify(heap)
        while heap:
            _, whole, at, a, b = heapq.heappop(heap)
            right = after[at]
            if ids[at] != a or right >= n or ids[right] != b:
                continue
            ids[at], ids[right], after[at] = whole, -1, after[right]
            if after[at] < n:
                before[after[at]] = at
                if (pair := (whole, ids[after[at]])) in merges:
                    heapq.heappush(heap, (*merges[pair], at, *pair))
            if before[at] >= 0 and (pair := (ids[before[at]], whole)) in merges:
                heapq.heappush(heap, (*merges[pair], before[at], *pair))
        return [i for i in ids if i >= 0]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal automaton of the words, numbered in byte order, and their ids.

    Words are added in byte order; when a word leaves a branch, its states are
    replaced by equal ones made before, so suffixes are shared.
    """
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # per state: ((byte, target), ...)
    finals: list[bool] = []
    sizes: list[int] = []  # words below a state

    def close(node: list) -> int:
        final, out = node
        key = (final, *out)
        if key not in register:
            register[key] = len(arcs)
            arcs.append(tuple(out))
            finals.append(final)
            sizes.append(final + sum(sizes[t] for _, t in out))
        return register[key]

    ordered = sorted(w for w in entries if w)
    path: list[list] = [[False, []]]
    last = b""
    for word in ordered:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            state = close(path.pop())
            path[-1][1].append((last[len(path) - 1], state))
        for _ in word[same:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        state = close(path.pop())
        path[-1][1].append((last[len(path) - 1], state))
    root = close(path[0])

    keys, targets, skips = [], [], []
    for state, out in enumerate(arcs):
        skip = int(finals[state])
        for byte, target in out:
            keys.append(state << 8 | byte)
            targets.append(target)
            skips.append(skip)
            skip += sizes[target]
    ids = [entries[w] for w in ordered]
    head = np.array([root, len(arcs), len(keys), len(ids)], "<u4")
    ends = np.cumsum([0, *map(len, ids)])
    return b"".join(np.asarray(part, kind).tobytes() for part, kind in (
        (head, "<u4"), (keys, "<u4"), (targets, "<u4"), (skips, "<u4"), (finals, "<u4"), (ends, "<u4"),
        ([i for one in ids for i in one], "<u4")))


class Lexicon:
    """A compiled lexicon, mapped from its file and walked by many words at once."""

    def __init__(self, path: str):
        data = np.memmap(path, "<u4", "r")
        self.root, states, arcs, words = (int(x) for x in data[:4])
        cuts = np.cumsum([4, arcs, arcs, arcs, states, words + 1])
        self.keys, self.targets, self.skips, self.finals, self.ends = (
            data[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        self.ids = data[cuts[-1]:]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for a word that the lexicon lacks."""
        out = np.full(len(words), -1, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        if not len(self.keys):
            return out
        rows = np.flatnonzero(size > 0)
        state = np.full(len(rows), self.root, np.int64)
        total = np.zeros(len(rows), np.int64)
        step = 0
        while len(rows):
            want = state << 8 | text[start[rows] + step]
            arc = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            alive = self.keys[arc] == want
            rows, arc, total = rows[alive], arc[alive], total[alive]
            state, total = self.targets[arc].astype(np.int64), total + self.skips[arc]
            step += 1
            done = size[rows] == step
            ended = done & (self.finals[state] > 0)
            out[rows[ended]] = total[ended]
            rows, state, total = rows[~done], state[~done], total[~done]
        return out

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.ends[number]:self.ends[number + 1]].tolist()

    def all_ids(self, numbers: np.ndarray) -> list[list[int]]:
        """``ids_of`` of every number, read at once."""
        start, size = self.ends[numbers].astype(np.int64), (self.ends[numbers + 1] - self.ends[numbers]).astype(np.int64)
        stop = np.cumsum(size)
        flat = np.asarray(self.ids[np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - stop + size, size)]).tolist()
        cuts = [0, *stop.tolist()]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


@lru_cache(maxsize=1)
def forms(name: str) -> tuple[dict, dict]:
    """Forms of pieces met by this worker: now, and before it was last full."""
    return {}, {}


def resolve(vocab: Vocabulary, lex: Lexicon | None, chunks: Iterable) -> dict:
    """The ids of distinct chunks."""
    own = {c: vocab.words(c) for c in chunks if not isinstance(c, int)}
    words = list({w for parts in own.values() for w in parts})
    found = lex.numbers(words) if lex else np.full(len(words), -1)
    held, rest = np.flatnonzero(found >= 0), [words[at] for at in np.flatnonzero(found < 0).tolist()]
    ids = dict(zip(rest, vocab.merge_all(rest), strict=True))
    if len(held):
        ids.update(zip([words[at] for at in held.tolist()], lex.all_ids(found[held]), strict=True))
    out = {c: ids[parts[0]] if len(parts) == 1 else [i for w in parts for i in ids[w]] for c, parts in own.items()}
    return out | {c: [c] for c in chunks if isinstance(c, int)}


def word_counts(docs: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """``word`` (bytes) and ``n`` over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for part in slices(batches):
            seen: Counter = Counter()
            for value in part.column(0).to_pylist():
                seen.update(vocab.chunks(value or ""))
            words: Counter = Counter()
            for chunk, n in seen.items():
                if not isinstance(chunk, int):
                    for word in vocab.words(chunk):
                        words[word] += n
            yield pa.record_batch([pa.array(words.keys(), pa.binary()), pa.array(words.values(), pa.int64())], ["word", "n"])

    return (docs.select(text).mapInArrow(count, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def put_file(spark: SparkSession, data: bytes, label: str) -> str:
    """Place ``data`` in the shared folder and let Spark bring it to every
    executor; returns the name for ``SparkFiles.get``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_path(spark, label))
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at:at + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return path.getName()


def build_lexicon(docs: DataFrame, vocab_path: str, text: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the ``words`` most frequent words of all texts; of those equally
    frequent with the last, the first by hash.

    The size of the lexicon is a parameter and does not follow the corpus; it
    decides how often a word is merged anew, never the ids.
    """
    vocab = vocabulary(vocab_path)
    counted = stage(word_counts(docs, vocab_path, text), "words")
    # how many words have each count: a short table, from which the least count
    # follows, so that no task sends more than its share of the lexicon
    often = sorted(((r.n, r.words) for r in counted.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    least, held, room = None, 0, 0
    for n, own in often:
        least, room = n, words - held
        held += own
        if held >= words:
            break
    by_hash = F.xxhash64("word")
    top = []
    if least is not None and words > 0:
        edge = counted.where(F.col("n") == least).orderBy(by_hash, "word").limit(room)
        top = counted.where(F.col("n") > least).unionByName(edge).collect()  # at most ``words`` rows
    held = [bytes(r.word) for r in top]
    data = compile_lexicon(dict(zip(held, vocab.merge_all(held), strict=True)))
    return put_file(docs.sparkSession, data, "lexicon")


def encode(docs: DataFrame, vocab_path: str, id_column: str = "doc_id", text: str = "text",
           words: int = LEXICON_WORDS) -> DataFrame:
    """``id_column`` and ``ids`` (array of int) of every text; null counts as empty.

    Nulls: a null id is kept. Empty tables give an empty result; repeated rows
    are encoded each; other columns of ``docs`` are ignored.
    """
    name = build_lexicon(docs, vocab_path, text, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, lex = vocabulary(vocab_path), lexicon(name)
        for part in slices(batches):
            texts = [vocab.chunks(t or "") for t in part.column(1).to_pylist()]
            ids = resolve(vocab, lex, {c for t in texts for c in t})
            rows = [[i for c in t for i in ids[c]] for t in texts]
            yield pa.record_batch([part.column(0), pa.array(rows, pa.list_(pa.int32()))], ["id", "ids"])

    kind = dict(docs.dtypes)[id_column]
    return (docs.select(id_column, text).mapInArrow(run, f"id {kind}, ids array<int>")
            .withColumnRenamed("id", id_column))


def decode(frame: DataFrame, vocab_path: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``id_column`` and ``text`` of every id list: tokens as the file writes
    them, joined by spaces; an id that the file lacks adds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(vocab_path).tokens
        for part in slices(batches):
            texts = [" ".join(tokens[i] for i in one or () if i in tokens) for one in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = dict(frame.dtypes)[id_column]
    return (frame.select(id_column, ids).mapInArrow(run, f"id {kind}, text string")
            .withColumnRenamed("id", id_column))


def digests(docs: DataFrame, vocab_path: str, id_column: str = "doc_id", text: str = "text",
            words: int = LEXICON_WORDS) -> DataFrame:
    """Encode and decode every text and keep lengths and hashes of both.

    One pass: a chunk's ids and tokens are written as text when a worker meets
    it, so a document is two joins of strings and two hashes. Forms are kept from
    slice to slice in two generations: when one is full, what the slices since
    have not used goes.
    """
    name = build_lexicon(docs, vocab_path, text, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, lex = vocabulary(vocab_path), lexicon(name)
        known, older = forms(name)
        for part in slices(batches):
            texts = [vocab.chunks(t or "") for t in part.column(1).to_pylist()]
            new = set().union(*texts).difference(known)
            for c in [c for c in new if c in older]:
                known[c] = older[c]
            new.difference_update(known)
            numeral, token = vocab.numerals.__getitem__, vocab.tokens.__getitem__
            for c, v in resolve(vocab, lex, new).items():
                known[c] = (len(v), " ".join(map(numeral, v)), " ".join(map(token, v)))
            rows = [[known[c] for c in t] for t in texts]

            def sha(row: list, form: int) -> str:
                return hashlib.sha256(" ".join([f[form] for f in row]).encode()).hexdigest()

            yield pa.record_batch([
                part.column(0), pa.array([sum([f[0] for f in row]) for row in rows], pa.int64()),
                pa.array([sha(row, 1) for row in rows]), pa.array([sha(row, 2) for row in rows])],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            if len(known) > FORMS:
                older.clear()
                older.update(known)
                known.clear()

    kind = dict(docs.dtypes)[id_column]
    return (docs.select(id_column, text)
            .mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", id_column))
