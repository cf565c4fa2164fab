"""Language of a text by cross-parsing against a suffix automaton per language.

A text is cut, left to right, into the longest phrases that occur in a
language's training text; few phrases mean that the text repeats that language.
The phrase count times log2 of the training length, per letter, estimates the
cross-entropy in bits; the language that needs fewest normalised phrases wins.

The automata are one table: a row per state and a column per frequent letter of
the language holds the next state, or the complement of the state after a phrase
break. Transitions by the other letters of a language are a sorted list, so that
no trained letter is lost. All blocks of all texts of a slice walk it in step, one
numpy lookup per letter, and one search where a letter has no column.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespan.llm.common import slices

SAMPLE_ROWS = 64  # texts per language, at most
WINDOW = 600  # letters taken from each of them, at a place its hash decides
LETTERS = 60  # most frequent letters of a language, with a column each; the others are searched for
BLOCK = 256  # letters that are parsed side by side; phrases go on from block to block
TABLE_STATES = 1_000_000  # over all languages; beyond 13 with full samples each trains on an equal part
SHARPNESS = 4.0
GAP = re.compile(r"[\W\d_]+")
UNDETERMINED = "und"


def plain(text: str) -> str:
    """Lower-case letters, with one space for whatever lies between words."""
    return GAP.sub(" ", text.lower())


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def suffix_automaton(classes: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is empty."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in classes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            target = step[at][c]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                twin = len(step)
                step.append(dict(step[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at >= 0 and step[at].get(c) == target:
                    step[at][c] = twin
                    at = link[at]
                link[target] = link[new] = twin
        last = new
    return step


class CrossParser:
    """The automata of all languages in one table, and the parse of many texts."""

    def __init__(self, training: dict[str, str]):
        self.languages = sorted(training)
        # an automaton has at most two states per letter
        share = max(1, TABLE_STATES // max(1, 2 * len(training)) - 2)
        texts = {lang: plain(t)[:share] for lang, t in training.items()}
        # letters: 0 pads, 1 is a letter that no training text holds
        letters = sorted(set().union(*texts.values()))
        self.class_of = np.ones(0x110000, np.int32)
        self.class_of[[ord(c) for c in letters]] = np.arange(len(letters)) + 2
        self.bits = np.array([math.log2(max(len(texts[lang]), 2)) for lang in self.languages])
        # of each language: the column of each letter, 1 if it has none, and the searched transitions
        self.column_of, self.rare, self.columns, self.start = [], [], [], []
        tables, base = [], 0
        for lang in self.languages:
            counts = Counter(self.classes(texts[lang]).tolist())
            column = {c: at + 2 for at, c in enumerate(sorted(sorted(counts), key=lambda c: -counts[c])[:LETTERS])}
            columns = len(column) + 2
            step = suffix_automaton(self.classes(texts[lang]).tolist())
            own = np.zeros((len(step) + 1, columns), np.int64)
            lost = len(step)  # after a letter that occurs nowhere: the next one breaks
            root = np.full(columns, lost)
            for c, target in step[0].items():
                if c in column:
                    root[column[c]] = target
            own[:] = ~(root * columns + base)
            keys, targets = [], []
            for state, out in enumerate(step):
                for c, target in out.items():
                    if c in column:
                        own[state, column[c]] = target * columns + base
                    else:
                        keys.append((state * columns + base) * (len(letters) + 2) + c)
                        targets.append(target * columns + base)
            own[0] = root * columns + base
            own[:, 0] = np.arange(len(own)) * columns + base
            own_column = np.ones(len(letters) + 2, np.int32)
            own_column[0] = 0
            for c, at in column.items():
                own_column[c] = at
            seen = np.zeros(len(letters) + 2, np.bool_)
            seen[[c for c in counts if c not in column]] = True
            order = np.argsort(np.array(keys, np.int64))
            self.column_of.append(own_column)
            self.rare.append((seen, np.array(keys, np.int64)[order], np.array(targets, np.int32)[order]))
            self.columns.append(columns)
            self.start.append(base)
            tables.append(own.ravel())
            base += own.size
        self.table = np.concatenate(tables).astype(np.int32) if tables else np.zeros(0, np.int32)

    def classes(self, text: str) -> np.ndarray:
        return self.class_of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each plain text, and its phrases in each language."""
        size = np.array([len(t) for t in texts], np.int64)
        flat = self.classes("".join(texts))
        blocks = -(-size // BLOCK)
        first = np.cumsum(blocks) - blocks
        owner = np.repeat(np.arange(len(texts)), blocks)
        inside = np.arange(len(owner)) - first[owner]
        begin = (np.cumsum(size) - size)[owner] + inside * BLOCK
        left = np.minimum(size[owner] - inside * BLOCK, BLOCK)
        grid = np.zeros((BLOCK, len(owner)), np.int32)
        for j in range(BLOCK):
            on = left > j
            grid[j, on] = flat[begin[on] + j]
        later = np.flatnonzero(inside > 0)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for at, start in enumerate(self.start):
            # all blocks as if a phrase began in each; then again from where the
            # block before really ended, until no block ends elsewhere than before
            entry = np.full(len(owner), start, np.int32)
            breaks, end = self._parse(at, grid, entry)
            while len(moved := later[end[later - 1] != entry[later]]):
                entry[moved] = end[moved - 1]
                breaks[moved], end[moved] = self._parse(at, grid[:, moved], entry[moved])
            out[:, at] = (np.bincount(owner, breaks, len(texts)) if len(owner) else 0) + (size > 0)
        return size, out

    def _parse(self, at: int, grid: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin behind the first letter of a block, and the states at its end."""
        seen = self.rare[at][0]
        searched = seen.any()
        breaks = np.zeros(grid.shape[1], np.int64)
        for row in grid:
            before = state
            state = self.table.take(before + self.column_of[at].take(row))
            if searched and len(which := np.flatnonzero(seen.take(row))):
                state[which] = self.search(at, before[which], row[which])
            sign = state >> 31
            breaks -= sign
            state ^= sign
        return breaks, state

    def search(self, at: int, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Next states by letters without a column, or the complement after a break."""
        _, keys, targets = self.rare[at]
        width, start = len(self.column_of[at]), self.start[at]
        key = state.astype(np.int64) * width + letter
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        root = np.searchsorted(keys, np.int64(start) * width + letter)  # every such letter leaves the root
        return np.where(keys[place] == key, targets[place], ~targets[root])

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ties go to the first name."""
        known = [at for at, t in enumerate(texts) if self.languages and has_letter(t)]
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if known:
            size, phrases = self.phrases([plain(texts[at]) for at in known])
            entropy = phrases * self.bits / np.maximum(size, 1)[:, None]
            best = entropy.argmin(1)
            weight = np.exp2(-SHARPNESS * (entropy - entropy.min(1, keepdims=True)))
            for at, b in zip(known, best.tolist(), strict=True):
                names[at] = self.languages[b]
            scores[known] = 1 / weight.sum(1)
        return names, scores


def train(docs: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> CrossParser:
    """Fit on at most ``sample_rows`` texts per language, copies counted once.

    Rows with null text, null lang or no letter teach nothing. The sample is by
    the hash of the text and bounded by languages times ``sample_rows``.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", F.xxhash64("text").alias("h"), "doc_id")
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = (rows.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"))
              .withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_rows).drop("n"))
    spot = F.col("h").bitwiseAND(F.lit((1 << 62) - 1)) % F.greatest(F.length("text") - WINDOW + 1, F.lit(1)) + 1
    texts = (docs.select("lang", "doc_id", "text").withColumn("h", F.xxhash64("text"))
             .join(F.broadcast(picked), ["lang", "h", "doc_id"])
             .select("lang", "h", F.col("text").substr(spot.cast("int"), F.lit(WINDOW)).alias("part")).distinct())
    training: dict[str, list[str]] = {}
    for r in sorted(texts.collect()):
        training.setdefault(r.lang, []).append(r.part)
    return CrossParser({lang: " ".join(parts) for lang, parts in training.items()})


def predict(docs: DataFrame, parser: CrossParser, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` with ``lang_pred`` and ``score`` of every whole text.

    A text that is null or has no letter, or any text when no language was
    learned, is ``und`` with score 0. Repeated rows are judged each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    kept = docs.select("text", *[F.col(c).alias(f"_{c}") for c in columns])
    schema = ", ".join(f"`_{c}` {dict(docs.dtypes)[c]}" for c in columns) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, 4_000_000):
            names, scores = own.classify(part.column(0).to_pylist())
            yield pa.record_batch([*part.columns[1:], pa.array(names), pa.array(scores)],
                                  [*(f"_{c}" for c in columns), "lang_pred", "score"])

    return kept.mapInArrow(run, schema).withColumnsRenamed({f"_{c}": c for c in columns})


def determined(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """The rows of ``docs`` with a letter, all columns: in every such text some
    language fits best. When no language was learned, they stay as well.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, 4_000_000):
            texts = part["text"].to_pylist()
            if own.languages:
                told = [n != UNDETERMINED for n in own.classify(texts)[0]]
            else:
                told = list(map(has_letter, texts))
            yield part.filter(pa.array(told, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
