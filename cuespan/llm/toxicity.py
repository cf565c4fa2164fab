"""Toxicity by two class-conditional Kneser-Ney models over the letters of words.

Each class keeps its own counts of letter n-grams of the highest order; every
lower order is one continuation model that both classes share, so a rare
expression falls back on the same counts under either class and cannot tip the
balance by being rare. A text is scored by the log-likelihood ratio of its
words, normalised by its length, as a whole and in its strongest stretch; a
logistic curve fitted on rows that the models have not seen makes it a
probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.llm.common import slices, stage

ORDER = 6
DISCOUNT = 0.75
SAMPLE_ROWS = 6_000  # labelled rows of each class, at most
STRETCH = 24  # words
THRESHOLD = 0.3  # a text is predicted toxic from this score on
KNOWN = 100_000  # words that a worker remembers before it starts anew
HELD_OUT = 4  # one in so many sampled rows fits the curve, not the models
FEW_CURVE = np.array([0.0, 0.0, 3.0, -7.0])  # near what is fitted on small tables; for too few held-out texts
WORD = re.compile(r"[^\W\d_]+")
PAD, END = "^", "$"


def ngrams(word: str, order: int = ORDER) -> list[str]:
    """The n-grams of highest order that spell the word and its end."""
    padded = PAD * (order - 1) + word + END
    return [padded[i:i + order] for i in range(len(word) + 1)]


class KneserNey:
    """Interpolated Kneser-Ney models of class 1 and class 0 with a shared backoff."""

    def __init__(self, grams: dict[str, tuple[int, int]], order: int = ORDER, discount: float = DISCOUNT):
        self.order, self.discount = order, discount
        self.top = grams
        self.context: dict[str, list[int]] = {}  # totals, then kinds, of class 1 and class 0
        for gram, counts in grams.items():
            own = self.context.setdefault(gram[:-1], [0, 0, 0, 0])
            for side in (0, 1):
                own[side] += counts[side]
                own[side + 2] += counts[side] > 0
        # shared continuation counts: how many different letters precede an n-gram
        self.lower: list[dict[str, int]] = [{} for _ in range(order)]
        self.lower_context: list[dict[str, list[int]]] = [{} for _ in range(order)]
        level: dict = grams
        for n in range(order - 1, 0, -1):
            level = self.lower[n] = dict(Counter(gram[1:] for gram in level))
            for gram, count in level.items():
                own = self.lower_context[n].setdefault(gram[:-1], [0, 0])
                own[0] += count
                own[1] += 1
        self.uniform = 1.0 / (len(self.lower[1]) + 1)

    def shared(self, gram: str) -> float:
        p, d = self.uniform, self.discount
        for n in range(1, self.order):
            part = gram[-n:]
            total, kinds = self.lower_context[n].get(part[:-1], (0, 0))
            if total:
                p = (max(self.lower[n].get(part, 0) - d, 0.0) + d * kinds * p) / total
        return p

    def probabilities(self, gram: str) -> tuple[float, float]:
        """p(last letter | the letters before) under class 1 and class 0."""
        p, own = self.shared(gram), self.context.get(gram[:-1], (0, 0, 0, 0))
        seen = self.top.get(gram, (0, 0))
        return tuple((max(seen[side] - self.discount, 0.0) + self.discount * own[side + 2] * p) / own[side] if own[side] else p
                     for side in (0, 1))

    def unseen_ratio(self, context: str) -> float:
        """log ratio of a letter that no class has seen after ``context``: the
        shared backoff stands on both sides and cancels."""
        own = self.context.get(context, (0, 0, 0, 0))
        one, zero = (self.discount * own[side + 2] / own[side] if own[side] else 1.0 for side in (0, 1))
        return math.log(one / zero)

    def gram_ratio(self, gram: str) -> float:
        """log p(last letter | before, class 1) - log p(last letter | before, class 0)."""
        if gram not in self.top:
            return self.unseen_ratio(gram[:-1])
        one, zero = self.probabilities(gram)
        return math.log(one / zero)


class Ratios:
    """What scoring needs of the models: one number for each seen n-gram and one
    for each context, as sorted 64-bit hashes and doubles. Workers share it as
    plain arrays and look up all words of a slice at once."""

    def __init__(self, models: KneserNey):
        self.order = models.order
        self.grams, self.seen = self._sorted(list(models.top), models.gram_ratio)
        self.contexts, self.unseen = self._sorted(list(models.context), models.unseen_ratio)

    def _sorted(self, texts: list[str], ratio) -> tuple[np.ndarray, np.ndarray]:
        keys = _hashes(_points(texts).reshape(len(texts), -1)) if texts else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        return keys[order], np.array([ratio(t) for t in texts], np.float64)[order]

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The value of each key, nan for one that is not there."""
        if not len(keys):
            return np.full(len(wanted), np.nan)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], np.nan)

    def words(self, words: list[str]) -> np.ndarray:
        """log p(word | 1) - log p(word | 0) of each word and its end."""
        if not words:
            return np.zeros(0)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        points = _points([PAD * (self.order - 1) + w + END for w in words])
        first = np.cumsum(size) - size
        start = np.arange(size.sum()) + np.repeat(np.arange(len(words)) * (self.order - 1), size)
        grams = np.lib.stride_tricks.sliding_window_view(points, self.order)[start]
        found = self._find(self.grams, self.seen, _hashes(grams))
        lacking = np.flatnonzero(np.isnan(found))
        found[lacking] = np.nan_to_num(self._find(self.contexts, self.unseen, _hashes(grams[lacking, :-1])))
        return np.add.reduceat(found, first)


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def _hashes(points: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each row of code points."""
    out = np.full(len(points), points.shape[1], np.uint64)
    for column in points.T:
        out = (out ^ (column.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


class Known:
    """Ratios of words that a worker has met; when full it starts anew."""

    def __init__(self, ratios: Ratios):
        self.ratios, self.words = ratios, {}

    def features(self, texts: list[str]) -> np.ndarray:
        """For each text: ratio per word of the text, of its strongest stretch,
        and the share of plainly toxic words; shrunk for short texts."""
        found = [WORD.findall(t.lower()) for t in texts]
        if len(self.words) > KNOWN:
            self.words = {}
        new = list({w for t in found for w in t}.difference(self.words))
        self.words.update(zip(new, self.ratios.words(new).tolist(), strict=True))
        return np.array([_features(np.array(list(map(self.words.__getitem__, t)))) for t in found]).reshape(-1, 3)


def _features(own: np.ndarray) -> tuple[float, float, float]:
    if not len(own):
        return 0.0, 0.0, 0.0
    sums = np.concatenate([[0.0], np.cumsum(own)])
    stretch = (sums[STRETCH:] - sums[:-STRETCH]).max() if len(own) > STRETCH else sums[-1]
    excess = np.maximum(own - 2.0, 0.0).sum()
    return (float(sums[-1] / (len(own) + STRETCH)), float(stretch / STRETCH), float(math.log1p(100 * excess / (len(own) + STRETCH))))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve by Newton's steps; the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Scorer:
    """Ratios of the two models and the curve that makes their features a probability."""

    def __init__(self, models: KneserNey | Ratios | None, curve: np.ndarray | None, share: float):
        self.models = Ratios(models) if isinstance(models, KneserNey) else models
        self.curve, self.share = curve, share

    def worker(self):
        """A function from texts to scores, with a memory of its own."""
        if self.models is None or self.curve is None:
            return lambda texts: np.full(len(texts), self.share)
        known = Known(self.models)

        def scores(texts: list[str]) -> np.ndarray:
            z = known.features(texts) @ self.curve[:-1] + self.curve[-1]
            return 1 / (1 + np.exp(-np.clip(z, -30.0, 30.0)))

        return scores

    def score(self, text: str) -> float:
        return float(self.worker()([text])[0])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        words = Counter()
        for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            words.update((w, label) for w in WORD.findall((text or "").lower()))
        counts: dict[str, list[int]] = {}
        for (word, label), n in words.items():
            for gram in ngrams(word):
                counts.setdefault(gram, [0, 0])[0 if label else 1] += n
        one, zero = zip(*counts.values(), strict=True) if counts else ((), ())
        yield pa.record_batch([pa.array(counts, pa.string()), pa.array(one, pa.int64()), pa.array(zero, pa.int64())],
                              ["gram", "one", "zero"])


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Fit on at most about ``sample_rows`` labelled texts of each class.

    ``labels`` holds doc_id and toxic (0, 1; null counts as unlabelled; of
    several labels of a doc_id the highest holds); ``usable`` says which rows of
    ``docs`` may be learned from. The sample is taken by the hash of the text,
    so copies count once. With fewer than ``2 * HELD_OUT`` texts of a class all
    of them fit the models and the curve is ``FEW_CURVE``, as it is when the held
    out texts are of one class. With rows of one class only, or none, there are no
    models and every score is the share of toxic rows.
    """
    spark = docs.sparkSession
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    # only ids and hashes are shuffled here, not the texts
    ids = docs.where(usable & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("h"))
    rows = stage(ids.join(known, "doc_id").groupBy("h", "label").agg(F.min("doc_id").alias("doc_id")), "labelled")
    total = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    few = min(total.values(), default=0) < 2 * HELD_OUT
    if len(total) < 2:
        return Scorer(None, None, total.get(1, 0) / max(1, sum(total.values())))
    span = 1 << 30
    bound = F.when(F.col("label") == 1, int(span * min(1.0, sample_rows / total[1]))).otherwise(
        int(span * min(1.0, sample_rows / total[0])))
    # at most about 2 * sample_rows rows of three numbers
    sample = F.broadcast(rows.where(F.pmod("h", F.lit(span)) < bound))
    texts = stage(docs.select("doc_id", "text").withColumn("h", F.xxhash64("text")).join(sample, ["doc_id", "h"])
                  .select("text", F.col("label").cast("int").alias("label"),
                          (F.lit(not few) & (F.pmod(F.shiftrightunsigned("h", 32), F.lit(HELD_OUT)) == 0)).alias("held")), "toxic-sample")
    counted = (texts.where("NOT held").select("text", "label").mapInArrow(_grams, "gram string, one long, zero long")
               .groupBy("gram").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")).toArrow())
    grams = dict(zip(counted["gram"].to_pylist(), zip(counted["one"].to_pylist(), counted["zero"].to_pylist(), strict=True), strict=True))
    if few:
        return Scorer(KneserNey(grams), FEW_CURVE, 0.0)
    ratios = Ratios(KneserNey(grams))
    shared = spark.sparkContext.broadcast(ratios)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(shared.value)
        for part in slices(batches):
            rows = known.features(part.column(0).to_pylist())
            yield pa.record_batch([*map(pa.array, rows.T), part.column(1)], ["a", "b", "c", "label"])

    seen = texts.where("held").select("text", "label").mapInArrow(features, "a double, b double, c double, label int").toPandas()
    y = seen["label"].to_numpy(float)
    if y.min(initial=1.0) == y.max(initial=0.0) or len(y) == 0:
        return Scorer(ratios, FEW_CURVE, 0.0)
    # each class weighs what it weighs among all labelled rows
    weight = np.where(y == 1, total[1] / y.sum(), total[0] / (len(y) - y.sum())) * len(y) / sum(total.values())
    return Scorer(ratios, fit_logistic(seen[["a", "b", "c"]].to_numpy(), y, weight), 0.0)


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` with ``score`` and ``predicted`` of every whole text.

    A null or empty text has no words and gets the score of a text without
    signal. Repeated rows are scored each; other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    kept = docs.select("text", *[F.col(c).alias(f"_{c}") for c in columns])
    schema = ", ".join(f"`_{c}` {dict(docs.dtypes)[c]}" for c in columns) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.worker()
        for part in slices(batches):
            scores = own([t or "" for t in part.column(0).to_pylist()])
            yield pa.record_batch([*part.columns[1:], pa.array(scores), pa.array((scores >= threshold).astype("i4"))],
                                  [*(f"_{c}" for c in columns), "score", "predicted"])

    return kept.mapInArrow(run, schema).withColumnsRenamed({f"_{c}": c for c in columns})


def without_toxic(docs: DataFrame, scorer: Scorer, threshold: float) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, all columns; all
    rows when there are no models, as the share alone says nothing about a text.
    """
    if scorer.models is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.worker()
        for part in slices(batches):
            yield part.filter(pa.array(own([t or "" for t in part["text"].to_pylist()]) < threshold))

    return docs.mapInArrow(run, docs.schema)
