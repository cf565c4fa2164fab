"""Phrase collocations by best-first branch and bound over prefixes.

A phrase of two to four words scores by its weakest cut: with a the count of the
phrase and l, r those of the two parts, floor(2000000 * a / (l + r)). A phrase
that begins with p has at most the count of p, and a first cut whose left part
is the first word of p, so it scores at most

    floor(2000000 * f(p) / (f(first word of p) + f(p))).

Prefixes are expanded in bands of this bound, best first. The band ends at a
floor per language, taken from the scores of its pairs; what lies above the
floor is then known in full. A language whose surviving phrases above the floor
reach the limit is settled: nothing below can enter, and ties at the last rank
are above it too. The others go on with a lower floor, at last with 0, where all
phrases are known.

A level is one pass over the texts. Workers learn which prefixes to expand from
filters of fixed size (a bit that is set by chance costs a row, not a result),
combine counts within a task, and shuffle digests of words, never text. Words
have no two digests alike: the first pass counts words by text and takes another
seed if a digest of a frequent word is not its own.

A shorter phrase goes when a longer one holds it in four fifths of its places.
That need only be asked of phrases one word longer: one in between is at least
as frequent as the longer one. So the floor is joined by all one-word extensions
of phrases above it, whatever those score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespan.llm.common import slices, stage, width
from cuespan.llm.words import Combined, byte_classes, cut, digests, filter_of, held_by

CLASSES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
LEAST, LONGEST, LIMIT, SCALE, WITHIN, WIDER = 30, 4, 2_000, 2_000_000, 80, 4
SLICE = 3_000_000  # bytes of texts cut into words at once; two workers share an executor with a full heap
TURN = 21  # bits by which the digest of each further word is turned in the key of a phrase


def _words(part: pa.RecordBatch):
    """The tokens of a slice: place of each in the distinct (language, word)
    lists, its piece; and the digests, languages and words of those lists."""
    lid = part.column("lid").to_numpy()
    words, owner, piece = cut(part.column("text").to_pylist(), CLASSES)
    coded = words.dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    size = max(len(names), 1)
    langs, lang = np.unique(lid, return_inverse=True)
    kinds, kind = np.unique(lang[owner] * size + code, return_inverse=True)
    owned = names.take(pa.array(kinds % size))
    digest = np.zeros(len(kinds), np.int64)
    for i, seed in enumerate(langs.tolist()):
        here = np.flatnonzero(kinds // size == i)
        digest[here] = digests(owned.take(pa.array(here)).to_pylist(), seed)
    return kind, piece, digest, langs[kinds // size], owned


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Combined(["h", "lid", "word"], ["n"])
    for part in slices(batches, SLICE):
        kind, _, digest, lid, names = _words(part)
        yield from out.add({"h": digest, "lid": lid, "word": names.cast(pa.string()), "n": np.bincount(kind, minlength=len(digest))})
    yield from out.rest()


def phrase_keys(words: np.ndarray, m: int) -> np.ndarray:
    """A 64-bit key of the phrase of m words that starts at each word."""
    words = words.view(np.uint64)
    count = max(len(words) - m + 1, 0)
    key = words[:count].copy()
    for j in range(1, m):
        turn = np.uint64(TURN * j % 64)
        key ^= (words[j:j + count] << turn) | (words[j:j + count] >> (np.uint64(64) - turn))
    return key.view(np.int64)


def phrase_key(names: list[str]) -> Column:
    """The same key of columns."""
    key = F.col(names[0])
    for j, name in enumerate(names[1:], 1):
        turn = TURN * j % 64
        key = key.bitwiseXOR(F.shiftleft(name, turn).bitwiseOR(F.shiftrightunsigned(name, 64 - turn)))
    return key


def _count_phrases(m: int, alive, pairs=None, grow=None, settle=None, only=None):
    """Count phrases of m words, all alive, inside pieces. ``only`` names the
    phrases by key; else the first m - 1 words are to ``grow`` or the last
    m - 1 are to ``settle``, where given."""
    names = [f"w{j}" for j in range(1, m + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Combined(names, ["n"])
        for part in slices(batches, SLICE):
            kind, piece, digest, _, _ = _words(part)
            count = len(kind) - m + 1
            if count <= 0:
                continue
            fit = held_by(alive.value, digest)[kind]
            ok = piece[:count] == piece[m - 1:]
            for j in range(m):
                ok &= fit[j:j + count]
            word = digest[kind]
            if pairs is not None:
                near = held_by(pairs.value, phrase_keys(word, 2))
                for j in range(m - 1):
                    ok &= near[j:j + count]
            if only is not None:
                ok &= held_by(only.value, phrase_keys(word, m))
            elif grow is not None:
                shorter = phrase_keys(word, m - 1)
                ok &= held_by(grow.value, shorter[:-1]) | held_by(settle.value, shorter[1:])
            at = np.flatnonzero(ok)
            if len(digest) ** m < 1 << 62:
                packed = np.zeros(len(at), np.int64)
                for j in range(m):
                    packed = packed * len(digest) + kind[at + j]
                packed, n = np.unique(packed, return_counts=True)
                columns = {}
                for name in reversed(names):
                    columns[name] = digest[packed % len(digest)]
                    packed = packed // len(digest)
            else:
                columns, n = {name: word[at + j] for j, name in enumerate(names)}, np.ones(len(at), np.int64)
            yield from out.add({name: columns[name] for name in names} | {"n": n.astype(np.int64)})
        yield from out.rest()

    return run


class Miner:
    """Counts of words and pairs of a corpus, and the search for its phrases.

    A null text is empty, a null lang is 'und', every row counts. Words and
    pieces of very long texts are cut a slice at a time. Columns of other names
    are not read. An empty table has no words and no phrases.
    """

    def __init__(self, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, limit: int = LIMIT,
                 within: int = WITHIN, scale: int = SCALE):
        self.spark, self.parts = docs.sparkSession, width(docs)
        self.least, self.longest, self.limit, self.within, self.scale = least, longest, limit, within, scale
        plain = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
        names = stage(plain.select("lang").distinct(), "languages")
        seed = 0
        while not self._counted(plain, names, seed):
            seed += 1
        self.alive = self.words.where(F.col("n") >= least)
        self.alive_bits = self._bits(self.alive.select("h"))
        self.levels = {2: self._pairs()}
        self.pair_bits = self._bits(self.levels[2].select(phrase_key(["w1", "w2"])))

    def _counted(self, plain: DataFrame, names: DataFrame, seed: int) -> bool:
        """Count words by text; whether digests of languages and of frequent words tell them apart."""
        lid = F.xxhash64(F.lit(seed), "lang").alias("lid")
        self.langs, self.rows = names.select("lang", lid), plain.select("text", lid)
        self.words = stage(self.rows.mapInArrow(_count_words, "h long, lid long, word string, n long")
                           .repartition(self.parts, "h").groupBy("h", "lid", "word").agg(F.sum("n").alias("n")), "words")
        same = self.words.groupBy("h").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
        twice = same.where((F.col("texts") > 1) & (F.col("n") >= self.least)).isEmpty()
        seen = self.langs.agg(F.count("*").alias("n"), F.count_distinct("lid").alias("ids")).first()
        return twice and seen.n == seen.ids

    def _bits(self, keys: DataFrame):
        return self.spark.sparkContext.broadcast(filter_of(keys))  # 2 MB, whatever the number of keys

    def _pass(self, rows: DataFrame, m: int, label: str, **filters) -> DataFrame:
        """(w1 .. wm, a) of frequent phrases of m words."""
        names = [f"w{j}" for j in range(1, m + 1)]
        counted = rows.mapInArrow(_count_phrases(m, self.alive_bits, **filters), ", ".join(f"{n} long" for n in names) + ", n long")
        return stage(counted.repartition(self.parts, *names).groupBy(*names).agg(F.sum("n").alias("a"))
                     .where(F.col("a") >= self.least), label)

    def _over(self, a: Column, below: Column) -> Column:
        """floor(scale * a / below), exact beyond 64 bits."""
        return F.call_function("div", a.cast("decimal(19,0)") * F.lit(self.scale).cast("decimal(10,0)"), below.cast("decimal(20,0)"))

    def _with_score(self, df: DataFrame) -> DataFrame:
        """``heads`` holds f(w1), f(w1 w2), .. and ``tails`` .., f(wm): the cut
        after k words has the k-th of both. Add the weakest cut, the first of equals."""
        def at(k, left, right):
            return F.struct(self._over(F.col("a"), left.cast("decimal(19,0)") + right.cast("decimal(19,0)")).alias("score"),
                            k.alias("k"), left.alias("l"), right.alias("r"))
        m = len([c for c in df.columns if c.startswith("w")])
        cuts = F.array(*[at(F.lit(k), F.col("heads")[k - 1], F.col("tails")[k - 1]) for k in range(1, m)])
        return df.withColumn("best", F.when(F.col("tails").isNotNull(), F.array_min(cuts)))

    def _pairs(self) -> DataFrame:
        """All frequent pairs: the bound of a single word is the highest score,
        so the first level of the frontier is expanded whole."""
        found = self._pass(self.rows, 2, "pairs")
        one = self.alive.select(F.col("h").alias("w1"), "lid", F.array("n").alias("heads"))
        two = self.alive.select(F.col("h").alias("w2"), F.array("n").alias("tails"))
        return stage(self._with_score(found.join(one, "w1").join(two, "w2")), "scored")

    def _tails(self, rows: DataFrame, keys: DataFrame, m: int) -> DataFrame:
        """(w1 .. wm, tails): counts of the phrase and its ends, for the distinct
        ``keys`` of m words; phrases that no band has expanded are counted now."""
        names = [f"w{j}" for j in range(1, m + 1)]
        whole = F.concat(F.array("a"), F.col("tails")).alias("tails")
        known = self.levels[m].where(F.col("tails").isNotNull()).select(*names, whole)
        if m == 2:
            return known.join(keys, names, "left_semi")
        lacking = stage(keys.join(known, names, "left_anti"), "lacking")
        found = known.join(keys, names, "left_semi")
        if lacking.isEmpty():
            return found
        counted = self._pass(rows, m, "ends", pairs=self.pair_bits, only=self._bits(lacking.select(phrase_key(names))))
        shorter = [F.col(n).alias(f"w{j}") for j, n in enumerate(names[1:], 1)]
        ends = self._tails(rows, lacking.select(*shorter).distinct(), m - 1)
        ends = ends.select(*[F.col(f"w{j}").alias(n) for j, n in enumerate(names[1:], 1)], F.col("tails"))
        more = counted.join(lacking, names, "left_semi").join(ends, names[1:]).select(*names, whole)
        return found.unionByName(more)

    def _level(self, rows: DataFrame, floors: DataFrame, m: int) -> tuple[DataFrame, DataFrame]:
        """Expand the prefixes of m - 1 words of the band. Returns the counts,
        and keeps heads, tails and scores of the phrases that may pass the floor."""
        names, heads = [f"w{j}" for j in range(1, m + 1)], [f"w{j}" for j in range(1, m)]
        prefixes = self.levels[m - 1].join(floors, "lid")
        bound = self._over(F.col("a"), F.col("heads")[0] + F.col("a"))
        grow = prefixes.where(bound >= F.col("floor"))
        above = prefixes.where(F.col("best.score") >= F.col("floor"))
        counts = self._pass(rows, m, f"phrases-{m}", pairs=self.pair_bits, grow=self._bits(grow.select(phrase_key(heads))),
                            settle=self._bits(above.select(phrase_key(heads))))
        begun = counts.join(grow.select(*heads, "lid", "floor", F.concat("heads", F.array("a")).alias("heads")), heads)
        begun = stage(begun, "begun")
        best_case = self._over(F.col("a"), F.col("heads")[0] + F.col("a"))
        last = self._over(F.col("a"), F.col("heads")[m - 2] + F.col("a"))
        able = begun.where((best_case >= F.col("floor")) & (last >= F.col("floor")))
        keys = able.select(*[F.col(n).alias(f"w{j}") for j, n in enumerate(names[1:], 1)]).distinct()
        ends = self._tails(rows, keys, m - 1).select(*[F.col(f"w{j}").alias(n) for j, n in enumerate(names[1:], 1)], "tails")
        scored = able.join(ends, names[1:])
        rest = begun.join(scored.select(*names), names, "left_anti").withColumn("tails", F.lit(None).cast("array<long>"))
        columns = [*names, "a", "lid", "heads", "tails"]
        self.levels[m] = stage(self._with_score(scored.select(columns).unionByName(rest.select(columns))), "scored")
        return counts

    def _surviving(self, m: int, longer: DataFrame | None, floors: DataFrame) -> DataFrame:
        """Phrases of m words above the floor that no longer one mostly holds."""
        names = [f"w{j}" for j in range(1, m + 1)]
        above = self.levels[m].join(floors, "lid").where(F.col("best.score") >= F.col("floor"))
        if longer is not None:
            front = longer.select(*names, F.col("a").alias("most"))
            back = longer.select(*[F.col(f"w{j + 1}").alias(n) for j, n in enumerate(names, 1)], F.col("a").alias("most"))
            held = front.unionByName(back).groupBy(*names).agg(F.max("most").alias("most"))
            above = above.join(held, names, "left").where(
                "most IS NULL" f" OR CAST(100 AS decimal(3,0)) * CAST(most AS decimal(19,0)) < CAST({self.within} AS decimal(3,0)) * CAST(a AS decimal(19,0))")
        words = [F.col(n) if n in names else F.lit(None).cast("long").alias(n) for n in (f"w{j}" for j in range(1, self.longest + 1))]
        return above.select("lid", "floor", *words, "a", "best.l", "best.r", "best.score")

    def phrases(self) -> DataFrame:
        """lang, rank, phrase, a, l, r, n, score: the first ``limit`` of each language."""
        waiting, goal, done = stage(self.langs.select("lid"), "waiting"), self.limit, None
        pairs = self.levels[2]
        while True:
            # the floor of a band: the score of the goal-th best pair, or 0
            place = F.row_number().over(Window.partitionBy("lid").orderBy(F.desc("best.score")))
            first = pairs.withColumn("place", place).where(F.col("place") <= goal)  # cut in every task before the shuffle
            nth = first.groupBy("lid").agg(F.count("*").alias("n"), F.min("best.score").alias("floor")).where(F.col("n") == goal).drop("n")
            floors = stage(waiting.join(nth, "lid", "left").na.fill(0, ["floor"]), "floors")
            rows = self.rows if done is None else self.rows.join(floors.select("lid"), "lid", "left_semi").select("text", "lid")
            counts = {m: self._level(rows, floors, m) for m in range(3, self.longest + 1)}
            kept = None
            for m in range(2, self.longest + 1):
                own = self._surviving(m, counts.get(m + 1), floors)
                kept = own if kept is None else kept.unionByName(own)
            kept = stage(kept, "surviving")
            reached = kept.groupBy("lid").agg(F.count("*").alias("n"))
            state = stage(floors.join(reached, "lid", "left").withColumn(
                "settled", (F.col("floor") == 0) | (F.coalesce("n", F.lit(0)) >= self.limit)), "state")
            now = kept.join(state.where("settled").select("lid"), "lid", "left_semi")
            done = now if done is None else done.unionByName(now)
            waiting = stage(state.where("NOT settled").select("lid"), "waiting")
            if waiting.isEmpty():
                break
            goal *= WIDER
        return self._ranked(done)

    def _ranked(self, found: DataFrame) -> DataFrame:
        by = [F.desc("score"), F.desc("a")]
        few = found.withColumn("place", F.rank().over(Window.partitionBy("lid").orderBy(*by))).where(F.col("place") <= self.limit)
        for j in range(1, self.longest + 1):  # text is joined to what can be in the result, ties included
            few = few.join(self.alive.select(F.col("h").alias(f"w{j}"), F.col("word").alias(f"t{j}")), f"w{j}", "left")
        phrase = F.concat_ws(" ", *[f"t{j}" for j in range(1, self.longest + 1)])
        totals = self.words.groupBy("lid").agg(F.sum("n").alias("n"))
        rank = F.row_number().over(Window.partitionBy("lid").orderBy(*by, "phrase"))
        return (few.withColumn("phrase", phrase).withColumn("rank", rank).where(F.col("rank") <= self.limit)
                .join(totals, "lid").join(self.langs, "lid")
                .select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, limit: int = LIMIT, within: int = WITHIN) -> DataFrame:
    """The first ``limit`` collocations of each language; see ``Miner``."""
    return Miner(docs, least, longest, limit, within).phrases()
