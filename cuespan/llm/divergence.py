"""Source divergence audit with late string materialization.

How far do the sources of a language differ in their words? Terms are counted by
group (language and source) without their text: what is shuffled is a 64-bit
digest of language and term, the id of the group, and two counts. A term stays
when enough documents of its language hold it.

Texts come late. A second pass over the documents sends the text of kept digests
only (a filter of fixed size tells them before the shuffle, a join after it),
and a digest whose smallest and largest text differ is a collision: its counts
are thrown away and made again by text. Text is joined to results only where it
is part of one.

Distances between sources need every kept term for every pair of sources. Terms
are dealt out in blocks, sources in tiles, and a task holds a block of terms for
two tiles, subtracts columns and returns one sum per pair. A source without a
term has the same number for all such terms, so only counts above zero travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespan.llm.common import slices, stage, width
from cuespan.llm.words import Combined, byte_classes, cut, digests, filter_of, held_by

LETTERS = byte_classes(bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)))
LEAST_DOCUMENTS, RANKS, SCALE, SMOOTH = 30, 50, 1_000_000_000, 5
BLOCK_TERMS, TILE_SOURCES = 4_096, 64


def _terms(part: pa.RecordBatch, bits: int):
    """For each (text, distinct term): the text's place, its count, and the place
    of its (language, term) in the lists of digests, languages and terms."""
    lid = part.column("lid").to_numpy()
    words, owner, _ = cut(part.column("text").to_pylist(), LETTERS)
    coded = words.dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    size = max(len(names), 1)
    each, n = np.unique(owner * size + code, return_counts=True)
    doc, code = each // size, each % size
    langs, lang = np.unique(lid[doc], return_inverse=True)
    kinds, kind = np.unique(lang * size + code, return_inverse=True)
    owned = names.take(pa.array(kinds % size))
    digest = np.zeros(len(kinds), np.int64)
    for i, seed in enumerate(langs.tolist()):
        here = np.flatnonzero(kinds // size == i)
        digest[here] = digests(owned.take(pa.array(here)).to_pylist(), seed)
    if bits < 64:
        digest &= (1 << bits) - 1
    return doc, n, kind, digest, langs[kinds // size], owned


def _by_group(part: pa.RecordBatch, doc: np.ndarray, n: np.ndarray, kind: np.ndarray, kinds: int):
    """(group id, place of the term, occurrences, documents) of a slice."""
    ids, group = np.unique(part.column("grp").to_numpy()[doc], return_inverse=True)
    each, place = np.unique(group * max(kinds, 1) + kind, return_inverse=True)
    return (ids[each // max(kinds, 1)], each % max(kinds, 1), np.bincount(place, n, len(each)).astype(np.int64),
            np.bincount(place, minlength=len(each)))


def _counted(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Combined(["digest", "grp"], ["n", "d"])
        for part in slices(batches):
            doc, n, kind, digest, _, _ = _terms(part, bits)
            grp, at, n, d = _by_group(part, doc, n, kind, len(digest))
            yield from out.add({"digest": digest[at], "grp": grp, "n": n, "d": d})
        yield from out.rest()

    return run


def _texts(bits: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Combined(["digest", "lid", "term"], [])
        for part in slices(batches):
            _, _, _, digest, lid, names = _terms(part, bits)
            at = np.flatnonzero(held_by(wanted.value, digest))
            yield from out.add({"digest": digest[at], "lid": lid[at], "term": names.take(pa.array(at)).cast(pa.string())})
        yield from out.rest()

    return run


def _counted_by_text(bits: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Combined(["digest", "lid", "term", "grp"], ["n", "d"])
        for part in slices(batches):
            doc, n, kind, digest, lid, names = _terms(part, bits)
            open_ = held_by(wanted.value, digest)[kind]
            grp, at, n, d = _by_group(part, doc[open_], n[open_], kind[open_], len(digest))
            yield from out.add({"digest": digest[at], "lid": lid[at], "term": names.take(pa.array(at)).cast(pa.string()),
                                "grp": grp, "n": n, "d": d})
        yield from out.rest()

    return run


def group_table(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, source, lid, grp): each group and language with a 64-bit id; the
    seed of the ids is the first that gives all of them different ones."""
    names = stage(docs.select("lang", "source").distinct(), "groups")
    seed = 0
    while True:
        table = names.withColumns({"lid": F.xxhash64(F.lit(seed), "lang"), "grp": F.xxhash64(F.lit(seed), "lang", "source")})
        langs = table.select("lang", "lid").distinct().agg(F.count("*").alias("n"), F.count_distinct("lid").alias("ids")).first()
        groups = table.agg(F.count("*").alias("n"), F.count_distinct("grp").alias("ids")).first()
        if langs.n == langs.ids and groups.n == groups.ids:
            return table, seed
        seed += 1


class Audit:
    """Counts of kept terms and what follows from them.

    A null text, lang or source is ''. Every row is a document, also one that
    repeats another. Very long texts are one slice of work each. An empty table
    has no groups and no rows; a group without terms, or a language without kept
    terms, has its pairs, with value 0 where no term is kept. Columns of other
    names are not read. ``bits`` shortens the digests (a test of collisions).
    """

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCUMENTS, bits: int = 64):
        text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("text", "lang", "source")}
        plain = docs.select(*[v.alias(c) for c, v in text.items()])
        self.spark, self.least, self.bits = docs.sparkSession, least, bits
        groups, seed = group_table(plain)
        self.rows = plain.select("text", F.xxhash64(F.lit(seed), "lang").alias("lid"), F.xxhash64(F.lit(seed), "lang", "source").alias("grp"))
        self.kept, self.names = self._kept()
        self.groups, self.scored = self._scored(groups)

    def _kept(self) -> tuple[DataFrame, DataFrame]:
        """(digest, part, grp, n) of kept terms, and (digest, part, term). ``part``
        is empty but for terms whose digest is not theirs alone."""
        sc, parts = self.spark.sparkContext, width(self.rows)
        documents = F.sum("d").over(Window.partitionBy("digest"))
        kept = stage(self.rows.mapInArrow(_counted(self.bits), "digest long, grp long, n long, d long")
                     .repartition(parts, "digest").groupBy("digest", "grp").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
                     .withColumn("d", documents).where(F.col("d") >= self.least).select("digest", "grp", "n"), "kept")
        known = kept.select("digest").distinct()
        wanted = sc.broadcast(filter_of(known))
        one = F.struct("lid", "term")
        names = stage(self.rows.mapInArrow(_texts(self.bits, wanted), "digest long, lid long, term string")
                      .join(known, "digest", "left_semi").groupBy("digest").agg(F.min(one).alias("lo"), F.max(one).alias("hi")), "terms")
        clash = names.where("lo <> hi").select("digest")
        alone = names.where("lo = hi").select("digest", F.lit("").alias("part"), "lo.term")
        kept = kept.withColumn("part", F.lit(""))
        if clash.isEmpty():
            return kept, alone
        wanted = sc.broadcast(filter_of(clash))
        documents = F.sum("d").over(Window.partitionBy("digest", "lid", "term"))
        split = stage(self.rows.mapInArrow(_counted_by_text(self.bits, wanted), "digest long, lid long, term string, grp long, n long, d long")
                      .join(clash, "digest", "left_semi").groupBy("digest", "lid", "term", "grp").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
                      .withColumn("d", documents).where(F.col("d") >= self.least)
                      .withColumn("part", F.concat_ws(" ", F.hex("lid"), "term")), "split")
        kept = kept.join(clash, "digest", "left_anti").unionByName(split.select("digest", "grp", "n", "part"))
        return stage(kept, "kept"), alone.unionByName(split.select("digest", "part", "term").distinct())

    @staticmethod
    def _share(count: Column, total: str, terms: str) -> Column:
        """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), products in 38 digits."""
        over = F.expr(f"CAST({total} AS decimal(19,0)) + {SMOOTH} * CAST({terms} AS decimal(18,0))")
        scaled = (count + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
        return F.lit(1).cast("long") + F.floor(F.call_function("div", scaled, F.nullif(over, F.lit(0)))).cast("long")

    def _scored(self, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Groups with their totals and the number of a term they lack (``zero``);
        counts with the number of the group (p) and of its language (q)."""
        kept = self.kept.join(groups.select("grp", "lid"), "grp")
        terms = kept.groupBy("lid", "digest", "part").agg(F.sum("n").alias("whole"))
        langs = terms.groupBy("lid").agg(F.count("*").alias("terms"), F.sum("whole").alias("lang_total"))
        totals = kept.groupBy("grp").agg(F.sum("n").alias("total"))
        sources = groups.groupBy("lid").agg(F.count("*").alias("sources"))
        table = (groups.join(totals, "grp", "left").join(langs, "lid", "left").join(sources, "lid")
                 .na.fill(0, ["total", "terms", "lang_total"]))
        table = stage(table.withColumn("zero", self._share(F.lit(0), "total", "terms")), "totals")
        known = table.select("grp", "total", "terms", "lang_total", "sources")
        whole = F.sum("n").over(Window.partitionBy("digest", "part"))
        scored = kept.withColumn("whole", whole).join(known, "grp")
        return table, stage(scored.select(
            "lid", "grp", "digest", "part", "terms", "sources", self._share(F.col("n"), "total", "terms").alias("p"),
            self._share(F.col("whole"), "lang_total", "terms").alias("q")), "shares")

    def outstanding(self, ranks: int = RANKS) -> DataFrame:
        """The terms that a group has most above its language: value p - q."""
        over = self.scored.where("p > q").select("grp", "digest", "part", (F.col("p") - F.col("q")).alias("value"))
        place = F.rank().over(Window.partitionBy("grp").orderBy(F.desc("value")))
        few = over.withColumn("place", place).where(F.col("place") <= ranks)  # with ties, text decides below
        final = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("value"), "item"))
        return (few.join(self.names, ["digest", "part"]).withColumnRenamed("term", "item")
                .withColumn("rank", final).where(F.col("rank") <= ranks)
                .join(self.groups.select("grp", "lang", "source"), "grp")
                .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))

    def distances(self) -> DataFrame:
        """For every group, every other source of its language: sum of |p - q|."""
        blocks, tiles = F.ceil(F.col("terms") / BLOCK_TERMS), F.ceil(F.col("sources") / TILE_SOURCES)
        full = self.groups.where("terms > 0")
        there = self.scored.withColumn("block", F.pmod(F.xxhash64("digest", "part"), blocks))
        lacking = (full.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("p", F.col("zero"))
                   .withColumn("digest", F.lit(None).cast("long")).withColumn("part", F.lit(None).cast("string")))
        columns = ["lid", "grp", "digest", "part", "p", "block", "sources"]
        tile = F.pmod(F.xxhash64("grp"), tiles)
        meet = F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda o: F.struct(
            F.least(F.col("tile"), o).alias("one"), F.greatest(F.col("tile"), o).alias("two")))
        dealt = (there.select(columns).unionByName(lacking.select(columns)).withColumn("tile", tile)
                 .withColumn("meet", F.explode(meet)).select("lid", "block", "meet.one", "meet.two", "tile", "grp", "digest", "part", "p"))
        sums = (dealt.groupBy("lid", "block", "one", "two").applyInPandas(_subtract, "grp long, other long, value long, seen long")
                .groupBy("grp", "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")))
        a, b = self.groups.alias("a"), self.groups.alias("b")
        both = (a.join(b, (F.col("a.lid") == F.col("b.lid")) & (F.col("a.grp") != F.col("b.grp")))
                .select("a.lang", "a.source", "a.grp", F.col("b.grp").alias("other"), F.col("b.source").alias("item"), "a.terms",
                        F.abs(F.col("a.zero") - F.col("b.zero")).alias("apart")))
        # terms that neither tile of a block has differ by the same number
        value = F.coalesce(F.col("value") + (F.col("terms") - F.col("seen")) * F.col("apart"), F.lit(0).cast("long"))
        place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("value"), "item"))
        return (both.join(sums, ["grp", "other"], "left").withColumn("value", value).withColumn("rank", place)
                .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"))


def _subtract(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over a block of terms for the sources of two tiles."""
    lacking = pdf["digest"].isna()
    base = pdf[lacking].sort_values("grp")
    ids, tile = base["grp"].to_numpy(), base["tile"].to_numpy()
    rows = pdf[~lacking]
    term = rows.groupby(["digest", "part"], sort=False).ngroup().to_numpy()
    seen = int(term.max()) + 1 if len(term) else 0
    share = np.tile(base["p"].to_numpy(np.int64), (seen, 1))
    share[term, np.searchsorted(ids, rows["grp"].to_numpy())] = rows["p"].to_numpy(np.int64)
    one, two = int(pdf["one"].iloc[0]), int(pdf["two"].iloc[0])
    left, right = np.flatnonzero(tile == one), np.flatnonzero(tile == two)
    out = []
    for a in left:
        value = np.abs(share[:, right] - share[:, [a]]).sum(0)
        own = right != a
        out.append((np.full(own.sum(), ids[a]), ids[right][own], value[own]))
        if one != two:
            out.append((ids[right], np.full(len(right), ids[a]), value))
    grp, other, value = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ())))
    return pd.DataFrame({"grp": grp, "other": other, "value": value, "seen": seen})


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS, bits: int = 64) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank; see ``Audit``."""
    made = Audit(docs, least, bits)
    return made.distances().unionByName(made.outstanding(ranks))
