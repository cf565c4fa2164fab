"""Translation memory and glossary."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.functions import text as tx
from cuespan.functions.keys import sha_id
from cuespan.session import cut_lineage, spread


def memory_from_decisions(state: DataFrame) -> DataFrame:
    """Accepted or edited decisions as memory rows."""
    return state.where(F.col("decision").isin("accepted", "edited")).select(
        sha_id("translation-memory-v1", F.col("decision_event_id"), length=32).alias("memory_id"),
        F.col("source_text").alias("verified_source_text"), F.col("translation").alias("approved_translation"),
        "cue_id", "proposal_id", "decision_event_id")


def not_in_memory(candidates: DataFrame, memory: DataFrame) -> DataFrame:
    return candidates.join(memory.select("decision_event_id"), "decision_event_id", "left_anti")


def active_memory(events: DataFrame, keys: Sequence[str] = ("scope_id",)) -> DataFrame:
    """Added entries without the rolled-back ones.

    ``events``: ``keys, line_no, event_id, event_type, undo_event_id``. One broken
    rule (a repeated id, a rollback of nothing active) voids the whole scope.
    """
    keys = list(keys)
    adds = events.where(F.col("event_type").isin("translation_add", "lexicon_add"))
    backs = events.where("event_type = 'rollback'").select(
        *keys, F.col("line_no").alias("back_line"), F.col("undo_event_id").alias("event_id"))
    repeated = events.groupBy(*keys, "event_id").agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    targets = backs.join(adds.select(*keys, "event_id", "line_no"), [*keys, "event_id"], "left")
    dangling = targets.where("line_no IS NULL OR line_no >= back_line").select(*keys)
    twice = backs.groupBy(*keys, "event_id").agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    void = repeated.unionByName(dangling).unionByName(twice).distinct()
    return adds.join(void, keys, "left_anti").join(backs.select(*keys, "event_id"), [*keys, "event_id"], "left_anti")


def tm_exact(queries: DataFrame, memory: DataFrame, keys: Sequence[str] = ("scope_id",)) -> DataFrame:
    """Suggestion, ambiguity or nothing per query text.

    ``queries``: ``keys, query_id, text``; ``memory``: ``keys, line_no,
    verified_source_text, approved_translation``. Texts meet case folded.
    """
    keys = list(keys)
    entries = memory.select(*keys, "line_no", tx.norm_memory("verified_source_text").alias("norm"),
                            "approved_translation", tx.norm_memory("approved_translation").alias("target"))
    # one row per source text, so a popular text cannot multiply query rows
    known = entries.groupBy(*keys, "norm").agg(
        F.count("*").alias("n"), F.count_distinct("target").alias("targets"),
        F.max_by("approved_translation", "line_no").alias("translation"))
    asked = queries.withColumn("norm", tx.norm_memory("text"))
    joined = asked.join(known, [*keys, "norm"], "left")
    return joined.select(
        *keys, "query_id",
        F.when(F.col("targets") == 1, "suggestion").when(F.col("targets") > 1, "ambiguous").otherwise("none").alias("status"),
        F.when(F.col("targets") == 1, F.col("translation")).alias("translation"),
        F.coalesce("n", F.lit(0)).alias("entries"))


@lru_cache(maxsize=1 << 16)
def _is_cjk(char: str) -> bool:
    name = unicodedata.name(char, "") if char else ""
    return any(s in name for s in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO"))


PART_TERMS, BLOCK_CHARS = 100_000, 8_000_000


class _Folds(dict):
    """One character for each character; equal for all that differ in case only."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        folded = c.casefold()
        self[code] = "i" if c in "\u0130\u0131" else folded if len(folded) == 1 else c.lower() if len(c.lower()) == 1 else c
        return self[code]


_FOLDS = _Folds()


def _fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLDS)


class _Terms:
    """The terms of one part of a glossary in one automaton that goes over a text once."""

    def __init__(self, terms: pd.DataFrame):
        import ahocorasick

        by_fold: dict[str, list[tuple]] = {}
        for row in zip(*(terms[c].tolist() for c in ("source_term", "norm", "target", "targets")), strict=True):
            if row[0]:
                by_fold.setdefault(_fold(row[0]), []).append(row)
        self.automaton, self.patterns, self.spelled = ahocorasick.Automaton(), {}, {}
        for folded, own in by_fold.items():
            # letters of ASCII that fold alike match each other in every pattern
            sure = self._hits(own) if folded.isascii() and all(row[0].isascii() for row in own) else None
            self.automaton.add_word(folded, (len(folded), own, sure))
        if by_fold:
            self.automaton.make_automaton()
        self.empty = not by_fold

    @staticmethod
    def _hits(own: list[tuple]) -> tuple[list[tuple], int, bool]:
        """Terms of one place by norm; how many have one target; whether another has several."""
        hits = list({norm: (norm, target, targets > 1) for _, norm, target, targets in reversed(own)}.values())[::-1]
        several = sum(hit[2] for hit in hits)
        return hits, len(hits) - several, several > 0

    def _matching(self, here: str, own: list[tuple]) -> tuple[list[tuple], int, bool]:
        """Folding is coarser than the comparison of the patterns."""
        if here not in self.spelled:
            same = []
            for row in own:
                if here != row[0]:
                    if row[0] not in self.patterns:
                        self.patterns[row[0]] = re.compile(re.escape(row[0]), re.IGNORECASE)
                    if not self.patterns[row[0]].fullmatch(here):
                        continue
                same.append(row)
            self.spelled[here] = self._hits(same)
        return self.spelled[here]

    def places(self, text: str):
        """(start, end, terms by norm, how many have one target, whether another has several)."""
        if self.empty:
            return
        ascii_text = text.isascii()
        for last, (size, own, sure) in self.automaton.iter(_fold(text)):
            start, end = last - size + 1, last + 1
            if sure is None or not (ascii_text or text[start:end].isascii()):
                hits = self._matching(text[start:end], own)
                if hits[0]:
                    yield start, end, hits
            else:
                yield start, end, sure


def _beside_cjk(text: str, start: int, end: int) -> bool:
    return (start > 0 and _is_cjk(text[start - 1])) or (end < len(text) and _is_cjk(text[end]))


def _find_terms(texts: pd.DataFrame, terms: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """All places of the terms of one part in the texts of one block."""
    known, out = _Terms(terms), []
    for *ids, text in zip(*(texts[c].tolist() for c in [*keys, "query_id", "text"]), strict=True):
        for start, end, (hits, _, _) in known.places(text):
            touches = _beside_cjk(text, start, end)
            out += [(*ids, start, end, *hit, touches) for hit in hits]
    return pd.DataFrame(out, columns=[*keys, "query_id", "start", "end", "norm", "target", "collides", "touches"])


def _judge_texts(texts: pd.DataFrame, terms: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """A row per text with a place: whether the part alone makes it ambiguous, the
    number of its places with one target, and these places unless it is.

    Two places that overlap and are not the same one make a text ambiguous
    whatever else it holds. Places come by their end, so the one before shows it.
    """
    known, out = _Terms(terms), []
    for *ids, text in zip(*(texts[c].tolist() for c in [*keys, "query_id", "text"]), strict=True):
        unsure, n, kept, before = None, 0, [], (-1, -1)
        cjk = not text.isascii() and any(map(_is_cjk, set(text)))
        for start, end, (hits, one_target, several) in known.places(text):
            n += one_target
            if unsure:
                continue
            place = (start, end)
            unsure = several or (start < before[1] and place != before) or (cjk and _beside_cjk(text, start, end))
            before = place
            kept += [(start, end, target, norm) for norm, target, _ in hits]
        if unsure is not None:
            out.append((*ids, unsure, n, *([list(x) for x in zip(*kept, strict=True)] if not unsure else [[], [], [], []])))
    return pd.DataFrame(out, columns=[*keys, "query_id", "unsure", "n", "starts", "ends", "target", "norm"])


def _search(texts: DataFrame, lexicon: DataFrame, keys: list[str], find, found: str) -> DataFrame:
    """``find`` on each block of texts with each part of its scope's glossary.

    All terms of a part of a scope's glossary are searched at once. Glossaries
    are dealt out in parts by the hash of the term and texts in blocks by theirs,
    both counted by size, so neither a short term nor a large scope gathers
    anywhere.
    """
    terms = lexicon.select(*keys, "line_no", "source_term", "target_term", tx.norm_memory("source_term").alias("norm"),
                           tx.norm_memory("target_term").alias("target_norm"))
    # stored once: counted, then dealt out
    per_term = cut_lineage(terms.groupBy(*keys, "norm").agg(
        F.count_distinct("target_norm").alias("targets"), F.max_by("target_term", "line_no").alias("target"),
        F.collect_set("source_term").alias("spellings")))
    sizes = per_term.groupBy(*keys).agg(F.ceil(F.count("*") / PART_TERMS).alias("_parts"))
    blocks = texts.groupBy(*keys).agg(F.ceil((F.sum(F.length("text")) + 1) / BLOCK_CHARS).alias("_blocks"))
    cut = cut_lineage(sizes.join(blocks, keys))  # a row per scope
    asked = (texts.where(F.col("text").isNotNull()).select(*keys, "query_id", "text").join(cut, keys)
             .withColumn("_block", F.pmod(F.xxhash64("query_id", "text"), F.col("_blocks")))
             .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts", "_blocks"))
    spelled = (per_term.join(cut, keys).withColumn("_part", F.pmod(F.xxhash64("norm"), F.col("_parts")))
               .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
               .select(*keys, "_part", "_block", "targets", "target", "norm", F.explode("spellings").alias("source_term")))
    place, types = [*keys, "_part", "_block"], dict(texts.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in [*keys, "query_id"]], found])
    return spread(asked, *place).groupBy(*place).cogroup(spread(spelled, *place).groupBy(*place)).applyInPandas(
        lambda one, two: find(one, two, keys), schema)


def lexicon_matches(texts: DataFrame, lexicon: DataFrame, keys: Sequence[str] = ("scope_id",)) -> DataFrame:
    """Where glossary terms occur: (keys, query_id, start, end, norm, target,
    collides, touches); a place touches when a CJK character stands beside it, as
    it may be part of a longer word then. Null texts hold no term.
    """
    return _search(texts, lexicon, list(keys), _find_terms,
                   "start int, end int, norm string, target string, collides boolean, touches boolean")


def lexicon_suggest(texts: DataFrame, lexicon: DataFrame, keys: Sequence[str] = ("scope_id",)) -> DataFrame:
    """Leftmost-longest substitution, or ``ambiguous`` when any place is unsure."""
    keys = list(keys)
    ids = [*keys, "query_id"]
    # places are written only of texts that no part of the glossary has shown to be ambiguous
    judged = _search(texts, lexicon, keys, _judge_texts, "unsure boolean, n long, starts array<int>, ends array<int>, "
                     "target array<string>, norm array<string>")
    places = F.transform(F.arrays_zip("starts", "ends", "target", "norm"), lambda x: F.struct(
        x["starts"].alias("start"), (-x["ends"]).alias("neg_end"), x["target"].alias("target"), x["norm"].alias("norm")))
    seen = cut_lineage(judged.groupBy(*ids).agg(
        F.bool_or("unsure").alias("unsure"), F.sum("n").alias("matches"), F.flatten(F.collect_list(places)).alias("m")))
    # the matches of one text are bounded by its length
    per_text = seen.where("NOT unsure").withColumn("m", F.array_sort("m")).join(texts.select(*ids, "text"), ids)

    step = lambda acc, x: F.struct(
        F.when(x["start"] >= acc["end"], -x["neg_end"]).otherwise(acc["end"]).alias("end"),
        F.when(x["start"] >= acc["end"], x["start"]).otherwise(acc["start"]).alias("start"),
        F.when(x["start"] >= acc["end"], x["target"]).otherwise(acc["target"]).alias("target"),
        # an overlap is harmless only for the same place with the same target
        (acc["clash"] | ((x["start"] < acc["end"]) & ~((x["start"] == acc["start"]) & (-x["neg_end"] == acc["end"])
                                                       & (F.lower(x["target"]) == F.lower(acc["target"]))))).alias("clash"),
        F.when(x["start"] >= acc["end"], F.concat(
            acc["out"], F.substring(F.col("text"), acc["end"] + 1, x["start"] - acc["end"]), x["target"])
               ).otherwise(acc["out"]).alias("out"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(-1).alias("start"), F.lit("").alias("target"),
                    F.lit(False).alias("clash"), F.lit("").alias("out"))
    folded = per_text.withColumn("f", F.aggregate("m", zero, step))
    clash = F.col("f.clash")
    answer = folded.select(*ids, F.when(clash, "ambiguous").otherwise("suggestion").alias("status"),
                           F.when(~clash, F.concat("f.out", F.expr("substr(text, f.end + 1)"))).alias("translation"), "matches")
    unsure = seen.where("unsure").join(texts.select(*ids), ids).select(
        *ids, F.lit("ambiguous").alias("status"), F.lit(None).cast("string").alias("translation"), "matches")
    return (texts.select(*ids).join(answer.unionByName(unsure), ids, "left")
            .withColumn("status", F.coalesce("status", F.lit("none"))).withColumn("matches", F.coalesce("matches", F.lit(0))))
