"""Learning safe replacement rules from corrected episodes."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuespan import constants as K
from cuespan.functions import text as tx
from cuespan.operators import repair
from cuespan.session import cut_lineage, spread

_WORD = re.compile(tx.WORD_PATTERN)
_FOLD = str.maketrans("şçği", "scgı")
_PAIRS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("old", "new", "relation")]))


def _folded(token: str) -> str:
    found = _WORD.match(token)
    word = found.group(2) if found else token
    return word.replace("I", "ı").replace("İ", "i").lower().translate(_FOLD)


def pair_tokens(old: list[str], new: list[str]) -> list[tuple[str, str, str]]:
    """Pair the tokens of one replaced run: alike, split, merged, else in turn."""
    def window(target: str, tokens: list[str], start: int) -> int | None:
        joined = ""
        for stop in range(start, min(start + 3, len(tokens))):
            joined += _folded(tokens[stop])
            if joined == target:
                return stop + 1
        return None

    pairs, i, j = [], 0, 0
    while i < len(old) and j < len(new):
        a, b = _folded(old[i]), _folded(new[j])
        split = None if a == b else window(a, new, j)
        merge = None if a == b or split else window(b, old, i)
        if split:
            pairs.append((old[i], " ".join(new[j:split]), "ayrisma"))
            i, j = i + 1, split
        elif merge:
            pairs.append((" ".join(old[i:merge]), new[j], "birlesme"))
            i, j = merge, j + 1
        else:
            pairs.append((old[i], new[j], "1-1"))
            i, j = i + 1, j + 1
    return pairs


@F.pandas_udf(_PAIRS)
def diff_tokens(old: pd.Series, new: pd.Series) -> pd.Series:
    """Changed token pairs of two texts."""
    def pairs(a: str, b: str):
        x, y = a.split(), b.split()
        found = []
        for tag, i1, i2, j1, j2 in SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes():
            if tag == "replace":
                found += [p for p in pair_tokens(x[i1:i2], y[j1:j2]) if p[0] != p[1]]
        return [dict(zip(("old", "new", "relation"), p)) for p in found]

    return pd.Series([pairs(a, b) for a, b in zip(old, new)])


def _edge_core(token: Column) -> Column:
    return tx.core(token)


@F.pandas_udf(T.BooleanType())
def _two_letters(a: pd.Series, b: pd.Series) -> pd.Series:
    """One or two replaced letters of the alphabet."""
    def ok(x: str, y: str) -> bool:
        if len(x) != len(y):
            return False
        diff = [q for p, q in zip(x, y) if p != q]
        return 1 <= len(diff) <= 2 and all(q in K.ALPHABET for q in diff)

    return pd.Series([ok(x, y) for x, y in zip(a, b)], dtype="bool")


def _reachable(a: Column, b: Column) -> Column:
    dots = (tx.dot_norm(a) == tx.dot_norm(b)) & (repair.flips(a, b) <= K.MAX_FLIPS) & (
        repair.flip_positions(a) <= K.MAX_FLIP_POSITIONS)
    return (a == b) | F.coalesce(dots, F.lit(False)) | repair._piece_ops(a, b).isNotNull() | _two_letters(a, b)


def _two_masks(word: Column) -> Column:
    n = F.length(word)
    return F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(
        F.sequence(i + 1, n), lambda j: F.concat(
            F.substring(word, F.lit(1), i - 1), F.lit("_"), F.substring(word, i + 1, j - i - 1), F.lit("_"),
            F.substring(word, j + 1, n)))))


def _thirds(word: Column) -> Column:
    """The three parts of a word with their places: of two words of one length
    that differ in two letters at most, one part is the same."""
    n = F.length(word)
    a, b = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    part = lambda i, start, stop: F.concat_ws("_", n, F.lit(i), F.substring(word, start + 1, stop - start))
    return F.array(part(0, F.lit(0), a), part(1, a, b), part(2, b, n))


def rivals(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Every dictionary word one repair family away: (token, cand, freq).

    Words below a tenth of the least accepted frequency can neither win nor
    prevent a win, so they are left out before the joins.
    """
    d = dictionary.where(F.col("freq") * K.DOMINANCE >= K.FREQ_MIN)
    words = d.select(F.col("word").alias("cand"), "freq")
    cols = ["token", "cand", "freq"]
    near = repair.diacritic_neighbours(tokens, d).select(*cols).unionByName(
        tokens.join(words.withColumn("token", F.col("cand")), "token").select(*cols))
    fold = tx.dot_norm
    short = tokens.select("token").where(F.length("token") <= K.WIDE_MAX)
    keyed = lambda df, keys: df.select(*df.columns, F.explode(F.array_distinct(keys)).alias("key"))
    w, c = F.col("token"), F.col("cand")
    heavy = (keyed(short, repair._masked_each(fold(w))).join(keyed(words, repair._masked_each(fold(c))), "key").select(*cols)
             .unionByName(short.withColumn("key", fold(w)).join(keyed(words, repair._without_each(fold(c))), "key").select(*cols))
             .unionByName(keyed(tokens.select("token"), repair._without_each(fold(w))).join(
                 words.withColumn("key", fold(c)), "key").select(*cols))).distinct()
    heavy = spread(heavy.where((w != c) & (F.levenshtein(w, c, K.MAX_FLIPS + 1) >= 0))).where(
        repair._piece_ops(w, c).isNotNull())
    # masks are many, so words that share no third with a token go first
    asked = cut_lineage(keyed(short.where(F.length("token") >= 2), _thirds(w)).select("key").distinct())
    able = keyed(words.where(F.length("cand").between(2, K.WIDE_MAX)), _thirds(c)).join(asked, "key", "left_semi").select("cand", "freq").distinct()
    double = (keyed(short.where(F.length("token") >= 2), _two_masks(w)).join(keyed(able, _two_masks(c)), "key").select(*cols).distinct()
        .where((w != c) & _two_letters(w, c)))
    return near.unionByName(heavy).unionByName(double).distinct()


def classify_pairs(pairs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Class, status and reason of distinct (old, new, relation) pairs.

    Status ``ogrenildi`` marks the pairs that may become rules ``rule_old`` →
    ``rule_new``.
    """
    c = F.col
    p = cut_lineage(pairs.select("old", "new", "relation").distinct())
    parts = F.split(tx.collapse_ws(c("new")), " ")
    p = (p.withColumn("n", F.size(parts)).withColumn("oc", tx.core(c("old")))
         .withColumn("nc", F.when(c("n") == 1, tx.core(c("new"))))
         .withColumn("a", F.when(c("n") == 2, tx.core(parts[0]))).withColumn("b", F.when(c("n") == 2, tx.core(parts[1]))))
    for name in ("oc", "nc", "a", "b"):
        p = p.withColumn(name + "_lo", tx.tr_lower(c(name)))
    freq = lambda key, name: dictionary.select(F.col("word").alias(key), F.col("freq").alias(name))
    p = p.join(freq("a_lo", "a_freq"), "a_lo", "left").join(freq("b_lo", "b_freq"), "b_lo", "left")
    p = p.join(freq("nc_lo", "n_freq"), "nc_lo", "left")
    stems = p.where("n = 2 AND oc_lo IS NOT NULL").select("oc_lo").distinct().select("oc_lo", F.explode(F.array(*[
        F.when(F.length("oc_lo") > cut + 3, F.expr(f"left(oc_lo, length(oc_lo) - {cut})")) for cut in (3, 4)])).alias("word"))
    veto = stems.join(dictionary.select("word"), "word", "left_semi").select("oc_lo").distinct().withColumn("veto", F.lit(True))
    p = p.join(veto, "oc_lo", "left")

    single = p.where("n = 1 AND oc_lo IS NOT NULL AND nc_lo IS NOT NULL AND oc_lo <> nc_lo")
    dotted = tx.dot_norm(c("oc_lo")) == tx.dot_norm(c("nc_lo"))
    dot_tokens = single.where(dotted).select(c("oc_lo").alias("token")).distinct()
    dot_pool = repair.diacritic_neighbours(dot_tokens, dictionary).drop("flips").unionByName(
        repair._self_entries(dot_tokens, dictionary))
    dot_best = repair.dominant(dot_pool).select(c("token").alias("oc_lo"), c("better").alias("dot_best"))
    wide = single.where(~dotted & (F.length("oc_lo") <= K.WIDE_MAX))
    # joining rivals only for words that a pair could really teach
    reach = cut_lineage(spread(wide.where(c("n_freq").isNotNull()).select("oc_lo", "nc_lo").distinct()).where(
        _reachable(c("oc_lo"), c("nc_lo"))).withColumn("reach", F.lit(True)))
    wide_best = repair.dominant(rivals(reach.select(c("oc_lo").alias("token")).distinct(), dictionary)).select(
        c("token").alias("oc_lo"), c("better").alias("wide_best"))
    p = (p.join(dot_best, "oc_lo", "left").join(reach, ["oc_lo", "nc_lo"], "left").join(wide_best, "oc_lo", "left"))

    def verdict(kind: str | None, status: str, reason: str) -> Column:
        return F.struct(F.lit(kind).cast("string").alias("kind"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    n_flips = repair.flips(c("oc_lo"), c("nc_lo"))
    zero = F.lit(0)
    split = (F.when(c("n") != 2, verdict("kaynakma", "atlandi", "not_two_parts"))
             .when(c("oc").isNull() | c("a").isNull() | c("b").isNull(), verdict("kaynakma", "atlandi", "no_core"))
             .when(F.length("oc_lo") < K.SPLIT_MIN, verdict("kaynakma", "atlandi", "too_short"))
             .when(F.least(F.length("a_lo"), F.length("b_lo")) < K.SPLIT_PART_MIN, verdict("kaynakma", "atlandi", "part_too_short"))
             .when(c("veto"), verdict("kaynakma", "atlandi", "inflected"))
             .when(tx.dot_norm(F.concat("a_lo", "b_lo")) != tx.dot_norm(c("oc_lo")), verdict("kaynakma", "atlandi", "parts_differ"))
             .when(F.least(F.coalesce("a_freq", zero), F.coalesce("b_freq", zero)) < K.FREQ_MIN,
                   verdict("kaynakma", "atlandi", "rare_part"))
             .otherwise(verdict("kaynakma", "ogrenildi", "known_parts")))
    marks = (F.when(c("oc") != c("nc"), verdict(None, "atlandi", "case_only"))
             .when(c("new").contains(c("old")) | c("old").contains(c("new")), verdict("noktalama", "atlandi", "substring"))
             .otherwise(verdict("noktalama", "ogrenildi", "marks_only")))
    dots = (F.when(n_flips > K.MAX_FLIPS, verdict("diakritik", "atlandi", "too_many_dots"))
            .when(c("n_freq").isNull() | (repair.flip_positions(c("oc_lo")) > K.MAX_FLIP_POSITIONS),
                  verdict("diakritik", "atlandi", "unknown_target"))
            .when(c("dot_best") == c("nc_lo"), verdict("diakritik", "ogrenildi", "dominant"))
            .otherwise(verdict("diakritik", "atlandi", "not_dominant")))
    letters = (F.when(c("reach") & (c("wide_best") == c("nc_lo")), verdict("harf", "ogrenildi", "dominant"))
               .when(c("reach"), verdict("harf", "atlandi", "not_dominant"))
               .otherwise(verdict(None, "belirsiz", "free_rewrite")))
    out = (F.when(c("old").contains(" "), verdict(None, "atlandi", "merge"))
           .when(c("n") >= 2, split)
           .when(c("oc").isNull() | c("nc").isNull(), verdict(None, "atlandi", "no_core"))
           .when(F.least(F.length("oc"), F.length("nc")) < K.WORD_MIN, verdict(None, "atlandi", "too_short"))
           .when(c("oc_lo") == c("nc_lo"), marks).when(dotted, dots).otherwise(letters))
    judged = p.withColumn("v", out)
    whole = c("v.kind") == "noktalama"
    return judged.select(
        "old", "new", "relation", "v.kind", "v.status", "v.reason",
        F.when(whole, c("old")).otherwise(c("oc")).alias("rule_old"),
        F.when(whole, c("new")).when(c("n") == 2, F.concat_ws(" ", "a", "b")).otherwise(c("nc")).alias("rule_new"))


def learn_rules(arrivals: DataFrame, rules: DataFrame) -> DataFrame:
    """Outcome per arriving rule: added, already known, or in conflict.

    ``arrivals``: ``arrival, old, new``; ``rules``: ``old, new``. The first mapping
    of a word stays.
    """
    first = arrivals.groupBy("old").agg(F.min("arrival").alias("first_at"), F.min_by("new", "arrival").alias("first_new"))
    holding = first.join(rules.select("old", F.col("new").alias("known_new")), "old", "left").select(
        "old", "first_at", F.coalesce("known_new", "first_new").alias("held"), F.col("known_new").isNull().alias("fresh"))
    c = F.col
    return arrivals.join(holding, "old").select(
        "arrival", "old", "new",
        F.when(c("fresh") & (c("arrival") == c("first_at")), "eklendi")
        .when(c("new") == c("held"), "zaten_var").otherwise("catisma").alias("outcome"), "held")


def merged_rules(outcomes: DataFrame, rules: DataFrame) -> DataFrame:
    """Current rules plus the added ones."""
    return rules.select("old", "new").unionByName(outcomes.where("outcome = 'eklendi'").select("old", "new"))


def teach_rules(lessons: DataFrame) -> DataFrame:
    """Interactive teaching overwrites: the last lesson of a word wins, its
    first place stays. ``lessons``: ``lesson, old, new``."""
    return lessons.groupBy("old").agg(F.max_by("new", "lesson").alias("new"), F.min("lesson").alias("rule_order"))


def learn_summary(classified: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    base = classified.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("status") == "ogrenildi").alias("learnable"),
        F.count_if(F.col("status") == "belirsiz").alias("ambiguous"), F.count_if(F.col("status") == "atlandi").alias("skipped"))
    if outcomes is None:
        return base
    counted = outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (
        ("eklendi", "added"), ("zaten_var", "already"), ("catisma", "conflict"))])
    one = F.lit(1).alias("_one")
    return base.select("*", one).join(counted.select("*", one), "_one").drop("_one")


def learn_round(auto: DataFrame, edited: DataFrame, dictionary: DataFrame, rules: DataFrame):
    """Align automatic and edited cues, take changed words, classify, learn.

    Returns (classified pairs with their episode, outcomes).
    """
    from cuespan.operators.align import attach_pairs, greedy_align
    from cuespan.operators.intervals import overlap_candidates
    aligned = attach_pairs(greedy_align(overlap_candidates(auto, edited)), auto, edited)
    changed = spread(aligned.where(tx.collapse_ws(F.col("p_text")) != tx.collapse_ws(F.col("r_text"))))
    pairs = cut_lineage(changed.select("episode_id", "p_cue_index", F.posexplode(
        diff_tokens("p_text", "r_text")).alias("at", "d")).select("episode_id", "p_cue_index", "at", "d.*"))
    judged = pairs.join(classify_pairs(pairs, dictionary), ["old", "new", "relation"])
    arrivals = judged.where("status = 'ogrenildi'").select(
        F.struct("episode_id", "p_cue_index", "at").alias("arrival"), F.col("rule_old").alias("old"), F.col("rule_new").alias("new"))
    return judged, learn_rules(arrivals, rules)


def word_vote(votes: DataFrame, needed: int = 2) -> DataFrame:
    """Corrections by contributors: accepted once ``needed`` different ones agree.

    ``votes``: ``contributor, old, new``; repeated votes of one contributor count once.
    """
    counted = votes.groupBy("old", "new").agg(F.count_distinct("contributor").alias("voters"))
    return counted.withColumn("status", F.when(F.col("voters") >= needed, "accepted").otherwise("candidate"))
