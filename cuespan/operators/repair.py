"""Dictionary repair as joins over distinct tokens.

The reference list of a token's variants grows with the alphabet (thousands per
word). Here nothing is enumerated over the alphabet: a token and a dictionary
word meet on a key that both derive by themselves, e.g. the word with one
position masked, with one letter left out, or with all dots folded away.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuespan import constants as K
from cuespan.functions import text as tx
from cuespan.functions.reach import (MISSING, REPLACED, SURPLUS, field_bits, maybe_known, near_cuts, near_steps,
                                     reach_field)
from cuespan.session import cut_lineage, spread, stored


def _letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def flips(a: Column, b: Column) -> Column:
    """Differing positions of two words of equal dot-folded form."""
    return F.size(F.filter(F.zip_with(_letters(a), _letters(b), lambda x, y: x != y), lambda d: d))


def flip_positions(word: Column) -> Column:
    return F.length(F.regexp_replace(word, f"[^{''.join(K.DOT_TWINS)}]", ""))


def _without_each(word: Column) -> Column:
    """The word with each position left out, one entry per position."""
    return F.transform(F.sequence(F.lit(1), F.length(word)),
                       lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def _masked_each(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(
        F.substring(word, F.lit(1), i - 1), F.lit("_"), F.substring(word, i + 1, F.length(word))))


def diacritic_neighbours(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary words that differ by one or two dots: (token, cand, freq, flips)."""
    t = tokens.select("token").where(flip_positions(F.col("token")).between(1, K.MAX_FLIP_POSITIONS)).withColumn(
        "key", tx.dot_norm(F.col("token")))
    d = dictionary.select(F.col("word").alias("cand"), "freq", tx.dot_norm(F.col("word")).alias("key"))
    met = t.join(d, "key").withColumn("flips", flips(F.col("token"), F.col("cand")))
    return met.where(F.col("flips").between(1, K.MAX_FLIPS)).select("token", "cand", "freq", "flips")


def _in_alphabet(letter: Column) -> Column:
    return letter.rlike(f"^[{K.ALPHABET}]$")


def replace_neighbours(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary words of the same length with one other letter."""
    t = tokens.select("token").where(F.length("token") <= K.WIDE_MAX).select(
        "token", F.explode(_masked_each(F.col("token"))).alias("key"))
    d = dictionary.select(F.col("word").alias("cand"), "freq").where(F.length("cand") <= K.WIDE_MAX).select(
        "cand", "freq", F.posexplode(_masked_each(F.col("cand"))).alias("at", "key"))
    letter = F.substring("cand", F.col("at") + 1, F.lit(1))
    return t.join(d, "key").where((F.col("cand") != F.col("token")) & _in_alphabet(letter)).select("token", "cand", "freq")


def insert_neighbours(tokens: DataFrame, dictionary: DataFrame, max_flips: int = 0) -> DataFrame:
    """Dictionary words one letter longer: (token, cand, freq, flips).

    With ``max_flips`` the letters both share may also differ by that many dots.
    """
    fold = tx.dot_norm if max_flips else (lambda c: c)
    t = tokens.select("token").where(F.length("token") <= K.WIDE_MAX).withColumn("key", fold(F.col("token")))
    d = (dictionary.select(F.col("word").alias("cand"), "freq").where(F.length("cand") <= K.WIDE_MAX + 1)
         .select("cand", "freq", F.posexplode(_without_each(F.col("cand"))).alias("at", "rest"))
         .where(_in_alphabet(F.substring("cand", F.col("at") + 1, F.lit(1)))))
    met = t.join(d.withColumn("key", fold(F.col("rest"))), "key").withColumn("flips", flips(F.col("token"), F.col("rest")))
    ok = (F.col("flips") <= max_flips) & (
        (F.col("flips") == 0) | (flip_positions(F.col("cand")) <= K.MAX_FLIP_POSITIONS))
    return met.where(ok).groupBy("token", "cand", "freq").agg(F.min("flips").alias("flips"))


def delete_neighbours(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary words one letter shorter."""
    t = tokens.select("token", F.explode(_without_each(F.col("token"))).alias("cand")).distinct()
    return t.join(dictionary.select(F.col("word").alias("cand"), "freq"), "cand").select("token", "cand", "freq")


def token_variants(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """All dictionary words within one repair step, with the kind of step."""
    kinds = [(diacritic_neighbours, "diacritic"), (replace_neighbours, "replace"),
             (insert_neighbours, "insert"), (delete_neighbours, "delete")]
    out = None
    for fn, kind in kinds:
        part = fn(tokens, dictionary).select("token", "cand", "freq", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


def dominant(candidates: DataFrame, keys: tuple[str, ...] = ("token",)) -> DataFrame:
    """The candidate with enough weight that also dwarfs the runner-up.

    Two equal best frequencies never dominate, so their order does not matter.
    """
    first = F.max_by("cand", F.struct("freq", "cand"))
    top = F.max_by(F.struct("freq", "cand"), F.struct("freq", "cand"))
    one = candidates.groupBy(*keys, "cand").agg(F.max("freq").alias("freq"))
    best = one.groupBy(*keys).agg(first.alias("better"), F.max("freq").alias("best"), top.alias("_top"))
    rest = (one.join(best.select(*keys, F.col("_top.cand").alias("cand")), [*keys, "cand"], "left_anti")
            .groupBy(*keys).agg(F.max("freq").alias("second")))
    return (best.join(rest, list(keys), "left")
            .where((F.col("best") >= K.FREQ_MIN)
                   & (F.col("second").isNull() | (F.col("best") >= K.DOMINANCE * F.col("second"))))
            .select(*keys, "better", F.col("best").alias("freq")))


def _self_entries(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    return tokens.join(dictionary.select(F.col("word").alias("token"), "freq"), "token").select(
        "token", F.col("token").alias("cand"), "freq")


def diacritic_upgrades(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tokens whose dominant dot variant is another word: (token, better, freq)."""
    pool = diacritic_neighbours(tokens, dictionary).drop("flips").unionByName(_self_entries(tokens, dictionary))
    return dominant(pool).where(F.col("better") != F.col("token"))


def weak_upgrades(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rare dictionary words next to a far more common one-letter neighbour."""
    weak = _self_entries(tokens, dictionary).where(F.col("freq") < K.WEAK_FREQ).select("token", F.col("freq").alias("own"))
    strong = replace_neighbours(weak, dictionary).join(weak, "token").where(
        F.col("freq") >= K.WEAK_DOMINANCE * F.col("own"))
    return strong.groupBy("token").agg(
        F.max_by("cand", F.struct("freq", "cand")).alias("better"), F.max("freq").alias("freq"))


def wide_upgrades(unknown: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One replaced or swallowed letter (then up to two dots) for unknown tokens."""
    replaced = replace_neighbours(unknown, dictionary).withColumn("kind", F.lit("replace"))
    inserted = insert_neighbours(unknown, dictionary, K.MAX_FLIPS).drop("flips").withColumn("kind", F.lit("insert"))
    pool = replaced.unionByName(inserted)
    kinds = pool.groupBy("token", F.col("cand").alias("better")).agg(F.max("kind").alias("_k"), F.min("kind").alias("kind"))
    return dominant(pool.drop("kind")).join(kinds.drop("_k"), ["token", "better"])


@F.pandas_udf(T.LongType())
def _piece_ops(token: pd.Series, cand: pd.Series) -> pd.Series:
    """Repair steps charged for reaching ``cand`` from ``token``, null if out of
    reach: one letter step plus at most two dots. A plain letter step only counts
    as one when no dotted route to the word comes before it in letter order."""
    def cost(a: str, b: str):
        routes = []  # (order, dots)
        gap = len(b) - len(a)
        if abs(gap) > 1 or (gap >= 0 and len(a) > K.WIDE_MAX):
            return None
        twin = K.DOT_TWINS
        dotted = sum(c in twin for c in b) <= K.MAX_FLIP_POSITIONS

        def dots(x: str, y: str):
            n = 0
            for p, q in zip(x, y):
                if p != q:
                    if twin.get(p) != q or n == K.MAX_FLIPS:
                        return None
                    n += 1
            return n

        for i in range(len(a) + (gap == 1)):
            if gap == -1:
                n = dots(a[:i] + a[i + 1:], b)
                if n is not None:
                    routes.append(((i, 0), n))
                continue
            n = dots(a[:i] + a[i + (gap == 0):], b[:i] + b[i + 1:])
            if n is None:
                continue
            for letter, extra in ((b[i], 0), (twin.get(b[i]), 1)):
                if letter is None or letter not in K.ALPHABET or n + extra > K.MAX_FLIPS:
                    continue
                if gap == 0 and letter == a[i]:
                    continue
                routes.append(((i, K.ALPHABET.index(letter)), n + extra))
        routes = [r for r in routes if r[1] == 0 or dotted]
        if not routes:
            return None
        if min(routes)[1] == 0:
            return 1
        return 1 + min(n for _, n in routes if n)

    return pd.Series([cost(a, b) for a, b in zip(token, cand)], dtype="Int64")


def _strong() -> Column:
    """A repaired part costs a step at least, so it only passes with a frequency of SPLIT_SCORE_MIN / SPLIT_PENALTY."""
    return F.col("freq") * K.SPLIT_PENALTY >= K.SPLIT_SCORE_MIN


def piece_repair(pieces: DataFrame, dictionary: DataFrame, field) -> DataFrame:
    """Best form of each part of a fused word: (token, better, freq, ops).

    ``field`` is the broadcast field of the words. Parts too rare to pass the split
    score are missing, repaired ones and known ones.
    """
    words = dictionary.select(F.col("word").alias("token"), F.col("freq").alias("own"))
    looked = stored(pieces.select("token").join(words, "token", "left"))  # read by both ways below
    own = looked.where("own IS NOT NULL")
    dots = diacritic_neighbours(own.select("token"), dictionary.where(_passing())).join(own, "token").where(
        F.col("freq") >= K.DOMINANCE * F.col("own"))
    upgraded = dots.groupBy("token").agg(F.max_by(F.struct("cand", "freq", "flips"), F.struct("freq", "cand")).alias("b"))
    known = own.join(upgraded, "token", "left").select(
        "token", F.coalesce("b.cand", "token").alias("better"), F.coalesce("b.freq", "own").alias("freq"),
        F.coalesce("b.flips", F.lit(0)).cast("bigint").alias("ops")).where(_passing())

    fold = tx.dot_norm
    unknown = looked.where("own IS NULL").select("token", fold(F.col("token")).alias("folded"))
    # a rival below a tenth of what passes changes nothing
    rivals = dictionary.select(F.col("word").alias("cand"), "freq").where(
        F.col("freq") * K.DOMINANCE * K.SPLIT_PENALTY >= K.SPLIT_SCORE_MIN)

    reach = rivals.select(fold(F.col("cand")).alias("word"), F.lit(True).alias("strong"))
    reach = pieces.sparkSession.sparkContext.broadcast(reach_field(reach, field_bits(reach)))

    def key(step: int, text: Column) -> Column:
        return F.concat(F.lit("=-+"[step]), text)

    word, cand = fold(F.col("token")), fold(F.col("cand"))
    rest = F.concat(F.expr("left(_w, at)"), F.when(F.col("step") == REPLACED, F.lit("_")).otherwise(F.lit("")), F.expr("substr(_w, at + 2)"))
    mine = near_steps(unknown, field, reach, K.WIDE_MAX).withColumn("_w", word).select("token", F.when(
        F.col("step") == MISSING, key(MISSING, F.col("_w"))).when(F.col("step") == SURPLUS, key(SURPLUS, rest)).otherwise(key(REPLACED, rest)).alias("key"))
    theirs = rivals.select("cand", "freq", F.explode(F.array_distinct(F.concat(
        F.transform(_masked_each(cand), lambda w: key(REPLACED, w)), F.array(key(SURPLUS, cand)),
        F.transform(_without_each(cand), lambda w: key(MISSING, w))))).alias("key"))
    pool = mine.join(theirs, "key").select("token", "cand", "freq")
    close = F.levenshtein("token", "cand", K.MAX_FLIPS + 1) >= 0
    pool = spread(pool.where((F.col("cand") != F.col("token")) & close), "token").distinct().withColumn(
        "ops", _piece_ops("token", "cand")).where("ops IS NOT NULL")
    best, second = (F.col(f"_by_freq.{i}") for i in ("one", "two"))
    two = F.slice(F.sort_array(F.collect_list(F.struct("freq", "cand", "ops")), asc=False), 1, 2)
    repaired = pool.groupBy("token").agg(two.alias("_two")).withColumn("_by_freq", F.struct(
        F.get("_two", F.lit(0)).alias("one"), F.get("_two", F.lit(1)).alias("two"))).where(
        (best["freq"] >= K.FREQ_MIN) & (second.isNull() | (best["freq"] >= K.DOMINANCE * second["freq"])))
    repaired = repaired.select("token", best["cand"].alias("better"), best["freq"].alias("freq"), best["ops"].alias("ops")).where(_strong())
    return known.unionByName(repaired)


def _passing() -> Column:
    return F.col("freq") >= K.SPLIT_SCORE_MIN


def split_fused(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Split unknown fused words into two known parts: (token, left, right, score)."""
    tokens = tokens.select("token").where(F.length("token") >= max(K.SPLIT_MIN, 2 * K.SPLIT_PART_MIN))
    # A part counts with a frequency of SPLIT_SCORE_MIN as it is, or of SPLIT_SCORE_MIN / SPLIT_PENALTY as the
    # repair of one step; the other cuts, nearly all of them, are never written out.
    words = dictionary.where(_passing()).select(tx.dot_norm(F.col("word")).alias("word"), _strong().alias("strong"))
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    bits = field_bits(words, dictionary.count())
    every = words.unionByName(dictionary.select("word", F.lit(None).cast("boolean").alias("strong")))
    field = tokens.sparkSession.sparkContext.broadcast(reach_field(every, bits))
    # a word that loses an ending and is then known is inflected, not fused
    stems = maybe_known(tokens, field, (3, 4), 3)
    inflected = stems.join(dictionary.select("word"), "word", "left_semi").select("token")
    long = tokens.join(inflected, "token", "left_anti")
    folded = long.withColumn("folded", tx.dot_norm(F.col("token")))
    cuts = stored(near_cuts(folded, field, K.SPLIT_PART_MIN, longest, K.WIDE_MAX))
    a, b = F.expr("left(token, k)"), F.expr("substr(token, k + 1)")
    pieces = cuts.select(F.explode(F.array(a, b)).alias("token")).distinct()
    fixed = stored(piece_repair(pieces, dictionary, field))
    side = lambda name, p: fixed.select(
        F.col("token").alias(name), F.col("better").alias(f"{p}_to"), F.col("freq").alias(f"{p}_freq"), F.col("ops").alias(f"{p}_ops"))
    scored = cuts.join(side("_a", "l"), a == F.col("_a")).drop("_a").join(side("_b", "r"), b == F.col("_b")).withColumn(
        "score", F.least("l_freq", "r_freq") * F.pow(F.lit(K.SPLIT_PENALTY), F.col("l_ops") + F.col("r_ops"))).where(
        F.col("score") >= K.SPLIT_SCORE_MIN)
    # equal scores must agree on the text: the first and the last of the best are the same
    ends = scored.groupBy("token").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "l_to", "r_to")).alias("a"), F.max(F.struct(F.col("score").alias("s"), "l_to", "r_to")).alias("b"))
    return ends.where("a.l_to = b.l_to AND a.r_to = b.r_to").select(
        "token", F.col("a.l_to").alias("left"), F.col("a.r_to").alias("right"), F.col("b.s").alias("score"))


def _recase(core: Column, fixed: Column) -> Column:
    first_upper = F.substring(core, 1, 1) != F.lower(F.substring(core, 1, 1))
    return (F.when(tx.is_upper(core), tx.tr_upper(fixed))
            .when(first_upper, F.concat(F.upper(F.substring(fixed, 1, 1)), F.lower(F.substring(fixed, 2, 1 << 20))))
            .otherwise(fixed))


def word_repair(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Repair distinct surface tokens: (surface, repaired, kind, old_core, new_core).

    Order of precedence: dots, rare entries, replaced or swallowed letters (only
    lower-case words), fused words. Tokens that need no repair are not returned.
    """
    surface = cut_lineage(tokens.select("surface").distinct().withColumn("core", tx.core(F.col("surface"))).where(
        "core IS NOT NULL AND length(core) >= 3").withColumn("token", tx.tr_lower(F.col("core"))))
    words = surface.select("token").distinct()
    lower = surface.where(tx.is_lower(F.col("core"))).select("token").distinct()
    unknown = words.join(dictionary.select(F.col("word").alias("token")), "token", "left_anti")

    dots = diacritic_upgrades(words, dictionary).select("token", F.col("better").alias("dot_to"))
    weak = weak_upgrades(lower, dictionary).select("token", F.col("better").alias("weak_to"))
    wide = wide_upgrades(unknown.join(lower, "token", "left_semi"), dictionary).select(
        "token", F.col("better").alias("wide_to"), F.col("kind").alias("wide_kind"))
    joined = cut_lineage(surface.join(dots, "token", "left").join(weak, "token", "left").join(wide, "token", "left"))
    # splitting is the last resort: only for words nothing else has repaired
    open_words = joined.where(F.col("dot_to").isNull() & (F.col("wide_to").isNull() | ~tx.is_lower(F.col("core"))))
    fused = split_fused(open_words.select("token").distinct().join(unknown, "token", "left_semi"), dictionary).select(
        "token", "left", "right")
    joined = joined.join(fused, "token", "left")
    is_lower = tx.is_lower(F.col("core"))
    weak_ok, wide_ok = is_lower & F.col("weak_to").isNotNull(), is_lower & F.col("wide_to").isNotNull()
    kind = (F.when(F.col("dot_to").isNotNull(), "diakritik").when(weak_ok, "harf-degistirme")
            .when(wide_ok, F.when(F.col("wide_kind") == "replace", "harf-degistirme").otherwise("harf-yutma"))
            .when(F.col("left").isNotNull(), "kaynakma"))
    single = F.when(F.col("dot_to").isNotNull(), F.col("dot_to")).when(weak_ok, F.col("weak_to")).when(wide_ok, F.col("wide_to"))
    core = F.col("core")
    pair = F.when(tx.is_upper(core), F.concat_ws(" ", tx.tr_upper(F.col("left")), tx.tr_upper(F.col("right")))).otherwise(
        F.concat_ws(" ", _recase(core, F.col("left")), F.col("right")))
    new = F.when(single.isNotNull(), _recase(core, single)).otherwise(pair)
    return (joined.withColumn("kind", kind).where("kind IS NOT NULL")
            .select("surface", F.concat(tx.edge_prefix(F.col("surface")), new, tx.edge_suffix(F.col("surface"))).alias("repaired"),
                    "kind", F.col("core").alias("old_core"), F.coalesce(single, pair).alias("new_core")))


def repair_text(lines: DataFrame, dictionary: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Repair every word of ``text``; returns (repaired lines, change log).

    Work is per distinct word; the repaired words join back to their places.
    """
    parts = lines.select(*keys, F.posexplode(F.split("text", r"(?U)(?<=\s)(?=\S)|(?<=\S)(?=\s)")).alias("at", "surface"))
    fixes = {a: b for a, b in K.APOSTROPHE_FIXES.items()}
    table = F.create_map(*[F.lit(x) for pair in fixes.items() for x in pair])
    core = tx.core(F.col("surface"))
    fixed = F.try_element_at(table, core)
    parts = parts.withColumn("fixed", F.when(fixed.isNotNull(), F.concat(
        tx.edge_prefix(F.col("surface")), fixed, tx.edge_suffix(F.col("surface")))))
    repairs = word_repair(parts.where("fixed IS NULL").select("surface"), dictionary)
    joined = parts.join(repairs, "surface", "left")
    new = F.coalesce("fixed", "repaired", "surface")
    # the words of one line come from one text value
    out = joined.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("at", new.alias("w")))), lambda x: x["w"]), "").alias("text"))
    log = joined.where("fixed IS NOT NULL OR kind IS NOT NULL").select(
        *keys, "at", F.coalesce("old_core", "surface").alias("old"),
        F.coalesce("fixed", "new_core").alias("new"), F.coalesce("kind", F.lit("apostrof")).alias("kind"))
    return out, log


def apply_rules(df: DataFrame, rules: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """Ordered literal replacements; later rules see the result of earlier ones.

    Adds ``applied``: how often each rule fired. ``rules`` is a short
    list in the job itself; for a table of rules join their array and use ``rules_fold``.
    """
    current, counts = F.col(text), []
    for i, (old, new) in enumerate(rules):
        name = f"_t{i}"
        df = df.withColumn(name, current)
        fired = (F.length(name) - F.length(F.replace(F.col(name), F.lit(old), F.lit("")))) / len(old)
        counts.append(F.struct(F.lit(old).alias("old"), F.lit(new).alias("new"), fired.cast("bigint").alias("n")))
        current = F.replace(F.col(name), F.lit(old), F.lit(new))
    used = F.filter(F.array(*counts), lambda c: c["n"] > 0) if counts else F.array()
    return df.withColumn("_out", current).withColumn("applied", used).withColumn(text, F.col("_out")).drop(
        "_out", *[f"_t{i}" for i in range(len(rules))])


def rules_fold(text: Column, rules: Column) -> Column:
    """The same as one expression when the rules are an array column."""
    return F.aggregate(rules, text, lambda t, r: F.replace(t, r["old"], r["new"]))


def line_cleanup(line: Column) -> Column:
    """Mechanical leftovers of a line; returns an array of states, one per rule,
    beginning with the line as it was."""
    tokens = F.split(line, " ")
    lone = lambda p: (F.length(p) == 1) & tx.has_cjk(p)
    dense = tx.dense_chars(line)
    drop = F.exists(tokens, lone) & (tx.cjk_count(dense) * 2 < F.length(dense))
    kept = F.array_join(F.filter(tokens, lambda p: ~lone(p)), " ")
    s1 = F.when(drop, tx.strip_ws(F.regexp_replace(kept, " {2,}", " "))).otherwise(line)
    s2 = F.regexp_replace(s1, r"^(?U:\s)*'+", "")
    s3 = F.regexp_replace(s2, r"(?U)\s+:s$", "")
    s4 = F.regexp_replace(s3, r"(?U)\s+\.$", ".")

    def numbers(t: Column) -> Column:
        gone = F.regexp_replace(t, r"(?U)(?<=\S)\s\d{1,2}(?=\s\S)", "")
        return F.when((gone != t) & t.rlike(f"[{tx.WORD_CHARS}]"),
                      tx.strip_ws(F.regexp_replace(gone, " {2,}", " "))).otherwise(t)

    # closing up double blanks can bring one more number into reach
    s5 = numbers(numbers(s4))
    s6 = F.when(s5.rlike("_+$"), F.regexp_replace(s5, "_+$", "...")).otherwise(
        F.regexp_replace(s5, r"(?<!\.)\.\.$", "..."))
    return F.array(line, s1, s2, s3, s4, s5, s6)


CLEANUP_KINDS = ["ekran-kalinti", "noktalama", "noktalama", "noktalama", "noktalama", "ellipsis"]


def cleanup_lines(df: DataFrame, keys: tuple[str, ...], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Clean every line of a block; returns (clean blocks, change log)."""
    states = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn(
        "states", line_cleanup(F.col("line")))
    clean = states.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("line_no", F.element_at("states", -1).alias("t")))), lambda x: x["t"]), "\n").alias(text))
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(kind).alias("kind"),
                               F.get("states", F.lit(i)).alias("old"), F.get("states", F.lit(i + 1)).alias("new"))
                      for i, kind in enumerate(CLEANUP_KINDS)])
    log = states.select(*keys, "line_no", F.explode(F.filter(steps, lambda s: s["old"] != s["new"])).alias("s")).select(
        *keys, "line_no", "s.*")
    return clean, log


def repair_blocks(blocks: DataFrame, dictionary: DataFrame, rules: list[tuple[str, str]],
                  keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The whole chain on dialogue blocks: sound lines out, taught rules, line
    cleanup, word repair, taught rules again. Returns (blocks, change log)."""
    from cuespan.operators.filters import sfx_lines
    quiet, dropped = sfx_lines(blocks.select(*keys, "text"), dictionary, keys)
    before = apply_rules(quiet, rules)
    clean, cleanup_log = cleanup_lines(before.select(*keys, "text"), keys)
    fixed, word_log = repair_text(clean, dictionary, keys)
    after = apply_rules(fixed, rules)

    def taught(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.explode("applied").alias("r")).select(*keys, "r.old", "r.new", F.lit("kullanici").alias("kind"))

    log = (dropped.select(*keys, F.col("line").alias("old"), F.lit("").alias("new"), F.lit("sfx-satir").alias("kind"))
           .unionByName(taught(before)).unionByName(cleanup_log.select(*keys, "old", "new", "kind"))
           .unionByName(word_log.select(*keys, "old", "new", "kind")).unionByName(taught(after)))
    return after.select(*keys, "text"), log
