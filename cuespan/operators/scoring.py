"""Accuracy of predicted text and timing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions import text as tx
from cuespan.functions.similarity import edit_substitutions
from cuespan.operators.align import first_per_key
from cuespan.session import cut_lineage


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b)


def _blank_words(text: Column) -> Column:
    """Words of a normal form: one blank stands between two words, and no other white space."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def pair_measures(pairs: DataFrame, ref: str = "reference", pred: str = "prediction") -> DataFrame:
    """Edit counts of each pair; a missing prediction reads as empty."""
    normal = pairs.withColumn("_ref", tx.norm_nfc(ref)).withColumn(
        "_pred", tx.norm_nfc(F.coalesce(F.col(pred), F.lit(""))))
    r, p = F.col("_ref"), F.col("_pred")
    scored = r != ""
    zero = F.lit(0).cast("bigint")
    return normal.select(
        *pairs.columns,
        F.length(r).cast("bigint").alias("ref_chars"),
        F.when(scored & (r != p), tx.char_distance(r, p)).otherwise(zero).cast("bigint").alias("char_edits"),
        F.size(_blank_words(r)).cast("bigint").alias("ref_words"),
        F.when(scored & (r != p), tx.word_distance(r, p, _blank_words)).otherwise(zero).cast("bigint").alias("word_edits"),
        (r == p).alias("exact"), (p != "").alias("covered"))


def text_sums() -> list[Column]:
    return [
        F.count("*").alias("rows"), F.sum("ref_chars").alias("reference_chars"),
        F.sum("ref_words").alias("reference_words"), F.sum("char_edits").alias("character_edits"),
        F.sum("word_edits").alias("word_edits"), F.count_if("exact").alias("exact_rows"),
        F.count_if("covered").alias("nonempty_outputs")]


def with_text_rates(sums: DataFrame) -> DataFrame:
    c = F.col
    return (sums.withColumn("cer", ratio(c("character_edits"), c("reference_chars")))
            .withColumn("wer", ratio(c("word_edits"), c("reference_words")))
            .withColumn("exact_match_rate", ratio(c("exact_rows"), c("rows")))
            .withColumn("coverage", ratio(c("nonempty_outputs"), c("rows"))))


def text_score(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return with_text_rates(pair_measures(pairs).groupBy(*keys).agg(*text_sums()))


def vtt_report(pairs: DataFrame, pred: DataFrame, ref: DataFrame,
               keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Quality report per episode over aligned pairs (``attach_pairs`` rows)."""
    keys = list(keys)
    diff = F.col("p_start_ms") - F.col("r_start_ms")
    measured = pairs.select(
        *keys, "p_cue_index", diff.alias("diff"), F.length("r_text").cast("bigint").alias("chars"),
        F.levenshtein("r_text", "p_text").cast("bigint").alias("edits"))
    first5 = (first_per_key(measured.select(*keys, "p_cue_index", "diff"), keys, [F.col("p_cue_index")], 5)
              .groupBy(*keys).agg((F.sum(F.abs("diff")) / F.count("*")).alias("first5_mean_abs_start_diff_ms")))
    scored = measured.groupBy(*keys).agg(
        F.count("*").alias("aligned_pairs"), F.sum("edits").alias("total_edit_distance"),
        F.sum("chars").alias("total_gt_chars"),
        F.avg(F.col("edits") / F.col("chars")).alias("mean_line_cer"),
        (F.sum("diff") / F.count("*")).alias("mean_signed_start_diff_ms"),
        (F.sum(F.abs("diff")) / F.count("*")).alias("mean_abs_start_diff_ms"))
    n_pred = pred.groupBy(*keys).agg(F.count("*").alias("srt_blocks"))
    n_ref = ref.groupBy(*keys).agg(F.count("*").alias("vtt_cues"))
    return _report(n_ref.join(n_pred, keys, "full_outer").join(scored, keys, "left").join(first5, keys, "left"))


def vtt_report_gathered(pairs: DataFrame) -> DataFrame:
    """The same report of ``gathered.greedy_pairs``, in one go over the pairs."""
    diff = F.col("p_start_ms") - F.col("r_start_ms")
    measured = pairs.select(
        "episode_id", "n_preds", "n_refs", "p_cue_index", diff.alias("diff"), F.length("r_text").cast("bigint").alias("chars"),
        F.levenshtein("r_text", "p_text").cast("bigint").alias("edits"), F.when(F.col("p_place") < 5, F.abs(diff)).alias("early"))
    return _report(measured.groupBy("episode_id").agg(
        F.max("n_refs").alias("vtt_cues"), F.max("n_preds").alias("srt_blocks"),
        F.count("p_cue_index").alias("aligned_pairs"), F.sum("edits").alias("total_edit_distance"), F.sum("chars").alias("total_gt_chars"),
        F.avg(F.col("edits") / F.col("chars")).alias("mean_line_cer"), ratio(F.sum("diff"), F.count("diff")).alias("mean_signed_start_diff_ms"),
        ratio(F.sum(F.abs("diff")), F.count("diff")).alias("mean_abs_start_diff_ms"),
        ratio(F.sum("early"), F.count("early")).alias("first5_mean_abs_start_diff_ms")))


def _report(sums: DataFrame) -> DataFrame:
    zero = {c: 0 for c in ("srt_blocks", "vtt_cues", "aligned_pairs", "total_edit_distance", "total_gt_chars")}
    c = F.col
    return (sums.fillna(zero)
            .withColumn("corpus_cer", ratio(c("total_edit_distance"), c("total_gt_chars")))
            .withColumn("recall", ratio(c("aligned_pairs"), c("vtt_cues")))
            .withColumn("precision", ratio(c("aligned_pairs"), c("srt_blocks")))
            .withColumn("compat_warning",
                        F.coalesce(c("first5_mean_abs_start_diff_ms") > K.COMPAT_WARNING_MS, F.lit(False))))


def worst_pairs(pairs: DataFrame, keys: Sequence[str] = ("episode_id",), n: int = 10) -> DataFrame:
    """The ``n`` worst lines per key; equal rates keep file order."""
    cer = F.bround(F.levenshtein("r_text", "p_text") / F.length("r_text"), 6)
    scored = pairs.where(F.length("r_text") > 0).select(
        *keys, "p_cue_index", "r_cue_index", "r_text", "p_text", cer.alias("cer"),
        (F.col("p_start_ms") - F.col("r_start_ms")).alias("start_diff_ms"))
    return first_per_key(scored, keys, [F.col("cer").desc(), F.col("p_cue_index")], n)


def _substitutions(truth: str, read: str) -> Column:
    """The replaced letters of each pair of lines. Where two lines of one length
    are no nearer than their differing places are many, every place is replaced or
    kept, which is the script Python would find; it gets the other pairs only."""
    letters = lambda c: F.split(c, "")
    places = F.filter(F.zip_with(letters(truth), letters(read), lambda x, y: F.struct(x.alias("gt"), y.alias("ocr"))),
                      lambda s: s["gt"] != s["ocr"])
    level = (F.length(truth) == F.length(read)) & (F.levenshtein(truth, read) == F.size(places))
    open_ = lambda c: F.when(~level, F.col(c))
    return F.when(level, places).otherwise(edit_substitutions(open_(truth), open_(read)))


def confusions(pairs: DataFrame, keys: Sequence[str] = ("episode_id",), top: int = 10) -> DataFrame:
    """Watched confusions by name, the ``top`` other ones, and lost ellipses."""
    keys = list(keys)
    differing = pairs.where((F.length("r_text") > 0) & (F.col("r_text") != F.col("p_text")))
    dots = lambda c: F.size(F.split(F.col(c), r"\.\.\.")) - 1
    # replaced letters and lost ellipses of a pair come from one reading of it
    gone = F.struct(F.lit(None).cast("string").alias("gt"), F.lit(None).cast("string").alias("ocr"),
                    F.greatest(dots("r_text") - dots("p_text"), F.lit(0)).cast("bigint").alias("n"))
    found = differing.select(*keys, F.explode(F.concat(F.array(gone), F.transform(
        _substitutions("r_text", "p_text"),
        lambda x: F.struct(x["gt"].alias("gt"), x["ocr"].alias("ocr"), F.lit(1).cast("bigint").alias("n"))))).alias("s"))
    counted = found.groupBy(*keys, F.col("s.gt").alias("gt"), F.col("s.ocr").alias("ocr")).agg(F.sum("s.n").alias("n"))
    watched = F.create_map(*[x for g, o in K.WATCHED_CONFUSIONS for x in (
        F.lit(g + o), F.lit(K.FOLDED_CONFUSION[1] if g == K.FOLDED_CONFUSION[0] else f"{g}→{o}"))])
    named = F.when(F.col("gt").isNull(), F.lit(K.ELLIPSIS_LOSS)).otherwise(F.try_element_at(watched, F.concat("gt", "ocr")))
    labelled = (counted.where("gt IS NOT NULL OR n > 0").withColumn("watched", named.isNotNull())
                .withColumn("confusion", F.coalesce(named, F.concat_ws("→", "gt", "ocr")))
                .groupBy(*keys, "watched", "confusion").agg(F.sum("n").alias("n")))
    labelled = cut_lineage(labelled)  # a row per confusion, used twice
    others = first_per_key(labelled.where("not watched"), keys, [F.col("n").desc(), F.col("confusion")], top)
    return labelled.where("watched").unionByName(others.drop("rank"))


def score_sums(matches: DataFrame, pred: DataFrame, ref: DataFrame, keys: Sequence[str],
               group: Sequence[str], tolerance_ms: int, engines: Sequence[str]) -> DataFrame:
    """Additive cue counts per ``group``; every reference cue is scored, a
    missed one against an empty prediction.

    ``keys`` identify an (engine, episode); ``ref`` is keyed by the episode only.
    Every one of the frozen ``engines`` is scored on every reference episode,
    also where it predicted nothing.
    """
    keys = list(keys)
    ref_keys = [k for k in keys if k in ref.columns]
    place = [*ref_keys, "r_cue_index"]
    sides = ("cue_index", "text", "start_ms", "end_ms")
    r = ref.select(*ref_keys, *[F.col(c).alias("r_" + c) for c in sides])
    p = pred.select(*keys, *[F.col(c).alias("p_" + c) for c in sides])
    hit = matches.select(*keys, "r_cue_index", "p_cue_index").join(p, [*keys, "p_cue_index"])
    # a reference cue is one row until its engines part, so its text travels once
    found = hit.groupBy(*place).agg(F.collect_list(F.struct("engine_id", *[f"p_{c}" for c in sides])).alias("_found"))
    runs = r.join(found, place, "left").withColumn("engine_id", F.explode(F.array(*map(F.lit, engines))))
    mine = F.filter("_found", lambda x: x["engine_id"] == F.col("engine_id"))
    joined = runs.withColumn("_p", F.get(mine, F.lit(0))).select(
        *keys, *[f"r_{c}" for c in sides], *[F.col(f"_p.p_{c}").alias(f"p_{c}") for c in sides])
    sums = _cue_sums(joined, keys, tolerance_ms)
    n_pred = pred.groupBy(*keys).agg(F.count("*").alias("prediction_cues"))
    return sums.join(n_pred, keys, "left").withColumn("prediction_cues", F.coalesce("prediction_cues", F.lit(0)))


def score_sums_gathered(cues: DataFrame, tolerance_ms: int) -> DataFrame:
    """The same counts of ``gathered.scored_cues`` per engine and episode."""
    return _cue_sums(cues, ["engine_id", "episode_id"], tolerance_ms, ["prediction_cues"])


def _cue_sums(joined: DataFrame, keys: list[str], tolerance_ms: int, same: Sequence[str] = ()) -> DataFrame:
    """Counts per ``keys`` of reference cues with the prediction each has, if it has one; ``same`` are
    columns with one value per key."""
    start_error = F.abs(F.col("r_start_ms") - F.col("p_start_ms"))
    end_error = F.abs(F.col("r_end_ms") - F.col("p_end_ms"))
    rows = pair_measures(
        joined.select(*keys, *same, F.col("r_text").alias("reference"), F.col("p_text").alias("prediction"),
                      F.col("p_cue_index").isNotNull().alias("matched"),
                      start_error.alias("start_error"), end_error.alias("end_error"),
                      F.coalesce((start_error <= tolerance_ms) & (end_error <= tolerance_ms),
                                 F.lit(False)).alias("in_tolerance")))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("reference_cues"), F.count_if("matched").alias("matched_cues"),
        F.sum("ref_chars").alias("reference_chars"), F.sum("ref_words").alias("reference_words"),
        F.sum("char_edits").alias("character_edits"), F.sum("word_edits").alias("word_edits"),
        F.count_if("exact").alias("exact_cues"),
        F.coalesce(F.sum("start_error"), F.lit(0)).alias("start_error_sum"),
        F.coalesce(F.sum("end_error"), F.lit(0)).alias("end_error_sum"),
        F.count_if("in_tolerance").alias("in_tolerance_cues"), *[F.max(c).alias(c) for c in same])


SUM_COLUMNS = [
    "reference_cues", "prediction_cues", "matched_cues", "reference_chars", "reference_words",
    "character_edits", "word_edits", "exact_cues", "start_error_sum", "end_error_sum", "in_tolerance_cues"]

RATE_COLUMNS = [
    "cue_precision", "cue_recall", "coverage", "cer", "wer", "exact_match_cue_rate",
    "timing_start_abs_error_ms", "timing_end_abs_error_ms", "timing_within_tolerance_rate"]


def with_cue_rates(sums: DataFrame) -> DataFrame:
    c = F.col
    return (sums
            .withColumn("missed_reference_cues", c("reference_cues") - c("matched_cues"))
            .withColumn("unmatched_prediction_cues", c("prediction_cues") - c("matched_cues"))
            .withColumn("cue_precision", F.coalesce(ratio(c("matched_cues"), c("prediction_cues")), F.lit(0.0)))
            .withColumn("cue_recall", ratio(c("matched_cues"), c("reference_cues")))
            .withColumn("coverage", ratio(c("matched_cues"), c("reference_cues")))
            .withColumn("cer", ratio(c("character_edits"), c("reference_chars")))
            .withColumn("wer", ratio(c("word_edits"), c("reference_words")))
            .withColumn("exact_match_cue_rate", ratio(c("exact_cues"), c("reference_cues")))
            .withColumn("timing_start_abs_error_ms", ratio(c("start_error_sum"), c("matched_cues")))
            .withColumn("timing_end_abs_error_ms", ratio(c("end_error_sum"), c("matched_cues")))
            .withColumn("timing_within_tolerance_rate", ratio(c("in_tolerance_cues"), c("matched_cues"))))


def micro_macro(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per ``keys``: micro rates from summed counts, macro as means of groups.

    ``scored`` has one row per (keys, group) with counts and rates; an undefined
    group rate does not enter its mean.
    """
    keys = list(keys)
    sums = scored.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in SUM_COLUMNS], F.count("*").alias("groups"),
        *[F.avg(c).alias("macro_" + c) for c in RATE_COLUMNS])
    return with_cue_rates(sums)


def drift_report(old: DataFrame, new: DataFrame, keys: Sequence[str], mean_limit: float = 0.02,
                 single_limit: float = 0.15, min_chars: int = 10, worst: int = 3) -> tuple[DataFrame, DataFrame]:
    """Compare readings of fixed points: (per-point rows, one verdict row).

    Both inputs hold ``keys``, ``text`` and ``was_read``; only points read on
    both sides are compared.
    """
    a = old.where("was_read").select(*keys, F.col("text").alias("old_text"))
    b = new.where("was_read").select(*keys, F.col("text").alias("new_text"))
    longest = F.greatest(F.length("old_text"), F.length("new_text"))
    distance = F.levenshtein("old_text", "new_text")
    points = a.join(b, list(keys)).select(
        *keys, "old_text", "new_text", longest.cast("bigint").alias("chars"),
        F.when(longest == 0, F.lit(0.0)).when(F.least(F.length("old_text"), F.length("new_text")) == 0, F.lit(1.0))
        .otherwise(distance / longest).alias("cer"))
    verdict = points.agg(
        F.count("*").alias("points"), F.avg("cer").alias("mean_cer"), F.max("cer").alias("max_cer"),
        F.coalesce(F.max(F.when(F.col("chars") >= min_chars, F.col("cer"))), F.lit(0.0)).alias("max_long_cer"))
    c = F.col
    verdict = verdict.withColumn(
        "verdict", F.when(c("points") == 0, "nothing_to_compare").when(c("max_cer") == 0, "unchanged")
        .when((c("mean_cer") > mean_limit) | (c("max_long_cer") > single_limit), "suspect")
        .otherwise("small_drift"))
    return points, verdict
