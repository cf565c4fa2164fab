"""Splits, lineage, provenance and set checks of datasets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions.ordered import prefix_scan


def split_sizes(n: int) -> list[int]:
    """How many groups each split gets: shares rounded down but never zero, then
    corrected one by one where the deviation is largest (earlier split on ties)."""
    if n < len(K.SPLIT_SHARES):
        raise ValueError("at least three groups are needed")
    want = [n * share for _, share in K.SPLIT_SHARES]
    have = [max(1, math.floor(w)) for w in want]
    while sum(have) != n:
        grow = sum(have) < n
        able = [i for i in range(len(have)) if grow or have[i] > 1]
        i = (max(able, key=lambda k: (want[k] - have[k], -k)) if grow
             else max(able, key=lambda k: (have[k] - want[k], have[k], -k)))
        have[i] += 1 if grow else -1
    return have


def ranked_groups(groups: DataFrame, seed: str, key: str = "group_key") -> DataFrame:
    """Distinct groups with their dense rank by seeded hash.

    Ranks are counted inside 4096 hash ranges and offset by the range totals, so
    no task sorts all groups.
    """
    digest = F.sha2(F.concat(F.lit(seed + "\0"), F.col(key)), 256)
    hashed = groups.select(key).distinct().withColumn("digest", digest).withColumn("_range", F.substring("digest", 1, 3))
    sizes = hashed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # 4096 rows at most
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("digest"))
    return hashed.withColumn("_r", inside).join(offsets, "_range").select(
        key, "digest", (F.col("_r") + F.col("_offset")).cast("bigint").alias("rank"))


def deterministic_split(groups: DataFrame, seed: str, key: str = "group_key") -> DataFrame:
    """(group, split): stable for a seed whatever the row order or partitioning."""
    n = groups.select(key).distinct().count()
    sizes = split_sizes(n)
    bound, label = 0, None
    for (name, _), size in zip(K.SPLIT_SHARES, sizes):
        bound += size
        label = F.when(F.col("rank") <= bound, name) if label is None else label.when(F.col("rank") <= bound, name)
    return ranked_groups(groups, seed, key).select(key, label.alias("split"))


def split_counts(rows: DataFrame, group: str = "group_key", split: str = "split") -> DataFrame:
    """Rows and groups per split, plus the total (null split)."""
    return rows.rollup(split).agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"))


def coverage_sets(rows: DataFrame, metadata: DataFrame, key: str = "cue_id") -> DataFrame:
    """How many keys are missing on either side."""
    a = rows.select(key).distinct().withColumn("_a", F.lit(1))
    b = metadata.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full_outer").agg(
        F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"))


def set_equality(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: missing and unexpected keys, duplicates, and equality."""
    e = expected.groupBy(*keys).agg(F.count("*").alias("_e"))
    f = found.groupBy(*keys).agg(F.count("*").alias("_f"))
    c = F.col
    row = e.join(f, list(keys), "full_outer").agg(
        F.count_if(c("_f").isNull()).alias("missing"), F.count_if(c("_e").isNull()).alias("unexpected"),
        F.count_if(c("_f") > 1).alias("duplicated"))
    return row.withColumn("equal", (c("missing") + c("unexpected") + c("duplicated")) == 0)


def provenance_groups(members: DataFrame) -> DataFrame:
    """Check pack ↔ group: ``members`` holds ``pack_id, group_key, cue_id``."""
    c = F.col
    packs = members.groupBy("pack_id").agg(F.count_distinct("group_key").alias("n")).agg(
        F.count("*").alias("packs"), F.count_if(c("n") != 1).alias("packs_with_many_groups"), F.lit(1).alias("_one"))
    groups = members.groupBy("group_key").agg(F.count_distinct("pack_id").alias("n")).agg(
        F.count("*").alias("groups"), F.count_if(c("n") != 1).alias("groups_with_many_packs"), F.lit(1).alias("_one"))
    cues = members.groupBy("cue_id").agg(F.count("*").alias("n")).agg(
        F.count_if(c("n") > 1).alias("cues_in_many_packs"), F.lit(1).alias("_one"))
    row = packs.join(groups, "_one").join(cues, "_one").drop("_one")
    return row.withColumn("valid", (c("groups") >= 3) & (
        c("packs_with_many_groups") + c("groups_with_many_packs") + c("cues_in_many_packs") == 0))


def merge_exports(exports: Sequence[DataFrame] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(union of per-pack exports, cue ids that collide)."""
    rows = exports if isinstance(exports, DataFrame) else reduce(lambda a, b: a.unionByName(b), exports)
    clash = rows.groupBy("cue_id").agg(F.count("*").alias("n"), F.min("pack_id").alias("first_pack"),
                                       F.max("pack_id").alias("last_pack")).where("n > 1")
    return rows, clash


def composite_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("crop_path", F.concat(F.lit("crops/"), "crop_sha256_local", F.lit(".jpg")))


def lineage_members(rows: DataFrame) -> DataFrame:
    """One lineage row per (pack, cue); edges, not one array per pack."""
    return rows.select("pack_id", "cue_id").distinct()


def write_composite(rows: DataFrame, path: str) -> None:
    """Merged rows and their lineage edges; an existing target is never replaced."""
    composite_rows(rows).write.mode("errorifexists").partitionBy("pack_id").parquet(path + "/rows")
    lineage_members(rows).write.mode("errorifexists").parquet(path + "/lineage")


def lineage_verify(composite: DataFrame, sources: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows that differ from their source export: (cue_id, problem)."""
    c = F.col
    a = composite.select("cue_id", *[c(f).alias("c_" + f) for f in fields], F.lit(True).alias("_in_c"))
    b = composite_rows(sources).groupBy("cue_id").agg(
        F.count("*").alias("_copies"), *[F.min(f).alias("s_" + f) for f in fields])
    joined = a.join(b, "cue_id", "full_outer")
    same = reduce(lambda x, y: x & y, [c("c_" + f).eqNullSafe(c("s_" + f)) for f in fields])
    problem = (F.when(c("_in_c").isNull(), "not_in_composite").when(c("_copies").isNull(), "no_source")
               .when(c("_copies") > 1, "cue_in_two_sources").when(~same, "row_differs"))
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select("cue_id", "problem")


def crop_dedup(cues: DataFrame, order: str = "cue_index") -> DataFrame:
    """The first cue per source image and per digest keeps the crop."""
    def canonical(keys: list[str], name: str) -> DataFrame:
        return cues.groupBy(*keys).agg(F.min_by("cue_id", order).alias(name))

    frame, digest = ["frame_no", "band"], ["crop_sha"]
    joined = cues.join(canonical(frame, "_by_frame"), frame).join(canonical(digest, "_by_digest"), digest)
    first = F.col("_by_digest")
    return joined.select("cue_id", "crop_sha", "bytes", F.when(first != F.col("cue_id"), first).alias("duplicate_of"),
                         (F.col("_by_frame") != F.col("cue_id")).alias("same_frame"))


def unique_bytes(cues: DataFrame) -> DataFrame:
    one = cues.groupBy("crop_sha").agg(F.max("bytes").alias("b"))
    return one.agg(F.count("*").alias("unique_crops"), F.sum("b").alias("unique_bytes"))


def crop_budget(cues: DataFrame, keys: Sequence[str], order: str, budget: int = K.MAX_CROP_TOTAL_BYTES) -> DataFrame:
    """Add the bytes of distinct crops up to and with each row of a dataset
    (``total_bytes``), and whether they pass the budget (``over_budget``): the
    dataset is refused from its first such row on. A digest counts where it
    stands first."""
    keys = list(keys)
    first = cues.groupBy(*keys, "crop_sha").agg(F.min(order).alias("_first"))
    fresh = cues.join(first, [*keys, "crop_sha"]).withColumn(
        "_bytes", F.when(F.col(order) == F.col("_first"), F.col("bytes")).otherwise(0).cast("bigint"))
    total = prefix_scan(fresh, keys, [order], {"total_bytes": ("sum", F.col("_bytes"))}, inclusive=True)
    return total.select(*cues.columns, "total_bytes", (F.col("total_bytes") > budget).alias("over_budget"))


def seed_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seed groups with counts, identities labelled with several episodes)."""
    c = F.col
    groups = rows.groupBy("episode_key", "size", "sha1").agg(
        F.count_if(c("action") == "replace_text").alias("candidates"), F.count_if(c("action") == "remove_cue").alias("skipped"))
    clash = rows.groupBy("size", "sha1").agg(F.count_distinct("episode_key").alias("episodes")).where("episodes > 1")
    return groups, clash


def reasons(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in order, as one text."""
    return F.array_join(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules])), ",")


def coverage_gate(scores: DataFrame, expected: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(per engine and group, verdict row).

    ``scores``: ``engine_id, group_key, reference_cues, matched_cues``. Every engine
    must have every expected group exactly once, and there must be two engines.
    """
    c = F.col
    rows = scores.withColumn("coverage", c("matched_cues") / c("reference_cues")).withColumn(
        "passed", c("coverage") >= threshold)
    want = expected.select("group_key").distinct().withColumn("_want", F.lit(1))
    per_group = rows.groupBy("group_key").agg(
        F.count("*").alias("n"), F.count_distinct("engine_id").alias("engines"), F.count_if(~c("passed")).alias("failed"))
    n_engines = scores.select(F.count_distinct("engine_id")).scalar()
    joined = want.join(per_group, "group_key", "full_outer")
    wanted = c("_want").isNotNull()
    verdict = joined.agg(
        F.coalesce(F.max(n_engines), F.lit(0)).alias("engines"),
        F.coalesce(F.sum(F.when(wanted, n_engines - F.coalesce(c("engines"), F.lit(0)))), F.lit(0)).alias("missing_groups"),
        F.coalesce(F.sum(F.when(~wanted, c("engines"))), F.lit(0)).alias("unexpected_groups"),
        F.coalesce(F.sum(c("n") - c("engines")), F.lit(0)).alias("duplicate_groups"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_groups"))
    good = (c("engines") == 2) & (c("missing_groups") + c("unexpected_groups") + c("duplicate_groups") + c("failed_groups") == 0)
    return rows, verdict.withColumn("status", F.when(good, "PASS").otherwise("FAIL"))


def baseline_vs_candidate(scores: DataFrame, baseline: str, candidate: str, value: str = "cer") -> DataFrame:
    """Per-group difference between two engines."""
    c = F.col
    a = scores.where(c("engine_id") == baseline).select("group_key", c(value).alias("baseline"))
    b = scores.where(c("engine_id") == candidate).select("group_key", c(value).alias("candidate"))
    return a.join(b, "group_key", "full_outer").withColumn("candidate_minus_baseline", c("candidate") - c("baseline"))


def comparison_gate(micro: DataFrame, deltas: DataFrame, coverage_status: DataFrame, baseline: str, candidate: str,
                    max_increase: float, forbid_regression: bool = True) -> DataFrame:
    """Corpus error limit, no worse group, coverage; missing data fails."""
    c = F.col
    one = F.lit(1).alias("_one")
    corpus = micro.agg(F.max(F.when(c("engine_id") == baseline, c("cer"))).alias("_b"),
                       F.max(F.when(c("engine_id") == candidate, c("cer"))).alias("_c"), one)
    groups = deltas.agg(F.coalesce(F.bool_and(F.coalesce(c("candidate_minus_baseline") <= 0, F.lit(False))), F.lit(False)).alias("no_worse_group"),
                        F.coalesce(F.bool_and(c("candidate_minus_baseline").isNotNull()), F.lit(False)).alias("group_data_complete"), one)
    cover = coverage_status.select((c("status") == "PASS").alias("coverage_passed"), one)
    row = corpus.join(groups, "_one").join(cover, "_one").withColumn("cer_increase", c("_c") - c("_b"))
    limit = F.coalesce(c("cer_increase") <= max_increase, F.lit(False))
    group_ok = (c("no_worse_group") & c("group_data_complete")) if forbid_regression else F.lit(True)
    return row.select("cer_increase", limit.alias("cer_limit_passed"), group_ok.alias("no_group_regression_passed"),
                      "group_data_complete", "coverage_passed",
                      F.when(limit & group_ok & c("coverage_passed"), "PASS").otherwise("FAIL").alias("status"))


def case_gate(reports: DataFrame, min_refs: int, min_pairs: int, min_chars: int, max_cer: float) -> DataFrame:
    """Reasons why a reference case fails; none means PASS."""
    c = F.col
    why = reasons((c("vtt_cues") == 0, "no_reference_in_window"), (c("vtt_cues") < min_refs, "few_references"),
                  (c("aligned_pairs") < min_pairs, "few_pairs"), (c("total_gt_chars") < min_chars, "few_characters"),
                  (c("corpus_cer").isNull() | (c("corpus_cer") > max_cer), "error_limit"),
                  (c("compat_warning"), "timing_warning"))
    return reports.withColumn("reasons", why).withColumn("status", F.when(c("reasons") == "", "PASS").otherwise("FAIL"))


def compat_gate(required: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required combinations without passing evidence."""
    return required.join(evidence.where("validation_passed").select(*keys).distinct(), list(keys), "left_anti")


def response_validate(request: DataFrame, response: DataFrame) -> DataFrame:
    """First problem per cue of a review response (null: fine).

    ``request``: ``request_id, cue_id, start_ms, end_ms, source_text``; ``response`` the
    same keys with ``source_status, observed, proposed_source, review_status,
    translation``.
    """
    c = F.col
    r = response.groupBy("request_id", "cue_id").agg(F.count("*").alias("_n"), F.first(F.struct(
        "start_ms", "end_ms", "source_status", "observed", "proposed_source", "review_status", "translation")).alias("r"))
    joined = request.join(r, ["request_id", "cue_id"], "full_outer")
    blank = lambda col: F.coalesce(F.trim(col) == "", F.lit(True))
    status = c("r.source_status")
    problem = (F.when(c("_n").isNull(), "missing").when(c("start_ms").isNull(), "unexpected").when(c("_n") > 1, "duplicate")
               .when((c("r.start_ms") != c("start_ms")) | (c("r.end_ms") != c("end_ms")), "times_changed")
               .when(~F.coalesce(status.isin("confirmed", "correction_proposed", "uncertain"), F.lit(False)), "source_status")
               .when((status == "correction_proposed") & (blank(c("r.proposed_source")) | (c("r.proposed_source") == c("source_text"))), "correction")
               .when((status != "correction_proposed") & c("r.proposed_source").isNotNull(), "correction_not_asked")
               .when((status == "confirmed") & ~c("r.observed").eqNullSafe(c("source_text")), "confirmed_differs")
               .when(~F.coalesce(c("r.review_status").isin("reviewed", "deferred"), F.lit(False)), "review_status")
               .when((c("r.review_status") == "reviewed") & (status != "confirmed"), "must_be_deferred")
               .when((c("r.review_status") == "reviewed") & blank(c("r.translation")), "translation")
               .when((c("r.review_status") == "deferred") & c("r.translation").isNotNull(), "translation_not_asked"))
    return joined.select("request_id", "cue_id", problem.alias("problem"))
