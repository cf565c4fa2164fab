"""Human rating journals, agreement and held-out metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions.ordered import prefix_scan, with_neighbours

SOURCE_FIELDS = ["context_sha", "source_status", "source_event_id", "text_sha", "crop_sha", "srt_sha"]


def active_ratings(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ratings in force, violations).

    ``ratings``: ``line_no, event_id, candidate_id, reviewer_id, supersedes_id``. A
    correction must replace the rating of the same pair that is current.
    """
    pair = ["candidate_id", "reviewer_id"]
    seen = prefix_scan(ratings, pair, ["line_no"], {"_current": ("last", F.col("event_id"))})
    bad = (F.when(F.col("supersedes_id").isNull() & F.col("_current").isNotNull(), "duplicate_rating")
           .when(F.col("supersedes_id").isNotNull() & ~F.coalesce(F.col("supersedes_id") == F.col("_current"), F.lit(False)),
                 "supersedes_not_current"))
    checked = seen.withColumn("problem", bad)
    replaced = ratings.where("supersedes_id IS NOT NULL").select(F.col("supersedes_id").alias("event_id")).distinct()
    return (ratings.join(replaced, "event_id", "left_anti"),
            checked.where("problem IS NOT NULL").select("line_no", "event_id", *pair, "problem"))


def source_status(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Is each candidate still bound to a current source?

    ``state`` holds ``candidate_id, active``, the source fields and
    ``candidate_sha, proposal_sha`` as they are now.
    """
    now = state.select("candidate_id", *[F.col(c).alias("now_" + c) for c in (
        "active", *SOURCE_FIELDS, "candidate_sha", "proposal_sha")])
    joined = candidates.join(now, "candidate_id", "left")

    def same(name: str) -> Column:
        return F.col("now_" + name).eqNullSafe(F.col(name))

    current = same(SOURCE_FIELDS[0])
    for name in SOURCE_FIELDS[1:]:
        current = current & same(name)
    status = (F.when(~F.coalesce(F.col("now_active"), F.lit(False)), "source_unavailable")
              .when(~current, "stale_source").when(F.col("candidate_sha").isNull(), "candidate_missing")
              .when(~(same("candidate_sha") & same("proposal_sha")), "stale_candidate").otherwise("current"))
    return joined.withColumn("source_state", status).select(*candidates.columns, "source_state")


def rating_rules(ratings: DataFrame) -> DataFrame:
    """First broken rule per rating (null: fine).

    ``ratings``: ``status``, one column per dimension, ``issues`` (array),
    ``outcome, reason, source_state``.
    """
    dims = [F.col(d) for d in K.DIMENSIONS]
    scored = dims[0].isin(0, 1, 2)
    empty = dims[0].isNull()
    for d in dims[1:]:
        scored, empty = scored & d.isin(0, 1, 2), empty & d.isNull()
    c, issues = F.col, F.col("issues")
    known = F.forall(issues, lambda i: i.isin(K.ISSUES)) & (F.size(F.array_distinct(issues)) == F.size(issues))
    alone = ~F.array_contains(issues, "none") | (F.size(issues) == 1)
    rated = (F.when(c("source_state") != "current", "source_not_current").when(~F.coalesce(scored, F.lit(False)), "dimensions")
             .when(~known, "issues").when(~alone, "none_not_alone")
             .when(~F.coalesce(c("outcome").isin(K.OUTCOMES), F.lit(False)), "outcome").when(c("reason").isNotNull(), "reason_given"))
    forced = c("source_state").isin("candidate_missing", "source_unavailable", "stale_source", "stale_candidate")
    unevaluable = (F.when(~empty | (F.size(issues) > 0) | c("outcome").isNotNull(), "scores_given")
                   .when(~F.coalesce(c("reason").isin(K.UNEVALUABLE_REASONS), F.lit(False)), "reason")
                   .when(forced & (c("reason") != c("source_state")), "reason_not_state")
                   .when((c("source_state") == "current") & c("reason").isin(
                       "source_unavailable", "stale_source", "stale_candidate", "candidate_missing"), "reason_not_state"))
    return ratings.withColumn("problem", F.when(c("status") == "rated", rated).when(c("status") == "unevaluable", unevaluable)
                              .otherwise("status"))


def adjudicate(candidates: DataFrame, ratings: DataFrame) -> DataFrame:
    """One status per candidate; identical ratings count as one item.

    ``candidates``: ``candidate_id, condition_id, group_id, split, candidate_sha,
    source_state``; ``ratings`` are those in force.
    """
    signature = F.to_json(F.struct(*K.DIMENSIONS, F.array_sort("issues").alias("issues"), "outcome"),
                          {"ignoreNullFields": "false"})
    rows = ratings.withColumn("_sig", signature)
    first = F.struct("reviewer_id", "event_id")
    per = rows.groupBy("candidate_id").agg(
        F.count("*").alias("n_ratings"), F.count_if(F.col("status") == "unevaluable").alias("n_unevaluable"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "unevaluable", F.col("reason")))), ",").alias("reasons"),
        F.count_distinct("_sig").alias("n_signatures"),
        F.min_by(F.struct(*K.DIMENSIONS, "issues", "outcome"), first).alias("agreed"))
    joined = candidates.join(per, "candidate_id", "left")
    c = F.col
    status = (F.when(c("candidate_sha").isNull(), "missing_output")
              .when(c("source_state") != "current", c("source_state"))
              .when(c("n_ratings").isNull(), "unrated").when(c("n_unevaluable") > 0, "unevaluable")
              .when(c("n_signatures") > 1, "disputed").otherwise("rated"))
    out = joined.withColumn("status", status)
    rated = c("status") == "rated"
    fine = (rated & (c("agreed.semantic_adequacy") == 2) & (c("agreed.omissions") < 2) & (c("agreed.additions") < 2)
            & (c("agreed.terminology") >= 1) & (c("agreed.style_register") >= 1))
    return out.withColumn("no_material_defect", F.coalesce(fine, F.lit(False)))


STATUSES = ["rated", "unevaluable", "missing_output", "source_unavailable", "stale_source", "stale_candidate",
            "disputed", "unrated"]


def rating_report(items: DataFrame) -> DataFrame:
    """Counts per condition and split of :func:`adjudicate` rows."""
    c = F.col
    return items.groupBy("condition_id", "split").agg(
        F.count("*").alias("expected"), F.coalesce(F.sum(F.when(c("status") != "missing_output", c("n_ratings"))), F.lit(0)).alias("active_ratings"),
        *[F.count_if(c("status") == s).alias(s) for s in STATUSES],
        F.count_if(~c("status").isin("rated", "unrated")).alias("excluded"))


def exclusion_reasons(items: DataFrame) -> DataFrame:
    """How many candidates each reason touches."""
    c = F.col
    reason = (F.when(c("status") == "unevaluable", F.transform(F.split("reasons", ","), lambda r: F.concat(F.lit("unevaluable:"), r)))
              .when(c("status") == "disputed", F.array(F.lit("reviewer_disagreement")))
              .when(c("status") == "unrated", F.array(F.lit("pending_rating")))
              .when(c("status") != "rated", F.array(c("status"))))
    return items.select("condition_id", "split", F.explode(reason).alias("reason")).groupBy(
        "condition_id", "split", "reason").agg(F.count("*").alias("n"))


def rating_histogram(items: DataFrame) -> DataFrame:
    """Counts of every dimension score, issue and outcome of agreed items."""
    agreed = items.where("status = 'rated'")
    facts = F.concat(
        F.array(*[F.struct(F.lit(d).alias("fact"), F.col(f"agreed.{d}").cast("string").alias("value")) for d in K.DIMENSIONS]),
        F.transform(F.filter("agreed.issues", lambda i: i != "none"), lambda i: F.struct(F.lit("issue").alias("fact"), i.alias("value"))),
        F.array(F.struct(F.lit("outcome").alias("fact"), F.col("agreed.outcome").alias("value"))))
    return agreed.select("condition_id", "split", F.explode(facts).alias("f")).groupBy(
        "condition_id", "split", "f.fact", "f.value").agg(F.count("*").alias("n"))


def reviewer_agreement(ratings: DataFrame) -> DataFrame:
    """Per candidate: how many reviewers, how many different verdicts."""
    signature = F.to_json(F.struct(*K.DIMENSIONS, F.array_sort("issues").alias("issues"), "outcome"), {"ignoreNullFields": "false"})
    return ratings.where("status = 'rated'").withColumn("_sig", signature).groupBy("candidate_id").agg(
        F.count("*").alias("ratings"), F.count_distinct("_sig").alias("verdicts")).withColumn(
        "state", F.when(F.col("verdicts") == 1, "agreed").otherwise("disputed"))


def heldout_metric(items: DataFrame, floor: float, human: bool = True) -> DataFrame:
    """Share of held-out items without material defect, only where every group
    meets the rating floor. Excluded items stay in the denominator."""
    c = F.col
    groups = items.where("split = 'held_out'").groupBy("condition_id", "group_id").agg(
        F.count("*").alias("expected"), F.count_if(c("status") == "rated").alias("rated"),
        F.count_if("no_material_defect").alias("passes"))
    rate = c("rated") / c("expected")
    out = groups.groupBy("condition_id").agg(
        F.count("*").alias("groups"), F.count_if(rate >= floor).alias("groups_meeting_floor"),
        F.bround(F.min(rate), 6).alias("minimum_rated_fraction"), F.sum("expected").alias("denominator"),
        F.sum("passes").alias("numerator"), F.avg(c("passes") / c("expected")).alias("_macro"))
    open_ = (c("groups") == c("groups_meeting_floor")) & F.lit(human)
    return out.select(
        "condition_id", "groups", "groups_meeting_floor", "minimum_rated_fraction", "denominator",
        F.when(open_, c("numerator")).alias("numerator"),
        F.when(open_, F.bround(c("numerator") / c("denominator"), 6)).alias("rate"),
        F.when(open_, F.bround("_macro", 6)).alias("group_macro_rate"),
        F.when(open_, "DESCRIPTIVE_HELD_OUT_REVIEW").when(F.lit(human), "COVERAGE_FLOOR_FAILED")
        .otherwise("SYNTHETIC_FIXTURE_ONLY").alias("metric_status"))


def blind_reveal(reveals: DataFrame, ratings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Problems of unblinding events: too early, or followed by ratings.

    ``reveals``: ``line_no, reviewer_id``; ``ratings``: all rating events.
    """
    needed = candidates.select(F.count_distinct("candidate_id")).scalar()
    last_rating = ratings.select(F.max("line_no")).scalar()
    before = (reveals.withColumnRenamed("line_no", "reveal_line")
              .join(ratings.select("reviewer_id", "candidate_id", "line_no"), "reviewer_id", "left")
              .groupBy("reviewer_id", "reveal_line").agg(
                  F.count_distinct(F.when(F.col("line_no") < F.col("reveal_line"), F.col("candidate_id"))).alias("rated")))
    c = F.col
    return before.withColumn("needed", needed).withColumn("status", F.when(c("rated") < c("needed"), "incomplete")
                             .when(last_rating > c("reveal_line"), "rated_after").otherwise("allowed"))


def neighbour_context(cues: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Verified text of a cue with that of its direct neighbours, labelled."""
    with_text = cues.join(sources.select(*keys, "cue_index", "verified_text"), [*keys, "cue_index"], "left")
    near = with_neighbours(with_text, keys, ["cue_index"], ["verified_text"])
    label = lambda name, col: F.when(col.isNotNull(), F.concat(F.lit(name + ": "), col))
    return near.where("verified_text IS NOT NULL").select(*keys, "cue_index", F.concat_ws(
        "\n", label("Önceki", F.col("prev.verified_text")), label("Mevcut", F.col("verified_text")),
        label("Sonraki", F.col("next.verified_text"))).alias("context"))


def cohort_candidates(test_rows: DataFrame, sources: DataFrame, proposals: DataFrame, conditions: DataFrame) -> DataFrame:
    """Test cues with their state: a case needs one reviewed proposal and a condition.

    ``test_rows``: ``cue_id, group_key, source_event_id``; ``sources``: ``cue_id,
    event_id``; ``proposals``: ``proposal_id, cue_id, source_event_id``;
    ``conditions``: ``proposal_id, condition_id``.
    """
    fitting = proposals.groupBy("cue_id", "source_event_id").agg(
        F.count("*").alias("n"), F.min("proposal_id").alias("proposal_id"))
    c = F.col
    joined = (test_rows.join(sources.select("cue_id", c("event_id").alias("now_event_id")), "cue_id", "left")
              .join(fitting, ["cue_id", "source_event_id"], "left").join(conditions, "proposal_id", "left"))
    return joined.select(
        "cue_id", "group_key", F.when(c("n") == 1, c("proposal_id")).alias("proposal_id"), "condition_id",
        F.when(c("now_event_id").isNull(), "source_missing").when(c("now_event_id") != c("source_event_id"), "lineage_stale")
        .when(F.coalesce(c("n"), F.lit(0)) != 1, "proposal_missing").when(c("condition_id").isNull(), "condition_missing")
        .otherwise("ready").alias("state"))


def readiness(cases: DataFrame, sources: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row: ready, or the first blocking reason, with counts."""
    c = F.col
    one = F.lit(1).alias("_one")
    has = lambda s: F.count_if(c("state") == s)
    facts = cases.agg(
        F.count("*").alias("cases"), F.count_distinct("group_key").alias("groups"), has("source_missing").alias("a"),
        has("lineage_stale").alias("b"), has("proposal_missing").alias("p"), has("condition_missing").alias("m"),
        F.count_distinct("condition_id").alias("conditions"), one)
    n_sources = sources.agg(F.count("*").alias("verified_sources"), one)
    n_props = proposals.agg(F.count("*").alias("proposals"), one)
    row = facts.join(n_sources, "_one").join(n_props, "_one")
    blocker = (F.when(c("cases") == 0, "TEST_CUES_MISSING").when(c("a") > 0, "TEST_SOURCE_REVIEW_MISSING")
               .when(c("b") > 0, "OCR_SOURCE_LINEAGE_STALE").when(c("p") > 0, "TEST_MANUAL_PROPOSALS_INCOMPLETE")
               .when(c("m") > 0, "CONDITION_ASSIGNMENT_MISSING").when(c("conditions") > 1, "MIXED_CONDITIONS"))
    return row.select(blocker.isNull().alias("ready"), blocker.alias("blocker"), "verified_sources", "proposals",
                      c("groups").alias("held_out_groups"), c("cases").alias("held_out_candidates"))
