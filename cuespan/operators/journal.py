"""Append-only journals replayed into current state.

The line number of an event is its logical clock. State per cue is found with
associative prefix values and aggregates, so a cue with very many events is
split over tasks like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.functions import text as tx
from cuespan.functions.ordered import prefix_scan, with_neighbours

REVIEW_KINDS = ["accepted", "corrected", "uncertain"]


def valid_review(kind: Column, verified: Column, ocr: Column) -> Column:
    blank = tx.strip_ws(verified) == ""
    return F.coalesce(F.when(kind == "accepted", verified == ocr).when(kind == "corrected", ~blank)
                      .when(kind == "uncertain", verified == ""), F.lit(False))


def bind_events(events: DataFrame, cues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events bound to their cue, events that match no cue or another version).

    Both hold ``cue_id, manifest_sha, crop_sha``; cues also ``ocr_text, crop_valid``.
    """
    side = cues.select("cue_id", F.col("manifest_sha").alias("_m"), F.col("crop_sha").alias("_c"), "ocr_text", "crop_valid")
    joined = events.join(side, "cue_id", "left")
    bound = F.coalesce((F.col("manifest_sha") == F.col("_m")) & (F.col("crop_sha") == F.col("_c")) & F.col("crop_valid"),
                       F.lit(False))
    return joined.where(bound).drop("_m", "_c"), joined.where(~bound).drop("_m", "_c", "ocr_text", "crop_valid")


def active_reviews(events: DataFrame, ocr: Column | None = None) -> DataFrame:
    """The review in force per cue.

    ``events``: ``line_no, event_id, cue_id, kind, verified_text, undo_id``. An undo
    counts only when it names the review in force; it leaves the cue empty.
    """
    review = valid_review(F.col("kind"), F.col("verified_text"), F.col("ocr_text") if ocr is None else ocr)
    rows = events.withColumn("_review", F.col("kind").isin(REVIEW_KINDS) & review)
    usable = rows.where(F.col("_review") | (F.col("kind") == "undo"))
    # a repeated event id counts once, at its first usable line
    first = usable.groupBy("event_id").agg(F.min("line_no").alias("line_no"))
    usable = usable.join(first, ["event_id", "line_no"], "left_semi")
    seen = prefix_scan(usable, ["cue_id"], ["line_no"],
                       {"_current": ("last", F.when(F.col("_review"), F.col("event_id")))})
    aimed = seen.where(F.col("_review") | (F.col("undo_id") == F.col("_current")))
    # of several undos of one review only the first finds it in force, but the
    # later ones change nothing: the cue is empty either way
    state = aimed.groupBy("cue_id").agg(F.max_by(
        F.struct("_review", "line_no", "event_id", "kind", "verified_text"), "line_no").alias("s"))
    return state.where("s._review").select("cue_id", "s.line_no", "s.event_id", "s.kind", "s.verified_text")


def review_view(cues: DataFrame, active: DataFrame) -> DataFrame:
    """Every cue with its active event, and a note only for proven clamps."""
    c = F.col
    proven = ((c("clamp_status") == "matched") & (c("clamp_srt_sha") == c("srt_sha"))
              & (c("raw_end_ms") > c("end_ms")) & (c("clamp_delta_ms") > 0))
    note = F.when(proven, F.concat_ws(" ", c("end_ms"), c("raw_end_ms"), c("clamp_delta_ms")))
    return cues.join(active.select("cue_id", "event_id", "kind"), "cue_id", "left").withColumn("raw_end_note", note)


def verified_sources(cues: DataFrame, active: DataFrame) -> DataFrame:
    """Cues whose active review is accepted or corrected and not blank."""
    good = active.where(F.col("kind").isin("accepted", "corrected") & (tx.strip_ws(F.col("verified_text")) != ""))
    return cues.where("crop_valid").join(
        good.select("cue_id", "event_id", "kind", "verified_text"), "cue_id")


def export_verified(cues: DataFrame, active: DataFrame) -> DataFrame:
    """Dataset rows of human-verified texts (an accepted text may be blank)."""
    good = active.where(F.col("kind").isin("accepted", "corrected"))
    return (cues.where("crop_valid").join(good.select("cue_id", "event_id", "verified_text"), "cue_id")
            .select("cue_id", F.col("verified_text").alias("source_text_verified"),
                    F.concat(F.lit("crops/"), "crop_sha", F.lit(".jpg")).alias("crop_path"), F.col("crop_sha").alias("crop_sha256_local"),
                    "start_ms", "end_ms", "ocr_confidence", F.col("event_id").alias("review_event_id")))


def review_progress(cues: DataFrame, active: DataFrame, pack: str = "pack_id") -> DataFrame:
    return cues.join(active.select("cue_id", F.lit(1).alias("_hit")), "cue_id", "left").groupBy(pack).agg(
        F.count("*").alias("candidates"), F.count("_hit").alias("reviewed"))


def clamp_attach(cues: DataFrame, clamps: DataFrame) -> DataFrame:
    """Writer clamps whose position, frames, end and delta all agree with a cue."""
    keys = ["srt_sha", "cue_index", "start_f", "end_f"]
    joined = cues.join(clamps, keys)
    delta = F.col("raw_end_ms") - F.col("emitted_end_ms")
    return joined.where(
        (F.col("emitted_end_ms") == F.col("end_ms")) & (F.col("clamp_delta_ms") > 0) & (delta > 0)
        & (F.abs(F.col("clamp_delta_ms") - delta) <= 1.001)).select(*keys, "end_ms", "raw_end_ms", "clamp_delta_ms")


def first_by(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(F.struct(order, *columns), order).alias("r")).select(*keys, "r.*")


def ai_proposals(events: DataFrame) -> DataFrame:
    """Append-only proposals; a repeated (request, response) import changes nothing."""
    return first_by(events, ["request_id", "response_sha"], "line_no", ["cue_id", "proposal"])


def proposal_state(proposals: DataFrame, decisions: DataFrame, sources: DataFrame) -> DataFrame:
    """Proposals still bound to their source with the first valid decision.

    ``proposals``: ``line_no, proposal_id, request_id, cue_id, source_event_id,
    source_text``; ``decisions``: ``line_no, event_id, proposal_id, cue_id,
    decision, translation``; ``sources`` from :func:`verified_sources`.
    """
    once = first_by(proposals, ["request_id", "cue_id"], "line_no", ["proposal_id", "source_event_id", "source_text", "draft"])
    link = sources.select("cue_id", F.col("event_id").alias("source_event_id"), F.col("verified_text").alias("source_text"))
    bound = once.join(link, ["cue_id", "source_event_id", "source_text"], "left_semi")
    valid = decisions.where(F.col("decision").isin("accepted", "edited", "rejected"))
    first = first_by(valid, ["proposal_id", "cue_id"], "line_no", ["event_id", "decision", "translation"]).withColumnsRenamed(
        {"event_id": "decision_event_id", "line_no": "decision_line"})
    return (bound.join(first, ["proposal_id", "cue_id"], "left")
            .withColumn("decision", F.coalesce("decision", F.lit("pending"))))


def chain_verify(events: DataFrame, keys: Sequence[str], body: Column) -> DataFrame:
    """Links of a hash chain that do not hold: (keys, line_no, problem).

    ``events``: ``line_no, event_id, event_type, event_sha256,
    previous_event_sha256``; ``body`` is the canonical text an event hashes.
    """
    near = with_neighbours(events, keys, ["line_no"], ["event_sha256"])
    c = F.col
    dup = events.groupBy(*keys, "event_id").agg(F.min("line_no").alias("_first"))
    near = near.join(dup, [*keys, "event_id"])
    problem = (F.when(c("line_no") != c("_first"), "duplicate_id")
               .when(~c("previous_event_sha256").eqNullSafe(c("prev.event_sha256")), "broken_link")
               .when(c("event_sha256") != F.sha2(body, 256), "hash_mismatch")
               .when(c("prev").isNull() & (c("event_type") != "cohort_frozen"), "not_frozen_first")
               .when(c("prev").isNotNull() & (c("event_type") == "cohort_frozen"), "frozen_twice"))
    return near.withColumn("problem", problem).where("problem IS NOT NULL").select(*keys, "line_no", "problem")
