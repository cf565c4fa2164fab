"""Streaming queries over the event table, fed in two steps with a restart."""

from __future__ import annotations


from pyspark.sql import functions as F

from cuespan.operators import journal
from cuespan.plans import views as v
from cuespan.plans.board_queries import _JOB, _payloads, _stats, _tokens
from cuespan.plans.registry import query
from cuespan.streaming import jobs
from cuespan.streaming.run import in_steps

def _events(spark, sf):
    """Events with an instant instead of a zoneless time, whatever the session zone."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return v.table(spark, sf, "events").withColumn("ts", F.timestamp_micros(micros))


def _halves(time="ts"):
    cut = F.timestamp_micros(F.lit(1_705_363_200_000_000))  # 2024-01-16 00:00 UTC
    return [F.col(time) < cut, F.col(time) >= cut]


@query("x1_contribution_ingest", """
SELECT 'S' || user_id % 60 || '-' || event_type AS submission_id, event_id AS seq,
       CASE WHEN event_id = first_value(event_id) OVER w THEN 'accepted'
            WHEN user_id = first_value(user_id) OVER w AND event_id % 4 = first_value(event_id % 4) OVER w THEN 'already_received' ELSE 'conflict' END AS status
FROM events WINDOW w AS (PARTITION BY user_id % 60, event_type ORDER BY event_id)""")
def x1(spark, sf):
    calls = _events(spark, sf).selectExpr(
        "'S' || user_id % 60 || '-' || event_type AS submission_id", "event_id AS seq", "user_id AS token_hash", "'p' || event_id % 4 AS payload", "ts")
    return in_steps(spark, calls, _halves(), lambda s: jobs.contribution_ingest(s.drop("ts"))).select("submission_id", "seq", "status")


@query("x1_drop_repeats", """
SELECT submission, count(*) AS n FROM (SELECT DISTINCT user_id % 10 || event_type AS submission, CAST(date_trunc('month', ts) AS VARCHAR) AS m FROM events) t GROUP BY 1""")
def x1_repeats(spark, sf):
    calls = _events(spark, sf).selectExpr("user_id % 10 || event_type AS submission", "ts")
    kept = in_steps(spark, calls, _halves(), lambda s: jobs.drop_repeats(s, "ts", "60 days", ["submission"]))
    return kept.groupBy("submission").agg(F.count("*").alias("n"))


@query("x2_rate_limit")
def x2(spark, sf):
    """Calls of ten tokens, five seconds of table time per hour of call time."""
    calls = _events(spark, sf).selectExpr(
        "user_id % 10 AS token_hash", "event_id AS seq", "unix_millis(ts) div 20 AS at_ms", "ts")
    return in_steps(spark, calls, _halves(), lambda s: jobs.rate_limit(s.drop("ts"))).select("token_hash", "seq", "allowed")


@query("x3_token_stream", """
SELECT e.event_id, NOT (user_id % 3 = 0) AND NOT (user_id % 7 = 0) AND e.ts < CASE WHEN user_id % 5 = 0 THEN TIMESTAMP '2024-01-21 00:00:00'
       ELSE TIMESTAMP '2024-01-10 00:00:00' + to_days(CAST(user_id % 5 AS INTEGER)) END AS valid FROM events e""")
def x3(spark, sf):
    calls = _events(spark, sf).select("event_id", F.col("user_id").alias("token_hash"), "ts")
    tokens = _tokens(spark, sf)
    return in_steps(spark, calls, _halves(), lambda s: jobs.token_validity(s, tokens, 20)).select("event_id", "valid")


_ACTIVE = """
SELECT cue_id, event_id, kind, verified_text FROM (
  SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY line_no DESC) AS rn FROM (
    SELECT *, last_value(CASE WHEN review THEN event_id END IGNORE NULLS) OVER (PARTITION BY cue_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current FROM (
      SELECT *, CASE kind WHEN 'accepted' THEN verified_text = 'cue ' || cue_id WHEN 'corrected' THEN trim(verified_text) <> ''
                WHEN 'uncertain' THEN verified_text = '' ELSE FALSE END AS review FROM journal) a
    WHERE review OR kind = 'undo') b
  WHERE review OR undo_id = current) c WHERE rn = 1 AND review"""


@query("x5_review_state_stream", _ACTIVE, ("journal",))
def x5(spark, sf):
    events = v.journal(spark, sf)
    ocr = F.concat(F.lit("cue "), "cue_id")
    checked = events.withColumn("review_ok", journal.valid_review(F.col("kind"), F.col("verified_text"), ocr)).join(
        _events(spark, sf).select("event_id", "ts"), "event_id").select(
        "cue_id", "line_no", "event_id", "kind", "verified_text", "undo_id", "review_ok", "ts")
    out = in_steps(spark, checked, _halves(), lambda s: jobs.review_state(s.drop("ts")), "update")
    last = out.where("not late").groupBy("cue_id").agg(F.max_by(F.struct("event_id", "kind", "verified_text"), "batch_id").alias("s"))
    return last.where("s.event_id >= 0").select("cue_id", "s.*")


@query("x6_job_lifecycle", """
SELECT id, max(seq) AS seq, arg_max(status, seq) AS status FROM jobs GROUP BY id""", ("jobs",))
def x6(spark, sf):
    updates = spark.sql(_JOB.replace("FROM events", "FROM {e}"), e=_events(spark, sf)).select("id", "seq", "status", "phase", F.col("updated_at").alias("ts"))
    out = in_steps(spark, updates, _halves(), lambda s: jobs.job_lifecycle(s.drop("ts")), "update")
    return out.groupBy("id").agg(F.max_by(F.struct("seq", "status"), F.struct("seq", "batch_id")).alias("s")).select("id", "s.*")


@query("x7_run_monitor", """
SELECT name, blocks, low_conf, round_even(low_conf * CAST(100.0 AS DOUBLE) / blocks, 1) AS low_pct,
       concat_ws(',', CASE WHEN round_even(low_conf * CAST(100.0 AS DOUBLE) / blocks, 1) > 40.0 THEN 'low_confidence' END,
                 CASE WHEN speech_seconds < 30.0 OR (blocks <= 3 AND speech_seconds < 60.0) THEN 'no_subtitles' END,
                 CASE WHEN scanned_seconds >= 60 AND blocks / (scanned_seconds / 60) < 4 AND low_conf * 2 > blocks THEN 'low_yield' END) AS alarms FROM run_stats""", ("run_stats",))
def x7(spark, sf):
    stats = _stats(spark, sf).select("name", "blocks", "low_conf", "speech_seconds", "scanned_seconds", "video_id")
    return in_steps(spark, stats, [F.col("video_id") % 2 == 0, F.col("video_id") % 2 == 1], jobs.run_monitor).drop("batch_id")


_WINDOWS = "SELECT epoch_ms({start}) AS start_ms, event_type AS kind, count(*) AS runs, count(*) FILTER (value < 20) AS low_runs FROM {src} GROUP BY 1, 2"


def _final_windows(spark, sf, size, slide=None):
    runs = _events(spark, sf).select("ts", F.col("event_type").alias("kind"), (F.col("value") < 20).alias("low"))
    out = in_steps(spark, runs, _halves(), lambda s: jobs.run_windows(s, "ts", "1 hour", size, slide), "update")
    last = out.groupBy("w", "kind").agg(F.max_by(F.struct("runs", "low_runs"), "batch_id").alias("s"))
    return last.select(F.unix_millis("w.start").alias("start_ms"), "kind", "s.*")


@query("x8_run_windows", _WINDOWS.format(start="date_trunc('day', ts)", src="events"))
def x8(spark, sf):
    return _final_windows(spark, sf, "1 day")


@query("x8_sliding_windows", _WINDOWS.format(start="s", src="(SELECT *, date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS s FROM events, (SELECT unnest([0, 1]) AS k) d) e"))
def x8_sliding(spark, sf):
    return _final_windows(spark, sf, "2 days", "1 day")


@query("x8_cue_sessions", """
SELECT episode_id, min(start_ms) AS start_ms, count(*) AS cues FROM (
  SELECT *, sum(opens) OVER (PARTITION BY episode_id ORDER BY start_ms, cue_index ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN start_ms - lag(start_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, cue_index) <= 4000 THEN 0 ELSE 1 END AS opens FROM cues_ref) a) b
GROUP BY episode_id, g""", ("cues_ref",))
def x8_sessions(spark, sf):
    cues = v.cues_ref(spark, sf).select("episode_id", F.timestamp_millis("start_ms").alias("ts"))
    # everything arrives in one step: the cues of an episode are not in table order
    out = in_steps(spark, cues, [F.lit(True)], lambda s: jobs.cue_sessions(s, "ts", "1 hour", "4 seconds"), "complete")
    return out.select("episode_id", F.unix_millis("w.start").alias("start_ms"), "cues")
