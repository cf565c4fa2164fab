"""Live forms of the journal, contribution, job and board logic.

Each function takes a streaming DataFrame and returns one; custom state is kept
per key by ``applyInPandasWithState`` and leaves by time-out or is bounded in size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuespan import constants as K
from cuespan.operators.board import low_percent
from cuespan.operators.contributions import judge_calls

DAY_MS = 86_400_000


def _ordered(rows: Iterator[pd.DataFrame], order: str):
    """The rows of one key in one micro-batch; the trigger bounds their number."""
    frames = list(rows)
    if not frames:
        return iter(())
    return pd.concat(frames, ignore_index=True).sort_values(order, kind="stable").itertuples(index=False)


def contribution_ingest(calls: DataFrame, retention_days: int = 90) -> DataFrame:
    """``submission_id, seq, token_hash, payload`` → status per call.

    The first payload of an id wins; the same token and payload again are a repeat,
    anything else is a conflict. Ids are forgotten after the retention time.
    """
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, out = (tuple(state.get) if state.exists else None), []
        for row in _ordered(rows, "seq"):
            said = (str(row.token_hash), row.payload)
            if known is None:
                known, status = said, "accepted"
                state.update(said)
            else:
                status = "already_received" if said == known else "conflict"
            out.append((key[0], int(row.seq), status))
        state.setTimeoutDuration(retention_days * DAY_MS)
        yield pd.DataFrame(out, columns=["submission_id", "seq", "status"])

    return calls.groupBy("submission_id").applyInPandasWithState(
        step, "submission_id string, seq bigint, status string", "token_hash string, payload string",
        "append", GroupStateTimeout.ProcessingTimeTimeout)


def contribution_calls(calls: DataFrame, retention_days: int = 90) -> DataFrame:
    """``seq, token_hash, payload`` and the consents of each call → status per call.

    Schema, key and consents are judged by columns first; only calls that pass
    reach the state of their id, so a bad call cannot make a good one a conflict.
    """
    judged = judge_calls(calls, retention_days).withColumn("submission_id", F.get_json_object("payload", "$.submission_id"))
    refused = judged.where("refusal IS NOT NULL").select("submission_id", F.col("seq").cast("bigint").alias("seq"), F.col("refusal").alias("status"))
    passed = judged.where("refusal IS NULL").select("submission_id", "seq", "token_hash", F.col("canonical").alias("payload"))
    return refused.unionByName(contribution_ingest(passed, retention_days))


def drop_repeats(calls: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """Exact repeats within the watermark, without custom state."""
    return calls.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def rate_limit(calls: DataFrame) -> DataFrame:
    """``token_hash, seq, at_ms`` → allowed or not, 60 accepted calls an hour.

    Rejected calls do not count, so the state is the list of accepted times, at
    most sixty per token.
    """
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = [int(t) for t in state.get[0].split(",") if t] if state.exists else []
        out = []
        for row in _ordered(rows, "seq"):
            times = [t for t in times if row.at_ms - t < K.RATE_WINDOW_S * 1000]
            allowed = len(times) < K.RATE_LIMIT
            if allowed:
                times.append(int(row.at_ms))
            out.append((key[0], int(row.seq), allowed))
        state.update((",".join(map(str, times)),))
        yield pd.DataFrame(out, columns=["token_hash", "seq", "allowed"])

    return calls.groupBy("token_hash").applyInPandasWithState(
        step, "token_hash bigint, seq bigint, allowed boolean", "accepted string", "append", GroupStateTimeout.NoTimeout)


def token_validity(calls: DataFrame, tokens: DataFrame, ttl_days: int | None = None) -> DataFrame:
    """Stream-static join: calls with ``valid``."""
    from cuespan.operators.contributions import token_valid
    return token_valid(calls.join(tokens, "token_hash", "left"), F.col("ts"), ttl_days)


def review_state(events: DataFrame) -> DataFrame:
    """Current review per touched cue after each batch (update rows), and a
    ``late`` row for every line at or before one already applied.

    ``events``: ``cue_id, line_no, event_id, kind, verified_text, undo_id, review_ok``.
    An ``event_id`` of -1 means that no review is in force.
    """
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line, active, kind, text = state.get if state.exists else (-1, -1, "", "")
        late = []
        for row in _ordered(rows, "line_no"):
            if row.line_no <= line:
                late.append((key[0], int(row.line_no), -1, "", "", True))
                continue
            line = int(row.line_no)
            if row.kind == "undo":
                if active >= 0 and not pd.isna(row.undo_id) and int(row.undo_id) == active:
                    active, kind, text = -1, "", ""
            elif row.review_ok:
                active, kind, text = int(row.event_id), row.kind, row.verified_text
        state.update((line, active, kind, text))
        yield pd.DataFrame([(key[0], line, active, kind, text, False), *late],
                           columns=["cue_id", "line_no", "event_id", "kind", "verified_text", "late"])

    return events.groupBy("cue_id").applyInPandasWithState(
        step, "cue_id bigint, line_no bigint, event_id bigint, kind string, verified_text string, late boolean",
        "line_no bigint, event_id bigint, kind string, verified_text string", "update", GroupStateTimeout.NoTimeout)


def job_lifecycle(updates: DataFrame, silence_ms: int = 3_600_000) -> DataFrame:
    """``id, seq, status, phase`` → latest status per job as it changes.

    A running job without an update for ``silence_ms`` is reported interrupted; the
    state of a finished job leaves after the same time.
    """
    columns = ["id", "seq", "status", "phase", "error_code"]

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seq, status, _ = state.get
            state.remove()
            if status == "running":
                yield pd.DataFrame([(key[0], seq, "interrupted", "complete", "server_restart")], columns=columns)
            return
        seq, status, phase = state.get if state.exists else (-1, "", "")
        for row in _ordered(rows, "seq"):
            if row.seq > seq:
                seq, status, phase = int(row.seq), row.status, row.phase
        state.update((seq, status, phase))
        state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame([(key[0], seq, status, phase, "")], columns=columns)

    return updates.groupBy("id").applyInPandasWithState(
        step, "id string, seq bigint, status string, phase string, error_code string",
        "seq bigint, status string, phase string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def run_monitor(stats: DataFrame) -> DataFrame:
    """Board rows and alarms of arriving run statistics."""
    from cuespan.operators.filters import low_yield, no_subtitle_suspect
    c = F.col
    pct = low_percent(c("blocks"), c("low_conf"))
    alarms: list[tuple[Column, str]] = [
        (F.coalesce(pct > K.BOARD_LOW_PERCENT, F.lit(False)), "low_confidence"),
        (no_subtitle_suspect(c("blocks"), c("speech_seconds")), "no_subtitles"),
        (low_yield(c("blocks"), c("low_conf"), c("scanned_seconds")), "low_yield")]
    return stats.select("name", "blocks", "low_conf", pct.alias("low_pct"), F.array_join(F.array_compact(F.array(*[
        F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in alarms])), ",").alias("alarms"))


def run_windows(runs: DataFrame, time: str, delay: str, size: str, slide: str | None = None) -> DataFrame:
    """Runs and low-confidence share per tumbling or sliding window."""
    at = F.window(time, size, slide) if slide else F.window(time, size)
    return runs.withWatermark(time, delay).groupBy(at.alias("w"), "kind").agg(
        F.count("*").alias("runs"), F.count_if("low").alias("low_runs"))


def cue_sessions(cues: DataFrame, time: str, delay: str, gap: str = "1200 milliseconds") -> DataFrame:
    """Bursts of cues of one episode."""
    return cues.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), "episode_id").agg(
        F.count("*").alias("cues"))
