"""Run summaries, the quality board and job history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions.ordered import exact_quantile, total_rank
from cuespan.operators.align import first_per_key


def run_summary(blocks: DataFrame, fps: float, keys: Sequence[str] = ("video_id",),
                conf_limit: float = K.LOW_CONF, kinds: str | None = None) -> DataFrame:
    """Counts and rates of one run; ``kinds`` names a class column to count."""
    keys, fps = list(keys), F.lit(float(fps))
    secs = F.col("end_f") - F.col("start_f") + 1
    out = blocks.groupBy(*keys).agg(
        F.count("*").alias("blocks"), F.count_if(F.col("conf") < conf_limit).alias("low_conf"),
        (F.sum(secs) / fps).alias("speech_seconds"), F.avg("conf").alias("mean_conf"),
        (F.sum(secs) / fps / F.count("*")).alias("mean_seconds"), ((F.max("end_f") + 1) / fps).alias("scanned_seconds"))
    out = out.withColumn("blocks_per_minute", F.col("blocks") / (F.col("scanned_seconds") / 60))
    if kinds:
        # one entry per class of a closed list
        counts = blocks.where(F.col(kinds).isNotNull()).groupBy(*keys, kinds).agg(F.count("*").alias("n"))
        maps = counts.groupBy(*keys).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(kinds, "n")))).alias("classes"))
        out = out.join(maps, keys, "left")
    return out


def low_percent(blocks: Column, low: Column) -> Column:
    return F.when(blocks > 0, F.bround(low * 100.0 / blocks, 1))


def quality_board(stats: DataFrame) -> DataFrame:
    """Rows of the board: share of low confidence and a flag above forty percent."""
    pct = low_percent(F.col("blocks"), F.col("low_conf"))
    return (stats.withColumn("low_pct", pct)
            .withColumn("flagged", F.coalesce(F.col("low_pct") > K.BOARD_LOW_PERCENT, F.lit(False))))


def board_totals(board: DataFrame) -> DataFrame:
    return board.agg(
        F.count("*").alias("episodes"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"),
        F.bround(F.avg("low_pct"), 1).alias("mean_low_pct"), F.count_if("flagged").alias("to_review"),
        F.count_if("no_subtitles").alias("suspected_without_subtitles"))


def board_order(board: DataFrame) -> DataFrame:
    """Place of each video in the display: flagged first, then by share, then by name."""
    return total_rank(board, [F.col("flagged").desc(), F.col("low_pct").desc_nulls_last(), F.col("name").asc()], "position")


def stage_timing(stages: DataFrame, stage: str = "stage", seconds: str = "seconds") -> DataFrame:
    """Exact median per stage; a null duration means the stage did not run.
    Stages overlap in time, so they are never added up."""
    counts = stages.groupBy(stage).agg(F.count("*").alias("runs"), F.count(seconds).alias("ran"), F.max(seconds).alias("longest"))
    middle = exact_quantile(stages, [stage], seconds, 0.5, "median").withColumnRenamed(stage, "_stage")
    return (counts.join(middle, F.col(stage).eqNullSafe(F.col("_stage")))
            .select(stage, "runs", "ran", "median", "longest"))


def log_level(line: Column) -> Column:
    t = F.trim(line)
    return (F.when(t.startswith("[auto]"), "auto").when(t.startswith("[!]"), "uyari")
            .when(t.contains("SRT yazildi") | t.startswith("[ass]"), "tamam")
            .when(t.startswith("Traceback") | t.contains("HATA") | t.startswith("[ui-hata]"), "hata")
            .otherwise("bilgi"))


JOB_STATUSES = ["running", "succeeded", "failed", "cancelled", "interrupted"]
JOB_PHASES = ["setup", "process_start", "child_running", "child_exit", "complete"]
JOB_MODES = ["gpu_default", "cpu"]
JOB_ERRORS = ["setup_failed", "process_start_failed", "worker_failed", "child_nonzero", "missing_srt",
              "cancelled", "server_restart"]


def clean_jobs(jobs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Keep well-formed, recent records; odd optional values become null."""
    c = F.col
    ok = (c("id").rlike(r"^run-[a-f0-9]{32}-[0-9]{1,12}$") & c("queue_id").rlike(r"^is-[0-9]{1,12}$")
          & c("status").isin(JOB_STATUSES) & c("phase").isin(JOB_PHASES) & c("mode").isin(JOB_MODES)
          & c("started_at").isNotNull() & (c("updated_at") >= now - F.make_dt_interval(days=F.lit(days))))
    return jobs.where(ok).withColumns({
        "return_code": F.when(c("return_code").between(-(2 ** 31), 2 ** 32 - 1), c("return_code")),
        "duration_seconds": F.when(c("duration_seconds").between(0, 7 * 24 * 3600), F.bround(c("duration_seconds"), 1)),
        "error_code": F.when(c("error_code").isin(JOB_ERRORS), c("error_code"))})


def recent_jobs(updates: DataFrame, limit: int = 20) -> DataFrame:
    """Latest record per job, newest first; ``updates`` has ``seq`` as its order."""
    latest = updates.groupBy("id").agg(F.max_by(F.struct(*updates.columns), "seq").alias("r")).select("r.*")
    return latest.orderBy(F.col("seq").desc()).limit(limit)


def natural_key(name: Column) -> Column:
    """Sort key that compares digit runs as numbers."""
    pieces = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def natural_order(files: DataFrame, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """Place of each file when runs of digits count as numbers."""
    return total_rank(files, [natural_key(F.col(name)).asc(), *[F.col(t).asc() for t in ties]], "position")


def skip_processed(inputs: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    return inputs if force else inputs.join(done.select("name", "size"), ["name", "size"], "left_anti")


def positional_conf(cues: DataFrame, dump: DataFrame, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Attach confidences by position, only where both sides have as many rows.

    Both hold ``keys, ordinal``; ``dump`` also ``conf``.
    """
    keys = list(keys)
    n_cues = cues.groupBy(*keys).agg(F.count("*").alias("_n"))
    n_dump = dump.groupBy(*keys).agg(F.count("*").alias("_m"))
    fits = n_cues.join(n_dump, keys, "left").select(*keys, F.coalesce(F.col("_n") == F.col("_m"), F.lit(False)).alias("fits"))
    return (cues.join(fits, keys).join(dump.select(*keys, "ordinal", F.col("conf").alias("_conf")), [*keys, "ordinal"], "left")
            .withColumn("conf", F.when(F.col("fits"), F.col("_conf"))).drop("_conf"))


def evidence_match(blocks: DataFrame, crops: DataFrame, tolerance_ms: int = 800) -> DataFrame:
    """Unique crop with the same video, the same text and nearly the same times.

    Both hold ``size, sha1, text, start_ms, end_ms``; blocks ``block_no``, crops ``cue_id``.
    """
    from cuespan.operators.intervals import interval_join
    keys = ["size", "sha1", "text"]
    b = blocks.select(*keys, "block_no", F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"),
                      (F.col("start_ms") - tolerance_ms).alias("b_from"), (F.col("start_ms") + tolerance_ms + 1).alias("b_to"))
    c = crops.select(*keys, "cue_id", F.col("start_ms").alias("c_start"), F.col("end_ms").alias("c_end"),
                     (F.col("start_ms") + 1).alias("c_to"))
    near = interval_join(b, c, keys, ("b_from", "b_to"), ("c_start", "c_to"), 2_000).where(
        F.abs(F.col("b_end") - F.col("c_end")) <= tolerance_ms)
    return near.groupBy("size", "sha1", "block_no").agg(
        F.count("*").alias("n"), F.min("cue_id").alias("cue_id")).where("n = 1").drop("n")


def first_jobs(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return first_per_key(df, keys, [F.col("seq").desc()], n)
