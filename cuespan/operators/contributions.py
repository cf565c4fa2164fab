"""Contributed metrics: validation, token validity and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import constants as K

PAYLOAD_KEYS = ["schema_version", "submission_id", "created_at", "metrics"]
_NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"
_WHOLE = r"^-?\d+$"
_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_ZONED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"


def device_class(device: Column) -> Column:
    d = F.lower(F.trim(F.coalesce(device, F.lit(""))))
    return (F.when((d == "cpu") | d.startswith("cpu "), "cpu")
            .when(d.startswith("gpu") | d.contains("cuda"), "cuda").otherwise("unknown"))


def engine_class(mode: Column) -> Column:
    m = F.lower(F.trim(F.coalesce(mode, F.lit(""))))
    return (F.when(m.startswith("easyocr") | (m == "easy"), "easyocr")
            .when(m.startswith("rapidocr") | (m == "rapid"), "rapidocr").otherwise("unknown"))


def build_payload(stats: DataFrame) -> DataFrame:
    """Privacy-minimised metrics of a run as JSON; only the listed keys leave."""
    c = F.col
    ratio = F.when(c("blocks") > 0, F.bround(c("low_conf") / c("blocks"), 4))
    metrics = F.struct(
        F.bround("duration_seconds", 1).alias("duration_seconds"), c("scanned_frames").alias("frames_scanned"),
        c("blocks").alias("cue_count"), c("low_conf").alias("low_conf_count"), device_class(c("device")).alias("device_class"),
        engine_class(c("ocr_mode")).alias("engine_class"), ratio.alias("low_conf_ratio"),
        F.bround("speech_seconds", 1).alias("speech_seconds"))
    return stats.withColumn("payload", F.to_json(F.struct(
        F.lit(1).alias("schema_version"), c("submission_id"), c("created_at"), metrics.alias("metrics"))))


def validate_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``problem``: the first broken rule of the closed schema, else null."""
    p, j, m = F.col(payload), F.col("_j"), F.col("_j.metrics")
    # parsed once; numbers and nested objects arrive as their JSON text
    df = df.withColumn("_j", F.from_json(
        p, "schema_version STRING, submission_id STRING, created_at STRING, metrics MAP<STRING,STRING>"))

    def field(name: str) -> Column:
        return F.try_element_at(m, F.lit(name))

    def quoted(names: list[str]) -> Column:
        # a JSON string would print like a number
        return p.rlike(f'"({"|".join(names)})"\\s*:\\s*"')

    def bad_number(name: str, top: float, whole: bool = False, required: bool = False) -> Column:
        raw = field(name)
        ok = raw.rlike(_WHOLE if whole else _NUMBER) & raw.try_cast("double").between(0, top)
        return ~F.coalesce(ok, F.lit(not required))

    keys, metric_keys = F.json_object_keys(p), F.map_keys(m)
    absent = lambda have, want: F.size(F.array_except(F.array(*map(F.lit, want)), have)) > 0
    extra = lambda have, want: F.size(F.array_except(have, F.array(*map(F.lit, want)))) > 0
    cer = field("cer")
    cer_keys = F.json_object_keys(cer)
    cer_bad = cer.isNotNull() & ~F.coalesce(
        ~absent(cer_keys, ["value", "reference_class"]) & ~extra(cer_keys, ["value", "reference_class"])
        & (F.get_json_object(cer, "$.reference_class") == "trusted_local_vtt")
        & F.get_json_object(cer, "$.value").try_cast("double").between(0, 10), F.lit(False))
    measures, counts = ["duration_seconds", "speech_seconds", "low_conf_ratio"], ["frames_scanned", "cue_count", "low_conf_count"]
    problem = (F.when(keys.isNull() | absent(keys, PAYLOAD_KEYS) | extra(keys, PAYLOAD_KEYS), "keys")
               .when(~F.coalesce(j["schema_version"] == "1", F.lit(False)), "schema_version")
               .when(~F.coalesce(j["submission_id"].rlike(_UUID), F.lit(False)), "submission_id")
               .when(~F.coalesce(j["created_at"].rlike(_ZONED), F.lit(False)), "created_at")
               .when(metric_keys.isNull() | extra(metric_keys, K.METRIC_KEYS), "unknown_metric")
               .when(absent(metric_keys, K.REQUIRED_METRIC_KEYS), "missing_metric")
               .when(~F.coalesce(field("device_class").isin("cuda", "cpu", "unknown")
                                 & field("engine_class").isin("easyocr", "rapidocr", "unknown"), F.lit(False)), "class")
               .when(quoted(measures) | bad_number("duration_seconds", 86400, required=True)
                     | bad_number("speech_seconds", 86400) | bad_number("low_conf_ratio", 1), "range")
               .when(quoted(counts) | bad_number("frames_scanned", 10_000_000, True, True)
                     | bad_number("cue_count", 1_000_000, True, True) | bad_number("low_conf_count", 1_000_000, True, True), "count")
               .when(field("low_conf_count").try_cast("bigint") > field("cue_count").try_cast("bigint"), "low_above_cues")
               .when(cer_bad, "cer"))
    return df.withColumn("problem", problem).drop("_j")


def judge_calls(calls: DataFrame, retention_days: int = 90, max_body: int = K.MAX_BODY_BYTES) -> DataFrame:
    """Add ``refusal``, the first reason to turn a call away before its id and
    token matter, else null; and ``canonical``, its payload in one spelling.

    ``calls`` holds payload, idempotency_key, metrics_consent, retention_policy
    and cer_consent. A call that is refused never becomes the first of its id.
    """
    c = F.col
    judged = validate_payload(calls.withColumnRenamed("problem", "_own_problem") if "problem" in calls.columns else calls)
    keys, metrics = F.json_object_keys("payload"), F.get_json_object("payload", "$.metrics")
    inner = F.json_object_keys(metrics)
    twice = (F.size(keys) > F.size(F.array_distinct(keys))) | (F.size(inner) > F.size(F.array_distinct(inner)))
    has_cer = F.coalesce(F.array_contains(inner, "cer"), F.lit(False))
    refusal = (F.when(F.coalesce(F.octet_length("payload"), F.lit(0)) > max_body, "too_large")
               .when(c("problem").isNotNull() | F.coalesce(twice, F.lit(True)), "payload_rejected")
               .when(~c("idempotency_key").eqNullSafe(F.get_json_object("payload", "$.submission_id")), "key_mismatch")
               .when(~c("metrics_consent").eqNullSafe(F.lit("v1")), "no_metrics_consent")
               .when(~c("retention_policy").eqNullSafe(F.lit(str(retention_days))), "retention_mismatch")
               .when(has_cer & ~c("cer_consent").eqNullSafe(F.lit("v1")), "no_cer_consent")
               .when(~has_cer & (F.coalesce(c("cer_consent"), F.lit("")) != ""), "unexpected_cer_consent"))
    parsed = F.from_json("payload", "schema_version STRING, submission_id STRING, created_at STRING, metrics MAP<STRING,STRING>")
    canonical = F.to_json(F.struct(parsed["schema_version"].alias("v"), parsed["submission_id"].alias("id"), parsed["created_at"].alias("at"),
                                   F.array_sort(F.map_entries(parsed["metrics"])).alias("metrics")))
    out = judged.withColumn("refusal", refusal).withColumn("canonical", F.when(F.col("refusal").isNull(), canonical)).drop("problem")
    return out.withColumnRenamed("_own_problem", "problem") if "_own_problem" in out.columns else out


def zoned_timestamp(text: Column) -> Column:
    """ISO-8601 text with a time zone, else null."""
    return F.when(text.rlike(_ZONED), F.try_to_timestamp(text))


def token_valid(tokens: DataFrame, now: Column, ttl_days: int | None = None) -> DataFrame:
    """``valid`` only when not revoked and before a readable expiry. Older tokens
    without one live ``ttl_days`` from a readable creation time."""
    expiry = zoned_timestamp(F.col("expires_at"))
    if ttl_days is not None:
        legacy = zoned_timestamp(F.col("created_at")) + F.make_dt_interval(days=F.lit(ttl_days))
        expiry = F.when(F.col("expires_at").isNull(), legacy).otherwise(expiry)
    return tokens.withColumn("valid", F.coalesce(F.col("revoked_at").isNull() & (now < expiry), F.lit(False)))


def retained(contributions: DataFrame, now: Column, days: int, retractions: DataFrame | None = None) -> DataFrame:
    """Contributions inside the retention time that nobody took back."""
    kept = contributions.where(F.col("received_at") >= now - F.make_dt_interval(days=F.lit(days)))
    if retractions is not None:
        kept = kept.join(retractions.select("submission_id", "token_hash"), ["submission_id", "token_hash"], "left_anti")
    return kept
