"""JSON sources with closed schemas and the checks that come with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions import text as tx
from cuespan.functions.keys import group_key
from cuespan.operators.contributions import zoned_timestamp
from cuespan.sources.lines import numbered_lines

HEX64, HEX32, HEX40 = "^[0-9a-f]{64}$", "^[0-9a-f]{32}$", "^[0-9a-f]{40}$"


def first_problem(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that does not hold; an undefined rule fails."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules], F.lit(None).cast("string"))


def json_lines(lines: DataFrame, schema: str, allowed: list[str] | None = None) -> DataFrame:
    """``file, line_no, line`` → row struct ``r`` and ``problem`` per line.

    A line that is no JSON object of the schema or has other keys than ``allowed``
    keeps its number and its problem.
    """
    rows = lines.where(tx.strip_ws(F.col("line")) != "").withColumn(
        "r", F.from_json("line", schema + ", _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    keys = F.json_object_keys("line")
    rules = [(F.col("r._corrupt_record").isNull() & keys.isNotNull(), "corrupt")]
    if allowed is not None:
        names = F.array(*map(F.lit, allowed))
        rules.append(((F.size(F.array_except(keys, names)) == 0) & (F.size(F.array_except(names, keys)) == 0), "keys"))
    return rows.withColumn("problem", first_problem(*rules)).select("file", "line_no", "r", "problem")


JOURNALS = {
    "review": "schema_version INT, event_type STRING, event_id STRING, job_id STRING, cue_id STRING, manifest_sha256 STRING, "
              "srt_sha256 STRING, crop_sha256_local STRING, created_at STRING, reviewer STRING, status STRING, "
              "verified_source_text STRING, undo_event_id STRING",
    "memory": "event_type STRING, event_id STRING, scope_id STRING, undo_event_id STRING, verified_source_text STRING, "
              "approved_translation STRING, source_term STRING, target_term STRING, decision_event_id STRING, created_at STRING",
    "translation": "event_type STRING, event_id STRING, proposal_id STRING, request_id STRING, job_id STRING, cue_id STRING, "
                   "source_review_event_id STRING, verified_source_text STRING, decision STRING, approved_translation STRING, created_at STRING",
    "rating": "event_type STRING, event_id STRING, event_sha256 STRING, previous_event_sha256 STRING, blind_candidate_id STRING, "
              "reviewer_id STRING, status STRING, dimensions MAP<STRING,INT>, issues ARRAY<STRING>, rubric_outcome STRING, "
              "exclusion_reason STRING, supersedes_event_id STRING, created_at STRING",
}
STRICT_JOURNALS = {"memory", "rating"}


def parse_journal(lines: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(events with ``line_no``, problems). In strict journals one bad line voids
    its whole file; the others only leave that line out."""
    parsed = json_lines(lines, JOURNALS[kind])
    problem = parsed.where("problem IS NOT NULL").select("file", "line_no", "problem")
    good = parsed.where("problem IS NULL").select("file", "line_no", "r.*").drop("_corrupt_record")
    if kind in STRICT_JOURNALS:
        good = good.join(problem.select("file").distinct(), "file", "left_anti")
    return good, problem


def read_journal(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    return parse_journal(numbered_lines(spark, path), kind)


def review_event_problem() -> Column:
    """Closed rules of a review journal event (columns of ``JOURNALS['review']``)."""
    c = F.col
    text_ok = (F.when(c("status") == "corrected", tx.strip_ws(c("verified_source_text")) != "")
               .when(c("status") == "uncertain", c("verified_source_text") == "").otherwise(c("verified_source_text").isNotNull()))
    body = (F.when(c("event_type") == "review", c("status").isin("accepted", "corrected", "uncertain") & text_ok
                   & (F.length("verified_source_text") <= K.MAX_REVIEW_CHARS))
            .when(c("event_type") == "undo", c("undo_event_id").rlike(HEX32)).otherwise(F.lit(False)))
    return first_problem(
        (c("schema_version") == 1, "schema_version"), (c("event_id").rlike(HEX32) & c("job_id").rlike(HEX32), "ids"),
        (c("manifest_sha256").rlike(HEX64) & c("srt_sha256").rlike(HEX64) & c("crop_sha256_local").rlike(HEX64), "hashes"),
        (c("reviewer") == "local_user", "reviewer"), (zoned_timestamp(c("created_at")).isNotNull(), "created_at"), (body, "body"))


VERIFIED = ("schema_version INT, cue_id STRING, source_text_verified STRING, crop_path STRING, crop_sha256_local STRING, "
            "start_ms BIGINT, end_ms BIGINT, ocr_confidence DOUBLE, review_event_id STRING, reviewed_at STRING")
VERIFIED_KEYS = [f.split()[0] for f in VERIFIED.split(", ")]


def check_verified(parsed: DataFrame) -> DataFrame:
    """Dataset rows with ``problem``; cue ids must be unique per file."""
    c = F.col
    rows = parsed.select("file", "line_no", "r.*", c("problem").alias("_line_problem")).drop("_corrupt_record")
    copies = rows.where("cue_id IS NOT NULL").groupBy("file", "cue_id").agg(F.min("line_no").alias("_first"))
    rows = rows.join(copies, ["file", "cue_id"], "left")
    return rows.withColumn("problem", F.coalesce("_line_problem", first_problem(
        (c("schema_version") == 1, "schema_version"), (c("cue_id") != "", "cue_id"), (c("line_no") == c("_first"), "repeated_cue"),
        (tx.strip_ws(c("source_text_verified")) != "", "text"), ((c("start_ms") >= 0) & (c("end_ms") > c("start_ms")), "interval"),
        (c("ocr_confidence").isNull() | c("ocr_confidence").between(0, 1), "confidence"),
        (c("crop_sha256_local").rlike(HEX64), "crop_hash")))).drop("_line_problem", "_first")


def read_verified_dataset(spark: SparkSession, path: str) -> DataFrame:
    return check_verified(json_lines(numbered_lines(spark, path), VERIFIED, VERIFIED_KEYS))


METADATA = ("cue_id STRING, source_id STRING, episode_id STRING, license STRUCT<status: STRING, identifier: STRING, "
            "evidence_path: STRING, evidence_sha256: STRING, human_review: STRUCT<status: STRING, reviewer: STRING, reviewed_at: STRING>>")


def check_metadata(records: DataFrame, statuses: list[str]) -> DataFrame:
    """Rights and group metadata with ``problem`` and ``group_key``."""
    c, lic = F.col, "license."
    copies = records.groupBy("cue_id").agg(F.count("*").alias("_n"))
    review = c(lic + "human_review.status")
    reviewed = (tx.strip_ws(c(lic + "human_review.reviewer")) != "") & zoned_timestamp(c(lic + "human_review.reviewed_at")).isNotNull()
    path = c(lic + "evidence_path")
    return records.join(copies, "cue_id", "left").withColumn("problem", first_problem(
        (c("cue_id") != "", "cue_id"), (c("_n") == 1, "repeated_cue"),
        ((tx.strip_ws(c("source_id")) != "") & (tx.strip_ws(c("episode_id")) != ""), "group"),
        (c(lic + "status").isin(statuses) & (tx.strip_ws(c(lic + "identifier")) != ""), "license"),
        ((path != "") & ~path.rlike(r"^/|\\|^[A-Za-z]:|(^|/)\.\.(/|$)"), "evidence_path"),
        (c(lic + "evidence_sha256").rlike(HEX64), "evidence_hash"),
        ((review == "pending") | ((review == "reviewed") & reviewed), "human_review"))).drop("_n").withColumn(
        "group_key", group_key(c("source_id"), c("episode_id")))


def read_metadata(spark: SparkSession, path: str, statuses: list[str]) -> DataFrame:
    doc = spark.read.schema(f"schema_version INT, records ARRAY<STRUCT<{METADATA}>>").json(path, multiLine=True)
    return check_metadata(doc.select(F.explode("records").alias("r")).select("r.*"), statuses)


def manifest_checks(records: DataFrame, keys: list[str], profile: list[str] | None = None) -> DataFrame:
    """One row: repeated keys, languages, engines whose profile is not constant."""
    one = F.lit(1).alias("_one")
    repeated = records.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count("*").alias("records"), one)
    out = repeated
    if "language" in records.columns:
        out = out.join(records.agg(F.count_distinct(F.lower(F.trim("language"))).alias("languages"), one), "_one")
    if profile:
        varied = records.groupBy("engine_id").agg(F.count_distinct(F.struct(*profile)).alias("n")).agg(
            F.count_if(F.col("n") > 1).alias("engines_with_many_profiles"), F.count("*").alias("engines"), one)
        out = out.join(varied, "_one")
    return out.drop("_one")


STATS = ("video STRUCT<ad: STRING, boyut: BIGINT, sha1_ilk_1MB: STRING>, fps DOUBLE, scanned_frames BIGINT, blocks BIGINT, low_conf BIGINT, "
         "conf_thr DOUBLE, speech_seconds DOUBLE, hardsub_shr STRING, altyazisiz_rip_muhtemel BOOLEAN, device STRING, ocr_mode STRING, "
         "ekran_siniflandirici MAP<STRING,BIGINT>")


def read_stats(spark: SparkSession, root: str) -> DataFrame:
    """Every run statistics file below ``root``; fields that a file lacks or has
    in another type are null."""
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.stats.json").text(root, wholetext=True))
    return stats_rows(raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), "value"))


def stats_rows(files: DataFrame) -> DataFrame:
    parsed = files.withColumn("s", F.from_json("value", STATS))
    keys = F.json_object_keys("value")
    full = F.coalesce(F.forall(F.array(*map(F.lit, ["blocks", "low_conf", "conf_thr"])), lambda k: F.array_contains(keys, k)), F.lit(False))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.stats\.json$", "")
    return parsed.select(
        "file", *(["modified"] if "modified" in files.columns else []), name.alias("name"), "s.blocks", "s.low_conf", "s.conf_thr",
        "s.speech_seconds", "s.scanned_frames", "s.fps", "s.hardsub_shr", F.coalesce("s.altyazisiz_rip_muhtemel", F.lit(False)).alias("no_subtitles"),
        "s.video", "s.device", "s.ocr_mode", (~full).alias("old_format"))


DUMP = "index BIGINT, start STRING, end STRING, metin STRING, conf DOUBLE, kaynak STRING"


def read_block_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(dialogue blocks, screen blocks) of block dumps."""
    rows = dump_rows(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))
    return rows.where("kaynak = 'ana'"), rows.where("kaynak = 'ekran'")


def dump_rows(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(F.from_json("value", f"ARRAY<STRUCT<{DUMP.replace(' BIGINT', ': BIGINT').replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE')}>>")).alias("ordinal", "b")).select(
        "file", "ordinal", "b.*")


SEED = ("schema STRING, version INT, image STRING, image_sha256 STRING, episode_key STRING, video_identity STRUCT<size: BIGINT, sha1_first_1mb: STRING>, "
        "cue_start_ms BIGINT, cue_end_ms BIGINT, observed_srt_text STRING, target_text STRING, label_source STRING, action STRING, "
        "training_eligible BOOLEAN, user_confirmation_status STRING, rights_status STRING, dataset_status STRING")
SEED_KEYS = ["schema", "version", "image", "image_sha256", "episode_key", "video_identity", "cue_start_ms", "cue_end_ms", "observed_srt_text",
             "target_text", "label_source", "action", "training_eligible", "user_confirmation_status", "rights_status", "dataset_status"]


def check_seed(parsed: DataFrame) -> DataFrame:
    """Seed rows with ``problem``: fixed states, action rules, unique cues."""
    c = F.col
    rows = parsed.select("file", "line_no", "r.*", c("problem").alias("_line_problem")).drop("_corrupt_record")
    key = F.to_json(F.struct("episode_key", "video_identity", "cue_start_ms", "cue_end_ms"))
    rows = rows.withColumn("_key", key)
    first = rows.groupBy("file", "_key").agg(F.min("line_no").alias("_first"))
    rows = rows.join(first, ["file", "_key"]).drop("_key")
    target = F.when(c("action") == "replace_text", (tx.strip_ws(c("target_text")) != "") & (F.length("target_text") <= K.MAX_REVIEW_CHARS)).when(
        c("action") == "remove_cue", c("target_text").isNull()).otherwise(F.lit(False))
    fixed = ((c("label_source") == "assistant_visual_review") & (c("user_confirmation_status") == "pending") & (c("rights_status") == "not_verified")
             & (c("dataset_status") == "candidate_needs_human_review") & (c("training_eligible") == F.lit(False)))
    return rows.withColumn("problem", F.coalesce("_line_problem", first_problem(
        (c("version") == 1, "version"), (fixed, "fixed_state"),
        ((c("video_identity.size") > 0) & c("video_identity.sha1_first_1mb").rlike(HEX40), "video_identity"),
        ((c("cue_start_ms") >= 0) & (c("cue_end_ms") > c("cue_start_ms")), "interval"),
        ((tx.strip_ws(c("observed_srt_text")) != "") & (F.length("observed_srt_text") <= K.MAX_REVIEW_CHARS), "observed_text"),
        (target, "action"), (c("image_sha256").rlike(HEX64), "image_hash"), (c("line_no") == c("_first"), "repeated")))).drop("_line_problem", "_first")


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    return check_seed(json_lines(numbered_lines(spark, path), SEED, SEED_KEYS))


def check_pack(manifest: DataFrame, srt: DataFrame, keys: list[str], job_id: str = "job_id") -> DataFrame:
    """Compare manifest cues with SRT cues by position: rows with ``problem`` and
    ``crop_valid``.

    ``manifest``: ``keys, cue_index, cue_id, job_id, start_ms, end_ms, text,
    mapping_status, crop_status, crop_sha, raw_end_ms, clamp_delta_ms``.
    """
    c = F.col
    s = srt.select(*keys, "cue_index", c("start_ms").alias("s_start"), c("end_ms").alias("s_end"), c("text").alias("s_text"))
    copies = manifest.groupBy(*keys, "cue_id").agg(F.count("*").alias("_n"))
    joined = manifest.join(copies, [*keys, "cue_id"], "left").join(s, [*keys, "cue_index"], "full_outer")
    delta = c("raw_end_ms") - c("end_ms")
    raw_ok = (c("raw_end_ms").isNull() & c("clamp_delta_ms").isNull()) | (
        (delta > 0) & (c("clamp_delta_ms") > 0) & (F.abs(c("clamp_delta_ms") - delta) <= 1.001))
    problem = first_problem(
        (c("cue_id").isNotNull(), "not_in_manifest"), (c("s_text").isNotNull(), "not_in_srt"),
        (c("cue_id").rlike(r"^[a-f0-9]{32}-cue-\d{5,}$") & c("cue_id").startswith(c(job_id)), "cue_id"), (c("_n") == 1, "repeated_cue"),
        ((c("start_ms") >= 0) & (c("end_ms") > c("start_ms")), "interval"),
        ((c("start_ms") == c("s_start")) & (c("end_ms") == c("s_end")) & (c("text") == c("s_text")), "differs_from_srt"), (raw_ok, "raw_end"))
    exact = (c("mapping_status") == "exact_original_ocr_segment_needs_visual_confirmation") & (
        c("crop_status") == "available_needs_visual_confirmation") & c("crop_sha").rlike(HEX64)
    return joined.select(*keys, "cue_index", "cue_id", problem.alias("problem"), F.coalesce(exact, F.lit(False)).alias("crop_valid"))


def read_review_pack(spark: SparkSession, root: str) -> DataFrame:
    """Check every ``*.review-pack`` folder below ``root``."""
    from cuespan.sources.subtitles import read_srt
    cue = ("cue_id: STRING, index: BIGINT, start_ms: BIGINT, end_ms: BIGINT, source_text_ocr: STRING, mapping_status: STRING, "
           "crop_status: STRING, crop_sha256_local: STRING, raw_end_ms: BIGINT, clamp_delta_ms: DOUBLE")
    pack = lambda f: F.regexp_extract(f, r"([^/]+\.review-pack)/", 1).alias("pack")
    found = spark.read.option("recursiveFileLookup", True)
    manifests = found.option("pathGlobFilter", "manifest.json").text(root, wholetext=True).select(
        pack(F.col("_metadata.file_path")), F.from_json("value", f"job_id STRING, cues ARRAY<STRUCT<{cue}>>").alias("m"))
    cues = manifests.select("pack", F.col("m.job_id").alias("job_id"), F.explode("m.cues").alias("c")).select(
        "pack", "job_id", F.col("c.index").alias("cue_index"), "c.cue_id", "c.start_ms", "c.end_ms", F.col("c.source_text_ocr").alias("text"),
        "c.mapping_status", "c.crop_status", F.col("c.crop_sha256_local").alias("crop_sha"), "c.raw_end_ms", "c.clamp_delta_ms")
    srt = read_srt(spark, root, "pack", "*.srt")[0].select(pack(F.col("file")), "cue_index", "start_ms", "end_ms", "text")
    return check_pack(cues, srt, ["pack"])


def crop_inventory(spark: SparkSession, rows: DataFrame, root: str, max_bytes: int = 8 * 1024 * 1024) -> DataFrame:
    """Rows with ``crop_problem``: the file must exist, fit and have its digest."""
    crops = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select(F.concat(F.lit("crops/"), F.element_at(F.split("path", "/"), -1)).alias("crop_path"), "length",
                     F.sha2("content", 256).alias("_digest")))
    joined = rows.join(crops, "crop_path", "left")
    return joined.withColumn("crop_problem", first_problem(
        (F.col("length").isNotNull(), "missing"), (F.col("length").between(1, max_bytes), "size"),
        (F.col("_digest") == F.col("crop_sha256_local"), "digest"))).drop("_digest")
