"""Readers, run on file contents that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.plans import views as v
from cuespan.plans.registry import query
from cuespan.session import cut_lineage
from cuespan.sources import records, subtitles, writers

def _files(spark, sf, sep=",", header=""):
    """One subtitle file per document, every seventh block without text and every
    eleventh with a broken stamp."""
    cues = v.cues_ref(spark, sf)
    blocks = writers.srt_blocks(cues)
    text = F.col("value")
    broken = (F.when(F.col("cue_index") % 7 == 3, F.regexp_replace(text, r"\n[^\n]*\n$", "\n"))
              .when(F.col("cue_index") % 11 == 5, F.regexp_replace(text, "-->", "->")).otherwise(text))
    # the cues of one file come from one document
    files = blocks.withColumn("value", broken).groupBy("episode_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("cue_index", "value"))), lambda x: x["value"]), "\n").alias("value"))
    value = F.concat(F.lit(header), F.regexp_replace("value", r"(\d\d:\d\d:\d\d),(\d\d\d)", "$1" + sep + "$2"))
    return files.select(F.concat(F.lit("ep"), "episode_id").alias("file"), value.alias("value"))


@query("s1_read_srt", """
SELECT file, cue_index, start_ms, end_ms, text FROM (
  SELECT 'ep' || episode_id AS file, cue_index AS pos, row_number() OVER (PARTITION BY episode_id ORDER BY cue_index) AS cue_index, start_ms, end_ms, text FROM cues_ref) t
WHERE pos % 7 <> 3 AND pos % 11 <> 5""", ("cues_ref",))
def s1(spark, sf):
    return subtitles.parse_srt(_files(spark, sf), "strict")[0]


@query("s1_strict_rejects", """
SELECT CASE WHEN cue_index % 7 = 3 THEN 'missing_text' ELSE 'bad_stamp' END AS problem, count(*) AS n FROM cues_ref
WHERE cue_index % 7 = 3 OR cue_index % 11 = 5 GROUP BY 1""", ("cues_ref",))
def s1_rejects(spark, sf):
    return subtitles.parse_srt(_files(spark, sf), "strict")[1].groupBy("problem").agg(F.count("*").alias("n"))


@query("s1_fail_fast", """
SELECT 'ep' || episode_id AS file, row_number() OVER (PARTITION BY episode_id ORDER BY cue_index) - 1 AS cue_index, start_ms, end_ms,
       trim(regexp_replace(text, '\\s+$', '')) AS text
FROM cues_ref c WHERE NOT EXISTS (SELECT 1 FROM cues_ref b WHERE b.episode_id = c.episode_id AND (b.cue_index % 7 = 3 OR b.cue_index % 11 = 5))""", ("cues_ref",))
def s1_fail_fast(spark, sf):
    return subtitles.parse_srt(_files(spark, sf), "fail_fast")[0]


_LOOSE = """
SELECT 'ep' || episode_id AS file, row_number() OVER (PARTITION BY episode_id ORDER BY cue_index) - 1 AS cue_index, start_ms, end_ms, text
FROM cues_ref WHERE cue_index % 7 <> 3 AND cue_index % 11 <> 5"""


@query("s1_token_edge", _LOOSE, ("cues_ref",))
def s1_token_edge(spark, sf):
    return subtitles.parse_srt(_files(spark, sf, sep="."), "token_edge")[0]


@query("s1_lenient")
def s1_lenient(spark, sf):
    return subtitles.parse_srt(_files(spark, sf, sep="."), "lenient")[0]


@query("s2_read_vtt")
def s2(spark, sf):
    return subtitles.parse_vtt(_files(spark, sf, sep=".", header="WEBVTT\n\nNOTE made\nfrom text\n\n"))


@query("s3_read_review_pack", """
SELECT 'ep' || episode_id AS pack, pos AS cue_index, CASE WHEN pos % 5 = 4 THEN 'differs_from_srt' END AS problem, pos % 3 <> 0 AS crop_valid
FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY cue_index) - 1 AS pos FROM cues_ref WHERE cue_index % 7 <> 3 AND cue_index % 11 <> 5) t""", ("cues_ref",))
def s3(spark, sf):
    # stored once: the manifest and the files are compared, and both come from these cues
    srt = cut_lineage(subtitles.parse_srt(_files(spark, sf, sep="."), "token_edge")[0].withColumnRenamed("file", "pack"))
    job = F.md5("pack")
    manifest = srt.select(
        "pack", "cue_index", job.alias("job_id"), F.concat(job, F.lit("-cue-"), F.lpad(F.col("cue_index").cast("string"), 6, "0")).alias("cue_id"),
        "start_ms", "end_ms", F.when(F.col("cue_index") % 5 == 4, "edited").otherwise(F.col("text")).alias("text"),
        F.when(F.col("cue_index") % 3 == 0, "merged").otherwise("exact_original_ocr_segment_needs_visual_confirmation").alias("mapping_status"),
        F.lit("available_needs_visual_confirmation").alias("crop_status"), F.sha2("text", 256).alias("crop_sha"),
        F.lit(None).cast("bigint").alias("raw_end_ms"), F.lit(None).cast("double").alias("clamp_delta_ms"))
    return records.check_pack(manifest, srt, ["pack"]).drop("cue_id")


def _event_lines(spark, sf, files=50):
    e = v.table(spark, sf, "events")
    body = F.to_json(F.struct(
        F.lit(1).alias("schema_version"), F.when(F.col("event_type") == "click", "undo").otherwise("review").alias("event_type"),
        F.md5(F.col("event_id").cast("string")).alias("event_id"), F.md5(F.col("user_id").cast("string")).alias("job_id"),
        F.col("user_id").cast("string").alias("cue_id"), F.sha2("props", 256).alias("manifest_sha256"), F.sha2("props", 256).alias("srt_sha256"),
        F.sha2("props", 256).alias("crop_sha256_local"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.lit("local_user").alias("reviewer"),
        F.when(F.col("event_type") != "click", "corrected").alias("status"), F.when(F.col("event_type") != "click", F.when(F.col("value") < 5, " ").otherwise("text")).alias("verified_source_text"),
        F.when(F.col("event_type") == "click", F.md5(F.lit("x"))).alias("undo_event_id")))
    line = F.when(F.col("event_id") % 40 == 7, F.expr("left(b, length(b) - 3)")).when(F.col("event_id") % 40 == 9, F.lit("[1]")).otherwise(F.col("b"))
    return e.withColumn("b", body).select(F.concat(F.lit("f"), F.col("user_id") % files).alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))


@query("s4_read_journal", """
SELECT 'f' || user_id % 50 AS file, event_id AS line_no, CASE WHEN event_id % 40 IN (7, 9) THEN 'corrupt'
       WHEN event_type <> 'click' AND value < 5 THEN 'body' END AS problem FROM events""")
def s4(spark, sf):
    good, bad = records.parse_journal(_event_lines(spark, sf), "review")
    return good.withColumn("problem", records.review_event_problem()).select("file", "line_no", "problem").unionByName(bad)


@query("s4_strict_journal", """
SELECT 'f' || user_id % 50 AS file, count(*) AS n FROM events e WHERE user_id % 50 NOT IN (SELECT user_id % 50 FROM events WHERE event_id % 40 IN (7, 9)) GROUP BY 1""")
def s4_strict(spark, sf):
    return records.parse_journal(_event_lines(spark, sf), "memory")[0].groupBy("file").agg(F.count("*").alias("n"))


@query("s4_strict_file_per_user", """
SELECT 'f' || user_id % 100000000 AS file, event_id AS line_no, CASE WHEN event_type = 'click' THEN 'undo' ELSE 'review' END AS event_type FROM events e
WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id % 100000000 = e.user_id % 100000000 AND b.event_id % 40 IN (7, 9))""")
def s4_strict_users(spark, sf):
    """A file for each user, so that files without a bad line are there too."""
    return records.parse_journal(_event_lines(spark, sf, 100_000_000), "memory")[0].select("file", "line_no", "event_type")


@query("s5_read_verified_dataset", """
SELECT doc_id AS line_no, CASE WHEN n_chars % 13 = 0 THEN 'keys' WHEN n_chars % 11 = 0 THEN 'interval' WHEN n_chars % 7 = 0 THEN 'confidence' END AS problem FROM documents""")
def s5(spark, sf):
    d = v.table(spark, sf, "documents")
    row = F.struct(
        F.lit(1).alias("schema_version"), F.concat(F.lit("c"), "doc_id").alias("cue_id"), F.col("text").alias("source_text_verified"), F.lit("crops/a.jpg").alias("crop_path"),
        F.sha2("text", 256).alias("crop_sha256_local"), F.col("doc_id").alias("start_ms"), (F.col("doc_id") + F.when(F.col("n_chars") % 11 == 0, 0).otherwise(900)).alias("end_ms"),
        F.when(F.col("n_chars") % 7 == 0, 1.5).otherwise(0.5).alias("ocr_confidence"), F.lit("e").alias("review_event_id"), F.lit("2024-01-01T00:00:00Z").alias("reviewed_at"))
    line = F.when(F.col("n_chars") % 13 == 0, F.regexp_replace(F.to_json(row), '"crop_path"', '"crop"')).otherwise(F.to_json(row))
    lines = d.select(F.lit("manifest.jsonl").alias("file"), F.col("doc_id").alias("line_no"), line.alias("line"))
    checked = records.check_verified(records.json_lines(lines, records.VERIFIED, records.VERIFIED_KEYS))
    return checked.select("line_no", "problem")


@query("s6_read_metadata", """
SELECT CAST(doc_id AS VARCHAR) AS cue_id, CASE WHEN n_chars % 13 = 0 THEN 'license' WHEN n_chars % 11 = 0 THEN 'evidence_path' WHEN n_chars % 7 = 0 THEN 'human_review' END AS problem,
       '["' || source || '","' || lang || '"]' AS group_key FROM documents""")
def s6(spark, sf):
    n = F.col("n_chars")
    rec = v.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("cue_id"), F.col("source").alias("source_id"), F.upper("lang").alias("episode_id"), F.struct(
            F.when(n % 13 == 0, "odd").otherwise("cleared").alias("status"), F.lit("id").alias("identifier"),
            F.when(n % 11 == 0, "../up.txt").otherwise("rights/a.txt").alias("evidence_path"), F.sha2("source", 256).alias("evidence_sha256"),
            F.struct(F.lit("reviewed").alias("status"), F.lit("me").alias("reviewer"), F.when(n % 7 == 0, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00+03:00").alias("reviewed_at")).alias("human_review")).alias("license"))
    return records.check_metadata(rec, ["cleared", "pending"]).select("cue_id", "problem", "group_key")


@query("s7_read_manifests", """
SELECT (SELECT count(*) FROM (SELECT lang, source FROM documents GROUP BY 1, 2 HAVING count(*) > 1) r) AS repeated,
       (SELECT count(*) FROM (SELECT DISTINCT lang, source FROM documents) r) AS records, (SELECT count(DISTINCT lang) FROM documents) AS languages,
       (SELECT count(*) FROM (SELECT lang FROM documents GROUP BY 1 HAVING count(DISTINCT n_chars % 2) > 1) r) AS engines_with_many_profiles,
       (SELECT count(DISTINCT lang) FROM documents) AS engines""")
def s7(spark, sf):
    rec = v.table(spark, sf, "documents").select(F.col("lang").alias("engine_id"), F.col("source").alias("group_key"), F.upper("lang").alias("language"), (F.col("n_chars") % 2).alias("model"))
    return records.manifest_checks(rec, ["engine_id", "group_key"], ["model"])


@query("s8_read_stats", """
SELECT 'run' || doc_id AS name, CASE WHEN doc_id % 5 <> 0 THEN n_chars % 90 END AS blocks, CASE WHEN doc_id % 7 <> 0 THEN n_chars % 40 END AS low_conf,
       doc_id % 3 = 0 AS no_subtitles, doc_id % 5 = 0 AS old_format FROM documents""")
def s8(spark, sf):
    d = v.table(spark, sf, "documents")
    doc = F.to_json(F.struct(
        F.when(F.col("doc_id") % 5 != 0, F.col("n_chars") % 90).alias("blocks"), F.when(F.col("doc_id") % 7 == 0, F.lit("many")).otherwise((F.col("n_chars") % 40).cast("string")).alias("low_conf"),
        F.lit(0.75).alias("conf_thr"), (F.col("doc_id") % 3 == 0).alias("altyazisiz_rip_muhtemel")))
    value = F.regexp_replace(doc, r'"low_conf":"(\d+)"', '"low_conf":$1')
    files = d.select(F.concat(F.lit("/runs/run"), "doc_id", F.lit(".stats.json")).alias("file"), value.alias("value"))
    return records.stats_rows(files).select("name", "blocks", "low_conf", "no_subtitles", "old_format")


@query("s9_read_block_dump", """
SELECT 'd' || video_id AS file, CASE WHEN conf < 0.2 THEN 'ekran' ELSE 'ana' END AS kaynak, count(*) AS n, max(length(text)) AS longest FROM blocks GROUP BY 1, 2""", ("blocks",))
def s9(spark, sf):
    b = v.blocks(spark, sf).select("video_id", F.struct(F.col("block_no").alias("index"), F.lit("0").alias("start"), F.lit("0").alias("end"), F.col("text").alias("metin"),
                                                        "conf", F.when(F.col("conf") < 0.2, "ekran").otherwise("ana").alias("kaynak")).alias("b"))
    # a dump is one document's blocks
    files = b.groupBy(F.concat(F.lit("d"), "video_id").alias("file")).agg(F.to_json(F.collect_list("b")).alias("value"))
    return records.dump_rows(files).groupBy("file", "kaynak").agg(F.count("*").alias("n"), F.max(F.length("metin")).alias("longest"))


@query("s11_read_seed", """
SELECT event_id AS line_no, CASE WHEN event_id % 17 = 0 THEN 'fixed_state' WHEN event_type = 'error' AND value < 50 THEN 'action' WHEN rn > 1 THEN 'repeated' END AS problem
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(floor(value) AS BIGINT) ORDER BY event_id) AS rn FROM events) t""")
def s11(spark, sf):
    e = v.table(spark, sf, "events")
    row = F.struct(
        F.lit("seed").alias("schema"), F.lit(1).alias("version"), F.lit("a.jpg").alias("image"), F.sha2("props", 256).alias("image_sha256"), F.concat(F.lit("s"), "user_id").alias("episode_key"),
        F.struct(F.length("event_type").alias("size"), F.sha1("event_type").alias("sha1_first_1mb")).alias("video_identity"), F.floor("value").alias("cue_start_ms"), (F.floor("value") + 900).alias("cue_end_ms"),
        F.lit("old").alias("observed_srt_text"), F.when((F.col("event_type") == "error") & (F.col("value") < 50), " ").otherwise("new").alias("target_text"),
        F.lit("assistant_visual_review").alias("label_source"), F.lit("replace_text").alias("action"), (F.col("event_id") % 17 == 0).alias("training_eligible"),
        F.lit("pending").alias("user_confirmation_status"), F.lit("not_verified").alias("rights_status"), F.lit("candidate_needs_human_review").alias("dataset_status"))
    lines = e.select(F.lit("seed").alias("file"), F.col("event_id").alias("line_no"), F.to_json(row).alias("line"))
    return records.check_seed(records.json_lines(lines, records.SEED, records.SEED_KEYS)).select("line_no", "problem")
