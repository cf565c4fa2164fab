"""Subtitle-shaped tables that Spark derives from the given tables.

Every document is an episode; its sentences, at most twelve words each, are the
cues. Nothing is dropped or cut: the cues of an episode spell out its document.
The SQL twin of each view sits next to its Spark form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuespan.plans.registry import sql_view

FPS = 24
ENGINES = ("base", "cand")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- cues --------------------------------------------------------------------
sql_view("lines", (), r"""
SELECT episode_id, CAST(pos AS BIGINT) AS cue_index, trim(line) AS text FROM (
  SELECT doc_id AS episode_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM (
    SELECT doc_id, flatten(list_transform(string_split(replace(text, '. ', '.' || chr(10)), chr(10)),
           lambda s: CASE WHEN length(s) > 160
             THEN string_split(regexp_replace(s, '((?:[^ ]+ ){12})', '\1' || chr(10), 'g'), chr(10))
             ELSE [s] END)) AS parts FROM documents) d) e
WHERE trim(line) <> ''""")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # shuffle whole documents, not their lines: later windows per episode and
    # joins on the episode reuse this partitioning
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    sentences = F.split(F.expr("replace(text, '. ', '.\n')"), "\n")
    wrap = lambda s: F.when(
        F.length(s) > 160, F.split(F.regexp_replace(s, r"((?:[^ ]+ ){12})", "$1\n"), "\n")).otherwise(F.array(s))
    return (docs.select(F.col("doc_id").alias("episode_id"),
                        F.posexplode(F.flatten(F.transform(sentences, wrap))).alias("pos", "line"))
            .select("episode_id", F.col("pos").cast("bigint").alias("cue_index"),
                    F.trim("line").alias("text"))
            .where("text <> ''"))


sql_view("cues_ref", ("lines",), """
SELECT episode_id, cue_index, text,
       CAST(coalesce(sum(1000 + 40 * length(text)) OVER before, 0) AS BIGINT) AS start_ms,
       CAST(coalesce(sum(1000 + 40 * length(text)) OVER before, 0) + 800 + 40 * length(text) AS BIGINT) AS end_ms
FROM lines WINDOW before AS (PARTITION BY episode_id ORDER BY cue_index
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")


def cues_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an episode here is one row of `documents`, so its cues fit in one task
    before = (Window.partitionBy("episode_id").orderBy("cue_index")
              .rowsBetween(Window.unboundedPreceding, -1))
    span = 1000 + 40 * F.length("text")
    start = F.coalesce(F.sum(span).over(before), F.lit(0)).cast("bigint")
    return (lines(spark, sf_dir).withColumn("start_ms", start)
            .withColumn("end_ms", F.col("start_ms") + 800 + 40 * F.length("text")))


_PRED = """
SELECT episode_id, cue_index,
       CASE WHEN length(text) % 3 = 0 THEN replace(text, 'o', '0')
            WHEN length(text) % 3 = 1 THEN replace(text, 'ü', 'u') ELSE text END AS text,
       greatest(0, start_ms + (episode_id * 7 + cue_index * 13) % 401 - 200) AS start_ms,
       end_ms + (episode_id * 5 + cue_index * 17) % 301 - 150 AS end_ms
FROM cues_ref WHERE length(text) >= 12
UNION ALL
SELECT episode_id, cue_index + 1000000 AS cue_index, 'on screen: ' || text AS text,
       start_ms + 300 AS start_ms, end_ms + 300 AS end_ms
FROM cues_ref WHERE text LIKE '%, %'"""
sql_view("cues_pred", ("cues_ref",), _PRED)


def cues_pred(spark: SparkSession, sf_dir: str, ref: DataFrame | None = None) -> DataFrame:
    """Shifted readings: flashes under 12 characters are lost, letters are
    misread, and lines with a comma also appear as screen text. ``ref`` is
    ``cues_ref``, if it is at hand."""
    c = F.col
    ref = cues_ref(spark, sf_dir) if ref is None else ref
    misread = (F.when(F.length("text") % 3 == 0, F.expr("replace(text, 'o', '0')"))
               .when(F.length("text") % 3 == 1, F.expr("replace(text, 'ü', 'u')")).otherwise(c("text")))
    reading = F.struct(
        c("cue_index"), misread.alias("text"),
        F.greatest(F.lit(0), c("start_ms") + (c("episode_id") * 7 + c("cue_index") * 13) % 401 - 200).alias("start_ms"),
        (c("end_ms") + (c("episode_id") * 5 + c("cue_index") * 17) % 301 - 150).alias("end_ms"))
    screen = F.struct(
        (c("cue_index") + 1_000_000).alias("cue_index"), F.concat(F.lit("on screen: "), "text").alias("text"),
        (c("start_ms") + 300).alias("start_ms"), (c("end_ms") + 300).alias("end_ms"))
    found = F.array_compact(F.array(
        F.when(F.length("text") >= 12, reading), F.when(c("text").contains(", "), screen)))
    return ref.select("episode_id", F.explode(found).alias("r")).select("episode_id", "r.*").select(
        "episode_id", "cue_index", "text", "start_ms", "end_ms")


_ENGINES = """
SELECT 'base' AS engine_id, episode_id, cue_index, text, start_ms, end_ms FROM cues_pred
UNION ALL
SELECT 'cand' AS engine_id, episode_id, cue_index,
       CASE WHEN cue_index % 2 = 0 THEN replace(text, '0', 'o') ELSE text END AS text,
       start_ms, end_ms FROM cues_pred"""
sql_view("engine_preds", ("cues_pred",), _ENGINES)


def engine_preds(spark: SparkSession, sf_dir: str, ref: DataFrame | None = None) -> DataFrame:
    pred = cues_pred(spark, sf_dir, ref)
    repaired = F.when(F.col("cue_index") % 2 == 0, F.expr("replace(text, '0', 'o')")).otherwise(F.col("text"))
    # one pass over the readings instead of one per engine
    return (pred.withColumn("engine_id", F.explode(F.array(*map(F.lit, ENGINES))))
            .withColumn("text", F.when(F.col("engine_id") == "cand", repaired).otherwise(F.col("text")))
            .select("engine_id", "episode_id", "cue_index", "text", "start_ms", "end_ms"))


# --- blocks ------------------------------------------------------------------
sql_view("blocks", ("lines",), """
SELECT episode_id AS video_id, cue_index AS block_no, start_f, end_f, text, conf FROM (
  SELECT episode_id, cue_index, text, 
         CAST(coalesce(sum(6 + length(text) % 29) OVER before, 0) AS BIGINT) AS start_f,
         CAST(coalesce(sum(6 + length(text) % 29) OVER before, 0) + (length(text) * 7) % 31 AS BIGINT) AS end_f,
         CAST((episode_id * 17 + cue_index * 29) % 100 AS DOUBLE) / 100 AS conf
  FROM lines WINDOW before AS (PARTITION BY episode_id ORDER BY cue_index
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) b""")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read blocks in frames at 24 per second; some last only a few frames."""
    before = (Window.partitionBy("video_id").orderBy("block_no")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(F.sum(6 + F.length("text") % 29).over(before), F.lit(0)).cast("bigint")
    return (lines(spark, sf_dir)
            .withColumnsRenamed({"episode_id": "video_id", "cue_index": "block_no"})
            .withColumn("start_f", start)
            .withColumn("end_f", F.col("start_f") + (F.length("text") * 7) % 31)
            .withColumn("conf", ((F.col("video_id") * 17 + F.col("block_no") * 29) % 100).cast("double") / 100)
            .select("video_id", "block_no", "start_f", "end_f", "text", "conf"))


# --- words -------------------------------------------------------------------
sql_view("word_counts", (), """
SELECT word, count(*) AS freq FROM (SELECT unnest(string_split(lower(replace(text, chr(10), ' ')), ' ')) AS word
                                    FROM documents) w
WHERE length(word) >= 2 GROUP BY word""")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(
        F.explode(F.split(F.lower(F.expr("replace(text, '\n', ' ')")), " ")).alias("word"))
    return words.where("length(word) >= 2").groupBy("word").agg(F.count("*").alias("freq"))


# --- journals ----------------------------------------------------------------
# The event number is the file order of the journal; it is the logical clock.
# Undo events name the latest review of their cue, or nothing at all.
sql_view("journal", (), """
SELECT event_id AS line_no, event_id, user_id AS cue_id,
       CASE event_type WHEN 'signup' THEN 'accepted' WHEN 'purchase' THEN 'corrected'
            WHEN 'view' THEN 'uncertain' WHEN 'click' THEN 'undo' ELSE 'invalid' END AS kind,
       CASE event_type WHEN 'signup' THEN CASE WHEN value < 120 THEN 'cue ' || user_id ELSE 'other' END
            WHEN 'purchase' THEN CASE WHEN value < 100 THEN 'fixed ' || event_id % 10 ELSE '  ' END
            WHEN 'view' THEN CASE WHEN value < 120 THEN '' ELSE 'x' END END AS verified_text,
       CASE WHEN event_type = 'click' THEN
            CASE WHEN value < 15 THEN -1 ELSE max(CASE WHEN event_type IN ('signup', 'purchase', 'view')
                 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END END AS undo_id,
       CASE WHEN value > 300 THEN 'old' ELSE 'm1' END AS manifest_sha, 'c' || user_id % 50 AS crop_sha
FROM events""")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuespan.functions.ordered import prefix_scan

    review = F.when(F.col("event_type").isin("signup", "purchase", "view"), F.col("event_id"))
    seen = prefix_scan(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], {"latest": ("max", review)})
    return seen.selectExpr(
        "event_id AS line_no", "event_id", "user_id AS cue_id",
        "CASE event_type WHEN 'signup' THEN 'accepted' WHEN 'purchase' THEN 'corrected' WHEN 'view' THEN 'uncertain' "
        "WHEN 'click' THEN 'undo' ELSE 'invalid' END AS kind",
        "CASE event_type WHEN 'signup' THEN if(value < 120, 'cue ' || user_id, 'other') "
        "WHEN 'purchase' THEN if(value < 100, 'fixed ' || event_id % 10, '  ') "
        "WHEN 'view' THEN if(value < 120, '', 'x') END AS verified_text",
        "CASE WHEN event_type = 'click' THEN if(value < 15, -1L, latest) END AS undo_id",
        "if(value > 300, 'old', 'm1') AS manifest_sha", "'c' || user_id % 50 AS crop_sha")


sql_view("pack_cues", (), """
SELECT DISTINCT user_id AS cue_id, user_id AS cue_index, 'pack' || user_id % 5 AS pack_id, 'cue ' || user_id AS ocr_text,
       user_id % 7 <> 0 AS crop_valid, 'm1' AS manifest_sha, 'c' || user_id % 50 AS crop_sha, 's' || user_id % 5 AS srt_sha,
       user_id * 1000 AS start_ms, user_id * 1000 + 900 AS end_ms, CAST(user_id % 100 AS DOUBLE) / 100 AS ocr_confidence,
       user_id // 3 AS frame_no, 100 + user_id % 50 AS bytes FROM events""")


def pack_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS cue_id", "user_id AS cue_index", "'pack' || user_id % 5 AS pack_id", "'cue ' || user_id AS ocr_text",
        "user_id % 7 <> 0 AS crop_valid", "'m1' AS manifest_sha", "'c' || user_id % 50 AS crop_sha", "'s' || user_id % 5 AS srt_sha",
        "user_id * 1000 AS start_ms", "user_id * 1000 + 900 AS end_ms", "cast(user_id % 100 AS double) / 100 AS ocr_confidence",
        "user_id div 3 AS frame_no", "100 + user_id % 50 AS bytes").distinct()
