"""Dataset, gate and rating queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.functions.keys import group_key, sha_id
from cuespan.operators import dataset, journal, rating
from cuespan.plans import views as v
from cuespan.plans.align_queries import _episode_scores, lev
from cuespan.plans.journal_queries import _active
from cuespan.plans.registry import query, sql_view
from cuespan.session import cut_lineage

SEED = "seed-1"
_FOLD = "replace(lower(trim(regexp_replace(nfc_normalize({0}), '\\s+', ' ', 'g'))), 'ß', 'ss')"

# every document is a dataset row; its source and its decade are its group
sql_view("rows_", (), """
SELECT doc_id AS cue_id, source AS source_id, 'E' || doc_id // 10 AS episode_id,
       '["' || source || '","e' || doc_id // 10 || '"]' AS group_key, text AS source_text_verified,
       'c' || length(text) % 97 AS crop_sha256_local, source AS pack_id, n_chars FROM documents""")


def _rows(spark, sf):
    d = v.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("cue_id"), F.col("source").alias("source_id"), F.expr("'E' || doc_id div 10").alias("episode_id"),
                    group_key(F.col("source"), F.expr("'E' || doc_id div 10")).alias("group_key"), F.col("text").alias("source_text_verified"),
                    F.concat(F.lit("c"), F.length("text") % 97).alias("crop_sha256_local"), F.col("source").alias("pack_id"), "n_chars")


sql_view("split_groups", ("rows_",), f"""
SELECT group_key, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'validation' ELSE 'test' END AS split FROM (
  SELECT group_key, row_number() OVER (ORDER BY sha256('{SEED}' || chr(0) || group_key)) AS r, count(*) OVER () AS n FROM
    (SELECT DISTINCT group_key FROM rows_) g) t,
  LATERAL (SELECT CASE WHEN over_ > 0 THEN x + 0 ELSE x END AS a, y AS b FROM (
     SELECT greatest(1, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)) + (CASE WHEN rest >= 1 AND first_ = 0 THEN 1 ELSE 0 END) + (CASE WHEN rest >= 2 AND second_ = 0 THEN 1 ELSE 0 END) AS x,
            greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT)) + (CASE WHEN rest >= 1 AND first_ = 1 THEN 1 ELSE 0 END) + (CASE WHEN rest >= 2 AND second_ = 1 THEN 1 ELSE 0 END) AS y,
            0 AS over_
     FROM (SELECT n - CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) - 2 * CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT) AS rest,
                  CASE WHEN f8 >= f1 THEN 0 ELSE 1 END AS first_,
                  CASE WHEN f8 >= f1 THEN 1 WHEN f8 >= f1 - 1 THEN 2 ELSE 2 END AS second_
           FROM (SELECT n * CAST(0.8 AS DOUBLE) - floor(n * CAST(0.8 AS DOUBLE)) AS f8, n * CAST(0.1 AS DOUBLE) - floor(n * CAST(0.1 AS DOUBLE)) AS f1) f) q) z) s""")


@query("w12_deterministic_split", "SELECT group_key, split FROM split_groups", ("split_groups",))
def w12(spark, sf):
    return dataset.deterministic_split(_rows(spark, sf), SEED)


@query("a13_split_counts", """
SELECT s.split, count(*) AS rows, count(DISTINCT r.group_key) AS groups FROM rows_ r JOIN split_groups s ON s.group_key = r.group_key
GROUP BY ROLLUP (s.split)""", ("rows_", "split_groups"))
def a13(spark, sf):
    rows = _rows(spark, sf)
    return dataset.split_counts(rows.join(dataset.deterministic_split(rows, SEED), "group_key"))


@query("t9_distinct_groups", "SELECT DISTINCT group_key FROM rows_", ("rows_",))
def t9(spark, sf):
    return _rows(spark, sf).select("group_key").distinct()


@query("f7_group_key", "SELECT cue_id, group_key, sha256('dataset:' || cue_id || ':' || source_id) AS row_id FROM rows_", ("rows_",))
def f7(spark, sf):
    return _rows(spark, sf).select("cue_id", "group_key", sha_id("dataset", F.col("cue_id"), F.col("source_id")).alias("row_id"))


@query("j10_metadata_coverage", """
SELECT count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (d.doc_id IS NULL) AS extra,
       count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS common
FROM documents d FULL OUTER JOIN labels l ON l.doc_id = d.doc_id""")
def j10(spark, sf):
    ids = lambda t: v.table(spark, sf, t).select(F.col("doc_id").alias("cue_id"))
    return dataset.coverage_sets(ids("documents"), ids("labels"))


@query("t8_set_equality", """
SELECT missing, unexpected, duplicated, missing + unexpected + duplicated = 0 AS equal FROM (
  SELECT count(*) FILTER (f.n IS NULL) AS missing, count(*) FILTER (e.n IS NULL) AS unexpected, count(*) FILTER (f.n > 1) AS duplicated
  FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1) e
  FULL OUTER JOIN (SELECT c_custkey AS user_id, count(*) AS n FROM customer GROUP BY 1) f ON f.user_id = e.user_id) t""")
def t8(spark, sf):
    expected = v.table(spark, sf, "events").where("event_type <> 'view'").select("user_id")
    return dataset.set_equality(expected, v.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), ["user_id"])


@query("a14_provenance_groups", """
SELECT packs, packs_with_many_groups, groups, groups_with_many_packs, cues_in_many_packs,
       groups >= 3 AND packs_with_many_groups + groups_with_many_packs + cues_in_many_packs = 0 AS valid
FROM (SELECT count(*) AS packs, count(*) FILTER (n <> 1) AS packs_with_many_groups
      FROM (SELECT pack_id, count(DISTINCT group_key) AS n FROM rows_ GROUP BY 1) a) p,
     (SELECT count(*) AS groups, count(*) FILTER (n <> 1) AS groups_with_many_packs
      FROM (SELECT group_key, count(DISTINCT pack_id) AS n FROM rows_ GROUP BY 1) b) g,
     (SELECT count(*) FILTER (n > 1) AS cues_in_many_packs FROM (SELECT cue_id, count(*) AS n FROM rows_ GROUP BY 1) c) q""", ("rows_",))
def a14(spark, sf):
    return dataset.provenance_groups(_rows(spark, sf))


@query("t7_merge_exports", """
SELECT cue_id, count(*) AS n, min(pack_id) AS first_pack, max(pack_id) AS last_pack FROM (
  SELECT doc_id AS cue_id, source AS pack_id FROM documents UNION ALL SELECT doc_id, 'labels' FROM labels
  UNION ALL SELECT item_id, 'benchmark' FROM benchmark) u GROUP BY 1 HAVING count(*) > 1""")
def t7(spark, sf):
    part = lambda t, key, pack: v.table(spark, sf, t).select(F.col(key).alias("cue_id"), pack.alias("pack_id"))
    return dataset.merge_exports([part("documents", "doc_id", F.col("source")), part("labels", "doc_id", F.lit("labels")),
                                  part("benchmark", "item_id", F.lit("benchmark"))])[1]


@query("s16_write_composite_dataset", """
SELECT cue_id, 'crops/' || crop_sha256_local || '.jpg' AS crop_path, pack_id FROM rows_""", ("rows_",))
def s16(spark, sf):
    return dataset.composite_rows(_rows(spark, sf)).select("cue_id", "crop_path", "pack_id")


@query("j14_lineage_verify", """
SELECT r.cue_id, CASE WHEN r.n_chars % 13 = 0 THEN 'not_in_composite' WHEN r.n_chars % 11 = 0 THEN 'cue_in_two_sources' ELSE 'row_differs' END AS problem
FROM rows_ r WHERE r.n_chars % 13 = 0 OR r.n_chars % 11 = 0 OR r.n_chars % 7 = 0""", ("rows_",))
def j14(spark, sf):
    rows = _rows(spark, sf)
    changed = F.when(F.col("n_chars") % 7 == 0, F.lit("changed")).otherwise(F.col("source_text_verified"))
    composite = dataset.composite_rows(rows.where("n_chars % 13 <> 0")).withColumn("source_text_verified", changed)
    sources = rows.unionByName(rows.where("n_chars % 11 = 0 AND n_chars % 13 <> 0"))
    return dataset.lineage_verify(composite, sources, ["source_text_verified", "crop_path", "crop_sha256_local", "pack_id"])


@query("a15_crop_dedup", """
SELECT cue_id, crop_sha, bytes, CASE WHEN by_digest <> cue_id THEN by_digest END AS duplicate_of, by_frame <> cue_id AS same_frame FROM (
  SELECT *, first_value(cue_id) OVER (PARTITION BY crop_sha ORDER BY cue_index) AS by_digest,
         first_value(cue_id) OVER (PARTITION BY frame_no, pack_id ORDER BY cue_index) AS by_frame FROM pack_cues) t""", ("pack_cues",))
def a15(spark, sf):
    return dataset.crop_dedup(v.pack_cues(spark, sf).withColumn("band", F.col("pack_id")))


@query("s12_crop_inventory", """
SELECT count(*) AS unique_crops, CAST(sum(b) AS BIGINT) AS unique_bytes FROM (SELECT sha256(text) AS s, max(length(text)) AS b FROM documents GROUP BY 1) t""")
def s12(spark, sf):
    crops = v.table(spark, sf, "documents").select(F.sha2("text", 256).alias("crop_sha"), F.length("text").alias("bytes"))
    return dataset.unique_bytes(crops)


@query("s12_crop_budget", """
SELECT lang, doc_id, CAST(sum(CASE WHEN doc_id = least_id THEN bytes ELSE 0 END) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) AS total_bytes,
       sum(CASE WHEN doc_id = least_id THEN bytes ELSE 0 END) OVER (PARTITION BY lang ORDER BY doc_id) > 134217728 AS over_budget
FROM (SELECT lang, doc_id, length(text) AS bytes, min(doc_id) OVER (PARTITION BY lang, sha256(text)) AS least_id FROM documents) t""")
def s12_budget(spark, sf):
    crops = v.table(spark, sf, "documents").select("lang", "doc_id", F.sha2("text", 256).alias("crop_sha"), F.length("text").alias("bytes"))
    return dataset.crop_budget(crops, ["lang"], "doc_id").select("lang", "doc_id", "total_bytes", "over_budget")


@query("a20_seed_groups", """
SELECT user_id AS episode_key, length(event_type) AS size, event_type AS sha1, count(*) FILTER (value < 100) AS candidates,
       count(*) FILTER (value >= 100) AS skipped FROM events GROUP BY 1, 2, 3""")
def a20(spark, sf):
    rows = v.table(spark, sf, "events").selectExpr(
        "user_id AS episode_key", "length(event_type) AS size", "event_type AS sha1",
        "if(value < 100, 'replace_text', 'remove_cue') AS action")
    return dataset.seed_groups(rows)[0]


@query("a20_identity_clash", """
SELECT length(event_type) AS size, event_type AS sha1, count(DISTINCT user_id) AS episodes FROM events GROUP BY 1, 2 HAVING count(DISTINCT user_id) > 1""")
def a20_clash(spark, sf):
    rows = v.table(spark, sf, "events").selectExpr("user_id AS episode_key", "length(event_type) AS size", "event_type AS sha1", "'x' AS action")
    return dataset.seed_groups(rows)[1]


# --- gates ------------------------------------------------------------------------
def _scores(spark, sf, matches=None):
    """Scores per group on the largest matching; ``indexed`` is the form that check SQL can say.

    Stored, a row per engine and episode with what gates look at: a gate asks for them up to six times."""
    return cut_lineage(_episode_scores(spark, sf, matches).select(
        "engine_id", F.col("episode_id").cast("string").alias("group_key"), "reference_cues", "matched_cues",
        "reference_chars", "character_edits", "cer"))


def _reference_groups(spark, sf):
    """The frozen groups: every episode that has a reference."""
    return v.cues_ref(spark, sf).select(F.col("episode_id").cast("string").alias("group_key")).distinct()


sql_view("engine_deltas", ("scored_episodes",), """
SELECT coalesce(b.episode_id, c.episode_id)::VARCHAR AS group_key, b.cer AS baseline, c.cer AS candidate, c.cer - b.cer AS candidate_minus_baseline
FROM (SELECT * FROM scored_episodes WHERE engine_id = 'base') b
FULL OUTER JOIN (SELECT * FROM scored_episodes WHERE engine_id = 'cand') c ON c.episode_id = b.episode_id""")


@query("j9_baseline_vs_candidate", "SELECT * FROM engine_deltas", ("engine_deltas",))
def j9(spark, sf):
    return dataset.baseline_vs_candidate(_scores(spark, sf, "indexed"), "base", "cand")


@query("j9_baseline_vs_candidate_matched")
def j9_matched(spark, sf):
    return dataset.baseline_vs_candidate(_scores(spark, sf), "base", "cand")


@query("a6_coverage_gate", """
SELECT count(DISTINCT engine_id) AS engines,
       count(DISTINCT engine_id) * (SELECT count(DISTINCT episode_id) FROM cues_ref) - count(DISTINCT (engine_id, episode_id)) AS missing_groups,
       count(*) FILTER (episode_id NOT IN (SELECT episode_id FROM cues_ref)) AS unexpected_groups,
       count(*) - count(DISTINCT (engine_id, episode_id)) AS duplicate_groups,
       count(*) FILTER (coverage < 0.75) AS failed_groups,
       CASE WHEN count(DISTINCT engine_id) = 2 AND count(*) FILTER (coverage < 0.75) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM scored_episodes""", ("scored_episodes", "cues_ref"))
def a6(spark, sf):
    return dataset.coverage_gate(_scores(spark, sf, "indexed"), _reference_groups(spark, sf), 0.75)[1]


@query("a6_coverage_gate_matched")
def a6_matched(spark, sf):
    return dataset.coverage_gate(_scores(spark, sf), _reference_groups(spark, sf), 0.75)[1]


@query("a7_comparison_gate", """
SELECT cer_increase, cer_increase <= 0.01 AS cer_limit_passed, worst <= 0 AND complete AS no_group_regression_passed,
       complete AS group_data_complete, covered AS coverage_passed,
       CASE WHEN cer_increase <= 0.01 AND worst <= 0 AND complete AND covered THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT CAST(sum(character_edits) FILTER (engine_id = 'cand') AS DOUBLE) / sum(reference_chars) FILTER (engine_id = 'cand')
           - CAST(sum(character_edits) FILTER (engine_id = 'base') AS DOUBLE) / sum(reference_chars) FILTER (engine_id = 'base') AS cer_increase,
             bool_and(coverage >= 0.75) AS covered FROM scored_episodes) m,
     (SELECT max(candidate_minus_baseline) AS worst, bool_and(candidate_minus_baseline IS NOT NULL) AS complete FROM engine_deltas) d""",
       ("scored_episodes", "engine_deltas"))
def a7(spark, sf):
    return _compare(spark, sf, _scores(spark, sf, "indexed"))


@query("a7_comparison_gate_matched")
def a7_matched(spark, sf):
    return _compare(spark, sf, _scores(spark, sf))


def _compare(spark, sf, scores):
    from cuespan.operators.scoring import ratio
    corpus = scores.groupBy("engine_id").agg(ratio(F.sum("character_edits"), F.sum("reference_chars")).alias("cer"))
    cover = dataset.coverage_gate(scores, _reference_groups(spark, sf), 0.75)[1]
    return dataset.comparison_gate(corpus, dataset.baseline_vs_candidate(scores, "base", "cand"),
                                   cover, "base", "cand", 0.01)


@query("a17_case_gate", """
SELECT episode_id, array_to_string(list_filter([CASE WHEN vtt < 8 THEN 'few_references' END, CASE WHEN n < 6 THEN 'few_pairs' END,
         CASE WHEN chars < 201 THEN 'few_characters' END, CASE WHEN n = 0 OR CAST(edits AS DOUBLE) / chars > 0.035 THEN 'error_limit' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT r.episode_id, any_value(r.n) AS vtt, count(i.p_cue_index) AS n, coalesce(sum(length(i.r_text)), 0) AS chars, sum(LEV) AS edits
      FROM (SELECT episode_id, count(*) AS n FROM cues_ref WHERE start_ms < 240000 GROUP BY 1) r
      LEFT JOIN window_pairs i ON i.episode_id = r.episode_id GROUP BY 1) t""".replace(
    "LEV", lev("i.r_text", "i.p_text")), ("cues_ref", "window_pairs"))
def a17(spark, sf):
    from cuespan.operators import gathered, scoring
    ref = v.cues_ref(spark, sf).where("start_ms < 240000")  # the case's time window
    pairs = gathered.greedy_pairs(gathered.episodes(v.cues_pred(spark, sf), ref))
    report = scoring.vtt_report_gathered(pairs).where("vtt_cues > 0")
    return dataset.case_gate(report, 8, 6, 201, 0.035).select("episode_id", "reasons")


@query("j17_compat_gate", """
SELECT r.r_name AS os, n.n_name AS backend, d.device FROM region r CROSS JOIN nation n CROSS JOIN (SELECT unnest(['gpu', 'cpu']) AS device) d
WHERE NOT EXISTS (SELECT 1 FROM nation e WHERE e.n_regionkey = r.r_regionkey AND e.n_name = n.n_name AND (d.device = 'cpu' OR e.n_nationkey % 2 = 0))""")
def j17(spark, sf):
    nation, region = v.table(spark, sf, "nation"), v.table(spark, sf, "region")
    device = F.explode(F.array(F.lit("gpu"), F.lit("cpu")))
    # a product of three short declared lists is the feature itself
    lists = nation.agg(F.sort_array(F.collect_set("n_name")).alias("backends"), F.lit(1).alias("_one"))
    required = (region.select(F.col("r_name").alias("os"), F.lit(1).alias("_one")).join(lists, "_one")
                .select("os", F.explode("backends").alias("backend")).select("os", "backend", device.alias("device")))
    evidence = (nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
                .select(F.col("r_name").alias("os"), F.col("n_name").alias("backend"), "n_nationkey", device.alias("device"))
                .withColumn("validation_passed", (F.col("device") == "cpu") | (F.col("n_nationkey") % 2 == 0)))
    return dataset.compat_gate(required, evidence, ["os", "backend", "device"])


@query("p24_response_validate", """
SELECT q.request_id, q.cue_id, CASE WHEN q.v > 300 THEN 'missing' WHEN q.v > 200 THEN 'times_changed'
       WHEN q.kind = 'error' THEN 'source_status' WHEN q.kind = 'view' AND q.v < 20 THEN 'correction'
       WHEN q.kind = 'click' AND q.v < 10 THEN 'confirmed_differs' WHEN q.kind IN ('purchase', 'view') AND q.v < 60 THEN 'must_be_deferred'
       WHEN q.kind IN ('purchase', 'view') THEN NULL WHEN q.v < 30 THEN 'translation' END AS problem
FROM (SELECT user_id AS request_id, event_id AS cue_id, event_type AS kind, value AS v FROM events) q""")
def p24(spark, sf):
    e = v.table(spark, sf, "events")
    request = e.selectExpr("user_id AS request_id", "event_id AS cue_id", "event_id AS start_ms", "event_id + 900 AS end_ms", "'text ' || user_id AS source_text")
    response = e.where("value <= 300").selectExpr(
        "user_id AS request_id", "event_id AS cue_id", "if(value > 200, event_id + 1, event_id) AS start_ms", "event_id + 900 AS end_ms",
        "CASE event_type WHEN 'error' THEN 'odd' WHEN 'view' THEN 'correction_proposed' WHEN 'purchase' THEN 'uncertain' ELSE 'confirmed' END AS source_status",
        "if(event_type = 'click' AND value < 10, 'other', 'text ' || user_id) AS observed",
        "CASE WHEN event_type = 'view' THEN if(value < 20, 'text ' || user_id, 'better') END AS proposed_source",
        "if(event_type IN ('purchase', 'view') AND value >= 60, 'deferred', 'reviewed') AS review_status",
        "CASE WHEN event_type IN ('purchase', 'view') AND value >= 60 THEN NULL WHEN value < 30 THEN ' ' ELSE 'ok' END AS translation")
    return dataset.response_validate(request, response)


# --- ratings ------------------------------------------------------------------------
# documents are candidates; labels and the document give the scores
sql_view("candidates", (), """
SELECT doc_id AS candidate_id, lang AS condition_id, source AS group_id, CASE WHEN length(source) % 2 = 0 THEN 'development' ELSE 'held_out' END AS split,
       CASE WHEN n_chars % 19 = 0 THEN NULL ELSE 'h' || doc_id END AS candidate_sha,
       CASE WHEN n_chars % 23 = 0 THEN 'source_unavailable' WHEN n_chars % 29 = 0 THEN 'stale_source' WHEN n_chars % 19 = 0 THEN 'candidate_missing'
            WHEN n_chars % 31 = 0 THEN 'stale_candidate' ELSE 'current' END AS source_state, n_chars FROM documents""")


def _candidates(spark, sf):
    return v.table(spark, sf, "documents").selectExpr(
        "doc_id AS candidate_id", "lang AS condition_id", "source AS group_id", "if(length(source) % 2 = 0, 'development', 'held_out') AS split",
        "if(n_chars % 19 = 0, NULL, 'h' || doc_id) AS candidate_sha",
        "CASE WHEN n_chars % 23 = 0 THEN 'source_unavailable' WHEN n_chars % 29 = 0 THEN 'stale_source' WHEN n_chars % 19 = 0 THEN 'candidate_missing' "
        "WHEN n_chars % 31 = 0 THEN 'stale_candidate' ELSE 'current' END AS source_state", "n_chars")


sql_view("ratings", (), """
SELECT l.doc_id AS candidate_id, rv AS reviewer_id, 'r' || l.doc_id || rv AS event_id, d.n_chars % 17 = 0 AS uneval,
       CASE WHEN d.n_chars % 17 = 0 THEN NULL WHEN l.quality = 1 THEN 2 ELSE d.n_chars % 2 + CASE WHEN rv = 'b' AND d.n_chars % 5 = 0 THEN 1 ELSE 0 END END AS semantic_adequacy,
       CASE WHEN d.n_chars % 17 = 0 THEN NULL ELSE l.toxic * 2 END AS omissions,
       CASE WHEN d.n_chars % 17 = 0 THEN NULL ELSE d.n_chars % 3 END AS terminology,
       CASE WHEN d.n_chars % 17 = 0 THEN NULL WHEN l.quality = 1 THEN 'accepted' ELSE 'edited' END AS outcome,
       CASE WHEN d.n_chars % 17 <> 0 THEN NULL WHEN d.n_chars % 2 = 0 THEN 'other' ELSE 'context_missing' END AS reason,
       CASE WHEN d.n_chars % 17 = 0 THEN '' WHEN l.toxic = 1 THEN 'omission' ELSE 'none' END AS issue
FROM labels l JOIN documents d ON d.doc_id = l.doc_id CROSS JOIN (SELECT unnest(['a', 'b']) AS rv) r""")


def _ratings(spark, sf):
    joined = v.table(spark, sf, "labels").join(v.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").withColumn(
        "rv", F.explode(F.array(F.lit("a"), F.lit("b"))))
    dim = lambda expr: f"CASE WHEN n_chars % 17 = 0 THEN NULL ELSE cast({expr} AS bigint) END"
    return joined.selectExpr(
        "doc_id * 2 + if(rv = 'a', 0, 1) AS line_no", "doc_id AS candidate_id", "rv AS reviewer_id", "'r' || doc_id || rv AS event_id",
        "if(n_chars % 17 = 0, 'unevaluable', 'rated') AS status",
        dim("if(quality = 1, 2, n_chars % 2 + if(rv = 'b' AND n_chars % 5 = 0, 1, 0))") + " AS semantic_adequacy",
        dim("toxic * 2") + " AS omissions", dim("0") + " AS additions", dim("n_chars % 3") + " AS terminology", dim("1") + " AS style_register",
        "CASE WHEN n_chars % 17 = 0 THEN NULL WHEN quality = 1 THEN 'accepted' ELSE 'edited' END AS outcome",
        "CASE WHEN n_chars % 17 <> 0 THEN NULL WHEN n_chars % 2 = 0 THEN 'other' ELSE 'context_missing' END AS reason",
        "CASE WHEN n_chars % 17 = 0 THEN array() WHEN toxic = 1 THEN array('omission') ELSE array('none') END AS issues")


def _items(spark, sf):
    return rating.adjudicate(_candidates(spark, sf), _ratings(spark, sf))


sql_view("items", ("candidates", "ratings"), """
SELECT c.*, r.n_ratings, r.sa, r.om, r.te, r.outcome, r.issue, CASE WHEN c.candidate_sha IS NULL THEN 'missing_output' WHEN c.source_state <> 'current' THEN c.source_state
       WHEN r.n_ratings IS NULL THEN 'unrated' WHEN r.uneval THEN 'unevaluable' WHEN r.verdicts > 1 THEN 'disputed' ELSE 'rated' END AS status
FROM candidates c LEFT JOIN (
  SELECT candidate_id, count(*) AS n_ratings, bool_or(uneval) AS uneval, count(DISTINCT (semantic_adequacy, omissions, terminology, outcome, issue)) AS verdicts,
         arg_min(semantic_adequacy, reviewer_id) AS sa, arg_min(omissions, reviewer_id) AS om, arg_min(terminology, reviewer_id) AS te,
         arg_min(outcome, reviewer_id) AS outcome, arg_min(issue, reviewer_id) AS issue FROM ratings GROUP BY 1) r ON r.candidate_id = c.candidate_id""")


@query("a10_rating_report", """
SELECT condition_id, split, count(*) AS expected, CAST(coalesce(sum(n_ratings) FILTER (status <> 'missing_output'), 0) AS BIGINT) AS active_ratings, """
       + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in rating.STATUSES)
       + """, count(*) FILTER (status NOT IN ('rated', 'unrated')) AS excluded FROM items GROUP BY 1, 2""", ("items",))
def a10(spark, sf):
    return rating.rating_report(_items(spark, sf))


@query("a10_exclusion_reasons", """
SELECT condition_id, split, reason, count(*) AS n FROM (
  SELECT condition_id, split, CASE status WHEN 'unevaluable' THEN 'unevaluable:' || CASE WHEN n_chars % 2 = 0 THEN 'other' ELSE 'context_missing' END
         WHEN 'disputed' THEN 'reviewer_disagreement' WHEN 'unrated' THEN 'pending_rating' ELSE status END AS reason FROM items WHERE status <> 'rated') t
GROUP BY 1, 2, 3""", ("items",))
def a10_reasons(spark, sf):
    return rating.exclusion_reasons(_items(spark, sf))


@query("a10_histogram", """
SELECT condition_id, split, fact, value, count(*) AS n FROM (
  SELECT condition_id, split, unnest(['semantic_adequacy', 'omissions', 'additions', 'terminology', 'style_register', 'outcome', CASE WHEN issue <> 'none' THEN 'issue' END]) AS fact,
         unnest([sa::VARCHAR, om::VARCHAR, '0', te::VARCHAR, '1', outcome, issue]) AS value FROM items WHERE status = 'rated') t
WHERE fact IS NOT NULL GROUP BY 1, 2, 3, 4""", ("items",))
def a10_histogram(spark, sf):
    return rating.rating_histogram(_items(spark, sf))


@query("a11_reviewer_agreement", """
SELECT candidate_id, count(*) AS ratings, count(DISTINCT (semantic_adequacy, omissions, terminology, outcome, issue)) AS verdicts,
       CASE WHEN count(DISTINCT (semantic_adequacy, omissions, terminology, outcome, issue)) = 1 THEN 'agreed' ELSE 'disputed' END AS state
FROM ratings WHERE NOT uneval GROUP BY 1""", ("ratings",))
def a11(spark, sf):
    return rating.reviewer_agreement(_ratings(spark, sf))


@query("a12_heldout_metric", """
SELECT condition_id, groups, met AS groups_meeting_floor, low AS minimum_rated_fraction, denominator,
       CASE WHEN groups = met THEN passes END AS numerator, CASE WHEN groups = met THEN round_even(CAST(passes AS DOUBLE) / denominator, 6) END AS rate,
       CASE WHEN groups = met THEN round_even(macro, 6) END AS group_macro_rate,
       CASE WHEN groups = met THEN 'DESCRIPTIVE_HELD_OUT_REVIEW' ELSE 'COVERAGE_FLOOR_FAILED' END AS metric_status
FROM (SELECT condition_id, count(*) AS groups, count(*) FILTER (CAST(rated AS DOUBLE) / expected >= 0.05) AS met, round_even(min(CAST(rated AS DOUBLE) / expected), 6) AS low,
             CAST(sum(expected) AS BIGINT) AS denominator, CAST(sum(p) AS BIGINT) AS passes, avg(CAST(p AS DOUBLE) / expected) AS macro
      FROM (SELECT condition_id, group_id, count(*) AS expected, count(*) FILTER (status = 'rated') AS rated,
                   count(*) FILTER (status = 'rated' AND sa = 2 AND om < 2 AND te >= 1) AS p FROM items WHERE split = 'held_out' GROUP BY 1, 2) g GROUP BY 1) t""", ("items",))
def a12(spark, sf):
    return rating.heldout_metric(_items(spark, sf), 0.05)


# corrections: every purchase supersedes the latest rating of its pair, sometimes a wrong one
sql_view("rating_events", (), """
SELECT event_id AS line_no, event_id, user_id AS candidate_id, event_type AS reviewer_id,
       CASE WHEN value < 200 THEN lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) END AS supersedes_id FROM events""")


def _rating_events(spark, sf):
    from cuespan.functions.ordered import prefix_scan
    e = prefix_scan(v.table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"], {"prior": ("last", F.col("event_id"))})
    return e.selectExpr("event_id AS line_no", "event_id", "user_id AS candidate_id", "event_type AS reviewer_id", "if(value < 200, prior, NULL) AS supersedes_id")


@query("e6_active_ratings", """
SELECT event_id, candidate_id, reviewer_id FROM rating_events r WHERE NOT EXISTS (SELECT 1 FROM rating_events s WHERE s.supersedes_id = r.event_id)""", ("rating_events",))
def e6(spark, sf):
    return rating.active_ratings(_rating_events(spark, sf))[0].select("event_id", "candidate_id", "reviewer_id")


@query("e6_rating_violations", """
SELECT line_no, event_id, candidate_id, reviewer_id, 'duplicate_rating' AS problem FROM (
  SELECT *, lag(event_id) OVER (PARTITION BY candidate_id, reviewer_id ORDER BY line_no) AS prior FROM rating_events) t
WHERE supersedes_id IS NULL AND prior IS NOT NULL""", ("rating_events",))
def e6_bad(spark, sf):
    return rating.active_ratings(_rating_events(spark, sf))[1]


@query("e7_chain_verify", """
SELECT scope, line_no, CASE WHEN line_no % 97 = 0 THEN 'broken_link' WHEN line_no % 89 = 0 THEN 'hash_mismatch' WHEN first THEN 'not_frozen_first' END AS problem
FROM (SELECT user_id AS scope, event_id AS line_no, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS first FROM events) t
WHERE line_no % 97 = 0 OR line_no % 89 = 0 OR first""")
def e7(spark, sf):
    from cuespan.functions.ordered import prefix_scan
    body = F.concat_ws("|", "event_id", "event_type", "value")
    e = v.table(spark, sf, "events").withColumn("body", body).withColumn(
        "event_sha256", F.when(F.col("event_id") % 89 == 0, F.lit("bad")).otherwise(F.sha2("body", 256)))
    e = prefix_scan(e, ["user_id"], ["event_id"], {"p": ("last", F.col("event_sha256"))})
    broken = F.when(F.col("event_id") % 97 == 0, F.lit("x")).otherwise(F.col("p"))
    chain = e.select(F.col("user_id").alias("scope"), F.col("event_id").alias("line_no"), "event_id", "event_type", "event_sha256",
                     broken.alias("previous_event_sha256"), "body")
    return journal.chain_verify(chain, ["scope"], F.col("body"))


@query("e8_blind_reveal", """
SELECT reviewer_id, reveal_line, count(DISTINCT candidate_id) FILTER (line_no < reveal_line) AS rated, any_value(needed) AS needed,
       CASE WHEN count(DISTINCT candidate_id) FILTER (line_no < reveal_line) < any_value(needed) THEN 'incomplete'
            WHEN any_value(last) > reveal_line THEN 'rated_after' ELSE 'allowed' END AS status
FROM (SELECT r.event_type AS reviewer_id, r.reveal_line, e.user_id AS candidate_id, e.event_id AS line_no, n.needed, n.last
      FROM (SELECT event_type, max(event_id) * (CASE WHEN event_type = 'view' THEN 2 ELSE 1 END) AS reveal_line FROM events GROUP BY event_type) r
      JOIN events e ON e.event_type = r.event_type, (SELECT count(DISTINCT user_id) AS needed, max(event_id) AS last FROM events) n) t
GROUP BY 1, 2""")
def e8(spark, sf):
    e = v.table(spark, sf, "events").select(F.col("event_id").alias("line_no"), F.col("user_id").alias("candidate_id"), F.col("event_type").alias("reviewer_id"))
    reveals = e.groupBy("reviewer_id").agg(F.max("line_no").alias("m")).selectExpr("reviewer_id", "m * if(reviewer_id = 'view', 2, 1) AS line_no")
    return rating.blind_reveal(reveals, e, e.select("candidate_id"))


@query("p20_source_status", """
SELECT candidate_id, CASE WHEN n_chars % 23 = 0 THEN 'source_unavailable' WHEN n_chars % 29 = 0 THEN 'stale_source' WHEN candidate_sha IS NULL THEN 'candidate_missing'
       WHEN n_chars % 31 = 0 THEN 'stale_candidate' ELSE 'current' END AS source_state FROM candidates""", ("candidates",))
def p20(spark, sf):
    base = _candidates(spark, sf).drop("source_state").withColumns({f: F.concat(F.lit(f), "candidate_id") for f in rating.SOURCE_FIELDS}).withColumn(
        "proposal_sha", F.lit("p"))
    n = F.col("n_chars")
    state = base.where(n % 23 != 0).select(
        "candidate_id", F.lit(True).alias("active"), *[F.col(f) for f in rating.SOURCE_FIELDS[:-1]],
        F.when(n % 29 == 0, F.lit("moved")).otherwise(F.col("srt_sha")).alias("srt_sha"), "candidate_sha",
        F.when(n % 31 == 0, F.lit("q")).otherwise(F.lit("p")).alias("proposal_sha"))
    return rating.source_status(base, state).select("candidate_id", "source_state")


@query("p21_rating_rules", """
SELECT event_id, CASE WHEN NOT uneval THEN CASE WHEN c.source_state <> 'current' THEN 'source_not_current' END
       WHEN c.source_state IN ('source_unavailable', 'stale_source', 'candidate_missing', 'stale_candidate') THEN 'reason_not_state' END AS problem
FROM ratings r JOIN candidates c ON c.candidate_id = r.candidate_id""", ("ratings", "candidates"))
def p21(spark, sf):
    return rating.rating_rules(_ratings(spark, sf).join(_candidates(spark, sf).select("candidate_id", "source_state"), "candidate_id")).select("event_id", "problem")


def _cases(spark, sf):
    """Events of a user as test rows; the user's active review is the source."""
    active = _active(spark, sf)
    events = v.table(spark, sf, "events")
    rows = events.selectExpr("event_id AS cue_no", "user_id AS cue_id", "user_id % 4 AS group_key").join(
        active.select("cue_id", F.col("event_id").alias("now")), "cue_id", "left").selectExpr(
        "cue_id", "group_key", "if(cue_no % 5 = 0, cue_no, coalesce(now, -1)) AS source_event_id").distinct()
    proposals = events.where("event_type = 'purchase'").selectExpr("event_id AS proposal_id", "user_id AS cue_id").join(
        active.select("cue_id", F.col("event_id").alias("source_event_id")), "cue_id")
    proposals = proposals.groupBy("cue_id", "source_event_id").agg(F.min("proposal_id").alias("proposal_id")).where("cue_id % 3 <> 0")
    conditions = proposals.selectExpr("proposal_id", "'c1' AS condition_id").where("proposal_id % 4 <> 0")
    return rows, active, proposals, conditions


sql_view("cases", ("active",), """
SELECT t.cue_id, t.group_key, CASE WHEN p.proposal_id IS NOT NULL THEN p.proposal_id END AS proposal_id,
       CASE WHEN p.proposal_id % 4 <> 0 THEN 'c1' END AS condition_id,
       CASE WHEN t.now IS NULL THEN 'source_missing' WHEN t.now <> t.source_event_id THEN 'lineage_stale' WHEN p.proposal_id IS NULL THEN 'proposal_missing'
            WHEN p.proposal_id % 4 = 0 THEN 'condition_missing' ELSE 'ready' END AS state
FROM (SELECT DISTINCT e.user_id AS cue_id, e.user_id % 4 AS group_key, CASE WHEN e.event_id % 5 = 0 THEN e.event_id ELSE coalesce(a.event_id, -1) END AS source_event_id, a.event_id AS now
      FROM events e LEFT JOIN active a ON a.cue_id = e.user_id) t
LEFT JOIN (SELECT e.user_id AS cue_id, a.event_id AS source_event_id, min(e.event_id) AS proposal_id FROM events e JOIN active a ON a.cue_id = e.user_id
           WHERE e.event_type = 'purchase' AND e.user_id % 3 <> 0 GROUP BY 1, 2) p ON p.cue_id = t.cue_id AND p.source_event_id = t.source_event_id""")


@query("j18_cohort_candidates", "SELECT * FROM cases", ("cases",))
def j18(spark, sf):
    return rating.cohort_candidates(*_cases(spark, sf))


@query("a23_readiness", """
SELECT b IS NULL AS ready, b AS blocker, s.n AS verified_sources, p.n AS proposals, c.groups AS held_out_groups, c.n AS held_out_candidates
FROM (SELECT count(*) AS n, count(DISTINCT group_key) AS groups, CASE WHEN count(*) = 0 THEN 'TEST_CUES_MISSING' WHEN bool_or(state = 'source_missing') THEN 'TEST_SOURCE_REVIEW_MISSING'
             WHEN bool_or(state = 'lineage_stale') THEN 'OCR_SOURCE_LINEAGE_STALE' WHEN bool_or(state = 'proposal_missing') THEN 'TEST_MANUAL_PROPOSALS_INCOMPLETE'
             WHEN bool_or(state = 'condition_missing') THEN 'CONDITION_ASSIGNMENT_MISSING' END AS b FROM cases) c,
     (SELECT count(*) AS n FROM active) s, (SELECT count(DISTINCT user_id) AS n FROM events e JOIN active a ON a.cue_id = e.user_id WHERE e.event_type = 'purchase' AND e.user_id % 3 <> 0) p""",
       ("cases", "active"))
def a23(spark, sf):
    rows, active, proposals, conditions = _cases(spark, sf)
    return rating.readiness(rating.cohort_candidates(rows, active, proposals, conditions), active, proposals)


@query("j19_neighbour_context", """
SELECT pack, cue_index, concat_ws(chr(10), 'Önceki: ' || prev, 'Mevcut: ' || cur, 'Sonraki: ' || nxt) AS context FROM (
  SELECT lang AS pack, doc_id AS cue_index, src AS cur, lag(src) OVER w AS prev, lead(src) OVER w AS nxt FROM
    (SELECT lang, doc_id, CASE WHEN n_chars % 3 <> 0 THEN source END AS src FROM documents) d
  WINDOW w AS (PARTITION BY lang ORDER BY doc_id)) t WHERE cur IS NOT NULL""")
def j19(spark, sf):
    d = v.table(spark, sf, "documents").select(F.col("lang").alias("pack"), F.col("doc_id").alias("cue_index"), F.col("source").alias("verified_text"), "n_chars")
    return rating.neighbour_context(d.select("pack", "cue_index"), d.where("n_chars % 3 <> 0"), ["pack"])
