"""Alignment and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.operators import align, gathered, intervals, scoring
from cuespan.plans import views as v
from cuespan.plans.registry import query, sql_view
from cuespan.session import cut_lineage

# DuckDB's levenshtein counts bytes. The tables use these non-ASCII letters and
# none of the control characters below, so a one-to-one exchange makes bytes and
# characters the same without leaving any text out.
LETTERS = "óéèñçüêäößíÉÈÑÓÇÄÊÜÖÍ"
CONTROLS = [c for c in range(1, 32) if c not in (9, 10, 13)][:len(LETTERS)]


def one_byte(expr: str) -> str:
    return f"translate({expr}, '{LETTERS}', {' || '.join(f'chr({c})' for c in CONTROLS)})"


def lev(a: str, b: str) -> str:
    return f"levenshtein({one_byte(a)}, {one_byte(b)})"


sql_view("edges", ("cues_ref", "cues_pred"), """
SELECT p.episode_id, p.cue_index AS p_cue_index, r.cue_index AS r_cue_index,
       least(p.end_ms, r.end_ms) - greatest(p.start_ms, r.start_ms) AS overlap_ms,
       p.text AS p_text, r.text AS r_text, p.start_ms AS p_start_ms, r.start_ms AS r_start_ms,
       p.end_ms AS p_end_ms, r.end_ms AS r_end_ms
FROM cues_pred p JOIN cues_ref r ON p.episode_id = r.episode_id AND p.start_ms < r.end_ms AND r.start_ms < p.end_ms
WHERE 2 * (least(p.end_ms, r.end_ms) - greatest(p.start_ms, r.start_ms)) >= p.end_ms - p.start_ms""")




def greedy_views(rounds: str, pairs: str, edges: str) -> None:
    """Largest overlap first, in SQL: each round takes the edges that are best
    for both of their cues among the edges that are left."""
    best = ", ".join(f"row_number() OVER (PARTITION BY episode_id, {side} ORDER BY overlap_ms DESC, p_cue_index, r_cue_index) AS {name}"
                     for side, name in (("p_cue_index", "rp"), ("r_cue_index", "rr")))
    take = "SELECT episode_id, p_cue_index, r_cue_index, overlap_ms, rp = 1 AND rr = 1 AS taken"
    sql_view(rounds, (edges,), f"""
{take} FROM (SELECT *, {best} FROM {edges}) a
UNION ALL
{take} FROM (SELECT *, {best} FROM (
  SELECT *, bool_or(taken) OVER (PARTITION BY episode_id, p_cue_index) AS p_used,
         bool_or(taken) OVER (PARTITION BY episode_id, r_cue_index) AS r_used FROM {rounds}) b WHERE NOT p_used AND NOT r_used) c""")
    sql_view(pairs, (edges, rounds), f"""
SELECT e.* FROM {edges} e JOIN {rounds} t ON t.taken AND t.episode_id = e.episode_id
 AND t.p_cue_index = e.p_cue_index AND t.r_cue_index = e.r_cue_index""")


greedy_views("greedy_rounds", "greedy_pairs", "edges")
sql_view("window_edges", ("edges",), "SELECT * FROM edges WHERE r_start_ms < 240000")
greedy_views("window_rounds", "window_pairs", "window_edges")


def _edges(spark, sf, share_of="pred"):
    return intervals.overlap_candidates(v.cues_pred(spark, sf), v.cues_ref(spark, sf), share_of=share_of)


def _stored(spark, sf):
    """The cues, split and timed once; readings and both sides of a join follow from them."""
    return cut_lineage(v.cues_ref(spark, sf))


def _greedy(spark, sf):
    pred, ref = v.cues_pred(spark, sf), v.cues_ref(spark, sf)
    # stored, as numbers: reports use the pairs more than once
    pairs = cut_lineage(align.greedy_align(intervals.overlap_candidates(pred, ref)))
    return align.attach_pairs(pairs, pred, ref), pred, ref


def _pairs(spark, sf):
    """The pairs of ``_greedy`` out of whole episodes, each of which is one document."""
    return gathered.greedy_pairs(gathered.episodes(v.cues_pred(spark, sf), v.cues_ref(spark, sf)))


@query("j1_overlap_candidates", "SELECT episode_id, p_cue_index, r_cue_index, overlap_ms FROM edges", ("edges",))
def j1(spark, sf):
    return _edges(spark, sf).select("episode_id", "p_cue_index", "r_cue_index", "overlap_ms")


@query("j1_overlap_of_reference", """
SELECT p.episode_id, p.cue_index AS p_cue_index, r.cue_index AS r_cue_index,
       least(p.end_ms, r.end_ms) - greatest(p.start_ms, r.start_ms) AS overlap_ms
FROM cues_pred p JOIN cues_ref r ON p.episode_id = r.episode_id AND p.start_ms < r.end_ms AND r.start_ms < p.end_ms
WHERE 2 * (least(p.end_ms, r.end_ms) - greatest(p.start_ms, r.start_ms)) >= r.end_ms - r.start_ms""",
       ("cues_ref", "cues_pred"))
def j1_ref(spark, sf):
    return _edges(spark, sf, "ref").select("episode_id", "p_cue_index", "r_cue_index", "overlap_ms")


@query("j2_greedy_align", "SELECT episode_id, p_cue_index, r_cue_index, overlap_ms FROM greedy_pairs", ("greedy_pairs",))
def j2(spark, sf):
    return align.greedy_align(_edges(spark, sf))


@query("j3_max_cardinality_align")
def j3(spark, sf):
    cues = _stored(spark, sf)
    pred = v.engine_preds(spark, sf, cues)
    edges = intervals.overlap_candidates(
        pred, cues.withColumn("engine_id", F.explode(F.array(*map(F.lit, v.ENGINES)))),
        keys=("engine_id", "episode_id"), share_of="ref")
    return align.largest_align(edges, ("engine_id", "episode_id"))


@query("a1_text_score", f"""
SELECT episode_id, count(*) AS rows, CAST(sum(length(r)) AS BIGINT) AS reference_chars,
       CAST(sum(len(string_split(r, ' '))) AS BIGINT) AS reference_words,
       CAST(sum(CASE WHEN r <> '' THEN {lev('r', 'p')} ELSE 0 END) AS BIGINT) AS character_edits,
       count(*) FILTER (r = p) AS exact_rows, count(*) FILTER (p <> '') AS nonempty_outputs,
       CAST(sum(CASE WHEN r <> '' THEN {lev('r', 'p')} ELSE 0 END) AS DOUBLE) / sum(length(r)) AS cer
FROM (SELECT r.episode_id, trim(regexp_replace(nfc_normalize(r.text), '\\s+', ' ', 'g')) AS r,
             coalesce(trim(regexp_replace(nfc_normalize(p.text), '\\s+', ' ', 'g')), '') AS p
      FROM cues_ref r LEFT JOIN cues_pred p ON r.episode_id = p.episode_id AND r.cue_index = p.cue_index) t
GROUP BY episode_id""", ("cues_ref", "cues_pred"))
def a1(spark, sf):
    ref = v.cues_ref(spark, sf).select("episode_id", "cue_index", F.col("text").alias("reference"))
    pred = v.cues_pred(spark, sf).select("episode_id", "cue_index", F.col("text").alias("prediction"))
    scored = scoring.text_score(ref.join(pred, ["episode_id", "cue_index"], "left"), ["episode_id"])
    return scored.select("episode_id", "rows", "reference_chars", "reference_words", "character_edits",
                         "exact_rows", "nonempty_outputs", "cer")


@query("a1_word_errors")
def a1_words(spark, sf):
    ref = v.cues_ref(spark, sf).select("episode_id", "cue_index", F.col("text").alias("reference"))
    pred = v.cues_pred(spark, sf).select("episode_id", "cue_index", F.col("text").alias("prediction"))
    return scoring.text_score(ref.join(pred, ["episode_id", "cue_index"], "left"), ["episode_id"])


@query("a2_vtt_report", f"""
SELECT r.episode_id, coalesce(p.n, 0) AS srt_blocks, r.n AS vtt_cues, coalesce(m.n, 0) AS aligned_pairs,
       coalesce(m.edits, 0) AS total_edit_distance, coalesce(m.chars, 0) AS total_gt_chars,
       CASE WHEN m.chars > 0 THEN CAST(m.edits AS DOUBLE) / m.chars END AS corpus_cer,
       CAST(coalesce(m.n, 0) AS DOUBLE) / r.n AS recall,
       CASE WHEN p.n > 0 THEN CAST(coalesce(m.n, 0) AS DOUBLE) / p.n END AS precision,
       m.line_cer AS mean_line_cer, m.signed AS mean_signed_start_diff_ms, m.absolute AS mean_abs_start_diff_ms,
       m.first5 AS first5_mean_abs_start_diff_ms, coalesce(m.first5 > 1000, FALSE) AS compat_warning
FROM (SELECT episode_id, count(*) AS n FROM cues_ref GROUP BY 1) r
LEFT JOIN (SELECT episode_id, count(*) AS n FROM cues_pred GROUP BY 1) p ON p.episode_id = r.episode_id
LEFT JOIN (SELECT episode_id, count(*) AS n, CAST(sum({lev('r_text', 'p_text')}) AS BIGINT) AS edits,
                  CAST(sum(length(r_text)) AS BIGINT) AS chars,
                  round(avg(CAST({lev('r_text', 'p_text')} AS DOUBLE) / length(r_text)), 9) AS line_cer,
                  CAST(sum(d) AS DOUBLE) / count(*) AS signed, CAST(sum(abs(d)) AS DOUBLE) / count(*) AS absolute,
                  CAST(sum(abs(d)) FILTER (rn <= 5) AS DOUBLE) / count(*) FILTER (rn <= 5) AS first5
           FROM (SELECT *, p_start_ms - r_start_ms AS d,
                        row_number() OVER (PARTITION BY episode_id ORDER BY p_cue_index) AS rn
                 FROM greedy_pairs) x GROUP BY 1) m
       ON m.episode_id = r.episode_id""", ("cues_ref", "cues_pred", "greedy_pairs"))
def a2(spark, sf):
    return scoring.vtt_report_gathered(_pairs(spark, sf)).withColumn("mean_line_cer", F.round("mean_line_cer", 9))


@query("a3_confusion_matrix")
def a3(spark, sf):
    return scoring.confusions(_pairs(spark, sf), keys=[])


def _episode_scores(spark, sf, matches=None):
    ref = v.cues_ref(spark, sf)
    # an episode is one document, so its cues fit in a row
    both = gathered.episodes(v.engine_preds(spark, sf, ref), ref, v.ENGINES)
    cues = gathered.scored_cues(both, v.ENGINES, "largest" if matches is None else matches)
    return scoring.with_cue_rates(scoring.score_sums_gathered(cues, 200))


@query("a4_cue_score")
def a4(spark, sf):
    return _episode_scores(spark, sf)


sql_view("scored_episodes", ("cues_ref", "engine_preds"), f"""
SELECT m.engine_id, m.episode_id, m.reference_cues, coalesce(k.prediction_cues, 0) AS prediction_cues, m.matched_cues, m.reference_chars,
       m.character_edits, m.exact_cues, m.start_error_sum, m.end_error_sum, m.in_tolerance_cues,
       CAST(m.matched_cues AS DOUBLE) / m.reference_cues AS coverage,
       coalesce(CAST(m.matched_cues AS DOUBLE) / k.prediction_cues, 0) AS cue_precision,
       CAST(m.character_edits AS DOUBLE) / m.reference_chars AS cer,
       CAST(m.exact_cues AS DOUBLE) / m.reference_cues AS exact_match_cue_rate,
       CASE WHEN m.matched_cues > 0 THEN CAST(m.start_error_sum AS DOUBLE) / m.matched_cues END AS timing_start_abs_error_ms,
       CASE WHEN m.matched_cues > 0 THEN CAST(m.in_tolerance_cues AS DOUBLE) / m.matched_cues END AS timing_within_tolerance_rate
FROM (SELECT e.engine_id, r.episode_id, count(*) AS reference_cues, count(p.cue_index) AS matched_cues,
             CAST(sum(length(trim(regexp_replace(r.text, '\\s+', ' ', 'g')))) AS BIGINT) AS reference_chars,
             CAST(sum({lev("trim(regexp_replace(r.text, '\\s+', ' ', 'g'))",
                           "coalesce(trim(regexp_replace(p.text, '\\s+', ' ', 'g')), '')")}) AS BIGINT) AS character_edits,
             count(*) FILTER (trim(regexp_replace(r.text, '\\s+', ' ', 'g')) =
                              coalesce(trim(regexp_replace(p.text, '\\s+', ' ', 'g')), '')) AS exact_cues,
             CAST(coalesce(sum(abs(r.start_ms - p.start_ms)), 0) AS BIGINT) AS start_error_sum,
             CAST(coalesce(sum(abs(r.end_ms - p.end_ms)), 0) AS BIGINT) AS end_error_sum,
             count(*) FILTER (abs(r.start_ms - p.start_ms) <= 200 AND abs(r.end_ms - p.end_ms) <= 200) AS in_tolerance_cues
      FROM cues_ref r CROSS JOIN (SELECT unnest(['base', 'cand']) AS engine_id) e
      LEFT JOIN engine_preds p ON p.engine_id = e.engine_id AND p.episode_id = r.episode_id AND p.cue_index = r.cue_index
           AND 2 * (least(p.end_ms, r.end_ms) - greatest(p.start_ms, r.start_ms)) >= r.end_ms - r.start_ms
      GROUP BY 1, 2) m
LEFT JOIN (SELECT engine_id, episode_id, count(*) AS prediction_cues FROM engine_preds GROUP BY 1, 2) k
     ON m.engine_id = k.engine_id AND m.episode_id = k.episode_id""")
_A4 = ["engine_id", "episode_id", "reference_cues", "prediction_cues", "matched_cues", "reference_chars",
       "character_edits", "exact_cues", "start_error_sum", "end_error_sum", "in_tolerance_cues", "coverage",
       "cue_precision", "cer", "exact_match_cue_rate", "timing_start_abs_error_ms", "timing_within_tolerance_rate"]


@query("a4_cue_score_indexed", f"SELECT {', '.join(_A4)} FROM scored_episodes", ("scored_episodes",))
def a4_indexed(spark, sf):
    return _episode_scores(spark, sf, "indexed").select(*_A4)


@query("a5_micro_macro")
def a5(spark, sf):
    return scoring.micro_macro(_episode_scores(spark, sf), ["engine_id"])


@query("a5_micro_macro_indexed", """
SELECT engine_id, count(*) AS groups, CAST(sum(matched_cues) AS BIGINT) AS matched_cues,
       CAST(sum(character_edits) AS DOUBLE) / sum(reference_chars) AS cer,
       CAST(sum(matched_cues) AS DOUBLE) / sum(reference_cues) AS coverage,
       CAST(sum(start_error_sum) AS DOUBLE) / sum(matched_cues) AS timing_start_abs_error_ms,
       round(avg(cer), 6) AS macro_cer, round(avg(coverage), 6) AS macro_coverage,
       round(avg(timing_start_abs_error_ms), 6) AS macro_timing_start_abs_error_ms
FROM scored_episodes GROUP BY engine_id""", ("scored_episodes",))
def a5_indexed(spark, sf):
    out = scoring.micro_macro(_episode_scores(spark, sf, "indexed"), ["engine_id"])
    macro = ["macro_cer", "macro_coverage", "macro_timing_start_abs_error_ms"]
    return out.select("engine_id", "groups", "matched_cues", "cer", "coverage", "timing_start_abs_error_ms",
                      *[F.round(m, 6).alias(m) for m in macro])


@query("t1_worst_pairs", f"""
SELECT episode_id, p_cue_index, r_cue_index, r_text, p_text, cer, start_diff_ms, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY cer DESC, p_cue_index) AS rank FROM (
    SELECT episode_id, p_cue_index, r_cue_index, r_text, p_text, p_start_ms - r_start_ms AS start_diff_ms,
           round_even(CAST({lev('r_text', 'p_text')} AS DOUBLE) / length(r_text), 6) AS cer FROM greedy_pairs) a) b
WHERE rank <= 10""", ("greedy_pairs",))
def t1(spark, sf):
    return scoring.worst_pairs(_greedy(spark, sf)[0])


@query("t2_unmatched_examples", """
SELECT side, episode_id, cue_index, text, rank FROM (
  SELECT side, episode_id, cue_index, text,
         row_number() OVER (PARTITION BY side, episode_id ORDER BY cue_index) AS rank FROM (
    SELECT 'reference' AS side, episode_id, cue_index, text FROM cues_ref r
    WHERE NOT EXISTS (SELECT 1 FROM greedy_pairs i WHERE i.episode_id = r.episode_id AND i.r_cue_index = r.cue_index)
    UNION ALL
    SELECT 'prediction', episode_id, cue_index, text FROM cues_pred p
    WHERE NOT EXISTS (SELECT 1 FROM greedy_pairs i WHERE i.episode_id = p.episode_id AND i.p_cue_index = p.cue_index)) u) w
WHERE rank <= 5""", ("cues_ref", "cues_pred", "greedy_pairs"))
def t2(spark, sf):
    pairs, pred, ref = _greedy(spark, sf)
    cols = ["episode_id", "cue_index", "text"]
    both = (align.unmatched(ref, pairs, "r").select(F.lit("reference").alias("side"), *cols)
            .unionByName(align.unmatched(pred, pairs, "p").select(F.lit("prediction").alias("side"), *cols)))
    return align.first_per_key(both, ["side", "episode_id"], [F.col("cue_index")], 5)


@query("a16_drift_report", f"""
SELECT count(*) AS points, round(avg(cer), 9) AS mean_cer, max(cer) AS max_cer,
       max(CASE WHEN chars >= 10 THEN cer END) AS max_long_cer,
       CASE WHEN max(cer) = 0 THEN 'unchanged'
            WHEN avg(cer) > 0.02 OR max(CASE WHEN chars >= 10 THEN cer END) > 0.15 THEN 'suspect'
            ELSE 'small_drift' END AS verdict
FROM (SELECT greatest(length(r.text), length(p.text)) AS chars,
             CAST({lev('r.text', 'p.text')} AS DOUBLE) / greatest(length(r.text), length(p.text)) AS cer
      FROM cues_ref r JOIN cues_pred p ON r.episode_id = p.episode_id AND r.cue_index = p.cue_index) t""",
       ("cues_ref", "cues_pred"))
def a16(spark, sf):
    read = F.lit(True).alias("was_read")
    points, verdict = scoring.drift_report(
        v.cues_ref(spark, sf).select("episode_id", "cue_index", "text", read),
        v.cues_pred(spark, sf).select("episode_id", "cue_index", "text", read), ["episode_id", "cue_index"])
    return verdict.withColumn("mean_cer", F.round("mean_cer", 9))
