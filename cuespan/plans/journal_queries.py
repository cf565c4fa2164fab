"""Review, proposal, memory and glossary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan.functions import text as tx
from cuespan.functions.keys import scope_id
from cuespan.functions.ordered import with_neighbours
from cuespan.operators import journal, memory
from cuespan.plans import views as v
from cuespan.plans.registry import query, sql_view

_BOUND = """e.manifest_sha = c.manifest_sha AND e.crop_sha = c.crop_sha AND c.crop_valid"""

sql_view("bound", ("journal", "pack_cues"), f"""
SELECT e.*, c.ocr_text FROM journal e JOIN pack_cues c ON c.cue_id = e.cue_id WHERE {_BOUND}""")
sql_view("active", ("bound",), """
SELECT cue_id, line_no, event_id, kind, verified_text FROM (
  SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY line_no DESC) AS rn FROM (
    SELECT *, last_value(CASE WHEN review THEN event_id END IGNORE NULLS) OVER (PARTITION BY cue_id ORDER BY line_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current FROM (
      SELECT *, CASE kind WHEN 'accepted' THEN verified_text = ocr_text WHEN 'corrected' THEN trim(verified_text) <> ''
                WHEN 'uncertain' THEN verified_text = '' ELSE FALSE END AS review FROM bound) a
    WHERE review OR kind = 'undo') b
  WHERE review OR undo_id = current) c WHERE rn = 1 AND review""")


def _bound(spark, sf):
    return journal.bind_events(v.journal(spark, sf), v.pack_cues(spark, sf))


def _active(spark, sf):
    return journal.active_reviews(_bound(spark, sf)[0])


@query("e1_active_reviews", "SELECT * FROM active", ("active",))
def e1(spark, sf):
    return _active(spark, sf)


@query("j13_event_cue_binding", f"""
SELECT e.event_id, c.cue_id IS NOT NULL AS bound FROM journal e LEFT JOIN pack_cues c ON c.cue_id = e.cue_id AND {_BOUND}""",
       ("journal", "pack_cues"))
def j13(spark, sf):
    good, bad = _bound(spark, sf)
    return good.select("event_id", F.lit(True).alias("bound")).unionByName(bad.select("event_id", F.lit(False).alias("bound")))


@query("e2_export_verified", """
SELECT c.cue_id, a.verified_text AS source_text_verified, 'crops/' || c.crop_sha || '.jpg' AS crop_path,
       c.crop_sha AS crop_sha256_local, c.start_ms, c.end_ms, c.ocr_confidence, a.event_id AS review_event_id
FROM pack_cues c JOIN active a ON a.cue_id = c.cue_id WHERE c.crop_valid AND a.kind IN ('accepted', 'corrected')""",
       ("active", "pack_cues"))
def e2(spark, sf):
    return journal.export_verified(v.pack_cues(spark, sf), _active(spark, sf))


sql_view("sources", ("active", "pack_cues"), """
SELECT c.*, a.event_id, a.kind, a.verified_text FROM pack_cues c JOIN active a ON a.cue_id = c.cue_id
WHERE c.crop_valid AND a.kind IN ('accepted', 'corrected') AND trim(a.verified_text) <> ''""")


def _sources(spark, sf):
    return journal.verified_sources(v.pack_cues(spark, sf), _active(spark, sf))


@query("j22_verified_sources", "SELECT cue_id, event_id, kind, verified_text FROM sources", ("sources",))
def j22(spark, sf):
    return _sources(spark, sf).select("cue_id", "event_id", "kind", "verified_text")


@query("a19_review_progress", """
SELECT c.pack_id, count(*) AS candidates, count(a.cue_id) AS reviewed FROM pack_cues c LEFT JOIN active a ON a.cue_id = c.cue_id
GROUP BY c.pack_id""", ("active", "pack_cues"))
def a19(spark, sf):
    return journal.review_progress(v.pack_cues(spark, sf), _active(spark, sf))


@query("j20_review_view", """
SELECT c.cue_id, a.event_id, a.kind, CASE WHEN c.cue_id % 4 = 0 THEN c.end_ms || ' ' || (c.end_ms + 300) || ' ' || 300 END AS raw_end_note
FROM pack_cues c LEFT JOIN active a ON a.cue_id = c.cue_id""", ("active", "pack_cues"))
def j20(spark, sf):
    cues = v.pack_cues(spark, sf).withColumns({
        "clamp_status": F.when(F.col("cue_id") % 4 == 0, "matched").otherwise("unavailable"), "clamp_srt_sha": F.col("srt_sha"),
        "raw_end_ms": F.col("end_ms") + 300, "clamp_delta_ms": F.lit(300)})
    return journal.review_view(cues, _active(spark, sf)).select("cue_id", "event_id", "kind", "raw_end_note")


@query("j15_clamp_attach", """
SELECT srt_sha, cue_index, start_f, end_f, end_ms, raw_end_ms, clamp_delta_ms FROM (
  SELECT 's1' AS srt_sha, block_no AS cue_index, start_f, end_f, end_ms, raw_end_ms, clamp_delta_ms FROM (
    SELECT *, CAST(round_even(emitted * 1000, 0) AS BIGINT) AS end_ms, CAST(round_even(raw * 1000, 0) AS BIGINT) AS raw_end_ms,
           round_even((raw - emitted) * 1000, 3) + CASE WHEN block_no % 5 = 0 THEN 2 ELSE 0 END AS clamp_delta_ms, video_id AS vid
    FROM (SELECT *, (end_f + 1) / 24.0::DOUBLE AS raw, least((end_f + 1) / 24.0::DOUBLE,
                 lead(start_f) OVER (PARTITION BY video_id ORDER BY block_no) / 24.0::DOUBLE) AS emitted FROM blocks) a) b
  WHERE clamp_delta_ms > 0 AND raw_end_ms > end_ms AND abs(clamp_delta_ms - (raw_end_ms - end_ms)) <= 1.001) c""", ("blocks",))
def j15(spark, sf):
    from cuespan.operators import lint
    clamped = lint.end_clamp(v.blocks(spark, sf), v.FPS).withColumn("srt_sha", F.concat(F.lit("s"), "video_id"))
    cues = clamped.select("srt_sha", F.col("block_no").alias("cue_index"), "start_f", "end_f", "end_ms")
    clamps = clamped.where("clamp_delta_ms IS NOT NULL").select(
        "srt_sha", F.col("block_no").alias("cue_index"), "start_f", "end_f", F.col("end_ms").alias("emitted_end_ms"), "raw_end_ms",
        (F.col("clamp_delta_ms") + F.when(F.col("block_no") % 5 == 0, 2).otherwise(0)).alias("clamp_delta_ms"))
    return journal.clamp_attach(cues, clamps).withColumn("srt_sha", F.lit("s1"))


# --- proposals ------------------------------------------------------------------
# every purchase proposes a translation for its cue; some imports are repeated
sql_view("proposals", ("sources", "journal"), """
SELECT j.line_no, j.event_id AS proposal_id, j.event_id // 4 AS request_id, j.cue_id,
       CASE WHEN j.event_id % 3 = 0 THEN j.event_id ELSE s.event_id END AS source_event_id, s.verified_text AS source_text,
       'draft ' || j.event_id % 6 AS draft
FROM journal j JOIN sources s ON s.cue_id = j.cue_id WHERE j.kind <> 'undo'""")
sql_view("decisions", ("proposals",), """
SELECT line_no + 1000000 AS line_no, proposal_id + 1000000 AS event_id, proposal_id, cue_id,
       CASE proposal_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'edited' WHEN 2 THEN 'rejected' ELSE 'maybe' END AS decision,
       'target ' || proposal_id % 9 AS translation FROM proposals
UNION ALL
SELECT line_no + 2000000, proposal_id + 2000000, proposal_id, cue_id, 'rejected', 'late' FROM proposals""")


def _proposals(spark, sf):
    src = _sources(spark, sf).select("cue_id", F.col("event_id").alias("s_event"), F.col("verified_text").alias("source_text"))
    return v.journal(spark, sf).where("kind <> 'undo'").select("line_no", "event_id", "cue_id").join(src, "cue_id").selectExpr(
        "line_no", "event_id AS proposal_id", "event_id div 4 AS request_id", "cue_id",
        "if(event_id % 3 = 0, event_id, s_event) AS source_event_id", "source_text", "'draft ' || event_id % 6 AS draft")


def _decisions(proposals):
    return proposals.selectExpr(
        "cue_id", "proposal_id", "explode(array(named_struct('l', line_no + 1000000, 'e', proposal_id + 1000000, "
        "'d', element_at(array('accepted', 'edited', 'rejected', 'maybe'), cast(proposal_id % 4 AS int) + 1), 't', 'target ' || proposal_id % 9), "
        "named_struct('l', line_no + 2000000, 'e', proposal_id + 2000000, 'd', 'rejected', 't', 'late'))) AS x").selectExpr(
        "x.l AS line_no", "x.e AS event_id", "proposal_id", "cue_id", "x.d AS decision", "x.t AS translation")


sql_view("proposal_states", ("proposals", "decisions", "sources"), """
SELECT p.request_id, p.cue_id, p.line_no, p.proposal_id, p.source_event_id, p.source_text, p.draft, d.line_no AS decision_line,
       d.event_id AS decision_event_id, coalesce(d.decision, 'pending') AS decision, d.translation
FROM (SELECT *, row_number() OVER (PARTITION BY request_id, cue_id ORDER BY line_no) AS rn FROM proposals) p
JOIN sources s ON s.cue_id = p.cue_id AND s.event_id = p.source_event_id AND s.verified_text = p.source_text
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY proposal_id, cue_id ORDER BY line_no) AS rn FROM decisions
           WHERE decision IN ('accepted', 'edited', 'rejected')) d ON d.proposal_id = p.proposal_id AND d.cue_id = p.cue_id AND d.rn = 1
WHERE p.rn = 1""")


def _states(spark, sf):
    proposals = _proposals(spark, sf)
    return journal.proposal_state(proposals, _decisions(proposals), _sources(spark, sf))


@query("e3_proposal_state", "SELECT * FROM proposal_states", ("proposal_states",))
def e3(spark, sf):
    return _states(spark, sf)


sql_view("memory_rows", ("proposal_states",), """
SELECT substr(sha256('translation-memory-v1:' || decision_event_id), 1, 32) AS memory_id, source_text AS verified_source_text,
       translation AS approved_translation, cue_id, proposal_id, decision_event_id
FROM proposal_states WHERE decision IN ('accepted', 'edited')""")


@query("e4_memory_from_decisions", "SELECT * FROM memory_rows", ("memory_rows",))
def e4(spark, sf):
    return memory.memory_from_decisions(_states(spark, sf))


@query("j16_decision_to_memory", "SELECT decision_event_id FROM memory_rows WHERE cue_id % 3 <> 0", ("memory_rows",))
def j16(spark, sf):
    rows = memory.memory_from_decisions(_states(spark, sf))
    return memory.not_in_memory(rows, rows.where("cue_id % 3 = 0")).select("decision_event_id")


@query("e9_ai_proposals", """
SELECT request_id, response_sha, min(line_no) AS line_no, arg_min(cue_id, line_no) AS cue_id, arg_min(proposal, line_no) AS proposal
FROM (SELECT event_id AS line_no, user_id AS request_id, sha256(event_type) AS response_sha, event_id % 100 AS cue_id,
             'p' || event_id AS proposal FROM events) t GROUP BY 1, 2""")
def e9(spark, sf):
    return journal.ai_proposals(v.table(spark, sf, "events").selectExpr(
        "event_id AS line_no", "user_id AS request_id", "sha2(event_type, 256) AS response_sha", "event_id % 100 AS cue_id",
        "'p' || event_id AS proposal"))


# --- memory journal ---------------------------------------------------------------
# a scope per customer segment of users; clicks roll back the entry 40 lines before
_TM = """
SELECT user_id % 20 AS scope_id, event_id AS line_no, event_id,
       CASE WHEN event_type = 'click' AND user_id % 20 <> 3 THEN 'skip' WHEN event_type = 'click' THEN 'rollback'
            WHEN event_type = 'view' THEN 'lexicon_add' WHEN event_type = 'error' AND user_id % 20 > 10 THEN 'rollback'
            ELSE 'translation_add' END AS event_type,
       CASE WHEN event_type = 'click' THEN -1 WHEN event_type = 'error' AND user_id % 20 > 10 THEN prior END AS undo_event_id
FROM {events}"""
sql_view("tm_events", (), _TM.replace("{events}", """(SELECT *, max(CASE WHEN event_type IN ('signup', 'purchase', 'view') THEN event_id END)
  OVER (PARTITION BY user_id % 20 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM events) e"""))


def _tm_events(spark, sf):
    from cuespan.functions.ordered import prefix_scan
    e = v.table(spark, sf, "events").withColumn("scope", F.col("user_id") % 20)
    add = F.when(F.col("event_type").isin("signup", "purchase", "view"), F.col("event_id"))
    e = prefix_scan(e, ["scope"], ["event_id"], {"prior": ("max", add)})
    return spark.sql(_TM.replace("{events}", "{e}"), e=e)


@query("e5_active_memory", """
SELECT scope_id, event_id, event_type FROM tm_events t WHERE event_type IN ('translation_add', 'lexicon_add')
 AND scope_id NOT IN (
   SELECT b.scope_id FROM tm_events b LEFT JOIN tm_events a ON a.scope_id = b.scope_id AND a.event_id = b.undo_event_id
     AND a.event_type IN ('translation_add', 'lexicon_add') AND a.line_no < b.line_no
   WHERE b.event_type = 'rollback' AND a.event_id IS NULL
   UNION ALL SELECT scope_id FROM tm_events WHERE event_type = 'rollback' GROUP BY scope_id, undo_event_id HAVING count(*) > 1)
 AND NOT EXISTS (SELECT 1 FROM tm_events b WHERE b.scope_id = t.scope_id AND b.event_type = 'rollback' AND b.undo_event_id = t.event_id)""",
       ("tm_events",))
def e5(spark, sf):
    return memory.active_memory(_tm_events(spark, sf)).select("scope_id", "event_id", "event_type")


sql_view("tm_entries", (), """
SELECT lang AS scope_id, doc_id AS line_no, text AS verified_source_text, source AS approved_translation FROM documents""")


@query("j7_tm_exact", """
SELECT q.lang AS scope_id, q.doc_id AS query_id, CASE WHEN m.targets = 1 THEN 'suggestion' WHEN m.targets > 1 THEN 'ambiguous' ELSE 'none' END AS status,
       CASE WHEN m.targets = 1 THEN m.translation END AS translation, coalesce(m.n, 0) AS entries
FROM (SELECT doc_id, lang, replace(trim(regexp_replace(lower(nfc_normalize(text)), '\\s+', ' ', 'g')), 'ß', 'ss') AS norm FROM documents) q
LEFT JOIN (SELECT scope_id, norm, count(*) AS n, count(DISTINCT approved_translation) AS targets, arg_max(approved_translation, line_no) AS translation
           FROM (SELECT *, replace(trim(regexp_replace(lower(nfc_normalize(verified_source_text)), '\\s+', ' ', 'g')), 'ß', 'ss') AS norm
                 FROM tm_entries) t GROUP BY 1, 2) m ON m.scope_id = q.lang AND m.norm = q.norm""", ("tm_entries",))
def j7(spark, sf):
    docs = v.table(spark, sf, "documents")
    entries = docs.select(
        F.col("lang").alias("scope_id"), F.col("doc_id").alias("line_no"), F.col("text").alias("verified_source_text"),
        F.col("source").alias("approved_translation"))
    queries = docs.select(F.col("lang").alias("scope_id"), F.col("doc_id").alias("query_id"), "text")
    return memory.tm_exact(queries, entries)


def _glossary(spark, sf):
    """Every word of each language, with its first document as its place."""
    words = v.table(spark, sf, "documents").select("lang", "doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    first = words.where("w <> ''").groupBy("lang", "w").agg(F.min("doc_id").alias("line_no"))
    return first.select(F.col("lang").alias("scope_id"), "line_no", F.col("w").alias("source_term"),
                                         F.upper("w").alias("target_term"))


@query("j8_lexicon_match")
def j8(spark, sf):
    languages = v.table(spark, sf, "documents").select(F.collect_set("lang")).scalar()  # each text in every scope
    texts = v.table(spark, sf, "conversations").selectExpr("conv_id * 100 + turn AS query_id", "text").withColumn(
        "scope_id", F.explode(languages))
    return memory.lexicon_suggest(texts, _glossary(spark, sf))


@query("s18_tm_projection", """
SELECT scope_id, count(*) FILTER (event_type = 'translation_add') AS translations, count(*) FILTER (event_type = 'lexicon_add') AS terms
FROM tm_events t WHERE event_type IN ('translation_add', 'lexicon_add')
 AND scope_id NOT IN (
   SELECT b.scope_id FROM tm_events b LEFT JOIN tm_events a ON a.scope_id = b.scope_id AND a.event_id = b.undo_event_id
     AND a.event_type IN ('translation_add', 'lexicon_add') AND a.line_no < b.line_no
   WHERE b.event_type = 'rollback' AND a.event_id IS NULL
   UNION ALL SELECT scope_id FROM tm_events WHERE event_type = 'rollback' GROUP BY scope_id, undo_event_id HAVING count(*) > 1)
 AND NOT EXISTS (SELECT 1 FROM tm_events b WHERE b.scope_id = t.scope_id AND b.event_type = 'rollback' AND b.undo_event_id = t.event_id)
GROUP BY scope_id""", ("tm_events",))
def s18(spark, sf):
    return memory.active_memory(_tm_events(spark, sf)).groupBy("scope_id").agg(
        F.count_if(F.col("event_type") == "translation_add").alias("translations"),
        F.count_if(F.col("event_type") == "lexicon_add").alias("terms"))


@query("f10_scope_id", """
SELECT doc_id, sha256('{"project_key":"' || source || '","source_language":"' || lang || '","target_language":"tr"}') AS scope_id FROM documents""")
def f10(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", scope_id(F.col("source"), F.upper("lang"), F.lit("TR")).alias("scope_id"))


@query("f3_normalisers", """
SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS nfc,
       trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\\s+', ' ', 'g')) AS memory_key FROM documents""")
def f3(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", tx.norm_nfc("text").alias("nfc"), tx.norm_memory("text").alias("memory_key"))


@query("f4_rep_norm", """
SELECT doc_id, trim(regexp_replace(lower(translate(text, 'çÇğĞıİöÖşŞüÜ', 'ccggiioossuu')), '[^a-z0-9]+', ' ', 'g')) AS rep_norm,
       lower(translate(text, 'Iİ', 'ıi')) AS tr_lower,
       translate(lower(translate(text, 'Iİ', 'ıi')), 'şçği', 'scgı') AS dot_norm FROM documents""")
def f4(spark, sf):
    t = F.col("text")
    return v.table(spark, sf, "documents").select(
        "doc_id", tx.rep_norm(t).alias("rep_norm"), tx.tr_lower(t).alias("tr_lower"), tx.dot_norm(tx.tr_lower(t)).alias("dot_norm"))


# every word of a pair becomes one letter of one byte; no cue of the tables has ninety different words
@query("f9_word_edits", """
SELECT episode_id, cue_index, CAST(levenshtein(array_to_string(list_transform(a, lambda x: chr(CAST(32 + list_position(v, x) AS INTEGER))), ''),
  array_to_string(list_transform(b, lambda x: chr(CAST(32 + list_position(v, x) AS INTEGER))), '')) AS BIGINT) AS words
FROM (SELECT *, list_distinct(list_concat(a, b)) AS v FROM (
  SELECT episode_id, cue_index, a, lag(a) OVER (PARTITION BY episode_id ORDER BY cue_index) AS b FROM (
    SELECT episode_id, cue_index, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS a
    FROM cues_ref) w) p WHERE b IS NOT NULL) t""", ("cues_ref",))
def f9_edits(spark, sf):
    """Each cue against the one before it: insertions, deletions and exchanges."""
    near = with_neighbours(v.cues_ref(spark, sf), ["episode_id"], ["cue_index"], ["text"]).where("prev IS NOT NULL")
    return near.select("episode_id", "cue_index", tx.word_distance(F.col("text"), F.col("prev.text")).cast("bigint").alias("words"))


@query("f9_edit_distance", """
SELECT r.episode_id, r.cue_index, CAST(len(string_split(trim(regexp_replace(r.text, '\\s+', ' ', 'g')), ' ')) AS BIGINT) AS words FROM cues_ref r""", ("cues_ref",))
def f9(spark, sf):
    """A text against itself with every word doubled: one insertion per word."""
    cues = v.cues_ref(spark, sf)
    doubled = F.array_join(F.flatten(F.transform(tx.words(F.col("text")), lambda w: F.array(w, w))), " ")
    return cues.select("episode_id", "cue_index", tx.word_distance(F.col("text"), doubled).alias("words"))
