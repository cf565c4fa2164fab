"""Token repair and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.operators import learning, repair
from cuespan.plans import views as v
from cuespan.plans.registry import query, sql_view
from cuespan.session import cut_lineage

# misread words: dots added, one letter swallowed, one letter replaced, two fused
sql_view("misread", ("word_counts",), """
SELECT DISTINCT CASE WHEN length(word) % 4 = 0 THEN translate(word, 'sg', 'şğ')
                     WHEN length(word) % 4 = 1 THEN substr(word, 1, 2) || substr(word, 4)
                     WHEN length(word) % 4 = 2 THEN substr(word, 1, 1) || 'b' || substr(word, 3)
                     ELSE word END AS token FROM word_counts""")


def _misread(spark, sf):
    w, n = F.col("word"), F.length("word")
    return v.word_counts(spark, sf).select(
        F.when(n % 4 == 0, F.translate(w, "sg", "şğ"))
        .when(n % 4 == 1, F.concat(F.substring(w, 1, 2), F.expr("substr(word, 4)")))
        .when(n % 4 == 2, F.concat(F.substring(w, 1, 1), F.lit("b"), F.expr("substr(word, 3)")))
        .otherwise(w).alias("token")).distinct()


_DOT = "translate({0}, 'şçği', 'scgı')"
_FLIPS = "len(list_filter(list_zip(string_split({0}, ''), string_split({1}, '')), lambda z: z[1] <> z[2]))"
_SPOTS = "length(regexp_replace({0}, '[^şsçcğgıi]', '', 'g'))"

sql_view("dot_neighbours", ("misread", "word_counts"), f"""
SELECT * FROM (SELECT m.token, d.word AS cand, d.freq, CAST({_FLIPS.format('m.token', 'd.word')} AS BIGINT) AS flips
  FROM misread m JOIN word_counts d ON {_DOT.format('m.token')} = {_DOT.format('d.word')}
  WHERE {_SPOTS.format('m.token')} BETWEEN 1 AND 12) t WHERE flips BETWEEN 1 AND 2""")


@query("j6_dictionary_lookup", """
SELECT m.token, d.freq FROM misread m LEFT JOIN word_counts d ON d.word = m.token""", ("misread", "word_counts"))
def j6(spark, sf):
    words = v.word_counts(spark, sf).withColumnRenamed("word", "token")
    return _misread(spark, sf).join(words, "token", "left")


@query("r1_diacritic_variants", "SELECT token, cand, freq, flips FROM dot_neighbours", ("dot_neighbours",))
def r1_dots(spark, sf):
    return repair.diacritic_neighbours(_misread(spark, sf), v.word_counts(spark, sf))


@query("r1_token_variants", f"""
SELECT token, cand, freq, 'diacritic' AS kind FROM dot_neighbours
UNION ALL
SELECT token, cand, freq, 'replace' FROM (
  SELECT DISTINCT m.token, d.word AS cand, d.freq, substr(d.word, CAST(m.i AS INTEGER), 1) AS letter FROM
    (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM misread WHERE length(token) <= 14) m
    JOIN (SELECT word, freq, unnest(range(1, length(word) + 1)) AS i FROM word_counts WHERE length(word) <= 14) d
      ON m.i = d.i AND substr(m.token, 1, CAST(m.i AS INTEGER) - 1) || '_' || substr(m.token, CAST(m.i AS INTEGER) + 1)
                     = substr(d.word, 1, CAST(d.i AS INTEGER) - 1) || '_' || substr(d.word, CAST(d.i AS INTEGER) + 1)
  WHERE m.token <> d.word) r WHERE contains('{K.ALPHABET}', letter)
UNION ALL
SELECT DISTINCT m.token, d.word, d.freq, 'insert' FROM misread m
  JOIN (SELECT word, freq, unnest(range(1, length(word) + 1)) AS i FROM word_counts WHERE length(word) <= 15) d
    ON m.token = substr(d.word, 1, CAST(d.i AS INTEGER) - 1) || substr(d.word, CAST(d.i AS INTEGER) + 1)
 WHERE length(m.token) <= 14 AND contains('{K.ALPHABET}', substr(d.word, CAST(d.i AS INTEGER), 1))
UNION ALL
SELECT DISTINCT m.token, d.word, d.freq, 'delete' FROM (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM misread) m
  JOIN word_counts d ON d.word = substr(m.token, 1, CAST(m.i AS INTEGER) - 1) || substr(m.token, CAST(m.i AS INTEGER) + 1)""",
       ("dot_neighbours",))
def r1(spark, sf):
    return repair.token_variants(_misread(spark, sf), v.word_counts(spark, sf))


@query("r2_dominant", """
SELECT token, arg_max(cand, freq) AS better, max(freq) AS freq FROM (
  SELECT *, row_number() OVER (PARTITION BY token ORDER BY freq DESC) AS rn FROM (
    SELECT token, cand, freq FROM dot_neighbours
    UNION ALL SELECT m.token, d.word, d.freq FROM misread m JOIN word_counts d ON d.word = m.token) u) t
GROUP BY token
HAVING max(freq) >= 50 AND coalesce(max(freq) >= 10 * max(freq) FILTER (rn = 2), TRUE)""", ("dot_neighbours",))
def r2(spark, sf):
    tokens, words = _misread(spark, sf), v.word_counts(spark, sf)
    pool = repair.diacritic_neighbours(tokens, words).drop("flips").unionByName(repair._self_entries(tokens, words))
    return repair.dominant(pool)


def _frequent(spark, sf):
    """Counts as if the corpus were larger, so that repair thresholds apply."""
    # stored once: every repair rule joins the dictionary again
    return cut_lineage(v.word_counts(spark, sf).withColumn("freq", F.col("freq") * 40))


@query("r3_word_repair")
def r3(spark, sf):
    tokens = _misread(spark, sf)
    return repair.word_repair(tokens.select(F.col("token").alias("surface")), _frequent(spark, sf))


@query("r4_split_fused")
def r4(spark, sf):
    """Neighbouring words of every line, written without the blank."""
    words = v.lines(spark, sf).select(F.explode(F.expr(
        "transform(sequence(0, size(split(text, ' ')) - 1), i -> concat(lower(split(text, ' ')[i]), coalesce(lower(get(split(text, ' '), i + 1)), '')))")).alias("token"))
    fused = words.distinct()
    known = v.word_counts(spark, sf).select(F.col("word").alias("token"))
    return repair.split_fused(fused.join(known, "token", "left_anti"), _frequent(spark, sf))


@query("r5_line_cleanup")
def r5(spark, sf):
    t = F.col("text")
    dirty = (F.when(F.length(t) % 3 == 0, F.concat(F.lit("'"), t)).when(F.length(t) % 3 == 1, F.expr("replace(text, '.', ' .')"))
             .otherwise(F.expr("replace(text, '.', '_')")))
    rows = v.blocks(spark, sf).withColumn("text", dirty)
    return repair.cleanup_lines(rows, ("video_id", "block_no"))[0]


@query("r5_cleanup_log")
def r5_log(spark, sf):
    rows = v.blocks(spark, sf).withColumn("text", F.expr("replace(text, '.', ' .')"))
    return repair.cleanup_lines(rows, ("video_id", "block_no"))[1]


_RULES = [("the", "teh"), ("teh", "THE"), ("en", "n"), (" de ", " dé ")]


@query("r6_apply_rules", """
SELECT video_id, block_no, replace(replace(replace(replace(text, 'the', 'teh'), 'teh', 'THE'), 'en', 'n'), ' de ', ' dé ') AS text,
       CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS first_rule
FROM blocks""", ("blocks",))
def r6(spark, sf):
    out = repair.apply_rules(v.blocks(spark, sf), _RULES)
    first = F.filter("applied", lambda a: a["old"] == "the")
    return out.select("video_id", "block_no", "text", F.coalesce(F.get(first, F.lit(0))["n"], F.lit(0)).alias("first_rule"))


def _lessons(spark, sf):
    """Cues whose reading lost letters, next to what an editor restored."""
    # stored: both sides of the alignment and their texts follow from one pass
    cues = cut_lineage(v.cues_ref(spark, sf))
    auto = cues.withColumn("text", F.when(F.length("text") % 3 == 0, F.expr("replace(text, 'the', 'tke')"))
                           .when(F.length("text") % 3 == 1, F.translate("text", "sg", "şğ"))
                           .otherwise(F.expr("replace(text, ' ere', 'ere')")))
    return auto, cues


def _word_pairs(spark, sf):
    auto, cues = _lessons(spark, sf)
    joined = auto.select("episode_id", "cue_index", F.col("text").alias("a")).join(
        cues.select("episode_id", "cue_index", F.col("text").alias("b")), ["episode_id", "cue_index"]).where("a <> b")
    return joined.select("episode_id", "cue_index", F.posexplode(learning.diff_tokens("a", "b")).alias("at", "d")).select(
        "episode_id", "cue_index", "at", "d.*")


@query("r7_diff_tokens")
def r7(spark, sf):
    return _word_pairs(spark, sf)


@query("r8_classify_pair")
def r8(spark, sf):
    return learning.classify_pairs(_word_pairs(spark, sf), _frequent(spark, sf))


# every word teaches its successor's spelling: many repeats and conflicts
sql_view("arrivals", (), """
SELECT event_id AS arrival, event_type || user_id % 40 AS old, event_type || CAST(floor(value) AS BIGINT) % 3 AS new FROM events""")
sql_view("rules", (), "SELECT DISTINCT 'click' || user_id % 40 AS old, 'click1' AS new FROM events")


def _arrivals(spark, sf):
    return v.table(spark, sf, "events").select(
        F.col("event_id").alias("arrival"), F.expr("event_type || user_id % 40").alias("old"),
        F.expr("event_type || cast(floor(value) AS bigint) % 3").alias("new"))


def _known_rules(spark, sf):
    return v.table(spark, sf, "events").select(F.expr("'click' || user_id % 40").alias("old"), F.lit("click1").alias("new")).distinct()


_LEARNED = """
SELECT a.arrival, a.old, a.new, CASE WHEN r.new IS NULL AND a.arrival = f.first_at THEN 'eklendi'
       WHEN a.new = coalesce(r.new, f.first_new) THEN 'zaten_var' ELSE 'catisma' END AS outcome, coalesce(r.new, f.first_new) AS held
FROM arrivals a JOIN (SELECT old, min(arrival) AS first_at, arg_min(new, arrival) AS first_new FROM arrivals GROUP BY old) f
  ON f.old = a.old LEFT JOIN rules r ON r.old = a.old"""
sql_view("learned", ("arrivals", "rules"), _LEARNED)


@query("r9_learn_rules", "SELECT * FROM learned", ("learned",))
def r9(spark, sf):
    return learning.learn_rules(_arrivals(spark, sf), _known_rules(spark, sf))


@query("r9_merged_rules", "SELECT old, new FROM rules UNION ALL SELECT old, new FROM learned WHERE outcome = 'eklendi'", ("learned", "rules"))
def r9_merged(spark, sf):
    rules = _known_rules(spark, sf)
    return learning.merged_rules(learning.learn_rules(_arrivals(spark, sf), rules), rules)


@query("r9_teach_rules", """
SELECT old, arg_max(new, arrival) AS new, min(arrival) AS rule_order FROM arrivals GROUP BY old""", ("arrivals",))
def r9_teach(spark, sf):
    return learning.teach_rules(_arrivals(spark, sf).withColumnRenamed("arrival", "lesson"))


@query("a18_learn_summary", """
SELECT count(*) FILTER (outcome = 'eklendi') AS added, count(*) FILTER (outcome = 'zaten_var') AS already,
       count(*) FILTER (outcome = 'catisma') AS conflict FROM learned""", ("learned",))
def a18(spark, sf):
    outcomes = learning.learn_rules(_arrivals(spark, sf), _known_rules(spark, sf))
    return outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (
        ("eklendi", "added"), ("zaten_var", "already"), ("catisma", "conflict"))])


@query("r10_learn_round")
def r10(spark, sf):
    auto, edited = _lessons(spark, sf)
    none = v.word_counts(spark, sf).where("freq < 0").selectExpr("word AS old", "word AS new")
    return learning.learn_round(auto, edited, _frequent(spark, sf), none)[1].groupBy("old", "held", "outcome").agg(
        F.count("*").alias("n"))


@query("s10_read_dictionary", """
SELECT word, arg_min(freq, line_no) AS freq FROM (
  SELECT doc_id * 2 + 1 AS line_no, source || lang AS word, n_chars AS freq FROM documents) t GROUP BY word""")
def s10(spark, sf):
    from cuespan.sources.dictionary import first_wins
    lines = v.table(spark, sf, "documents").select(
        (F.col("doc_id") * 2 + 1).alias("line_no"), F.concat("source", "lang").alias("word"), F.col("n_chars").alias("freq"))
    return first_wins(lines)


@query("a22_word_vote", """
SELECT old, new, count(DISTINCT contributor) AS voters, CASE WHEN count(DISTINCT contributor) >= 2 THEN 'accepted' ELSE 'candidate' END AS status
FROM (SELECT user_id AS contributor, event_type || event_id % 97 AS old, 'w' || event_id % 13 AS new FROM events) v GROUP BY 1, 2""")
def a22(spark, sf):
    votes = v.table(spark, sf, "events").selectExpr(
        "user_id AS contributor", "event_type || event_id % 97 AS old", "'w' || event_id % 13 AS new")
    return learning.word_vote(votes)
