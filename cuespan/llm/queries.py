"""Queries of this subpackage, each over its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan.llm import bpe, chat, collocations, divergence, forest, hamming, jaccard, language, mixing, packing, pii, token_files, toxicity
from cuespan.llm.common import crc_mod, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql.strip()
        return fn

    return register


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_multi_index_hashing", """
WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, r.vec_id,
             CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.bits[i] <> r.bits[i] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
      FROM b q JOIN b r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) r WHERE rank <= 10""")
def op1(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", hamming.sign_code("embedding").alias("code"))
    return hamming.search(rows, rows.where("vec_id % 50 = 0"), 10)


@query("op2_perspective_rotation", """
WITH v AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL),
r AS (SELECT c.conv_id, perspective, turn, role, text, coalesce(role = perspective, false) AS trained,
             CASE WHEN role = perspective THEN '<|assistant|>' || chr(10)
                  ELSE '<|user name=' || coalesce(replace(role, '<|', '< |'), 'unknown') || '|>' || chr(10) END AS head
      FROM conversations c JOIN v ON c.conv_id IS NOT DISTINCT FROM v.conv_id),
f AS (SELECT *, head || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS rendered FROM r),
p AS (SELECT *, coalesce(sum(length(rendered)) OVER w, 0) AS start, count(*) OVER w AS position FROM f
      WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, role, rendered, CAST(start AS BIGINT) AS start,
       CAST(start + CASE WHEN trained THEN length(head) ELSE 0 END AS BIGINT) AS mask_start,
       CAST(start + CASE WHEN trained THEN length(rendered) - 1 ELSE 0 END AS BIGINT) AS mask_end, trained
FROM p""")
def op2(spark, sf):
    return chat.rotate(read(spark, sf, "conversations"))


@query("op3_bpe_transducer")
def op3(spark, sf):
    return bpe.digests(read(spark, sf, "documents"), vocabulary_path("word_bpe_49k.json"))


@query("op4_class_kneser_ney")
def op4(spark, sf):
    docs = read(spark, sf, "documents")
    scorer = toxicity.train(docs, read(spark, sf, "labels"), crc_mod("doc_id", 4) != 2)
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return toxicity.score(docs, scorer).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op5_cross_parsing_language")
def op5(spark, sf):
    docs = read(spark, sf, "documents")
    parser = language.train(docs, crc_mod("doc_id", 3) != 1)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return language.predict(docs, parser).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_sum_of_squares_packing")
def op6(spark, sf):
    return packing.pack_documents(read(spark, sf, "documents"), vocabulary_path("word_bpe_49k.json"), 2048)


@query("op7_dictionary_token_files")
def op7(spark, sf):
    return token_files.write(read(spark, sf, "documents"), vocabulary_path("byte_bpe_50k.json")).documents()


@query("op8_projection_forest")
def op8(spark, sf):
    rows = read(spark, sf, "embeddings")
    return forest.search(rows, rows.where("vec_id % 100 = 0"), 10)


@query("op9_word_shape_field")
def op9(spark, sf):
    return pii.scan(read(spark, sf, "documents"))


@query("op10_heavy_light_jaccard", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS set FROM w),
c AS (SELECT min(doc_id) AS rep, max(len(set)) AS n, list_sort(set) AS key FROM s WHERE len(set) > 0 GROUP BY list_sort(set)),
e AS (SELECT rep, n, unnest(key) AS shingle FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS n, b.n AS m, count(*) AS i FROM e a JOIN e b ON a.shingle = b.shingle AND a.rep <> b.rep GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (n + m - i)),
r(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a AS rep, min(b) AS root FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(set) AS BIGINT) AS n_shingles, coalesce(g.root, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.key = list_sort(s.set) AND len(s.set) > 0 LEFT JOIN g ON g.rep = c.rep""")
def op10(spark, sf):
    return jaccard.join(read(spark, sf, "documents"))


@query("op11_late_string_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS whole FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
l AS (SELECT lang, count(*) AS v, sum(whole) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v) AS p,
             1 + (1000000000::HUGEINT * (whole + 5)) // (l.total + 5 * v) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN l ON g.lang = l.lang LEFT JOIN s ON g.lang = s.lang AND g.source = s.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) x
WHERE part = 'pair' OR rank <= 50""")
def op11(spark, sf):
    return divergence.audit(read(spark, sf, "documents"))


@query("op12_pivotal_mixture")
def op12(spark, sf):
    return mixing.mix(read(spark, sf, "documents"))


@query("op13_best_first_collocations", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, row_number() OVER () AS pid, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, pid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
o AS (SELECT lang, w, lead(w, 1) OVER v AS w2, lead(w, 2) OVER v AS w3, lead(w, 3) OVER v AS w4 FROM t WINDOW v AS (PARTITION BY pid ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, 1 AS m, w AS phrase, count(*) AS a FROM o GROUP BY ALL
  UNION ALL SELECT lang, 2, w || ' ' || w2, count(*) FROM o WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM o WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM o WHERE w4 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND a >= 30),
x AS (SELECT c.lang, c.m, c.phrase, c.a, k, one.a AS l, two.a AS r, (2000000::HUGEINT * c.a) // (one.a + two.a) AS score
      FROM c JOIN (VALUES (1), (2), (3)) t(k) ON k < m
      JOIN f one ON one.lang = c.lang AND one.phrase = array_to_string(ws[1:k], ' ')
      JOIN f two ON two.lang = c.lang AND two.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT c.lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS most
      FROM c JOIN (VALUES (2), (3)) u(s) ON s < m JOIN (VALUES (1), (2), (3)) v(i) ON i + s - 1 <= m GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE most IS NULL OR 100 * most < 80 * a)
SELECT z.lang, rank, z.phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000""")
def op13(spark, sf):
    return collocations.mine(read(spark, sf, "documents"))
