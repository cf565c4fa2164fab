"""Joins of short intervals, stored sides of scores, and word counts of lines."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from cuespan.functions import text as tx
from cuespan.operators import intervals, scoring
from cuespan.plans import align_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("longest", [50, 79, 81, 4_000])
def test_short_and_long_spans_meet_alike(spark, longest):
    rng = random.Random(longest)
    make = lambda: [(rng.randrange(3), i, s, s + rng.choice([0, 1, 9, 10, 11, longest]))
                    for i, s in enumerate(rng.choices(range(-40, 900), k=120))]
    left, right = make(), make()
    a = spark.createDataFrame(left, "k int, a int, a_from bigint, a_to bigint")
    b = spark.createDataFrame(right, "k int, b int, b_from bigint, b_to bigint")
    joined = intervals.interval_join(a, b, ["k"], ("a_from", "a_to"), ("b_from", "b_to"), 10)
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    assert sorted(map(tuple, joined.select("a", "b").collect())) == want
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert longest in (79, 81) or ("_role" not in plan) == (longest == 50)


def test_cues_are_timed_once(spark, monkeypatch):
    made, cues = [], align_queries.v.cues_ref
    monkeypatch.setattr(align_queries.v, "cues_ref", lambda *a: made.append(a) or cues(*a))
    for query in (align_queries.j3, align_queries.a4, align_queries.a4_indexed):
        made.clear()
        query(spark, SF)
        assert len(made) == 1


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_edits_and_normal_forms(spark):
    rng = random.Random(6)
    line = lambda: "".join(rng.choices(["a", "b", "c ", " ", "  ", "\t", "é", "ü", "\x1c", "x y"], k=rng.randrange(9)))
    rows = [(i, line(), line()) for i in range(600)]
    rows += [(600 + i, a, a.replace("a", "b")) for i, (_, a, _) in enumerate(rows[:200])]
    table = spark.createDataFrame(rows, "i int, reference string, prediction string")
    normal = lambda s: " ".join(unicodedata.normalize("NFC", s).split())
    got = {r.i: r for r in scoring.pair_measures(table).withColumn("n", tx.norm_nfc("reference")).withColumn(
        "d", tx.word_distance(F.col("reference"), F.col("prediction"))).collect()}
    for i, a, b in rows:
        x, y = normal(a), normal(b)
        assert got[i].n == x and got[i].ref_words == len(x.split())
        assert got[i].word_edits == (_edits(x.split(), y.split()) if x else 0)
        assert got[i].char_edits == (_edits(x, y) if x else 0) and got[i].exact == (x == y)


def test_engines_without_a_match_are_scored(spark):
    ref = spark.createDataFrame([(1, 0, "a b", 0, 1000), (1, 1, "c", 2000, 3000)], "episode_id int, cue_index bigint, text string, start_ms bigint, end_ms bigint")
    pred = spark.createDataFrame([("x", 1, 5, "a c", 10, 1000)], "engine_id string, episode_id int, cue_index bigint, text string, start_ms bigint, end_ms bigint")
    pairs = spark.createDataFrame([("x", 1, 5, 0)], "engine_id string, episode_id int, p_cue_index bigint, r_cue_index bigint")
    keys = ("engine_id", "episode_id")
    got = {r.engine_id: r for r in scoring.score_sums(pairs, pred, ref, keys, keys, 200, ("x", "y")).collect()}
    assert [(got[e].reference_cues, got[e].prediction_cues, got[e].matched_cues, got[e].word_edits, got[e].start_error_sum, got[e].in_tolerance_cues)
            for e in "xy"] == [(2, 1, 1, 2, 10, 1), (2, 0, 0, 3, 0, 0)]
