import random

import pytest
from pyspark.sql import functions as F

from cuespan.operators import align, intervals
from cuespan.plans import align_queries, views
from cuespan.plans.catalog import QUERIES


def edges_of(seed, episodes, cues=7, near=4):
    """Random overlap edges: reference i may take predictions close to i."""
    rng = random.Random(seed)
    rows = []
    for e in range(episodes):
        n = rng.randrange(1, cues)
        for r in range(n):
            for p in rng.sample(range(r, r + near), rng.randrange(1, near)):
                rows.append((e, p, r, rng.randrange(1, 4) * 100, p * 1000, p * 1000 + 900, r * 1000, r * 1000 + 900))
    return rows


SCHEMA = ("episode_id long, p_cue_index long, r_cue_index long, overlap_ms long, "
          "p_start_ms long, p_end_ms long, r_start_ms long, r_end_ms long")


def one_after_another(rows):
    """Per episode: while some chain of swaps adds a pair, all references without
    one try, in order, for the first chain of the least length that crosses none
    of this round."""
    out = []
    for e in {r[0] for r in rows}:
        wishes = {}
        for _, p, r, o, *_ in sorted((x for x in rows if x[0] == e), key=lambda x: (x[2], -x[3], x[1])):
            wishes.setdefault(r, []).append(p)
        order = sorted(wishes, key=lambda r: (len(wishes[r]), r))
        pair = {}
        while True:
            taken_by = {p: r for r, p in pair.items()}
            step, known, length = [r for r in order if r not in pair], {}, None
            for d in range(len(order) + 1):
                for r in step:
                    known[r] = d
                if any(p not in taken_by for r in step for p in wishes[r]):
                    length = d
                    break
                step = list(dict.fromkeys(taken_by[p] for r in step for p in wishes[r] if taken_by[p] not in known))
            if length is None:
                break
            crossed = set()

            def chain(r):
                for p in wishes[r]:
                    if p in crossed:
                        continue
                    holder = taken_by.get(p)
                    if holder is None and known[r] == length:
                        return [(r, p)]
                    if holder is not None and known.get(holder) == known[r] + 1 <= length:
                        rest = chain(holder)
                        if rest:
                            return [(r, p), *rest]
                return None

            new = {}
            for r in order:
                if r not in pair:
                    found = chain(r)
                    if found:
                        crossed |= {p for _, p in found}
                        new.update(found)
            pair.update(new)
        out += [(e, p, r) for r, p in pair.items()]
    return sorted(out)


def triples(df):
    return sorted((r.episode_id, r.p_cue_index, r.r_cue_index) for r in df.collect())


def test_largest_matching_in_a_fold_and_in_rounds_on_3000_episodes(spark):
    rows = edges_of(1, 2900, 5, 3) + [(5000 + e, *rest) for e, *rest in edges_of(2, 100, 9, 4)]
    edges = spark.createDataFrame(rows, SCHEMA)
    want = one_after_another(rows)
    assert triples(align.largest_align(edges)) == want
    assert triples(align.largest_align(edges, fold_edges=0)) == want


def test_one_long_island_of_each_kind(spark):
    rows = edges_of(3, 1, 60, 4)
    rows = [(0, p, r, o, 0, 10_000_000, 0, 10_000_000) for _, p, r, o, *_ in rows]
    edges = spark.createDataFrame(rows, SCHEMA)
    assert triples(align.largest_align(edges, fold_edges=10)) == triples(align.largest_align(edges, fold_edges=10**9))
    assert triples(align.greedy_align(edges, fold_edges=10)) == triples(align.greedy_align(edges, fold_edges=10**9))


def test_no_edges(spark):
    edges = spark.createDataFrame([], SCHEMA)
    assert triples(align.largest_align(edges)) == triples(align.largest_align_rounds(edges)) == []


def spans(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        length = rng.choice([0, 1, 500, 5_000, 9_999, 10_000, 80_000, 81_000, 200_000, 3_000_000]) if rng.random() < 0.5 else rng.randrange(8_000)
        start = rng.randrange(0, 4_000_000)
        out.append((rng.randrange(2), i, start, None if rng.random() < 0.02 else start + length))
    return [*out, (0, n, 0, 5_000_000), (1, n + 1, 0, 10**15)]


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_join_on_all_levels(spark, seed):
    a, b = spans(seed, 300), spans(seed + 10, 300)
    left = spark.createDataFrame(a, "k int, i int, s long, e long")
    right = spark.createDataFrame(b, "k int, j int, t long, f long")
    got = [(r.i, r.j) for r in intervals.interval_join(left, right, ["k"], ("s", "e"), ("t", "f")).collect()]
    want = [(i, j) for k, i, s, e in a for m, j, t, f in b
            if k == m and None not in (e, f) and s < e and t < f and s < f and t < e]
    assert sorted(got) == sorted(want)


def test_a_span_as_long_as_its_episode_fills_no_place(spark):
    cues = [(0, i, i * 3_000, i * 3_000 + 2_500) for i in range(20_000)]
    left = spark.createDataFrame(cues, "k int, i int, s long, e long")
    right = spark.createDataFrame([*cues, (0, -1, 0, 60_000_000)], "k int, j int, t long, f long")
    placed = intervals._spread(left, ("s", "e"), 10_000, intervals._levels(right, ("t", "f"), 10_000), True)
    rows = placed.groupBy(*intervals._PLACE).count().agg(F.max("count"), F.sum("count")).first()
    assert rows[0] <= 200 and rows[1] <= 20_000 * 4


def test_the_matching_of_whole_tables(spark):
    """J3 as A4 to A7 and J9 use it, with screen texts, on every edge of the tables."""
    sf = "/root/testdata/sf0.001"
    pred = views.engine_preds(spark, sf)
    ref = views.cues_ref(spark, sf).withColumn("engine_id", F.explode(F.array(*map(F.lit, views.ENGINES))))
    cues = [[(r.engine_id, r.episode_id, r.cue_index, r.start_ms, r.end_ms) for r in t.collect()] for t in (pred, ref)]
    by_episode, rows = {}, []
    for k, e, i, s, t in cues[0]:
        by_episode.setdefault((k, e), []).append((i, s, t))
    for k, e, j, a, b in cues[1]:
        rows += [((k, e), i, j, min(t, b) - max(s, a)) for i, s, t in by_episode.get((k, e), ()) if s < b and a < t and 2 * (min(t, b) - max(s, a)) >= b - a]
    got = sorted(((r.engine_id, r.episode_id), r.p_cue_index, r.r_cue_index) for r in QUERIES["j3_max_cardinality_align"](spark, sf).collect())
    assert got == one_after_another(rows)
    scores = {(r.engine_id, r.episode_id): r.matched_cues for r in align_queries.a4(spark, sf).collect()}
    want = {}
    for key, _, _ in got:
        want[key] = want.get(key, 0) + 1
    assert {k: n for k, n in scores.items() if n} == want
