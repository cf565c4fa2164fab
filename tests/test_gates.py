"""The gates on the real matching against a brute force of it."""

from itertools import permutations

from cuespan.plans import views as v
from cuespan.plans.catalog import QUERIES

SCREEN = 1_000_000  # cue numbers of screen text begin here
REF = [(1, 1, "one", 0, 1000), (1, 2, "two", 2000, 3000), (1, 3, "three", 2500, 3500), (2, 1, "four", 0, 1000), (2, 2, "five", 5000, 6000)]
# cue 1 of episode 1 has screen text only; cues 2 and 3 can only both be matched crosswise; cue 2 of episode 2 has nothing
BASE = [(1, SCREEN + 1, "one", 0, 1000), (1, 2, "three", 2500, 3500), (1, 3, "two", 1500, 2900), (2, 1, "four", 0, 1000)]
CAND = [*BASE[:3], (2, 1, "f0ur", 0, 1000), (2, SCREEN + 2, "five", 5000, 6000)]


def largest(ref, pred):
    """Most references that can be matched one to one, by trying every assignment."""
    fits = lambda p, r: 2 * (min(p[4], r[4]) - max(p[3], r[3])) >= r[4] - r[3]
    padded = [*pred, *[None] * len(ref)]
    return max(sum(p is not None and fits(p, r) for p, r in zip(way, ref)) for way in permutations(padded, len(ref)))


def test_gates_use_the_largest_matching(spark, monkeypatch):
    columns = "episode_id long, cue_index long, text string, start_ms long, end_ms long"
    ref = spark.createDataFrame(REF, columns)
    preds = spark.createDataFrame([("base", *r) for r in BASE] + [("cand", *r) for r in CAND], "engine_id string, " + columns)
    monkeypatch.setattr(v, "cues_ref", lambda *_: ref)
    monkeypatch.setattr(v, "engine_preds", lambda *_: preds)

    coverage = []
    for pred in (BASE, CAND):
        for episode in (1, 2):
            own = [r for r in REF if r[0] == episode]
            coverage.append(largest(own, [p for p in pred if p[0] == episode]) / len(own))
    assert coverage == [1.0, 0.5, 1.0, 1.0]
    gate = QUERIES["a6_coverage_gate_matched"](spark, "").collect()[0]
    assert (gate.engines, gate.failed_groups, gate.status) == (2, sum(c < 0.75 for c in coverage), "FAIL")
    # letters that differ: nothing in episode 1; "five" missing in base, one letter wrong in cand
    delta = {r.group_key: (r.baseline, r.candidate) for r in QUERIES["j9_baseline_vs_candidate_matched"](spark, "").collect()}
    assert delta == {"1": (0.0, 0.0), "2": (4 / 8, 1 / 8)}
    both = QUERIES["a7_comparison_gate_matched"](spark, "").collect()[0]
    assert abs(both.cer_increase - (1 / 19 - 4 / 19)) < 1e-12 and both.no_group_regression_passed
    assert not both.coverage_passed and both.status == "FAIL"
    # by equal numbers episode 1 falls below the gate in both engines
    assert QUERIES["a6_coverage_gate"](spark, "").collect()[0].failed_groups > gate.failed_groups
