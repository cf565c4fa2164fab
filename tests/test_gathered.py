"""Matching inside rows against a plain matching of every pair of cues."""

import random

import pyarrow as pa
import pytest

from cuespan.operators import gathered, scoring
from cuespan.plans import align_queries
from tests.test_matching import one_after_another


def episodes(seed, n, longest):
    """Per row: references (number, from, to) and predictions (run, number, from, to), in any order, some without a span."""
    rng = random.Random(seed)

    def span():
        start = rng.randrange(0, 4_000)
        kind = rng.random()
        return (start, start + rng.choice([1, 300, 700, 900, longest])) if kind < 0.9 else (start, start) if kind < 0.95 else (None, start)

    out = []
    for _ in range(n):
        refs = [(i, *span()) for i in range(rng.randrange(0, 7))]
        preds = [(g, i, *span()) for g in (0, 1) for i in range(rng.randrange(0, 7))]
        rng.shuffle(refs), rng.shuffle(preds)
        out.append((refs, preds))
    return out


def edges(refs, preds, run, of_pred):
    rows = []
    for g, i, s, t in preds:
        for j, a, b in refs:
            if g == run and None not in (s, a) and s < t and a < b and s < b and a < t:
                overlap = min(t, b) - max(s, a)
                if 2 * overlap >= (t - s if of_pred else b - a):
                    rows.append((0, i, j, overlap))
    return rows


def greedy(rows):
    used_p, used_r, out = set(), set(), []
    for e, p, r, o in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):
        if p not in used_p and r not in used_r:
            used_p.add(p), used_r.add(r), out.append((e, p, r))
    return sorted(out)


@pytest.mark.parametrize("slice_", [40, 1 << 19])
@pytest.mark.parametrize("longest", [1_200, 6_000, 10**17])
@pytest.mark.parametrize(("how", "share_of"), [("greedy", "pred"), ("largest", "ref"), ("indexed", "ref")])
def test_places_by_brute_force(monkeypatch, how, share_of, longest, slice_):
    monkeypatch.setattr(gathered, "SLICE", slice_)
    table = episodes(len(how) + longest % 7, 400, longest)
    lists = lambda side, at: pa.array([[x[at] for x in row[side]] for row in table], pa.list_(pa.int64()))
    got = gathered.places([lists(0, i) for i in range(3)], [lists(1, i) for i in range(4)], 2, share_of, how).to_pylist()
    several = 0
    for (refs, preds), places in zip(table, got, strict=True):
        assert len(places) == 2 * len(refs)
        for run in (0, 1):
            rows = edges(refs, preds, run, share_of == "pred")
            want = {"greedy": greedy, "largest": one_after_another,
                    "indexed": lambda rows: sorted((e, p, r) for e, p, r, _ in rows if p == r)}[how](rows)
            mine = places[run * len(refs):(run + 1) * len(refs)]
            assert all(preds[at][0] == run for at in mine if at is not None)
            assert sorted((0, preds[at][1], refs[i][0]) for i, at in enumerate(mine) if at is not None) == want
            several += len(want) > 2
    assert several > 20 or how == "indexed"


def test_rows_without_cues():
    none = pa.array([[], []], pa.list_(pa.int64()))
    some = pa.array([[], [5]], pa.list_(pa.int64()))
    assert gathered.places([none] * 3, [some] * 4, 1, "pred", "greedy").to_pylist() == [[], []]
    assert gathered.places([some] * 3, [none] * 4, 2, "ref", "largest").to_pylist() == [[], [None, None]]


def test_reports_out_of_rows_and_out_of_joins_are_equal(spark):
    sf = "/root/testdata/sf0.001"
    joined, rows = align_queries._greedy(spark, sf), align_queries._pairs(spark, sf)
    plain = lambda r: {k: round(x, 9) if isinstance(x, float) else x for k, x in r.asDict().items()}
    want, got = ({r.episode_id: plain(r) for r in df.collect()} for df in (scoring.vtt_report(*joined), scoring.vtt_report_gathered(rows)))
    assert got == want and len(want) > 100
    want, got = (sorted((r.watched, r.confusion, r.n) for r in scoring.confusions(df, keys=[]).collect()) for df in (joined[0], rows))
    assert got == want and want


def test_rows_after_an_explode_carry_no_array(spark):
    plan = align_queries.a4(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate explode" in line and "cues#" in line]
    assert made and not any(name in line for line in made for name in ("preds#", "refs#", "places#"))
