"""Ratios by blocks found in the texts themselves, and the pick among readings."""

import random
from difflib import SequenceMatcher

from cuespan.functions.similarity import ratio
from cuespan.operators.cleanup import consensus_pick
from cuespan.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def slow(x, y):
    return 1.0 if x == y else SequenceMatcher(None, x, y).ratio()


def test_ratio_is_that_of_difflib():
    rng = random.Random(7)
    pairs = [("".join(rng.choices("abcd0", k=rng.randrange(14))), "".join(rng.choices("abce1", k=rng.randrange(14))))
             for _ in range(20_000)]
    for x, _ in pairs[:5_000]:
        pairs += [(x, x.replace("a", "1")), (x.replace("b", "c"), x), (x, "漢字" + x),
                  (x, "".join(c if rng.random() < .7 else rng.choice("abx1") for c in x))]
    pairs += [("ab" * n + x, "ba" * n + y) for n in (50, 99, 100, 101, 130) for x, y in pairs[:200]]
    for x, y in pairs:
        assert ratio(x, y) == slow(x, y), (x, y)


def test_pick_is_that_of_all_pairs(spark):
    rng = random.Random(8)
    rows = [(s, pos, text, rng.random()) for s in range(150) for pos in range(rng.randrange(1, 6))
            for text in [rng.choice(["", None, "aab", "aba", "abaab", "baa", "b"])]]
    got = {r.s: (r.text, r.conf) for r in consensus_pick(
        spark.createDataFrame(rows, "s int, pos int, text string, conf double"), ["s"]).collect()}
    for s in {r[0] for r in rows}:
        held = sorted((p, t, c) for n, p, t, c in rows if n == s and t)
        sums = {}
        for p, t, _ in held:
            total = 0.0
            for _, u, _ in held:
                total += slow(t, u)
            sums[t] = max(sums.get(t, (-1.0,)), (total, len(t), -p))
        best = max(sums, key=sums.get, default=None)
        assert got[s] == ((best, max(c for _, t, c in held if t == best)) if best else ("", 0.0)), s


def test_readings_of_a_segment_are_gathered_once(spark):
    plan = QUERIES["w13_consensus_pick"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 1 and "Join" not in plan
