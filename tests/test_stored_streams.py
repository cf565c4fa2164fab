"""Both streams come from one pass over the blocks."""

import random
from collections import Counter
from difflib import SequenceMatcher

from cuespan.functions.similarity import alike
from cuespan.plans import block_queries

SF = "/root/testdata/sf0.001"


def test_streams_are_stored(spark):
    plan = block_queries._streams(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "Window" not in plan


def test_alike_keeps_its_bounds():
    rng = random.Random(5)
    for _ in range(5_000):
        x, y = ("".join(rng.choices("abc ", k=rng.randrange(9))) for _ in range(2))
        total = len(x) + len(y)
        shared = 2.0 * sum((Counter(x) & Counter(y)).values())
        for limit in (0.5, 0.7, 0.85):
            assert alike(x, y, limit) == (not total or (shared / total >= limit and SequenceMatcher(None, x, y).ratio() >= limit))
