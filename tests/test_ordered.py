import random

import pytest
from pyspark.sql import functions as F

from cuespan.functions.ordered import exact_quantile, total_rank


@pytest.mark.parametrize("seed", [1, 2])
def test_total_rank_with_a_heavy_value(spark, seed):
    rng = random.Random(seed)
    rows = [(None if rng.random() < 0.05 else 7 if rng.random() < 0.4 else rng.randrange(500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "v int, i int").repartition(5)
    got = {(r.v, r.i): r.rank for r in total_rank(df, [F.col("v").desc_nulls_last(), F.col("i").asc()]).collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == {r: k for k, r in enumerate(want, 1)}


def test_total_rank_splits_equal_rows_and_takes_empty_tables(spark):
    same = spark.range(4000).select(F.lit("x").alias("v"))
    assert sorted(r.rank for r in total_rank(same, [F.col("v").asc()]).collect()) == list(range(1, 4001))
    assert total_rank(same.where("v = 'y'"), [F.col("v").asc()]).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.25, 1.0])
def test_exact_quantile_equals_percentile(spark, share):
    rng = random.Random(3)
    rows = [(k, None if rng.random() < 0.1 else v) for k, n in (("a", 5000), ("b", 6), ("c", 1), (None, 301))
            for v in (rng.choice([1e300, -1e300, 5e-324, 0.0, rng.random(), rng.lognormvariate(0, 9)]) for _ in range(n))]
    rows += [("same", 2.5)] * 3000 + [("none", None)] * 4
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: r.quantile for r in exact_quantile(df, ["k"], "v", share).collect()}
    want = {r.k: r.q for r in df.groupBy("k").agg(F.expr(f"percentile(v, {share})").alias("q")).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k] or got[k] == pytest.approx(want[k], rel=1e-12)
    assert exact_quantile(df.where("k = 'no'"), ["k"], "v", share).count() == 0
