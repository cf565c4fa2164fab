"""Costly steps run once, and the cheap way to a result gives the same result."""

import random

import pytest
from pyspark.sql import functions as F

from cuespan.functions import similarity
from cuespan.operators import scoring
from cuespan.plans import align_queries, dataset_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("make", [
    lambda spark: dataset_queries._scores(spark, SF, "indexed"), lambda spark: align_queries._greedy(spark, SF)[0].select("overlap_ms")],
    ids=["scores", "pairs"])
def test_scores_and_pairs_are_stored(spark, make):
    plan = make(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "MapInPandas" not in plan and "levenshtein" not in plan.lower()


def test_replaced_letters_without_python(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        a = "".join(rng.choice("ab o") for _ in range(rng.randint(0, 9)))
        b = "".join(rng.choice("ab 0") if rng.random() < 0.3 else c for c in a) if rng.random() < 0.7 else a[rng.randint(0, 2):] + rng.choice(["", "x", "ü😀"])
        rows.append((a, b))
    table = spark.createDataFrame(rows, "r string, p string")
    got = table.select("r", "p", scoring._substitutions("r", "p").alias("s")).collect()
    assert [[(x["gt"], x["ocr"]) for x in g["s"]] for g in got] == [similarity.substitutions(a, b) for a, b in rows]

    @F.pandas_udf("array<struct<gt:string,ocr:string>>")
    def none(truth, read):
        assert truth.isna().all(), "a pair of lines that differ in single places went to Python"
        return truth.map(lambda _: [])

    monkeypatch.setattr(scoring, "edit_substitutions", none)
    level = spark.createDataFrame([("the old inn", "the 0ld inn"), ("für", "fur"), ("same", "same")], "r string, p string")
    assert level.select(F.explode(scoring._substitutions("r", "p")).alias("s")).select("s.*").count() == 2
