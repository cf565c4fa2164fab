"""Queries on tables whose ids are larger than those of the given ones."""

import pytest
from pyspark.sql import functions as F

from cuespan.plans.catalog import CHECKS, QUERIES
from tests.oracle import compare, duck

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def late_events(spark, tmp_path_factory):
    """The events of sf0.001 with ids up to 60 times those of sf0.1."""
    folder = tmp_path_factory.mktemp("late")
    for name in ("region nation customer supplier part orders lineitem documents embeddings pages benchmark labels conversations").split():
        (folder / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    e.withColumn("event_id", F.col("event_id") * 5_999).write.parquet(str(folder / "events.parquet"))
    (folder / "events.parquet" / "_SUCCESS").unlink()
    return folder


@pytest.mark.parametrize("name", ["p19_contribution_validate", "x1_judged_calls"])
def test_late_events_follow_the_sql(spark, late_events, name):
    con = duck(SMALL)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{late_events}/events.parquet/*.parquet')")
    assert spark.read.parquet(f"{late_events}/events.parquet").agg(F.max("event_id")).first()[0] > 1_000_000
    assert compare(spark, con, name, str(late_events), QUERIES, CHECKS).startswith("ok")
