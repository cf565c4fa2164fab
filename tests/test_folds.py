"""A group that spans many Arrow batches folds like one that fits into one."""

import pytest

from cuespan.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["w5_merge_readings", "w6_micro_cleanup", "w10_frame_segments"])
def test_small_batches_change_no_row(spark, name):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(map(repr, QUERIES[name](spark, SF).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(repr, QUERIES[name](spark, SF).collect())) == want and want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
