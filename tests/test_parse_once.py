"""The subtitle parser reads each text once and evaluates each rule once a row."""

import pytest
from pyspark.sql import functions as F

from cuespan.functions import text as tx
from cuespan.sources import subtitles

SRT = "1\n00:00:01,000 --> 00:00:02,000\n one \n\n2\n00:00:03,000 -> 00:00:04,000\nbad\n\n \n\n3\n00:00:05,000 --> 00:00:06,000\nthree\nlines\n"


@pytest.mark.parametrize("dialect,cues", [
    ("strict", [(1, "one"), (3, "three\nlines")]), ("fail_fast", []), ("lenient", [(0, "one"), (1, "three lines")]),
    ("token_edge", [(0, "one"), (1, "three\nlines")]), ("pack", [(0, "one"), (1, "three\nlines")])])
def test_a_text_is_split_once(spark, dialect, cues):
    # from a file, as rows given by the driver would be evaluated while the query is planned
    files = spark.range(1).select(F.concat(F.lit("a"), "id").alias("file"), F.when(F.col("id") == 0, SRT).alias("value"))
    got = subtitles.parse_srt(files, dialect)[0]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[ \\t]*") == 1
    assert sorted((r.cue_index, r.text) for r in got.collect()) == cues


def test_white_space_is_that_of_the_patterns(spark):
    chars = spark.range(0, 0x3100).where("id NOT BETWEEN 55296 AND 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    padded = chars.select("c", F.concat("c", F.lit("x y"), "c", "c").alias("t"))
    want = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert padded.where(~tx.strip_ws(F.col("t")).eqNullSafe(want)).count() == 0
    assert padded.where(want == "x y").count() == len(tx.WHITE)
