"""Boxes become lines in parts of a page, whatever their number and place."""

import random

from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.operators import cleanup
from cuespan.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
BOX = "page string, box_no bigint, y double, x int, h int, text string, conf double"


def slow(rows):
    out = []
    for page in {r[0] for r in rows}:
        boxes = sorted((r for r in rows if r[0] == page), key=lambda r: (r[2], r[1]))
        h = sorted(r[4] for r in boxes if r[4] and r[4] > 0)
        limit = max(K.LINE_MIN_PX, 0.5 * h[len(h) // 2] if h else 0.0)
        lines, last = [], None
        for r in boxes:
            if lines and r[2] - last <= limit and r[2] - sum(b[2] for b in lines[-1]) / len(lines[-1]) <= 3 * limit:
                lines[-1].append(r)
            else:
                lines.append([r])
            last = r[2]
        out += [(page, line[0][2], len(line), " ".join(r[5] for r in sorted(line, key=lambda r: r[3])),
                 min((r[6] for r in line if r[6] is not None), default=None)) for line in lines]
    return sorted(out, key=str)


def test_pages_of_one_and_of_many_chunks(spark, monkeypatch):
    for chunk in (100_000, 300, 60):
        monkeypatch.setattr(cleanup, "PAGE_CHUNK_PX", chunk)
        rng = random.Random(chunk)
        rows = [(rng.choice("abcd"), i, float(rng.randrange(-50, 1500)), rng.randrange(40), rng.choice([None, 0, 10, 40, 90]),
                 f"w{i}", rng.choice([None, 0.5, rng.random()])) for i in range(180)]
        got = cleanup.line_group(spark.createDataFrame(rows, BOX).repartition(3), ["page"]).collect()
        assert sorted(map(tuple, got), key=str) == slow(rows), chunk


def test_boxes_are_sorted_once(spark):
    plan = QUERIES["w14_line_group"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "SortAggregate" not in plan and "Window" not in plan


def test_gathered_pages_in_any_order(spark):
    rng = random.Random(9)
    rows = [(page, i, float(rng.randrange(-50, 250_000)) if page == "b" else float(rng.randrange(300)), rng.randrange(40),
             rng.choice([None, 0, 10, 40, 90]), f"w{i}", rng.choice([None, 0.5, rng.random()])) for page in "abcd" for i in rng.sample(range(60), 60)]
    boxes = spark.createDataFrame(rows, BOX).coalesce(1)
    got = cleanup.line_group(boxes, ["page"], gathered=True).collect()
    assert sorted(map(tuple, got), key=str) == slow(rows)


def test_words_of_a_page_are_not_shuffled(spark):
    plan = QUERIES["w14_line_group"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")
