import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuespan.llm import chat, forest, hamming
from cuespan.llm.queries import CHECKS, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_multi_index_hashing", "op2_perspective_rotation"])
def test_check_sql(spark, name):
    assert compare(spark, duck(SF), name, SF, QUERIES, CHECKS).startswith("ok")


def nearest(rows, queries, k):
    rows = {r for r in rows if None not in r}
    out = []
    for q, code in {r for r in queries if None not in r}:
        best = sorted((bin((code ^ c) & (2 ** 64 - 1)).count("1"), v) for v, c in rows if v != q)[:k]
        out += [(q, n + 1, v, d) for n, (d, v) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("segments", [None, 9])
def test_hamming_by_brute_force(spark, segments):
    rng = random.Random(3)
    codes = [rng.getrandbits(64) - 2 ** 63 for _ in range(40)]
    rows = [(i, c) for i, c in enumerate(codes)] + [(100 + i, codes[0]) for i in range(30)]
    rows += [(200 + i, codes[1] ^ (1 << (i % 63))) for i in range(60)] + [(None, 5), (300, None), (0, codes[0])]
    table = spark.createDataFrame(rows, "vec_id long, code long")
    for k in (1, 4):
        queries = [r for r in rows if r[0] is not None and r[0] % 5 == 0]
        got = hamming.search(table, table.where("vec_id % 5 = 0"), k, segments).collect()
        assert sorted(map(tuple, got)) == nearest(rows, queries, k)


def test_hamming_few_rows(spark):
    few = spark.createDataFrame([(1, 7), (2, -1), (3, 7)], "vec_id long, code long")
    assert sorted(map(tuple, hamming.search(few, few, 10).collect())) == nearest([(1, 7), (2, -1), (3, 7)], [(1, 7), (2, -1), (3, 7)], 10)
    assert hamming.search(few.limit(0), few.limit(0), 3).collect() == []
    vectors = spark.createDataFrame([(1, [1.0, -1.0]), (2, None), (3, [None, 1.0]), (4, [])], "vec_id long, embedding array<float>")
    assert [r.code for r in vectors.orderBy("vec_id").select(hamming.sign_code("embedding").alias("code")).collect()] == [1, None, None, 0]


def test_hamming_in_blocks_without_rounds_of_jobs(spark):
    """Blocks and groups give what one gives, and a query far from all rows costs no more jobs than a near one."""
    rng = random.Random(4)
    rows = [(i, rng.getrandbits(20)) for i in range(90)] + [(90 + i, 3) for i in range(20)] + [(200, -1)]
    table = spark.createDataFrame(rows, "vec_id long, code long")
    asked, jobs = [r for r in rows if r[0] % 4 == 0], []
    for group, among in (("near", "vec_id % 4 = 0 AND vec_id < 200"), ("far", "vec_id % 4 = 0")):
        spark.sparkContext.setJobGroup(group, group)
        got = hamming.search(table, table.where(among), 6, 5, block_rows=30, group_queries=7).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, got)) == nearest(rows, asked, 6)
    assert jobs[0] == jobs[1]


def test_forest_edges(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]),
            (103, [math.nan, 1.0, 1.0]), (104, [math.inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (105, [1.0, 2.0]), (7, [0.0, 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = forest.search(table, table.where("vec_id % 10 = 0"), 4).collect()
    good = [(i, np.array(v)) for i, v in rows if i is not None and (i < 60)]
    for q in range(0, 60, 10):
        own = next(v for i, v in good if i == q)
        want = sorted((float(np.sqrt(((v - own) ** 2).sum())), i) for i, v in good if i != q)[:4]
        assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    assert {r.query_id for r in got} == set(range(0, 60, 10))
    assert forest.search(table.limit(0), table.limit(0), 4).collect() == []
    assert len(forest.search(table.where("vec_id < 3"), table.where("vec_id = 0"), 10).collect()) == 2


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_forest_recall(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    ids, points = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in QUERIES["op8_projection_forest"](spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        far = np.sqrt(((points - points[ids == q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        hits += len({v for _, v, _ in found} & set(ids[order].tolist()))
        assert [n for n, *_ in sorted(found)] == list(range(1, 11))
        assert all(s == pytest.approx(far[ids == v][0], abs=1e-12) for _, v, s in found)
    assert len(got) == (ids % 100 == 0).sum() and hits >= 0.9 * 10 * len(got)


def test_rotation_edges(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_TURNS", 3)
    rows = [(1, t, "abc"[t % 3], f"hi <|end|> {t}") for t in range(11)] + [(1, 4, "b", "hi <|end|> 4"), (1, None, "a", None), (1, 5, None, "who"),
            (2, 0, None, "alone"), (None, 0, "a", "lost"), (None, 7, "b", ""), (3, 0, "a", "x" * 100000)]
    talk = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, start int")
    got = chat.rotate(talk).collect()
    views = {}
    for r in got:
        views.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(views) == {(1, "a"), (1, "b"), (1, "c"), (None, "a"), (None, "b"), (3, "a")}
    for (conv, view), own in views.items():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        key = lambda x: (x is not None, x if x is not None else 0)
        want = sorted((r for r in rows if r[0] == conv), key=lambda r: (key(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        place = 0
        for r, (_, turn, role, text) in zip(own, want, strict=True):
            body = (text or "").replace("<|", "< |") + "<|end|>"
            head = "<|assistant|>\n" if role == view else f"<|user name={role or 'unknown'}|>\n"
            assert (r.turn, r.role, r.rendered, r.start, r.trained) == (turn, role, head + body + "\n", place, role == view)
            whole = head + body + "\n"
            assert whole[r.mask_start - place:r.mask_end - place] == (body if role == view else "")
            place += len(whole)
    assert chat.rotate(talk.limit(0)).collect() == []


def test_forest_with_several_lengths_and_repeated_queries(spark):
    rng = np.random.default_rng(3)
    three, two = rng.normal(size=(40, 3)), rng.normal(size=(9, 2))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(three)] + [(100 + i, [float(x) for x in v]) for i, v in enumerate(two)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id IN (0, 7, 103)")
    got = forest.search(vectors, asked.unionByName(asked), 5).collect()
    for query, group, first in ((0, three, 0), (7, three, 0), (103, two, 100)):
        far = sorted((float(np.sqrt(((group[query - first] - v) ** 2).sum())), first + i) for i, v in enumerate(group) if first + i != query)[:5]
        own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == query)
        assert [x[:2] for x in own] == [(k, i) for k, (_, i) in enumerate(far, 1)]
        assert [x[2] for x in own] == pytest.approx([f for f, _ in far], abs=1e-12)
