import random
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuespan.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Cut, reshare by weight, until no target is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, fixed = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(most * sizes[s] for s in fixed)
        target = {s: Fraction(most * sizes[s]) if s in fixed else Fraction(left * weight[s], sum(weight[f] for f in free)) for s in order}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target
        fixed |= above


def check(docs, got):
    sizes = {}
    for _, text, _, source, _ in docs:
        sizes[source] = sizes.get(source, 0) + words(text)
    target, taken, longest = brute_targets(sizes), {}, {}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source or "") for r in got) == sorted(
        (d is None, d or 0, words(t), s or "") for d, t, _, s, _ in docs)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(target[r.source]), rel=1e-12)
        rate = float(target[r.source]) / sizes[r.source] if sizes[r.source] else 0
        assert r.taken == r.copies * r.size and r.taken <= 3 * r.size
        if r.size:
            assert int(rate) <= r.copies <= int(rate) + (rate > int(rate))
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 0), r.size)
    for s, t in target.items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1e-6, (s, taken[s], float(t))
    return target, taken


def corpus(seed, n=900):
    rng = random.Random(seed)
    rows = [(0, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0), (None, "a b", "x", "null", 2), (2, " \t\n", "x", "empty", 3)]
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "é", None, "z", "tiny" if rng.random() < 0.1 else "c"])
        rows.append((i, " ".join(["w"] * int(rng.lognormvariate(3, 1.2))), "en", source, 0))
    rows += [(5000, "same row here", "en", "copies", 1)] * 700 + [(5001, "long " * 20_000, "en", "long", 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_by_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 16)
    monkeypatch.setattr(mixing, "FAN", 3)  # several levels
    monkeypatch.setattr(mixing, "CHUNK", 64)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    check(rows, got)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixed_corpus_has_each_document_as_often_as_it_is_taken(spark):
    rows = corpus(3, 200)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("base", F.lit("own")).withColumn("m", F.lit(1)).withColumn("_kind", F.lit(2))
    plan = mixing.mix(docs).groupBy("source").agg(F.sum("copies").alias("n"), F.sum("taken").alias("w")).collect()
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))
    real = out.groupBy("source").agg(F.count("*").alias("n"), F.sum(size).alias("w")).collect()
    assert {r.source: (r.n, r.w) for r in plan if r.n} == {r.source: (r.n, r.w) for r in real}


def test_empty_table_and_tables_without_words(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, "x", "a", 0), (2, "", "x", None, 0)]
    assert [(r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()] == [
        (1, 0, 0.0, 0), (2, 0, 0.0, 0)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10**6), st.floats(0.001, 0.999), st.floats(0, 0.999)), min_size=1, max_size=40))
def test_rounding_keeps_the_words(rows):
    size, part, coin = (np.array(x) for x in zip(*rows, strict=True))
    up, rest = mixing.pivot(size, part, coin)
    assert (up < 0).sum() <= 1
    kept = np.where(up < 0, rest, up)
    assert (kept * size).sum() == pytest.approx((part * size).sum(), rel=1e-9, abs=1e-6)


def test_each_document_is_taken_as_often_as_its_part_says():
    rng = np.random.default_rng(5)
    size, part = rng.integers(1, 50, 30), rng.uniform(0.05, 0.95, 30)
    runs = 6000
    seen = np.zeros(30)
    for _ in range(runs):
        up, rest = mixing.pivot(size, part, rng.random(30))
        seen += np.where(up < 0, rest, up)
    assert np.abs(seen / runs - part).max() < 0.03
