import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuespan.llm import jaccard
from tests.oracle import compare, duck


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"e{rng.randrange(1000)}"
        elif kind == 1:
            words.insert(at, f"i{rng.randrange(1000)}")
        elif len(words) > 1:
            del words[at]
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_join_by_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "one", "One", "a b c d", "a b c d", "É é", "é É", "İ x\x1cy z"]
    shared = [f"s{i}" for i in range(60)]
    for size in (5, 8, 9, 12, 14, 16, 19, 21, 24, 40, 90, 200, 400):
        for _ in range(4):
            base = [f"w{rng.randrange(300)}" for _ in range(size)]
            if size > 100:
                base[20:80] = shared
            texts.append(" ".join(base))
            for _ in range(rng.randrange(5)):
                texts.append(" ".join(edited(rng, base, rng.choice([0, 1, 1, 2, size // 60, size // 40]))).title())
    chain = [f"c{i}" for i in range(120)]
    for step in range(12):
        texts.append(" ".join([*chain[step * 3:], *(f"t{step}_{i}" for i in range(3 * step))]))
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, sig string").repartition(7)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect())
    assert got == brute(rows)
    assert len({g[2] for g in got}) < len(rows) - 40


def test_hot_lists_led_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_LIST", 2)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([1, 1, 2])))) for i in range(60)]
    rows += [(100 + i, " ".join([f"z{i}_{k}" for k in range(70)] + base[:40])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()) == brute(rows)


def test_edges(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (7, "A b c d e f"), (8, "x" * 200000), (9, None)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == [
        ("1", 2, 1), ("1", 2, 1), ("7", 2, 1), ("8", 1, 8), ("9", 0, 9), ("None", 2, None)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("aAb \té", max_size=40), max_size=6))
def test_sets_by_brute_force(texts):
    for text, own in zip(texts, jaccard.shingle_sets(texts), strict=True):
        assert len(own) == len(brute_set(text))
    assert (len({brute_set(t) for t in texts}) == len({s.tobytes() for s in jaccard.shingle_sets(texts)}))


def test_light_sets_list_a_common_subset_just_when_they_link():
    for n in range(1, 17):
        for m in range(n, 17):
            for i in range(max(0, n - 4), n + 1):
                if n == m == i:
                    continue
                a = jaccard.mix(np.arange(1, n + 1, dtype=np.uint64))
                b = jaccard.mix(np.concatenate([np.arange(1, i + 1), np.arange(100, 100 + m - i)]).astype(np.uint64))
                one, two = (dict(zip(*(x.tolist() for x in jaccard.subset_keys(s, 16)), strict=True)) for s in (a, b))
                meet = any(one[k] or two[k] for k in one.keys() & two.keys())
                assert meet == (100 * i >= 80 * (n + m - i)), (n, m, i)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), max_size=20), st.integers(1, 5))
def test_lists_across_batches(rows, step):
    rows = sorted((k, 0, 1, s, 9, 0) for k, s in rows)
    names = ["key", "salt", "salts", "sig", "n", "pos"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    batches = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i:i + step], strict=True), kinds, strict=True)], names)
               for i in range(0, len(rows), step)]
    got = sorted((r["key"], r["sig"], r["lsig"]) for b in jaccard._leaders(iter(batches)) for r in b.to_pylist())
    lists = {}
    for k, _, _, s, _, _ in rows:
        lists.setdefault(k, []).append(s)
    want = sorted((k, s, own[0]) for k, own in lists.items() if len(set(own)) > 1 for s in set(own))
    assert got == want


def test_marks_never_count_more_than_two_sets_differ_by():
    rng = np.random.default_rng(3)
    for n, m, i in [(0, 3, 0), (1, 1, 0), (30, 33, 30), (31, 40, 20), (300, 1100, 290), (5000, 5200, 4500), (40_000, 41_000, 0)]:
        every = jaccard.mix(rng.integers(1, 1 << 62, n + m - i).astype(np.uint64))
        a, b = np.sort(every[:n]), np.sort(every[n - i:])
        one, two = jaccard.marks(a), jaccard.marks(b)
        far = len(np.setxor1d(a, b))
        assert jaccard.apart(one, two) == jaccard.apart(two, one) <= far
        assert jaccard.apart(one, one) == 0
        if n >= 30 and 100 * i < 60 * (n + m - i):  # sets that far apart are told without them
            assert (n + m - jaccard.apart(one, two)) // 2 < jaccard.needed(n, m)


def test_sets_that_share_a_list_and_no_more_are_not_brought_together(spark, monkeypatch):
    """A line that many texts share puts them into a common list; their marks part them."""
    shared = [f"s{i}" for i in range(12)]
    rows = [(i, " ".join([f"z{i}_{k}" for k in range(28)] + shared)) for i in range(30)]
    rows += [(100 + i, " ".join([f"y{k}" for k in range(60)] + [f"e{i}"])) for i in range(3)]
    compared, verify = [], jaccard.JaccardJoin.verify

    def counted(self, pairs, sets):
        compared.append(pairs.count())
        return verify(self, pairs, sets)

    monkeypatch.setattr(jaccard.JaccardJoin, "verify", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()) == brute(rows)
    assert sum(compared) <= 3


def test_check_sql(spark):
    from cuespan.llm.queries import CHECKS, QUERIES
    name = "op10_heavy_light_jaccard"
    assert compare(spark, duck("/root/testdata/sf0.001"), name, "/root/testdata/sf0.001", QUERIES, CHECKS).startswith("ok")


def test_one_of_each_with_any_column_names(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "y"), (3, "p q r", "z"), (None, "p q r", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h string").selectExpr("*", "1 AS key", "2 AS `row`", "3 AS hash", "4 AS `a.b`")
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r._h) for r in got.collect()) == [(0, "w"), (1, "x"), (3, "z")]
