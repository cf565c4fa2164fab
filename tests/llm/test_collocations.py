import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuespan.llm import collocations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least=30, longest=4, limit=2000, within=80):
    out = []
    by_lang = {}
    for _, text, lang, _, _ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        pieces = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]
        by_lang.setdefault("und" if lang is None else lang, []).extend(pieces)
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i:i + m]) for p in pieces for m in range(1, longest + 1) for i in range(len(p) - m + 1))
        n = sum(len(p) for p in pieces)
        candidates = {c: a for c, a in f.items() if len(c) > 1 and a >= least}
        most = Counter()
        for c, a in candidates.items():
            for m in range(2, len(c)):
                for i in range(len(c) - m + 1):
                    most[c[i:i + m]] = max(most[c[i:i + m]], a)
        kept = []
        for c, a in candidates.items():
            if 100 * most[c] >= within * a:
                continue
            score, k = min((2_000_000 * a // (f[c[:k]] + f[c[k:]]), k) for k in range(1, len(c)))
            kept.append((-score, -a, " ".join(c).encode(), f[c[:k]], f[c[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(kept)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


def corpus(seed, n=500):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "straße", "水", "İx", "x\x1cy", "don't"]
    weights = [1 / (i + 1) for i in range(len(words))]
    fixed = ["New York Stock Exchange", "by the way", "rare1 rare2", "a a a a a", "one two three four five six"]
    rows = [(0, None, None, None, None), (1, "", "en", "", 0), (2, " \t.,;", None, "", 0), (3, "w0", "one", "", 0)]
    for i in range(n):
        lang = "en" if rng.random() < 0.5 else rng.choice(["de", None, "und"])
        parts = []
        for _ in range(rng.randrange(1, 8)):
            parts.append(rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(words, weights, k=rng.randrange(1, 9))))
            parts.append(rng.choice([" ", ". ", ",", "\t", "\n", "\r\n", " ; ", "  "]))
        rows.append((i, "".join(parts), lang, "s", 0))
    rows += [(900, "exact copy of this whole row here", "en", "s", 0)] * 35
    rows += [(901, "long text " * 20_000 + "v" * 50_000, "en", "s", 0)]
    rng.shuffle(rows)
    return rows


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [t for _, t in df.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("seed", "limit", "least"), [(1, 10, 30), (2, 25, 8), (3, 60, 3)])
def test_phrases_by_brute_force(spark, seed, limit, least, monkeypatch):
    monkeypatch.setattr(collocations, "WIDER", 2)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("lid", F.lit(1)).withColumn("w1", F.lit("x")).repartition(5)
    assert got(collocations.mine(docs, least=least, limit=limit)) == brute(rows, least, limit=limit)


def test_phrases_with_production_parameters(spark):
    rows = corpus(4, 900)
    assert got(collocations.mine(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_longer_phrases_need_the_counts_of_their_ends(spark):
    rows = corpus(5, 300)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(collocations.mine(docs, least=6, longest=6, limit=40)) == brute(rows, 6, longest=6, limit=40)


def test_empty_table(spark):
    assert got(collocations.mine(spark.createDataFrame([], SCHEMA))) == []


def test_full_filters_change_no_row(spark, monkeypatch):
    rows = corpus(6, 200)
    monkeypatch.setattr(collocations, "filter_of", lambda keys: np.full(1 << 21, 255, np.uint8))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(collocations.mine(docs, least=10, limit=15)) == brute(rows, 10, limit=15)


def test_phrase_keys_agree(spark):
    words = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 50)
    rows = [tuple(int(x) for x in words[i:i + 4]) for i in range(47)]
    df = spark.createDataFrame(rows, "w1 long, w2 long, w3 long, w4 long")
    for m in (2, 3, 4):
        have = [r[0] for r in df.select(collocations.phrase_key([f"w{j}" for j in range(1, m + 1)])).collect()]
        assert have == collocations.phrase_keys(words, m)[:47].tolist()


def test_words_are_cut_from_small_slices(monkeypatch):
    import pyarrow as pa

    from cuespan.llm import collocations

    seen, words = [], collocations._words
    monkeypatch.setattr(collocations, "_words", lambda part: seen.append(part.nbytes) or words(part))
    batch = pa.record_batch([["one two. " * 1_000] * 1_000, pa.array([1] * 1_000, pa.int64())], ["text", "lid"])
    assert sum(n for b in collocations._count_words(iter([batch])) for n in b["n"].to_pylist()) == 2_000_000
    assert len(seen) > 2 and max(seen) < 4_000_000
