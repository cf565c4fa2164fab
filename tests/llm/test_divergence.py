import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuespan.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least, ranks):
    docs = [(lang or "", source or "", terms(text)) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held, by_source = Counter(), {}
        for _, source, own in (d for d in docs if d[0] == lang):
            held.update(set(own))
            by_source.setdefault(source, Counter()).update(own)
        kept = [t for t, n in held.items() if n >= least]
        whole = {t: sum(c[t] for c in by_source.values()) for t in kept}

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in by_source.items()}
        for s in p:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, k) for k, (v, o) in enumerate(pairs, 1)]
            over = sorted(((p[s][t] - q[t], t) for t in kept if by_source[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, k) for k, (v, t) in enumerate(over[:ranks], 1)]
    return sorted(out)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "É", "straße", "水", "Zz", "x") for b in ("", "a", "bé", "c", "dd", "日")]
    rows = [(0, None, None, None, None), (1, "", "", "", 0), (2, "1234 -- _", "en", "digits", 0), (3, "İstanbul \x00 a b", "tr", "s", 0)]
    for i in range(n):
        lang = "en" if rng.random() < 0.5 else rng.choice(["de", "", None])
        source = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "", "é", "z"])
        take = vocabulary[::2] if source == "hot" else vocabulary
        rows.append((i, ", ".join(rng.choice(take).swapcase() if rng.random() < 0.3 else rng.choice(take)
                                  for _ in range(rng.randrange(40))), lang, source, 0))
    rows += [(900, "same copy of the row", "en", "copies", 0)] * 40 + [(901, "verylong " * 30_000 + "w" * 100_000, "en", "long", 0)]
    rng.shuffle(rows)
    return rows


def got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert [t for _, t in df.dtypes] == ["string", "string", "string", "string", "bigint", "int"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("seed", "bits"), [(1, 64), (2, 4), (3, 1)])
def test_audit_by_brute_force(spark, seed, bits, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 5)  # several blocks and tiles
    monkeypatch.setattr(divergence, "TILE_SOURCES", 3)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit(1)).withColumn("grp", F.lit("x")).repartition(5)
    assert got(divergence.audit(docs, least=12, ranks=7, bits=bits)) == brute(rows, 12, 7)


def test_audit_with_production_parameters(spark):
    rows = corpus(4, 600)
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 30, 50)


def test_empty_table_and_no_kept_terms(spark):
    assert got(divergence.audit(spark.createDataFrame([], SCHEMA))) == []
    rows = [(1, "a b", "en", "x", 0), (2, None, "en", None, 0), (3, "c", None, "y", 0)]
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == [("en", "", "pair", "x", 0, 1), ("en", "x", "pair", "", 0, 1)]


def test_combined_counts_pass_the_bound_once():
    from cuespan.llm.words import Combined
    out, seen = Combined(["k"], ["n"], rows=10), Counter()
    batches = []
    for i in range(50):
        batches += out.add({"k": np.arange(i % 13), "n": np.ones(i % 13, np.int64)})
    batches += out.rest()
    for b in batches:
        for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen[k] += n
    want = Counter(k for i in range(50) for k in range(i % 13))
    assert +seen == want
