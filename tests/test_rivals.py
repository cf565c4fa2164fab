"""Words that two replaced letters separate meet, and few others are masked."""

import random

from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.operators import learning


def test_words_two_letters_away_meet_by_thirds(spark, monkeypatch):
    asked, keep = [], learning.cut_lineage
    monkeypatch.setattr(learning, "cut_lineage", lambda df: asked.append(keep(df)) or asked[-1])
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abcd", k=rng.randrange(2, 8))) for _ in range(400)})
    tokens = rng.sample(words, 12) + ["zz", "zzzzzzz"]
    dictionary = spark.createDataFrame([(w, 10 * K.FREQ_MIN) for w in words], "word string, freq bigint")
    got = {(r.token, r.cand) for r in learning.rivals(spark.createDataFrame([(t,) for t in tokens], "token string"), dictionary).collect()}
    for t in tokens:
        for w in words:
            if len(w) == len(t) and 1 <= sum(a != b for a, b in zip(t, w)) <= 2:
                assert (t, w) in got, (t, w)
    assert len(asked) == 1 and asked[0].count() <= 3 * len(tokens)


def test_two_letters_leave_a_third(spark):
    rng = random.Random(10)
    rows = []
    for _ in range(500):
        a = [rng.choice("abc") for _ in range(rng.randrange(2, 14))]
        b = list(a)
        for i in rng.sample(range(len(a)), 2):
            b[i] = rng.choice("abcx")
        rows.append(("".join(a), "".join(b)))
    left = spark.createDataFrame(rows, "a string, b string").where(
        ~F.arrays_overlap(learning._thirds(F.col("a")), learning._thirds(F.col("b"))))
    assert left.collect() == []
