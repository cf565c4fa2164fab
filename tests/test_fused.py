import random

from pyspark.sql import functions as F

from cuespan.functions import reach
from cuespan.operators import repair


def test_cuts_that_cannot_be_repaired_are_not_written(spark, monkeypatch):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcdesşcçgğıi", k=rng.randrange(4, 10))) for _ in range(150)})
    dictionary = spark.createDataFrame(
        [(w, rng.choice([5, 299, 300, 400, 999, 1000, 4000, 90_000])) for w in words], "word string, freq long")

    def spoil(w):
        at, kind = rng.randrange(len(w)), rng.randrange(5)
        return [w, w, w[:at] + w[at + 1:], w[:at] + rng.choice("abşi") + w[at:], w[:at] + rng.choice("xbş") + w[at + 1:]][kind].replace(
            *rng.choice([("s", "ş"), ("i", "ı"), ("ğ", "g")]))

    tokens = sorted({spoil(rng.choice(words)) + spoil(rng.choice(words)) for _ in range(1500)} | {"x" * 400, "çç𝒳" * 5})
    tokens = spark.createDataFrame([(t,) for t in tokens], "token string")
    cuts = []
    near = repair.near_cuts

    def counted(folded, *rest):
        cuts.append(near(folded, *rest))
        return cuts[0]

    monkeypatch.setattr(repair, "near_cuts", counted)
    got = sorted(repair.split_fused(tokens, dictionary).collect())

    def every(folded, field, least, longest, wide):
        at = F.sequence(F.lit(least), F.length("token") - least)
        cuts.append(folded.select("token", F.explode(at).alias("k")))
        return cuts[1]

    monkeypatch.setattr(repair, "near_cuts", every)
    assert got == sorted(repair.split_fused(tokens, dictionary).collect()) and len(got) > 100
    assert cuts[0].count() * 3 < cuts[1].count()


def test_rare_rivals_and_inflected_words_and_a_growing_field(spark):
    """A weak word near a part forbids its repair; the field grows with the dictionary."""
    dictionary = spark.createDataFrame(
        [("garden", 4000), ("marble", 9000), ("pinter", 5000), ("pintek", 600), ("lanterns", 300), ("lantern", 20)], "word string, freq long")
    tokens = spark.createDataFrame([(t,) for t in ("gardenmarble", "gardenpintez", "gardenmarbke", "gardenpinte", "lanternsing", "lanternsgarden")], "token string")
    got = sorted((r.token, r.left, r.right, r.score) for r in repair.split_fused(tokens, dictionary).collect())
    # pintez is one letter from pinter and from pintek, whose weight forbids the choice, and so is pinte
    assert got == [("gardenmarbke", "garden", "marble", 4000 * 0.3), ("gardenmarble", "garden", "marble", 4000.0),
                   ("lanternsgarden", "lanterns", "garden", 300.0)]
    words = spark.range(300_000).selectExpr("concat('w', id) AS word", "true AS strong")
    bits = reach.field_bits(words)
    assert bits >= 16 * 300_000 * 12 and reach.field_bits(words.limit(10)) == reach.LEAST_BITS
    field = reach.reach_field(words, bits)
    assert field.size * 8 == bits and 0.02 < reach.np.unpackbits(field).mean() < 0.25
