"""Word rules are worked out once for each different token."""

from pyspark.sql import functions as F

from cuespan.functions import text as tx
from cuespan.operators import cleanup


def test_rules_meet_each_token_once(spark, monkeypatch):
    seen, keep = [], cleanup.cut_lineage
    monkeypatch.setattr(cleanup, "cut_lineage", lambda df: seen.append(keep(df)) or seen[-1])
    words = spark.createDataFrame([("bugün", 90), ("hava", 80), ("güzel", 70)], "word string, freq bigint")
    texts = ["bugün hava\ngüzel", "bugün xqzw wqxz qqxw", "xqzw wqxz qqxw zzxw qwzx bugün hava", "漢字漢 a", "a !", " \t", None, "bugUn xqzw"]
    blocks = spark.createDataFrame([(1, i, t, 0.1 if i % 2 else 0.9) for i, t in enumerate(texts * 3)],
                                   "video_id int, block_no int, text string, conf double")
    got = [r.rule for r in cleanup.screen_profile(blocks, words).orderBy("block_no").collect()]
    assert got == [None, "b1-profil", None, "a-cjk", "c-sembol", None, None, "b1-profil",
                   None, "b1-profil", None, "a-cjk", "c-sembol", None, None, "b1-profil"] + [
                   None, "b1-profil", None, "a-cjk", "c-sembol", None, None, "b1-profil"]
    tokens = [r.token for r in seen[0].collect()]
    assert len(tokens) == len(set(tokens)) and "bugün" in tokens


def test_counts_of_letters_and_white_space(spark):
    texts = ["a　漢 b\x0bc ", "\U0001f600ç 1\x85漢", "", None, "　　"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(
        tx.dense_chars(F.col("t")), tx.letter_count(F.col("t")), tx.cjk_count(F.col("t")), tx.cjk_ratio(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("a漢bc", 4, 2, 0.25), ("\U0001f600ç1漢", 2, 1, 0.25), ("", 0, 0, 0.0),
                                        (None, None, None, 0.0), ("", 0, 2, 0.0)]
