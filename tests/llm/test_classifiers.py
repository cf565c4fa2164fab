import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuespan.llm import language, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_backoff_is_shared_and_proper():
    grams = {}
    for word, one, zero in (("abab", 3, 1), ("abc", 0, 4), ("b", 2, 2)):
        for g in toxicity.ngrams(word, 3):
            old = grams.get(g, (0, 0))
            grams[g] = (old[0] + one, old[1] + zero)
    models = toxicity.KneserNey(grams, 3)
    letters = sorted({g[-1] for g in grams})
    for history in ("^^", "^a", "ab", "ba"):
        for side in (0, 1):
            total = sum(models.probabilities(history + x)[side] for x in letters)
            unseen = models.probabilities(history + "?")[side]
            assert total + unseen == pytest.approx(1, abs=1e-9)
    assert models.gram_ratio("zzz") == 0.0
    one, zero = models.probabilities("abc")
    assert models.gram_ratio("abc") == pytest.approx(math.log(one / zero)) and one < zero


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_edge_rows(spark):
    from pyspark.sql import functions as F
    rows = [(i, f"you awful brat{i} scoundrel noise" if i % 3 == 0 else f"the calm river number w{i} flows on", int(i % 3 == 0))
            for i in range(300)]
    rows += [(900, None, 1), (901, "", None), (902, "word " * 30000, None), (903, rows[0][1], None), (903, rows[0][1], None), (None, "x", None)]
    docs, labels = labelled(spark, rows)
    scorer = toxicity.train(docs, labels, F.lit(True))
    got = toxicity.score(docs, scorer).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    right = sum(r.predicted == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 300)
    assert right >= 295
    assert {r.predicted for r in got if r.doc_id in (900, 901)} == {0}
    none = toxicity.train(docs, labels.where("doc_id < 0"), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), scorer).collect() == []


def test_toxicity_held_out(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op4_class_kneser_ney"](spark, SF).collect() if r.held_out and r.doc_id in truth]
    hits = sum(r.predicted and truth[r.doc_id] for r in rows)
    assert hits >= 0.5 * sum(truth[r.doc_id] for r in rows)
    assert sum(r.predicted and not truth[r.doc_id] for r in rows) <= 0.05 * len(rows)


def parse_by_hand(train, text):
    phrases = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in train:
            size += 1
        phrases, at = phrases + 1, at + size
    return phrases


@settings(max_examples=150, deadline=None)
@given(st.text("ab c", min_size=1, max_size=30), st.text("ab c", min_size=1, max_size=30), st.lists(st.text("abd c", max_size=300), max_size=4))
def test_phrases_by_brute_force(one, two, texts):
    parser = language.CrossParser({"x": one, "y": two})
    texts = [language.plain(t) for t in texts]
    size, phrases = parser.phrases(texts)
    for t, n, own in zip(texts, size.tolist(), phrases.tolist(), strict=True):
        assert n == len(t)
        for name, got in zip(parser.languages, own, strict=True):
            train = language.plain({"x": one, "y": two}[name])
            assert got == sum(parse_by_hand(train, t[i:i + language.BLOCK]) for i in range(0, len(t), language.BLOCK))


def test_language_edge_rows(spark):
    from pyspark.sql import functions as F
    rows = [(i, f"the cat number {i} sat here", "en", 1) for i in range(30)] + [(100 + i, f"der hund ging {i} nach haus", "de", 1) for i in range(30)]
    rows += [(500, None, "en", 1), (501, "", None, 1), (502, "12 ½² !?", "fr", 1), (503, "the cat " * 20000, None, 1), (None, "der hund", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in language.predict(docs, language.train(docs, F.lit(True))).collect()}
    assert all(got[i].lang_pred == "en" and got[100 + i].lang_pred == "de" for i in range(30))
    assert [got[i].lang_pred for i in (500, 501, 502, 503, None)] == ["und", "und", "und", "en", "de"]
    assert language.train(docs.limit(0), F.lit(True)).languages == []
    assert {r.lang_pred for r in language.predict(docs, language.CrossParser({})).collect()} == {"und"}


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in queries.QUERIES["op5_cross_parsing_language"](spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) >= 0.97


@settings(max_examples=40, deadline=None)
@given(st.text("abxyzжшщ", min_size=1, max_size=40), st.text("жшщюя ", min_size=1, max_size=40), st.lists(st.text("abxyжшщю ", max_size=300), max_size=4))
def test_phrases_with_searched_letters(one, two, texts):
    old, language.LETTERS = language.LETTERS, 2
    try:
        parser = language.CrossParser({"x": one, "y": two})
        texts = [language.plain(t) for t in texts]
        _, phrases = parser.phrases(texts)
    finally:
        language.LETTERS = old
    for t, own in zip(texts, phrases.tolist(), strict=True):
        for train, got in zip((one, two), own, strict=True):
            train = language.plain(train)
            assert got == sum(parse_by_hand(train, t[i:i + language.BLOCK]) for i in range(0, len(t), language.BLOCK))


def test_no_trained_letter_is_lost():
    """Three scripts and one of many letters: more letters than any column number holds."""
    greek, cyrillic = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    signs = "".join(chr(0x4E00 + i) for i in range(3000))
    training = {"la": "the quick brown fox jumps over the lazy dog " * 40, "ru": cyrillic * 3, "gr": greek, "zh": signs}
    parser = language.CrossParser(training)
    asked = {"ru": cyrillic[20:], "gr": greek[3:20], "zh": signs[2500:2600], "la": "lazy dog"}
    names, _ = parser.classify(list(asked.values()))
    assert names == list(asked)
    _, phrases = parser.phrases([signs[2500:2600]])
    assert phrases[0][parser.languages.index("zh")] == 1


def test_bits_of_the_compiled_text(monkeypatch):
    monkeypatch.setattr(language, "TABLE_STATES", 400)
    parser = language.CrossParser({"x": "ab" * 500, "y": "cd" * 20})
    assert parser.bits.tolist() == [math.log2(98), math.log2(40)]


def test_without_a_language_only_letterless_texts_go(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(1, "the cat", None), (2, "12 !?", None), (3, None, None), (4, "der hund", None)], "doc_id long, text string, lang string")
    parser = language.train(docs, F.lit(True))
    assert parser.languages == []
    assert {r.doc_id for r in language.determined(docs, parser).collect()} == {1, 4}


def test_few_toxic_texts_are_learned(spark):
    from pyspark.sql import functions as F
    rows = [(i, f"the calm river number w{i} flows on past the mill", 0) for i in range(40)]
    rows += [(100 + i, f"you awful scoundrel and filthy rogue w{i} be gone", 1) for i in range(5)]
    asked = [(200, "gone you filthy scoundrel and awful rogue", None), (201, "past the mill the river flows", None)]
    docs, labels = labelled(spark, rows + asked)
    scorer = toxicity.train(docs, labels, F.lit(True))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, scorer).collect()}
    assert got == {i: int(100 <= i < 201) for i in got}
    assert {r.doc_id for r in toxicity.without_toxic(docs, scorer, toxicity.THRESHOLD).collect()} == {i for i, p in got.items() if not p}


def test_no_document_goes_without_models(spark):
    from pyspark.sql import functions as F
    docs, labels = labelled(spark, [(i, f"text {i}", 1) for i in range(9)])
    scorer = toxicity.train(docs, labels, F.lit(True))
    assert scorer.models is None and toxicity.without_toxic(docs, scorer, toxicity.THRESHOLD).count() == 9


def test_phrases_go_on_over_blocks(monkeypatch):
    import random
    rng = random.Random(4)
    train = {"x": "".join(rng.choices("abc ", k=400)) + "a" * 700, "y": "".join(rng.choices("abd ", k=900))}
    texts = ["a" * 3000, train["x"][:300] * 5, "".join(rng.choices("abcd ", k=5000)), train["y"][100:800] + "zz" + train["y"], "b", "", "a" * 511 + "d"]
    parser = language.CrossParser(train)
    own = {lang: language.plain(t) for lang, t in train.items()}
    for block in (256, 7):
        monkeypatch.setattr(language, "BLOCK", block)
        size, phrases = parser.phrases(texts)
        assert size.tolist() == [len(t) for t in texts]
        assert phrases.tolist() == [[parse_by_hand(own[lang], t) for lang in parser.languages] for t in texts]
