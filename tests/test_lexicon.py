import random
import re

import pytest

from cuespan.operators import memory


@pytest.mark.parametrize("seed", [1, 2])
def test_places_of_terms_by_a_pattern_for_each(spark, seed, monkeypatch):
    monkeypatch.setattr(memory, "PART_TERMS", 7)  # several parts and blocks
    monkeypatch.setattr(memory, "BLOCK_CHARS", 300)
    rng = random.Random(seed)
    letters = "abcAB \u0130\u0131i\u017fs\u1e9e\u00df\u6c34\u30c6\u212ak."
    words = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 4))) for _ in range(60)} - {" ", "  ", "   "})
    terms = [(rng.choice("xy"), i, w, rng.choice(["one", "two"])) for i, w in enumerate(words) if w.strip() == w]
    texts = [(s, i, None if i == 3 else "".join(rng.choices(letters, k=rng.randrange(30)))) for i in range(60) for s in "xyz"]
    found = memory.lexicon_matches(spark.createDataFrame(texts, "scope_id string, query_id long, text string"),
                                   spark.createDataFrame(terms, "scope_id string, line_no long, source_term string, target_term string"))
    got = {(r.scope_id, r.query_id, r.start, r.end) for r in found.collect()}
    want = {(s, i, m.start(), m.start() + len(m[1])) for s, i, t in texts if t for k, _, w, _ in terms if k == s
            for m in re.finditer(f"(?=({re.escape(w)}))", t, re.IGNORECASE)}
    assert got == want and want
    assert found.count() == found.select("scope_id", "query_id", "start", "end", "norm").distinct().count()


def test_an_ambiguous_text_is_one_row_and_answers_follow_from_all_places(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(memory, "PART_TERMS", 5)
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abcdeçkK水", k=rng.randrange(2, 5))) for _ in range(40)})
    terms = [("x", i, w, rng.choice(["one", "Two", "three"])) for i, w in enumerate([*words, *words[::9]])]
    texts = [("x", i, "-".join(rng.choices(["q", "qq", *words], [60, 60, *[1] * len(words)], k=rng.randrange(1, 9)))) for i in range(150)]
    asked = spark.createDataFrame(texts, "scope_id string, query_id long, text string")
    lexicon = spark.createDataFrame(terms, "scope_id string, line_no long, source_term string, target_term string")
    places = {}
    for r in memory.lexicon_matches(asked, lexicon).collect():
        places.setdefault(r.query_id, []).append(r)
    want = {}
    for _, i, text in texts:
        own = places.get(i, [])
        good = sorted((r.start, -r.end, r.target, r.norm) for r in own if not r.collides)
        clash = any(a[0] < -b[1] and b[0] < -a[1] and (*a[:2], a[2].lower()) != (*b[:2], b[2].lower()) for a in good for b in good)
        if not own:
            want[i] = ("none", None, 0)
        elif clash or any(r.collides or r.touches for r in own):
            want[i] = ("ambiguous", None, len(good))
        else:
            out, end = "", 0
            for start, back, target, _ in good:
                if start >= end:
                    out, end = out + text[end:start] + target, -back
            want[i] = ("suggestion", out + text[end:], len(good))
    got = {r.query_id: (r.status, r.translation, r.matches) for r in memory.lexicon_suggest(asked, lexicon).collect()}
    assert got == want and {s for s, _, _ in want.values()} == {"none", "ambiguous", "suggestion"}
    rows = memory._judge_texts(pd.DataFrame({"scope_id": ["x"], "query_id": [1], "text": ["abab" * 50]}), pd.DataFrame(
        {"source_term": ["ab", "ba"], "norm": ["ab", "ba"], "target": ["1", "2"], "targets": [1, 1]}), ["scope_id"])
    assert len(rows) == 1 and rows.n[0] == 199 and rows.starts[0] == []
