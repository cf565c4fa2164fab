"""Scores of whole texts against a slow model with plain dictionaries."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from cuespan.llm import toxicity


def slow_ratio(words, word, order=6, d=0.75):
    """log p(word | 1) - log p(word | 0) by the textbook formulas."""
    tops = [Counter(), Counter()]
    for w, label, n in words:
        padded = "^" * (order - 1) + w + "$"
        for i in range(len(w) + 1):
            tops[label][padded[i:i + order]] += n
    level = set(tops[0]) | set(tops[1])
    lower = {}
    for k in range(order - 1, 0, -1):
        lower[k] = Counter(g[1:] for g in level)
        level = set(lower[k])

    def backoff(gram):
        p = 1 / (len(lower[1]) + 1)
        for k in range(1, order):
            part = gram[-k:]
            follow = {g: c for g, c in lower[k].items() if g[:-1] == part[:-1]}
            if follow:
                p = (max(lower[k][part] - d, 0) + d * len(follow) * p) / sum(follow.values())
        return p

    total = 0.0
    padded = "^" * (order - 1) + word + "$"
    for i in range(len(word) + 1):
        gram, ps = padded[i:i + order], []
        for side in (1, 0):
            follow = {g: c for g, c in tops[side].items() if g[:-1] == gram[:-1]}
            whole = sum(follow.values())
            base = backoff(gram)
            ps.append((max(tops[side][gram] - d, 0) + d * len(follow) * base) / whole if whole else base)
        total += math.log(ps[0] / ps[1])
    return total


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_texts_against_plain_dictionaries(seed):
    rng = random.Random(seed)
    words = [("".join(rng.choices("abcé水", k=rng.randrange(1, 9))), rng.randrange(2), rng.randrange(1, 4)) for _ in range(60)]
    grams = {}
    for w, label, n in words:
        for g in toxicity.ngrams(w):
            one, zero = grams.get(g, (0, 0))
            grams[g] = (one + n * label, zero + n * (1 - label))
    models = toxicity.KneserNey(grams)
    asked = [w for w, _, _ in words[:15]] + ["".join(rng.choices("abcxyz", k=rng.randrange(1, 12))) for _ in range(15)]
    slow = {w: slow_ratio(words, w) for w in asked}
    assert toxicity.Ratios(models).words(asked) == pytest.approx([slow[w] for w in asked], abs=1e-9)
    curve = np.array([0.7, 1.1, 2.0, -0.5])
    scorer = toxicity.Scorer(models, curve, 0.0)
    for text in ("", "12 34", " ".join(asked), " ".join(rng.choices(asked, k=90)).upper()):
        own = [slow[w] for w in text.lower().split() if w in slow]
        n = len(own) + 24
        best = max((sum(own[i:i + 24]) for i in range(max(1, len(own) - 23))), default=0) if own else 0
        x = [sum(own) / n, best / 24, math.log1p(100 * sum(max(r - 2, 0) for r in own) / n)] if own else [0, 0, 0]
        z = sum(a * b for a, b in zip(curve, [*x, 1], strict=True))
        assert scorer.score(text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_a_full_memory_changes_no_score(monkeypatch):
    grams = {g: (1, 2) for w in ("abc", "bcd", "xyz") for g in toxicity.ngrams(w)}
    scorer = toxicity.Scorer(toxicity.KneserNey(grams), np.array([1.0, 1.0, 1.0, 0.0]), 0.0)
    texts = [f"abc w{i} bcd" for i in range(9)]
    want = scorer.worker()(texts)
    monkeypatch.setattr(toxicity, "KNOWN", 2)
    own = scorer.worker()
    assert [own([t])[0] for t in texts] == pytest.approx(want.tolist())
