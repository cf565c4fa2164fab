import hashlib
import itertools
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cuespan.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@settings(max_examples=400, deadline=None)
@given(st.text("a.@-é ", max_size=24))
def test_emails_as_the_pattern(text):
    assert pii.emails(text) == [("email", *m.span()) for m in EMAIL.finditer(text)]


def slow_base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("012459.+- (", max_size=40))
def test_numbers_as_the_patterns(text):
    assert pii.base_spans(text) == slow_base(text)


def test_best_path_by_brute_force():
    chain = pii.field()
    for line in ("at dot com 4 x", "Call 555-867-5301 or 12", "joe at x.example", "(437) 555-0689 4111 1111", "7"):
        words = line.split()
        forms = [pii.shape(w) for w in words]
        scores = np.stack([chain._sum(chain._features(forms, t)) for t in range(len(words))])

        def value(path, scores=scores):
            full = [0, *path, 0]
            return sum(chain.pairs[a, b] for a, b in itertools.pairwise(full)) + sum(scores[t, y] for t, y in enumerate(path))

        best = max(itertools.product(range(len(pii.TAGS)), repeat=len(words)), key=value)
        assert tuple(chain.tags([words])[0]) == best


def test_learned_its_table_and_adds_spans():
    rows = pii.labelled_rows()
    got = pii.field().tags([w for w, _ in rows])
    wrong = sum(int((g != np.array(t)).sum()) for g, (_, t) in zip(got, rows, strict=True))
    assert wrong <= 0.02 * sum(len(t) for _, t in rows)
    (base, spans), (_, none) = pii.find(["ring (437) 555-0689, not +1 (437) 555-0689.", "In 1998 there were 12 halls."], pii.field())
    assert base == [("phone", 25, 42)] and ("phone", 5, 19) in spans and set(base) < set(spans) and none == []


def test_rows(spark):
    texts = [None, "", "mail é@ a@b.co 10.0.0.1", "x " * 50000 + "a@b.co", "4111 1111 1111 1111", "4111 1111 1111 1111", "+1 2 3 4 5 6 7 8 9 " * 2000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.scan(docs).collect()}
    for i, t in enumerate(texts):
        base = slow_base(t or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert all(f"{k}:{a}:{b}" in got[i].spans.split(",") for k, a, b in base)
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] is None and clean[1] == "" and clean[2] == "mail é@ [EMAIL] [IP]" and clean[4] == "[CARD]"
    assert pii.scan(docs.limit(0)).collect() == []


def test_a_million_digits_take_linear_time():
    begin = time.perf_counter()
    assert pii.base_spans("7" * 1_000_000 + " 1.2.3.4 " + "5" * 1_000_000) == [("ip", 1_000_001, 1_000_008)]
    assert time.perf_counter() - begin < 20
