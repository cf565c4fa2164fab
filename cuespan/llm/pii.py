"""Personal data: exact patterns, and a linear-chain CRF over word shapes.

The patterns give the base spans. The field is trained from a small labelled
table by gradient steps on its likelihood, with forward-backward sums over all
rows at once, and adds spans that the patterns miss: spaced or spelt-out
addresses, numbers without a country code. A base span is never changed.

Decoding is Viterbi in numpy over all texts of a slice. A word whose shape
scores "other" so far ahead that no neighbour can change it, is "other" in every
best path; the chain is cut there, which is exact and leaves short runs.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.llm.common import slices
from cuespan.llm.pii_table import ROWS

KINDS = ("email", "ip", "card", "phone")
TAGS = ("other", *KINDS)
KNOWN_WORDS = 400_000
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
# a match that began inside a run of digits would have begun at its first one
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# words that join or announce personal data keep their letters in their shape
LINKS = frozenset("at dot (at) (dot) [at] [dot] tel tel. phone fax mobile call dial ring mail host ip card visa number no. version page".split())

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Each @ is looked at once: the local part is the run of its letters before
    it, after the last match. A pattern would start anew at every letter."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_LETTERS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
            floor = domain.end()
        at = text.find("@", max(at + 1, floor))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, by kind as in KINDS, then start."""
    out = emails(text)
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


class _Classes(dict):
    def __missing__(self, code: int) -> str:
        kind = unicodedata.category(chr(code))
        self[code] = "X" if kind in ("Lu", "Lt") else "x" if kind[0] in "LM" else "d" if kind == "Nd" else chr(code) if code < 128 else "?"
        return self[code]


_CLASSES = _Classes()


def shape(word: str) -> str:
    low = word.lower()
    return low if low in LINKS else word.translate(_CLASSES)


def own_features(form: str) -> list[str]:
    """Features of one shape."""
    digits = form.count("d")
    short = re.sub(r"(.)\1+", r"\1+", form)
    marks = "".join(sorted({c for c in form if c not in "Xxd"}))[:6]
    out = [f"short={short[:16]}", f"marks={marks}", f"first={form[:1]}", f"last={form[-1:]}", f"digits={min(digits, 13)}",
           f"letters={digits == 0 and 'x' in form.lower()}", "bias"]
    out.append("runs=" + "-".join(str(min(len(r), 5)) for r in re.findall("d+", form)[:5]))
    if form in LINKS:
        out.append(f"word={form}")
    if "@" in form:
        out.append("at")
    return out


def near_features(form: str) -> list[str]:
    """What a neighbour sees of a shape."""
    return [f"short={re.sub(r'(.)\1+', r'\1+', form)[:12]}", f"digits={min(form.count('d'), 5)}",
            f"word={form if form in LINKS else ''}", f"at={'@' in form}"]


def labelled_rows(rows: str = ROWS) -> list[tuple[list[str], list[int]]]:
    """Words and tags of each row of the labelled table."""
    out = []
    for line in filter(None, map(str.strip, rows.splitlines())):
        words, tags = [], []
        for kind, inner, plain in re.findall(r"\[(email|ip|card|phone) ((?:[^\[\]]|\[at\]|\[dot\]|\[\.\])+)\]\S*|(\S+)", line):
            new = inner.split() if kind else [plain]
            words += new
            tags += [TAGS.index(kind) if kind else 0] * len(new)
        out.append((words, tags))
    return out


class Field:
    """A linear-chain CRF: weights of features per tag, and of tag pairs."""

    def __init__(self, rows: list[tuple[list[str], list[int]]], steps: int = 300, rate: float = 0.1, ridge: float = 0.02):
        forms = [[shape(w) for w in words] for words, _ in rows]
        names: dict[str, int] = {}
        longest, n = max(map(len, forms)), len(rows)
        lists = [[[names.setdefault(f, len(names)) for f in self._features(own, t)] for t in range(len(own))] for own in forms]
        active = np.zeros((n, longest, len(names)))
        gold, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
        for i, own in enumerate(lists):
            for t, found in enumerate(own):
                active[i, t, found] = 1.0
            gold[i, :len(own)], mask[i, :len(own)] = rows[i][1], True
        self.names, k = names, len(TAGS)
        w, a = np.zeros((len(names), k)), np.zeros((k, k))
        target = np.eye(k)[gold] * mask[..., None]
        before = np.concatenate([np.zeros((n, 1), np.int64), gold[:, :-1]], 1)
        pairs = np.zeros((k, k))
        np.add.at(pairs, (before[mask], gold[mask]), 1)
        ends = np.zeros(k)
        np.add.at(ends, gold[np.arange(n), mask.sum(1) - 1], 1)
        pairs[:, 0] += ends  # a row ends before a virtual "other"
        state = [np.zeros_like(x) for x in (w, w, a, a)]
        for step in range(1, steps + 1):
            tags, expected = self._expect(active @ w, a, mask)
            for at, (x, slope) in enumerate(((w, np.tensordot(active, tags - target, ((0, 1), (0, 1))) + ridge * n * w / 10),
                                             (a, expected - pairs + ridge * n * a))):
                m, v = state[2 * at], state[2 * at + 1]
                m += 0.1 * (slope - m)
                v += 0.001 * (slope ** 2 - v)
                x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.weights, self.pairs = w, a
        # how far "other" must lead for no neighbours to change it
        self.lead = -(a[:, :1] - a).min(0) - (a[:1] - a).min(1)
        self._prepare()

    @staticmethod
    def _features(forms: list[str], t: int) -> list[str]:
        out = own_features(forms[t])
        out += ["<" + f for f in near_features(forms[t - 1] if t else "")]
        return out + [">" + f for f in near_features(forms[t + 1] if t + 1 < len(forms) else "")]

    @staticmethod
    def _expect(scores: np.ndarray, a: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected tags and expected tag pairs, rows between virtual "other"s."""
        def total(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

        n, longest, k = scores.shape
        ahead = np.zeros((n, longest, k))
        behind = np.zeros((n, longest, k))
        ahead[:, 0] = a[0] + scores[:, 0]
        for t in range(1, longest):
            new = total(ahead[:, t - 1, :, None] + a, 1) + scores[:, t]
            ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
        last = mask.sum(1) - 1
        behind[np.arange(n), last] = a[:, 0]
        for t in range(longest - 2, -1, -1):
            new = total(a + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where((t < last)[:, None], new, behind[:, t])
        z = total(ahead[:, -1] + a[:, 0], 1)
        tags = np.where(mask[..., None], np.exp(ahead + behind - z[:, None, None]), 0)
        pair = np.exp(ahead[:, :-1, :, None] + a + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None])
        expected = (pair * mask[:, 1:, None, None]).sum((0, 1))
        expected[0] += tags[:, 0].sum(0)
        expected[:, 0] += tags[np.arange(n), last].sum(0)
        return tags, expected

    def _prepare(self) -> None:
        self.number: dict[str, int] = {}  # of a shape
        self.scores: list[np.ndarray] = []  # own, as left neighbour, as right neighbour
        self.words: dict[str, int] = {}
        self.edge = self._shape_number("")

    def _sum(self, features: list[str]) -> np.ndarray:
        found = [self.names[f] for f in features if f in self.names]
        return self.weights[found].sum(0) if found else np.zeros(len(TAGS))

    def _shape_number(self, form: str) -> int:
        if form not in self.number:
            self.number[form] = len(self.scores)
            near = near_features(form)
            self.scores.append(np.concatenate([self._sum(own_features(form)) if form else np.zeros(len(TAGS)),
                                               self._sum(["<" + f for f in near]), self._sum([">" + f for f in near])]))
        return self.number[form]

    def _word_number(self, word: str) -> int:
        self.words[word] = number = self._shape_number(shape(word))
        return number

    def tags(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The best tags of every list of words."""
        if len(self.words) > KNOWN_WORDS or len(self.scores) > KNOWN_WORDS:
            self._prepare()
        known, number, k = self.words, self._word_number, len(TAGS)
        sizes = np.array([len(t) for t in texts], np.int64)
        # each text between two edges, so that neighbours are looked up at once
        flat = np.array([n for t in texts for n in (self.edge, *(known[w] if w in known else number(w) for w in t), self.edge)], np.int64)
        table = np.stack(self.scores)
        inner = np.ones(len(flat), bool)
        first = np.cumsum(sizes + 2) - (sizes + 2)
        inner[first] = inner[first + sizes + 1] = False
        at = np.flatnonzero(inner)
        scores = table[flat[at], :k] + table[flat[at - 1], k:2 * k] + table[flat[at + 1], 2 * k:]
        sure = ((scores[:, :1] - scores - self.lead)[:, 1:] > 0).all(1)
        best = np.zeros(len(at), np.int64)
        unsure = np.flatnonzero(~sure)
        if len(unsure):
            new = np.concatenate([[True], (at[unsure[1:]] - at[unsure[:-1]]) > 1])
            start = np.flatnonzero(new)
            self._viterbi(scores, unsure[start], np.diff(np.append(start, len(unsure))), best)
        cuts = np.cumsum(sizes)[:-1]
        return np.split(best, cuts)

    def _viterbi(self, scores: np.ndarray, begin: np.ndarray, size: np.ndarray, best: np.ndarray) -> None:
        """Best tags of runs of words, each run between two "other"s; runs of
        about the same length are decoded together."""
        level = np.ceil(np.log2(size)).astype(int)
        for own in np.unique(level):
            rows = np.flatnonzero(level == own)
            longest, n = int(size[rows].max()), len(rows)
            back = np.zeros((longest, n, len(TAGS)), np.int8)
            now = self.pairs[0] + scores[begin[rows]]
            for t in range(1, longest):
                live = size[rows] > t
                step = now[live][:, :, None] + self.pairs
                back[t, live] = step.argmax(1)
                now[live] = step.max(1) + scores[begin[rows[live]] + t]
            tag = (now + self.pairs[:, 0]).argmax(1)
            for t in range(longest - 1, -1, -1):
                live = size[rows] > t
                best[begin[rows[live]] + t] = tag[live]
                tag[live] = back[t, live, tag[live]]

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Spans of tagged words without the marks around them, where the kind
        is borne out by what they hold."""
        out = []
        for text, tags in zip(texts, self.tags([t.split() for t in texts]), strict=True):
            found: list[Span] = []
            if tags.any():
                places = [m.span() for m in re.finditer(r"\S+", text)]
                edge = np.flatnonzero(np.diff(tags, prepend=0, append=0))
                for a, b in zip(edge, edge[1:], strict=False):
                    if tags[a]:
                        found += _trimmed(text, TAGS[tags[a]], places[a][0], places[b - 1][1])
            out.append(found)
        return out


def _trimmed(text: str, kind: str, start: int, end: int) -> list[Span]:
    keep = "+(" if kind == "phone" else ""
    while start < end and not text[start].isalnum() and text[start] not in keep:
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    inside = text[start:end]
    digits = len(re.findall("[0-9]", inside))
    borne_out = {"email": bool(re.search(r"@|\bat\b", inside, re.I) and re.search(r"\.|\bdot\b", inside, re.I)),
                 "ip": inside.count(".") >= 3 and 4 <= digits <= 12, "card": 13 <= digits <= 19, "phone": 7 <= digits <= 15}
    return [(kind, start, end)] if borne_out[kind] else []


@lru_cache(maxsize=1)
def field() -> Field:
    """Trained once on the driver and broadcast; the labelled table bounds it."""
    return Field(labelled_rows())


def find(texts: list[str], chain: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans: the base ones and those of the field that
    touch none of them, by kind, then start."""
    out = []
    for text, extra in zip(texts, chain.spans(texts), strict=True):
        base = base_spans(text)
        more = [s for s in extra if all(s[2] <= b[1] or b[2] <= s[1] for b in base)]
        out.append((base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` with counts of base spans by kind, their digest
    and all spans of every whole text.

    A null text counts as empty and has no span. Places are code points, ends
    exclusive. Repeated rows are scanned each; other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field())
    kept = docs.select("text", *[F.col(c).alias(f"_{c}") for c in columns])
    schema = (", ".join(f"`_{c}` {dict(docs.dtypes)[c]}" for c in columns)
              + "".join(f", n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = find([t or "" for t in part.column(0).to_pylist()], shared.value)
            yield pa.record_batch(
                [*part.columns[1:], *(pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS),
                 pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]),
                 pa.array([written(spans) for _, spans in found])],
                [*(f"_{c}" for c in columns), *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return kept.mapInArrow(run, schema).withColumnsRenamed({f"_{c}": c for c in columns})


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with every span in ``column`` replaced by its kind in brackets;
    spans that overlap are replaced as one, by the kind that begins first. Null
    stays null."""
    def hide(text: str | None, spans: list[Span]) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    shared = docs.sparkSession.sparkContext.broadcast(field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part[column].to_pylist()
            clean = [hide(t, spans) for t, (_, spans) in zip(texts, find([t or "" for t in texts], shared.value), strict=True)]
            yield part.set_column(part.schema.get_field_index(column), column, pa.array(clean, pa.string()))

    return docs.mapInArrow(run, docs.schema)
