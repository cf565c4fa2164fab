"""Which words lie near a dictionary word: a filter of bounded size.

Keys of words, of words with one letter masked and of words with one letter left
out are bits of one field. A cut of a token whose parts have no key in it cannot
be repaired, so most cuts go before anything is shuffled, and so do the steps of a
part that lead nowhere. A bit that is set by chance costs a row and never a result.
The field has sixteen bits a key, up to 64 MB; beyond that it fills up and tells less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
KEY_BITS, HASHES = 16, 4
BLOCK_ROWS = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
WHOLE, STRONG, LONGER, MASKED, KNOWN = (np.uint64(0xD6E8FEB86659FD93 * (i + 1) % (1 << 64)) for i in range(5))
#: Steps from a part to a word: a letter replaced, a letter too many, a letter too few.
REPLACED, SURPLUS, MISSING = 0, 1, 2
SIZE, PLACE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Words:
    """Letters of many words as numbers whose sums are hashes of any part."""

    def __init__(self, words: list[str]):
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(self.size) - self.size
        longest = int(self.size.max(initial=0)) + 1
        self.back = _powers(BACK, longest)
        place = np.arange(len(letters)) - np.repeat(self.first, self.size)
        self.worth = _mix(letters + BASE) * _powers(BASE, longest)[place]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.worth, dtype=np.uint64)])

    def whole(self, lo: np.ndarray, hi: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """The part of letters lo to hi of a word that begins ``shift`` letters before lo."""
        return (self.sums[hi] - self.sums[lo]) * self.back[shift]

    def each(self, lo, hi, shift):
        """Per letter of every part: the part, the letter's place, and the hashes
        of the part without its value and of the part closed up over it."""
        size = hi - lo
        part = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size)
        here, turn = lo[part] + at, self.back[shift][part]
        masked = self.whole(lo, hi, shift)[part] - self.worth[here] * turn
        closed = ((self.sums[here] - self.sums[lo[part]]) + (self.sums[hi[part]] - self.sums[here + 1]) * BACK) * turn
        return part, at.astype(np.uint64), masked, closed


def _key(kind: np.uint64, hashed: np.ndarray, size: np.ndarray, at: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:  # noqa: B008
    return _mix(hashed + kind + size.astype(np.uint64) * SIZE + at * PLACE)


def _bits(key: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = key >> np.uint64(32) | np.uint64(1)
    for i in range(HASHES):
        yield (key + np.uint64(i) * step & np.uint64(bits - 1)).astype(np.int64)


def _held(field: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = np.arange(len(key))
    step = key >> np.uint64(32) | np.uint64(1)
    for i in range(HASHES):
        bit = (key[at] + np.uint64(i) * step[at] & np.uint64(len(field) * 8 - 1)).astype(np.int64)
        at = at[(field[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
    found = np.zeros(len(key), bool)
    found[at] = True
    return found


def field_bits(words: DataFrame, known: int = 0) -> int:
    """Bits of the field of the words (word, strong) and of ``known`` whole ones."""
    keys = words.agg(F.sum(1 + F.when(F.col("strong"), 1 + 2 * F.length("word")).otherwise(0))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * (keys + known) - 1).bit_length()))


def _dictionary_bits(bits: int):
    """The bits of words (word, strong); strong ones can be the repair of a part.
    Where strong is null, the word is one to look up whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                look = part["strong"].is_null().to_numpy(zero_copy_only=False)
                strong = part["strong"].fill_null(False).to_numpy(zero_copy_only=False)
                words = _Words(part["word"].to_pylist())
                lo, hi, none = words.first, words.first + words.size, np.zeros(len(words.size), np.int64)
                whole = words.whole(lo, hi, none)
                lo, hi, none, size = lo[strong], hi[strong], none[strong], words.size[strong]
                own, place, masked, closed = words.each(lo, hi, none)
                keys = np.concatenate([
                    _key(KNOWN, whole[look], words.size[look]), _key(WHOLE, whole[~look], words.size[~look]),
                    _key(STRONG, whole[strong], size), _key(MASKED, masked, size[own], place), _key(LONGER, closed, size[own] - 1)])
                yield pa.record_batch([pa.array(np.unique(np.concatenate(list(_bits(keys, bits)))))], ["bit"])

    return run


def reach_field(words: DataFrame, bits: int) -> np.ndarray:
    """The field of the words (word, strong), of ``bits`` bits."""
    place = F.col("bit") + 1
    rows = (words.select("word", "strong").mapInArrow(_dictionary_bits(bits), "bit long")
            .select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).toLocalIterator())
    field = np.zeros(bits // 8, np.uint8)
    for r in rows:
        own = np.frombuffer(r.bits, np.uint8)[:len(field)]
        field[(r.bucket - 1) * 4096:(r.bucket - 1) * 4096 + len(own)] = own
    return field


def _near(field: np.ndarray, words: _Words, lo: np.ndarray, hi: np.ndarray, shift: np.ndarray, wide: int) -> np.ndarray:
    """Whether each part equals a word or is one letter step from a strong one."""
    size, whole = hi - lo, words.whole(lo, hi, shift)
    near = _held(field, _key(WHOLE, whole, size))
    near |= (size <= wide) & _held(field, _key(LONGER, whole, size))
    far = np.flatnonzero(~near)
    own, place, masked, closed = words.each(lo[far], hi[far], shift[far])
    found = _held(field, _key(STRONG, closed, size[far][own] - 1))
    short = np.flatnonzero(size[far][own] <= wide)
    found[short] |= _held(field, _key(MASKED, masked[short], size[far][own[short]], place[short]))
    near[far[own[found]]] = True
    return near


def near_cuts(tokens: DataFrame, field, least: int, longest: int, wide: int) -> DataFrame:
    """(token, k) of the cuts of ``token`` after k letters whose two parts, of
    ``least`` letters or more, may both be near a dictionary word. ``folded`` is
    the token as the field spells it, ``longest`` the most letters of a word there,
    ``field`` its broadcast; parts of up to ``wide`` letters may lack or change one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # letters of all parts of a block stay bounded; a part is one letter longer than a word at most
                part = batch.slice(at, 1_000)
                at += part.num_rows
                words = _Words(part["folded"].to_pylist())
                begin, end = np.maximum(least, words.size - longest - 1), np.minimum(words.size - least, longest + 1)
                count = np.maximum(end - begin + 1, 0)
                row = np.repeat(np.arange(len(count)), count)
                k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin[row]
                step = max(1, BLOCK_ROWS // (2 * longest + 2))
                kept = []
                for i in range(0, len(row), step):
                    own, cut = row[i:i + step], k[i:i + step]
                    first = words.first[own]
                    ok = _near(field.value, words, first, first + cut, np.zeros(len(cut), np.int64), wide)
                    own, cut, first = own[ok], cut[ok], first[ok]
                    if len(own):
                        ok = _near(field.value, words, first + cut, first + words.size[own], cut, wide)
                        kept.append((own[ok], cut[ok]))
                if kept:
                    own, cut = (np.concatenate(x) for x in zip(*kept, strict=True))
                    yield pa.record_batch([part["token"].take(pa.array(own)), pa.array(cut.astype(np.int32))], ["token", "k"])

    return tokens.select("token", "folded").mapInArrow(run, "token string, k int")


def maybe_known(tokens: DataFrame, field, cuts: tuple[int, ...], more: int) -> DataFrame:
    """(token, word) where word is ``token`` without its last letters, one of
    ``cuts`` many, that leave over ``more``; words the field does not know are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)["token"]
                text = part.to_pylist()
                words, out = _Words(text), []
                for cut in cuts:
                    own = np.flatnonzero(words.size > cut + more)
                    lo = words.first[own]
                    ok = _held(field.value, _key(KNOWN, words.whole(lo, lo + words.size[own] - cut, np.zeros(len(own), np.int64)), words.size[own] - cut))
                    out += [(text[i], text[i][:len(text[i]) - cut]) for i in own[ok].tolist()]
                if out:
                    token, word = zip(*out, strict=True)
                    yield pa.record_batch([pa.array(token, pa.string()), pa.array(word, pa.string())], ["token", "word"])

    return tokens.select("token").mapInArrow(run, "token string, word string")


def near_steps(parts: DataFrame, field, rivals, wide: int) -> DataFrame:
    """(token, step, at) of the single letter steps that may lead from ``folded`` to
    a word of the field ``rivals``: letter ``at`` replaced or left out, or a letter
    more somewhere. Tokens that no step leads to a strong word of ``field`` have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 20_000):
                part = batch.slice(first, 20_000)
                words = _Words(part["folded"].to_pylist())
                size, none = words.size, np.zeros(len(words.size), np.int64)
                lo, hi = words.first, words.first + size
                own, at, masked, closed = words.each(lo, hi, none)
                tried = np.flatnonzero(size <= wide), np.arange(len(own)), np.flatnonzero(size[own] <= wide)
                keys = (_key(LONGER, words.whole(lo, hi, none), size)[tried[0]], _key(STRONG, closed, size[own] - 1),
                        _key(MASKED, masked[tried[2]], size[own[tried[2]]], at[tried[2]]))
                owner = tried[0], own, own[tried[2]]
                near = np.zeros(len(size), bool)
                for who, key in zip(owner, keys, strict=True):
                    near[who[_held(field.value, key)]] = True
                kept = [np.flatnonzero(near[who]) for who in owner]
                more, less, other = (t[k[_held(rivals.value, key[k])]] for t, key, k in zip(tried, keys, kept, strict=True))
                row = np.concatenate([more, own[less], own[other]])
                step = np.repeat(np.array([MISSING, SURPLUS, REPLACED], np.int32), [len(more), len(less), len(other)])
                place = np.concatenate([none[more], at[less].astype(np.int64), at[other].astype(np.int64)]).astype(np.int32)
                if len(row):
                    yield pa.record_batch([part["token"].take(pa.array(row)), pa.array(step), pa.array(place)], ["token", "step", "at"])

    return parts.select("token", "folded").mapInArrow(run, "token string, step int, at int")
