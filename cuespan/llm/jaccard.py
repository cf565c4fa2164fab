"""Jaccard join of word-shingle sets: size-aware, heavy and light.

Documents with the same set are one class, so copies never meet each other.

Light sets (few shingles) list all subsets of the size that a partner of a given
size must share; two of them link exactly when they list a common subset. Heavy
sets scan inverted lists: two sets can only link if their prefixes, the rarest
fifth of each, share a shingle. The boundary is the size at which the expected
number of subsets passes the expected length of the lists. Light sets that a
heavy set may link with stand in the lists too.

How rare a shingle is, is read from counters over all texts, of fixed number;
any order that all documents share gives the same links, so counters that fill
up cost time and nothing else.

Only connected groups are wanted, so pairs within a group are not listed: each
list first links its members with one of them, groups are joined, and only pairs
that share a list and still lie in different groups are compared afterwards.

Before whole sets are brought together, pairs are compared by their marks, a few
bits per shingle that count at least part of what two sets do not share. What
the marks leave open is decided by the sets, so only they meet in full.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.llm.common import slices, stage, width

WORDS, PERCENT = 5, 80
COUNTERS, CHUNK = 1 << 20, 1 << 14
LIGHT_AT_MOST = 16
HOT_LIST, STAR_ROUNDS = 4_096, 2
FILTER_BITS = 1 << 24
SLICE = 500_000  # bytes of text cut into shingles at once: their arrays take some fifty times as much
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-stirred copy of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _tables(seed: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    letters = mix(np.arange(1, 257, dtype=np.uint64) * GOLD + np.uint64(seed))
    powers = mix(np.arange(1, longest + 1, dtype=np.uint64) * GOLD + np.uint64(seed + 7_919)) | np.uint64(1)
    return letters, powers


def shingle_sets(texts: list[str | None], words: int = WORDS, seed: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, all texts at once."""
    data = np.frombuffer(b"".join((t or "").encode("utf-8", "surrogatepass") + b" " for t in texts), np.uint8)
    ends = np.cumsum([len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts])
    lower = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    solid = ~((lower == 32) | ((lower >= 9) & (lower <= 13)))
    edge = np.diff(solid.astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return [np.zeros(0, np.uint64) for _ in texts]
    size = stop - start
    letters, powers = _tables(seed, 1 << int(size.max()).bit_length())
    at = np.flatnonzero(solid)
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    word = mix(np.add.reduceat(letters[lower[at]] * powers[place], first) + size.astype(np.uint64) * GOLD)
    owner = np.searchsorted(ends, start, "right")
    count = np.bincount(owner, minlength=len(texts))
    factor = mix(np.arange(1, words + 1, dtype=np.uint64) * GOLD + np.uint64(seed + 1)) | np.uint64(1)
    padded = np.concatenate([word, np.zeros(words, np.uint64)])
    whole = mix(sum(padded[i:i + len(word)] * factor[i] for i in range(words)) + np.uint64(words))
    out, lo = [], 0
    for n in count.tolist():
        if n >= words:
            out.append(np.unique(whole[lo:lo + n - words + 1]))
        elif n:
            out.append(mix((word[lo:lo + n] * factor[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        lo += n
    return out


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def needed(a, b, percent: int = PERCENT):
    """Shingles that sets of sizes a and b must share: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def partners(n: int, light: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, shared) for each light partner size of a set of size n."""
    sizes = range(-(-percent * n // 100), min(light, 100 * n // percent) + 1)
    out = [(min(n, m), max(n, m), needed(n, m, percent)) for m in sizes]
    return [(a, b, c) for a, b, c in out if c <= a and not c == a == b]  # equal sets are one class


def boundary(sizes: dict[int, int], list_length: float, percent: int = PERCENT) -> int:
    """The largest size whose subsets are expected to cost less than list scans.

    A subset is one row to shuffle, an entry of a list is one row and
    ``list_length`` comparisons.
    """
    def subsets(n: int, light: int) -> int:
        return sum(comb(n, c) for _, _, c in partners(n, light, percent))

    def cost(light: int) -> float:
        far = -(-percent * (light + 1) // 100)
        return sum(rows * ((subsets(n, light) if n <= light else 0)
                           + (prefix_length(n, percent) * (1 + list_length) if n >= far else 0))
                   for n, rows in sizes.items())

    return min(range(LIGHT_AT_MOST + 1), key=cost)


@lru_cache(maxsize=256)
def _left_out(n: int, shared: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), n - shared)), np.int64).reshape(comb(n, shared), n - shared)


def subset_keys(own: np.ndarray, light: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """A key for every subset that a light partner of some size must share, and
    whether the set has the smaller of the two sizes.

    Smaller sets with a common key link with each other and with every larger
    set that has it; two larger sets do not link by it.
    """
    stirred = mix(own + GOLD)
    keys, small = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for a, b, c in partners(len(own), light, percent):
        keys.append(mix(stirred.sum() - stirred[_left_out(len(own), c)].sum(1) + np.uint64((a << 20) + b)))
        small.append(np.full(len(keys[-1]), len(own) == a))
    return np.concatenate(keys), np.concatenate(small)


def marks(own: np.ndarray) -> bytes:
    """A bit for each class of shingle hashes: whether the set has an odd number of it.

    There are two to four times as many classes as shingles, 64 at least."""
    size = 1 << max(6, (2 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(one: bytes, two: bytes) -> int:
    """So many shingles at least are in one of two sets alone, by their marks.

    Halves of the longer marks are added until both have the same classes; a class
    in which the sums differ holds at least one such shingle."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _profile(seed: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        for part in slices(batches, SLICE):
            sets = shingle_sets(part.column(1).to_pylist(), words, seed)
            flat = np.concatenate(sets)
            counters += np.bincount(bucket(flat), minlength=COUNTERS)
            yield pa.record_batch([
                part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), len(s)) for s in sets], np.uint64).view(np.int64)),
                pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) for s in sets], np.uint64).view(np.int64)),
                pa.array([marks(s) for s in sets], pa.binary()),
                pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())],
                ["doc_id", "n", "sig", "sig2", "marks", "chunk", "counts"])
        if counters.any():
            chunks = COUNTERS // CHUNK
            yield pa.record_batch([
                *[pa.nulls(chunks, pa.int64())] * 4, pa.nulls(chunks, pa.binary()), pa.array(range(chunks), pa.int32()),
                pa.array([counters[i * CHUNK:(i + 1) * CHUNK].astype("<i4").tobytes() for i in range(chunks)], pa.binary())],
                ["doc_id", "n", "sig", "sig2", "marks", "chunk", "counts"])

    return run


def _add_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, "<i4").astype(np.int64)
    yield pa.record_batch([pa.array(sums, pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["chunk", "counts"])


def _lists(light: int, order: np.ndarray, seed: int, words: int, percent: int):
    """Rows (key, salt, salts, sig, n, pos) of every set; pos is -1 for a subset
    of the smaller set, -2 for one of the larger."""
    far = -(-percent * (light + 1) // 100)

    def rows(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(own)
        keys, small = subset_keys(own, light, percent) if n <= light else (np.zeros(0, np.uint64), np.zeros(0, bool))
        places, crowd = np.where(small, -1, -2), np.zeros(len(keys), np.int64)
        if n >= far:
            often = order[bucket(own)]
            rare = np.argsort(often, kind="stable")[:prefix_length(n, percent)]
            keys = np.concatenate([keys, own[rare]])
            places = np.concatenate([places, np.arange(len(rare))])
            crowd = np.concatenate([crowd, often[rare]])
        return keys, places, crowd

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in one task are written once
        for part in slices(batches, SLICE):
            parts: list[tuple] = []
            for own in shingle_sets(part.column(0).to_pylist(), words, seed):
                sig = xxhash.xxh64_intdigest(own.tobytes(), len(own))
                if not len(own) or sig in seen:
                    continue
                seen.add(sig)
                keys, places, crowd = rows(own)
                salts = crowd // HOT_LIST + 1
                parts.append((keys, sig % salts.astype(np.uint64), salts, np.full(len(keys), sig, np.uint64),
                              np.full(len(keys), len(own)), places))
            if parts:
                key, salt, salts, sig, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(salts.astype(np.int32)),
                                       pa.array(sig.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32))],
                                      ["key", "salt", "salts", "sig", "n", "pos"])

    return run


LISTED = "key long, salt int, salts int, sig long, n int, pos int"


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, salt, larger, pos, turn, sig), keep lists of two or more sets,
    each row with the first of its list. One row is carried between batches."""
    lead = None  # the first row of the open list, its last sig, whether it was written
    for batch in batches:
        if not batch.num_rows:
            continue
        key, salt, salts, sig, n, pos = (batch[c].to_numpy() for c in ("key", "salt", "salts", "sig", "n", "pos"))
        held = lead is not None and (key[0], salt[0]) == lead[0][:2]
        if held:
            key, salt, salts, sig, n, pos = (np.concatenate([[v], a]) for v, a in zip(lead[0], (key, salt, salts, sig, n, pos), strict=True))
        before = np.concatenate([[0], sig[:-1]])
        starts = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        if held and len(sig) > 1:
            before[1] = lead[1]
        keep = starts | (sig != before)
        last_sig = sig[-1]
        key, salt, salts, sig, n, pos, starts = (a[keep] for a in (key, salt, salts, sig, n, pos, starts))
        heads = np.flatnonzero(starts)
        lengths = np.diff(np.append(heads, len(key)))
        head = np.repeat(heads, lengths)
        shared = np.repeat(lengths > 1, lengths) | (salts > 1)
        open_head = heads[-1]
        written = bool(shared[open_head]) or (held and open_head == 0 and lead[2])
        if held and lead[2]:
            shared[0] = False  # written with an earlier batch
        lead = ((key[open_head], salt[open_head], salts[open_head], sig[open_head], n[open_head], pos[open_head]), last_sig, written)
        at = np.flatnonzero(shared)
        yield pa.record_batch(
            [pa.array(a[at]) for a in (key, salts.astype(np.int32), sig, n.astype(np.int32), pos.astype(np.int32))]
            + [pa.array(a[head[at]]) for a in (sig, n.astype(np.int32), pos.astype(np.int32))],
            ["key", "salts", "sig", "n", "pos", "lsig", "ln", "lpos"])


LED = "key long, salts int, sig long, n int, pos int, lsig long, ln int, lpos int"


def _led(listed: DataFrame) -> DataFrame:
    # a list is led by the set in which its shingle stands nearest the front: that
    # set has fewest rare shingles of its own, so it is the original of its copies
    turn = F.xxhash64("sig")
    return (listed.withColumn("turn", turn).repartition(width(listed), "key", "salt")
            .sortWithinPartitions("key", "salt", F.col("pos") == -2, "pos", "turn", "sig").drop("turn").mapInArrow(_leaders, LED))


def _possible(n: str, pos: str, m: str, other: str, percent: int):
    """Whether the first common element of sets of sizes n and m can stand at
    these places of their common order, if they share enough; so many elements
    must follow in both. Subset keys (below 0) settle it themselves."""
    need = f"ceil({percent} * ({n} + {m}) / {100 + percent})"
    return F.expr(f"{pos} < 0 OR (100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) "
                  f"AND {n} - {pos} >= {need} AND {m} - {other} >= {need})")


def id_filter(ids: DataFrame) -> np.ndarray:
    """One bit for each hash of an id, of fixed size: tells most rows that are
    not wanted before they are shuffled. When it is full it tells none."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)) + 1
    rows = (ids.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        own = np.frombuffer(r.bits, np.uint8)
        bits[(r.bucket - 1) * 4096:(r.bucket - 1) * 4096 + len(own)] = own
    return bits


def components(edges: DataFrame) -> DataFrame:
    """(a, b): the smallest vertex b that each vertex a reaches, for a > b.

    Alternating large and small stars; each step is a minimum per vertex and a
    join back, and its result is written to the shared folder.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stage(small.select("e.*").where("a <> b").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now
        state = seen


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        one, two = part["one"], part["two"]
        shared = [np.intersect1d(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), assume_unique=True).size
                  for a, b in zip(one, two, strict=True)]
        yield pa.record_batch([part["a"], part["b"], part["n"], part["m"], pa.array(shared, pa.int32())], ["a", "b", "n", "m", "shared"])


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, m = part["n"].to_numpy().astype(np.int64), part["m"].to_numpy().astype(np.int64)
            alone = np.array([apart(a.as_py(), b.as_py()) for a, b in zip(part["one"], part["two"], strict=True)], np.int64)
            keep = pa.array((n + m - alone) // 2 >= needed(n, m, percent))
            yield pa.record_batch([part["a"], part["b"]], ["a", "b"]).filter(keep)

    return run


class JaccardJoin:
    """Links between the sets of one table of documents; see ``join``."""

    def __init__(self, docs: DataFrame, words: int, percent: int, seed: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.words, self.percent, self.seed = words, percent, seed

    def profile(self) -> DataFrame:
        """doc_id, n, sig of every document; equal sets have equal sig."""
        made = stage(self.docs.mapInArrow(_profile(self.seed, self.words),
                                          "doc_id long, n long, sig long, sig2 long, marks binary, chunk int, counts binary"), "profile")
        counted = (made.where("chunk IS NOT NULL").select("chunk", "counts").repartition(width(made), "chunk")
                   .mapInArrow(_add_counters, "chunk int, counts binary").collect())  # of fixed size
        self.order = np.zeros(COUNTERS, np.int64)
        for r in counted:
            self.order[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, np.int64)
        self.marked = made.where("chunk IS NULL").select("doc_id", "sig", "n", "marks")
        return made.where("chunk IS NULL").select("doc_id", "n", "sig", "sig2")

    def lists(self, classes: DataFrame) -> DataFrame:
        sizes = {r.n: r.rows for r in classes.where(f"n BETWEEN 1 AND {2 * LIGHT_AT_MOST}").groupBy("n").agg(F.count("*").alias("rows")).collect()}
        # a list that a prefix meets holds about as many sets as its counter beyond the mean
        mean = self.order.mean()
        length = float(np.maximum(self.order - mean, 0).sum() / max(1, self.order.sum()))
        self.light = boundary(sizes, length, self.percent)
        shared = self.docs.sparkSession.sparkContext.broadcast(self.order)  # of fixed size
        light, seed, words, percent = self.light, self.seed, self.words, self.percent

        def run(batches):
            return _lists(light, shared.value, seed, words, percent)(batches)

        listed = self.docs.where("doc_id IS NOT NULL").select("text").mapInArrow(run, LISTED)
        led = stage(_led(listed), "lists")
        # a hot list was led in salted parts; its leaders form a list of their own
        firsts = led.where("salts > 1").select("key", F.lit(0).alias("salt"), F.lit(1).alias("salts"), F.col("lsig").alias("sig"),
                                               F.col("ln").alias("n"), F.col("lpos").alias("pos"))
        return led.drop("salts"), stage(_led(firsts), "hot-leaders").drop("salts")

    @staticmethod
    def ends(pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """(sig, rep): the classes in the pairs (a, b)."""
        return pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(classes.select("sig", "rep"), "sig")

    def near(self, pairs: DataFrame, classes: DataFrame, label: str) -> DataFrame:
        """The pairs (a, b) of classes without those that cannot link by their marks."""
        # one document of a class, so that copies do not meet at their class
        own = (self.marked.join(self.ends(pairs, classes).withColumnRenamed("rep", "doc_id"), ["doc_id", "sig"])
               .dropDuplicates(["sig"]))
        own = stage(own.select("sig", "n", "marks"), f"{label}-marks")
        both = (pairs.select("a", "b").join(own.select(F.col("sig").alias("a"), "n", F.col("marks").alias("one")), "a")
                .join(own.select(F.col("sig").alias("b"), F.col("n").alias("m"), F.col("marks").alias("two")), "b"))
        return stage(both.select("a", "b", "n", "m", "one", "two").mapInArrow(_near(self.percent), "a long, b long"), label)

    def sets_of(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """(sig, n, own): the sets of the classes in the pairs (a, b)."""
        seed, words = self.seed, self.words
        wanted = stage(self.ends(pairs, classes), "wanted")
        near = self.docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select(F.col("rep").alias("doc_id"))))  # of fixed size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = batch["place"].to_numpy()
                batch = batch.filter(pa.array((near.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))
                for part in slices([batch], SLICE):
                    sets = shingle_sets(part["text"].to_pylist(), words, seed)
                    sig = np.array([xxhash.xxh64_intdigest(s.tobytes(), len(s)) for s in sets], np.uint64).view(np.int64)
                    yield pa.record_batch([pa.array(sig), pa.array([len(s) for s in sets], pa.int32()),
                                           pa.array([s.tobytes() for s in sets], pa.binary())], ["sig", "n", "own"])

        place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
        return stage(self.docs.where("doc_id IS NOT NULL").select(place.alias("place"), "text")
                     .mapInArrow(run, "sig long, n int, own binary")
                     .join(wanted.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]), "sets")

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of classes whose sets link."""
        both = (pairs.join(sets.select(F.col("sig").alias("a"), "n", F.col("own").alias("one")), "a")
                .join(sets.select(F.col("sig").alias("b"), F.col("n").alias("m"), F.col("own").alias("two")), "b"))
        common = both.select("a", "b", "n", "m", "one", "two").mapInArrow(_common, "a long, b long, n int, m int, shared int")
        return common.where(f"100 * shared >= {self.percent} * (n + m - shared)").select("a", "b")

    def labels(self, classes: DataFrame) -> DataFrame:
        """(a, b): the smallest class b of the group of class a, for a > b."""
        led, hot = self.lists(classes)
        stars = led.unionByName(hot).where("sig <> lsig").where(_possible("n", "pos", "ln", "lpos", self.percent))
        sure = stars.where("pos < 0 AND lpos = -1").select(F.col("sig").alias("a"), F.col("lsig").alias("b"))  # a common subset is a link
        open_ = stage(stars.where("pos >= 0").groupBy(F.col("sig").alias("a"), F.col("lsig").alias("b")).agg(F.min("lpos").alias("lpos")), "star-pairs")
        close = self.near(open_, classes, "near-stars")
        open_, sets = open_.join(close, ["a", "b"], "left_semi"), self.sets_of(close, classes)
        groups, tried = components(sure), None
        # a member of many lists needs one link, not one for each: every group
        # tries one of its leaders in a round, and pairs within a group are done
        for _ in range(STAR_ROUNDS):
            open_ = self.across(open_, groups).select("a", "b", "lpos", "root")
            turn = F.struct("lpos", F.xxhash64("b").alias("turn"), "a", "b")
            now = stage(open_.groupBy("root").agg(F.min(turn).alias("p")).select("p.a", "p.b"), "tried")
            tried = now if tried is None else tried.unionByName(now)
            open_ = open_.select("a", "b", "lpos").join(now, ["a", "b"], "left_anti")
            groups = components(groups.unionByName(self.verify(now, sets)))

        def members() -> DataFrame:
            """Rows of heavy lists that hold more than one group."""
            rows = (led.where("pos >= 0").select("key", "sig", "n", "pos")
                    .join(groups.withColumnsRenamed({"a": "sig", "b": "root"}), "sig", "left")
                    .withColumn("root", F.coalesce("root", "sig")))
            mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
            return stage(rows.join(mixed.select("key"), "key", "left_semi"), "mixed-lists")

        rest = members()
        one = rest.select("key", *[F.col(c).alias(f"{c}1") for c in ("sig", "n", "pos", "root")])
        two = rest.select("key", *[F.col(c).alias(f"{c}2") for c in ("sig", "n", "pos", "root")])
        done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = stage(one.join(two, "key").where("root1 < root2").where(_possible("n1", "pos1", "n2", "pos2", self.percent))
                     .select(F.least("sig1", "sig2").alias("a"), F.greatest("sig1", "sig2").alias("b")).distinct()
                     .join(done, ["a", "b"], "left_anti"), "left-pairs")
        left = self.near(left, classes, "near-left")
        return components(groups.unionByName(self.verify(left, self.sets_of(left, classes))))

    @staticmethod
    def across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """The pairs whose ends lie in different groups, with the group of a."""
        of_a, of_b = (groups.select(F.col("a").alias(end), F.col("b").alias(f"root_{end}")) for end in ("a", "b"))
        named = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
        root, other = F.coalesce("root_a", "a"), F.coalesce("root_b", "b")
        return named.withColumn("root", root).where(root != other)


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, seed: int = 0) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Null, empty and blank texts have no shingle, link with nothing and are their
    own component. A row without doc_id cannot be named: its set is counted, it
    links with nothing and its component is null. Repeated rows are one class.
    Other columns are ignored.

    Sets are told apart by a 64-bit hash; a second hash finds two sets that
    share the first, and then everything is hashed anew with another seed.
    """
    work = JaccardJoin(docs, words, percent, seed)
    profile = work.profile()
    linkable = "n > 0 AND doc_id IS NOT NULL"
    classes = stage(profile.where(linkable).groupBy("sig").agg(
        F.min("doc_id").alias("rep"), F.min("n").alias("n"), (F.min("sig2") != F.max("sig2")).alias("clash")), "classes")
    if not classes.where("clash").isEmpty():
        return join(docs, words, percent, seed + 1)
    roots = work.labels(classes)
    named = (classes.join(roots.withColumnsRenamed({"a": "sig", "b": "root"}), "sig", "left")
             .withColumn("root", F.coalesce("root", "sig")))
    # only groups of several classes need the minimum of their members
    groups = roots.select("b").distinct().withColumnRenamed("b", "root")
    least = named.join(groups, "root", "left_semi").groupBy("root").agg(F.min("rep").alias("least"))
    ids = named.join(least, "root", "left").select("sig", F.coalesce("least", "rep").alias("component_id"))
    return (profile.where(linkable).join(ids, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
            .unionByName(profile.where(f"NOT ({linkable})").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one document of each linked group, the one of
    smallest doc_id; all columns. Rows that are repeated with id and text stay
    once; rows without doc_id stay."""
    kept = join(docs, words, percent).where("component_id = doc_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    # all columns travel in one struct, so that no name of theirs can clash
    rows = named.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("key"))
    return rows.dropDuplicates(["key"]).select("row.*").unionByName(docs.where("doc_id IS NULL"))
