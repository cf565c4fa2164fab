"""Operators against small goldens and brute force."""

import itertools
import random

from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions import times as tm
from cuespan.functions.ordered import adjacent_islands, interval_islands, prefix_scan, with_neighbours
from cuespan.functions.similarity import alike, substitutions
from cuespan.operators import align, cleanup, dataset, intervals, journal, memory, repair, scoring
from cuespan.sources import subtitles

CUE = "episode_id string, cue_index bigint, start_ms bigint, end_ms bigint, text string"


def random_cues(rng, episodes, n, horizon=60_000):
    rows = []
    for e in range(episodes):
        for i in range(n):
            start = rng.randrange(0, horizon)
            rows.append((f"e{e}", i, start, start + rng.randrange(200, 6000), f"t{i}"))
    return rows


def brute_edges(preds, refs, of_pred=True):
    out = []
    for p, r in itertools.product(preds, refs):
        if p[0] == r[0]:
            ov = min(p[3], r[3]) - max(p[2], r[2])
            dur = p[3] - p[2] if of_pred else r[3] - r[2]
            if ov > 0 and ov * 2 >= dur:
                out.append((p[0], p[1], r[1], ov))
    return out


def test_interval_join_matches_nested_loop_with_very_long_spans(spark):
    rng = random.Random(1)
    preds = random_cues(rng, 3, 25) + [("e0", 99, 100, 9_000_000_000, "long")]
    refs = random_cues(rng, 3, 25) + [("e0", 98, 0, 8_000_000_000, "long")]
    a, b = spark.createDataFrame(preds, CUE), spark.createDataFrame(refs, CUE)
    got = intervals.overlap_candidates(a, b).select("episode_id", "p_cue_index", "r_cue_index", "overlap_ms")
    assert sorted(map(tuple, got.collect())) == sorted(brute_edges(preds, refs))


def test_greedy_alignment_three_ways(spark):
    rng = random.Random(2)
    preds, refs = random_cues(rng, 4, 30), random_cues(rng, 4, 30)
    edges = intervals.overlap_candidates(spark.createDataFrame(preds, CUE), spark.createDataFrame(refs, CUE))
    used, want = set(), []
    for e, p, r, ov in sorted(brute_edges(preds, refs), key=lambda t: (t[0], -t[3], t[1], t[2])):
        if (e, "p", p) not in used and (e, "r", r) not in used:
            used |= {(e, "p", p), (e, "r", r)}
            want.append((e, p, r, ov))
    cols = ["episode_id", "p_cue_index", "r_cue_index", "overlap_ms"]
    assert sorted(map(tuple, align.greedy_align(edges).select(cols).collect())) == sorted(want)
    assert sorted(map(tuple, align.greedy_align_rounds(edges).select(cols).collect())) == sorted(want)


def test_largest_matching_examples_and_size(spark):
    def run(refs, preds):
        r = spark.createDataFrame([("e", i, a, b, "x") for i, (a, b) in enumerate(refs)], CUE)
        p = spark.createDataFrame([("e", i, a, b, "x") for i, (a, b) in enumerate(preds)], CUE)
        pairs = align.largest_align(intervals.overlap_candidates(p, r, share_of="ref"))
        return sorted((x.r_cue_index, x.p_cue_index) for x in pairs.collect())

    assert run([(0, 1000), (1000, 2000)], [(500, 1500), (500, 1500)]) == [(0, 0), (1, 1)]
    assert run([(0, 1000), (1000, 2000)], [(0, 1500), (0, 900)]) == [(0, 1), (1, 0)]
    rng = random.Random(3)
    preds, refs = random_cues(rng, 3, 40, 30_000), random_cues(rng, 3, 40, 30_000)
    edges = intervals.overlap_candidates(spark.createDataFrame(preds, CUE), spark.createDataFrame(refs, CUE), share_of="ref")
    large, greedy = align.largest_align(edges).collect(), align.greedy_align(edges).collect()
    assert len(large) >= len(greedy)
    assert len({(x.episode_id, x.p_cue_index) for x in large}) == len({(x.episode_id, x.r_cue_index) for x in large}) == len(large)


def test_chunked_windows_equal_plain_ones(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randrange(0, 9), i * 10 + rng.randrange(0, 40)) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint, e bigint")
    small = F.floor(F.col("i") / 7)
    got = prefix_scan(df, ["k"], ["i"], {"s": ("sum", F.col("v")), "l": ("last", F.when(F.col("v") > 6, F.col("i")))}, chunk=small)
    near = {(x.k, x.i): (x.prev and x.prev.v, x.next and x.next.v) for x in with_neighbours(df, ["k"], ["i"], ["v"], chunk=small).collect()}
    runs = {(x.k, x.i): x.island for x in adjacent_islands(df, ["k"], ["i"], ["v"], lambda a, b: a["v"] <= b["v"], chunk=small).collect()}
    # starts must grow: use i * 10 as start
    spans = df.withColumn("s", F.col("i") * 10)
    groups = {(x.k, x.i): x.g for x in interval_islands(spans, ["k"], "s", "e", ["i"], small, "g").collect()}
    for k in "ab":
        mine = [r for r in rows if r[0] == k]
        total, last, island, reach, group = None, None, 0, None, 0
        scanned = {x.i: (x.s, x.l) for x in got.where(F.col("k") == k).collect()}
        for n, (_, i, v, e) in enumerate(mine):
            assert scanned[i] == (total, last)
            total, last = (total or 0) + v, i if v > 6 else last
            assert near[k, i] == (mine[n - 1][2] if n else None, mine[n + 1][2] if n + 1 < len(mine) else None)
            if n and mine[n - 1][2] > v:
                island = i
            assert runs[k, i] == island
            if reach is None or i * 10 >= reach:
                group = i * 10
            reach = max(reach or 0, e)
            assert groups[k, i] == group


def test_report_golden(spark):
    ref = [("e", 0, 1000, 2000, "Café line"), ("e", 1, 3000, 4000, "Second")]
    pred = [("e", 0, 1100, 2050, "Cafe line"), ("e", 1, 7000, 8000, "Nothing")]
    r, p = spark.createDataFrame(ref, CUE), spark.createDataFrame(pred, CUE)
    pairs = align.largest_align(intervals.overlap_candidates(p, r, share_of="ref"))
    runs = p.withColumn("engine_id", F.lit("x"))
    matches = pairs.withColumn("engine_id", F.lit("x"))
    row = scoring.with_cue_rates(scoring.score_sums(matches, runs, r, ["engine_id", "episode_id"], [], 200, ["x"])).first()
    assert (row.matched_cues, row.cue_precision, row.cue_recall) == (1, 0.5, 0.5)
    assert (row.timing_start_abs_error_ms, row.timing_end_abs_error_ms) == (100.0, 50.0)
    assert row.character_edits == 1 + len("Second")


def test_text_pairs_golden(spark):
    pairs = spark.createDataFrame([("CAT", "CAT"), ("DOG", "DOT")], "reference string, prediction string")
    row = scoring.text_score(pairs).first()
    assert (row.character_edits, row.cer, row.exact_match_rate, row.word_edits) == (1, 1 / 6, 0.5, 1)


def test_substitutions_and_bounds():
    assert substitutions("şeker", "seker") == [("ş", "s")]
    assert substitutions("abc", "abc") == []
    assert substitutions("hello!", "hellol") == [("!", "l")]
    from difflib import SequenceMatcher
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))
        b = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))
        assert alike(a, b, 0.6) == (SequenceMatcher(None, a, b).ratio() >= 0.6)


def test_time_stamps(spark):
    rows = [("00:00:01,000", 1000), ("999999999:00:00,000", 999999999 * 3_600_000), ("0:00:01,000", None),
            ("00:61:01,000", None), ("1" * 4301 + ":00:00,000", None)]
    df = spark.createDataFrame(rows, "s string, want bigint").withColumn("got", tm.srt_ms(F.col("s")))
    assert df.where("NOT (got <=> want)").count() == 0
    loose = spark.createDataFrame([("01:02.5 align:left", 62_500), ("1:00:00,25", 3_600_250)], "s string, want bigint")
    assert loose.withColumn("got", tm.loose_ms(F.col("s"))).where("NOT (got <=> want)").count() == 0


def test_srt_dialects_and_vtt(spark):
    text = ("1\n00:00:01,000 --> 00:00:02,000\n<i>Hi</i> &amp; bye\n\n2\n00:00:03,000 --> 00:00:02,000\nback\n\n"
            "3\nbroken\n\n4\n00:00:05,000 --> 00:00:06,000 x\nlast\n")
    files = spark.createDataFrame([("f", text)], "file string, value string")
    cues, rejects = subtitles.parse_srt(files, "strict")
    assert [(c.cue_index, c.text) for c in cues.collect()] == [(1, "<i>Hi</i> &amp; bye")]
    assert sorted(r.problem for r in rejects.collect()) == ["bad_stamp", "end_not_after_start", "missing_text"]
    assert subtitles.parse_srt(files, "fail_fast")[0].count() == 0
    lenient = sorted((c.cue_index, c.text) for c in subtitles.parse_srt(files, "lenient")[0].collect())
    assert lenient == [(0, "Hi & bye"), (1, "back"), (2, "last")]
    vtt = "WEBVTT\n\nNOTE x\n00:01.000 --> 00:02.000\nhidden\n\nid\n00:01.000 --> 00:02.000 align:left\none\ntwo\n\nstray\n"
    got = subtitles.parse_vtt(spark.createDataFrame([("v", vtt)], "file string, value string")).collect()
    assert [(c.start_ms, c.end_ms, c.text) for c in got] == [(1000, 2000, "one two")]


def _micro_model(blocks, fps):
    """Plain sequential form of the micro-block rule."""
    from cuespan.functions.similarity import alike as same
    out, moved, wait = [], [], None
    dur = lambda b: (b[1] - b[0] + 1) / fps

    def junk(b):
        dense = "".join(b[2].split())
        share = sum(c.isalpha() for c in dense) / len(dense) if dense else 0
        return not (b[3] >= 0.75 or (b[3] >= 0.5 and len(dense) >= 12 and share >= 0.8))

    def join(a, b):
        t = a if dur(a) >= dur(b) else b
        return [min(a[0], b[0]), max(a[1], b[1]), t[2], t[3]]

    def drop(b):
        (moved if junk(b) else out).append(b)

    for b in map(list, blocks):
        if dur(b) < K.MICRO_MAX_SECONDS and b[2].strip():
            if out and out[-1][2].strip() and same(b[2], out[-1][2], 0.7):
                out[-1] = join(out[-1], b)
            elif wait and same(b[2], wait[2], 0.7):
                wait = join(wait, b)
            else:
                if wait:
                    drop(wait)
                wait = b
            continue
        if wait:
            if b[2].strip() and same(wait[2], b[2], 0.7):
                b = join(wait, b)
            else:
                drop(wait)
            wait = None
        out.append(b)
    if wait:
        drop(wait)
    return sorted(map(tuple, out)), sorted(map(tuple, moved))


def test_micro_cleanup_cuts_do_not_change_the_result(spark):
    rng = random.Random(6)
    words = ["same line", "same lime", "other", "♪ # *", "a longer real sentence"]
    data, models = [], {}
    for vid in range(12):
        t, rows = 0, []
        for no in range(25):
            length = rng.choice([2, 4, 8, 12, 30])
            rows.append((t, t + length, rng.choice(words), rng.choice([0.2, 0.6, 0.9])))
            t += length + rng.randrange(1, 20)
        models[vid] = _micro_model(rows, 24.0)
        data += [(vid, i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "video_id bigint, block_no bigint, start_f bigint, end_f bigint, text string, conf double")
    got = cleanup.micro_cleanup(df, 24.0).collect()
    for vid, (main, moved) in models.items():
        pick = lambda s: sorted((x.start_f, x.end_f, x.text, x.conf) for x in got if x.video_id == vid and x.stream == s)  # noqa: E731,B023
        assert pick("dialogue") == main
        assert pick("screen") == moved


def test_split_sizes():
    assert dataset.split_sizes(3) == [1, 1, 1]
    assert dataset.split_sizes(10) == [8, 1, 1]
    for n in range(3, 400):
        assert sum(dataset.split_sizes(n)) == n and min(dataset.split_sizes(n)) >= 1


def test_undo_leaves_nothing_active(spark):
    rows = [(1, 1, 1, "accepted", "a", None), (2, 2, 1, "corrected", "b", None), (3, 3, 1, "undo", None, 2), (4, 4, 2, "accepted", "a", None),
            (5, 5, 2, "undo", None, 99)]
    df = spark.createDataFrame(rows, "line_no bigint, event_id bigint, cue_id bigint, kind string, verified_text string, undo_id bigint")
    assert [(x.cue_id, x.event_id) for x in journal.active_reviews(df, F.lit("a")).collect()] == [(2, 4)]


def test_repairs_of_known_examples(spark):
    words = {"anlaşılan": 39044, "anlasılan": 11, "gibi": 2_430_246, "gibb": 133, "için": 900_000, "teşekkürler": 682_375,
             "tesekkürler": 4987, "zorlamayacağım": 80, "kanıyor": 5000}
    d = spark.createDataFrame(list(words.items()), "word string, freq bigint")
    tokens = spark.createDataFrame([("Anlasılan.",), ("gibb",), ("icinitesekkürler",), ("zolamayacağım",), ("kanigor",), ("gibi",)], "surface string")
    got = {x.surface: (x.repaired, x.kind) for x in repair.word_repair(tokens, d).collect()}
    assert got["Anlasılan."] == ("Anlaşılan.", "diakritik")
    assert got["gibb"] == ("gibi", "harf-degistirme")
    assert got["icinitesekkürler"] == ("için teşekkürler", "kaynakma")
    assert got["zolamayacağım"] == ("zorlamayacağım", "harf-yutma")
    assert "gibi" not in got


def test_glossary_substring_of_cjk_word_is_ambiguous(spark):
    texts = spark.createDataFrame([("s", 1, "黒猫です"), ("s", 2, "the red cat"), ("s", 3, "nothing")], "scope_id string, query_id int, text string")
    terms = spark.createDataFrame([("s", 1, "猫", "kedi"), ("s", 2, "red", "kızıl"), ("s", 3, "red cat", "kızıl kedi")],
                                  "scope_id string, line_no int, source_term string, target_term string")
    got = {x.query_id: (x.status, x.translation) for x in memory.lexicon_suggest(texts, terms).collect()}
    assert got[1] == ("ambiguous", None) and got[3] == ("none", None)
    assert got[2][0] == "ambiguous"  # overlapping places of different terms
