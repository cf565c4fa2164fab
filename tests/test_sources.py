"""Readers and writers on files: write to a folder, read back, compare."""

import hashlib
import json

from pyspark.sql import functions as F

from cuespan.operators import dataset, scoring
from cuespan.sources import dictionary, records, subtitles, writers

H64, H32 = "a" * 64, "b" * 32


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_srt_dialects_from_files(spark, tmp_path):
    long = "w " * 3000
    put(tmp_path / "a.srt", f"1\n00:00:01,000 --> 00:00:02,000\nhello\n\n2\n00:00:03,000 --> 00:00:04,000\n{long}\n")
    put(tmp_path / "b.srt", "1\n00:00:05,000 --> 00:00:04,000\nback\n\n2\n00:00:06,000 --> 00:00:07,000\nok\n")
    cues, rejects = subtitles.read_srt(spark, str(tmp_path), "strict")
    assert sorted((r.start_ms, len(r.text)) for r in cues.collect()) == [(1000, 5), (3000, 5999), (6000, 2)]
    assert [r.problem for r in rejects.collect()] == ["end_not_after_start"]
    cues, rejects = subtitles.read_srt(spark, str(tmp_path), "fail_fast")
    assert {r.file[-5:] for r in cues.collect()} == {"a.srt"} and [r.problem for r in rejects.collect()] == ["file_rejected"]


def test_vtt_from_files(spark, tmp_path):
    put(tmp_path / "a.vtt", "WEBVTT\n\nNOTE hidden\n00:00:09.000 --> 00:00:10.000\nno\n\n00:00:01.000 --> 00:00:02.500\nyes\n")
    assert [(r.start_ms, r.end_ms, r.text) for r in subtitles.read_vtt(spark, str(tmp_path)).collect()] == [(1000, 2500, "yes")]


def test_subtitles_written_and_read_back(spark, tmp_path):
    rows = [("e1", i, 1000 * i, 1000 * i + 900, f"text {i}") for i in range(30)]
    cues = spark.createDataFrame(rows, "episode_id string, cue_index long, start_ms long, end_ms long, text string")
    writers.write_text(writers.srt_blocks(cues), str(tmp_path / "out"), ["episode_id"], "cue_index")
    parts = sorted((tmp_path / "out" / "episode_id=e1").glob("part-*"))
    put(tmp_path / "in" / "e1.srt", "\n".join(p.read_text() for p in parts))
    back, rejects = subtitles.read_srt(spark, str(tmp_path / "in"), "strict")
    assert sorted((r.start_ms, r.end_ms, r.text) for r in back.collect()) == [r[2:] for r in rows] and rejects.isEmpty()


def test_journals_from_files(spark, tmp_path):
    add = {"event_type": "translation_add", "event_id": "1", "scope_id": "s"}
    put(tmp_path / "m" / "good.jsonl", json.dumps(add) + "\n" + json.dumps(add | {"event_id": "2", "verified_source_text": "x" * 300_000}) + "\n")
    put(tmp_path / "m" / "bad.jsonl", json.dumps(add) + "\nnot json\n")
    events, problems = records.read_journal(spark, str(tmp_path / "m"), "memory")
    assert sorted((r.file[-10:], r.line_no, r.event_id) for r in events.collect()) == [("good.jsonl", 0, "1"), ("good.jsonl", 1, "2")]
    assert [(r.line_no, r.problem) for r in problems.collect()] == [(1, "corrupt")]
    lenient, _ = records.read_journal(spark, str(tmp_path / "m"), "review")
    assert lenient.count() == 3  # only the broken line is left out


def test_verified_rows_metadata_and_crops(spark, tmp_path):
    crop = b"pixels"
    (tmp_path / "crops").mkdir()
    (tmp_path / "crops" / "a.jpg").write_bytes(crop)
    row = {"schema_version": 1, "cue_id": "c1", "source_text_verified": "t" * 19_000, "crop_path": "crops/a.jpg",
           "crop_sha256_local": hashlib.sha256(crop).hexdigest(), "start_ms": 0, "end_ms": 5, "ocr_confidence": 0.5,
           "review_event_id": "e", "reviewed_at": "2024-01-01T00:00:00Z"}
    bad = row | {"cue_id": "c2", "end_ms": 0, "crop_path": "crops/none.jpg"}
    path = put(tmp_path / "d" / "set.jsonl", "\n".join(map(json.dumps, [row, bad])) + "\n")
    rows = records.read_verified_dataset(spark, path)
    assert {r.cue_id: r.problem for r in rows.collect()} == {"c1": None, "c2": "interval"}
    found = records.crop_inventory(spark, rows, str(tmp_path / "crops"))
    assert {r.cue_id: r.crop_problem for r in found.collect()} == {"c1": None, "c2": "missing"}
    lic = {"status": "owned", "identifier": "x", "evidence_path": "e/p.txt", "evidence_sha256": H64, "human_review": {"status": "pending", "reviewer": None, "reviewed_at": None}}
    meta = {"schema_version": 1, "records": [{"cue_id": "c1", "source_id": "s", "episode_id": "e", "license": lic},
                                             {"cue_id": "c2", "source_id": "s", "episode_id": "e", "license": lic | {"evidence_path": "/etc"}}]}
    got = records.read_metadata(spark, put(tmp_path / "meta.json", json.dumps(meta)), ["owned"])
    assert {r.cue_id: r.problem for r in got.collect()} == {"c1": None, "c2": "evidence_path"}


def test_stats_dictionary_and_rules(spark, tmp_path):
    put(tmp_path / "s" / "x.stats.json", json.dumps({"blocks": 3, "low_conf": 1, "conf_thr": 0.5, "fps": 24.0}))
    assert [(r["name"], r.blocks) for r in records.read_stats(spark, str(tmp_path / "s")).collect()] == [("x", 3)]
    words = dictionary.read_dictionary(spark, put(tmp_path / "w.txt", "the 5\nthe 9\nodd x\nno\n"))
    assert sorted(map(tuple, words.collect())) == [("odd", 1), ("the", 5)]
    rules = dictionary.read_rules(spark, put(tmp_path / "r.txt", "a\tb\na\tc\nsame\tsame\n"))
    assert [(r.old, r.new) for r in rules.collect()] == [("a", "c")]


def test_logs_and_projections_replace_their_part(spark, tmp_path):
    old = spark.createDataFrame([("d1", 1), ("d2", 2)], "run_date string, n int")
    writers.write_change_log(old, str(tmp_path / "log"))
    writers.write_change_log(spark.createDataFrame([("d2", 7)], "run_date string, n int"), str(tmp_path / "log"))
    assert sorted((str(r.run_date), r.n) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [("d1", 1), ("d2", 7)]
    writers.write_projection(old.withColumnRenamed("run_date", "scope_id"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    writers.write_report(old, str(tmp_path / "rep"), ["run_date"])
    assert all("run_date_sha256" in r.value for r in spark.read.text(str(tmp_path / "rep")).collect())


def test_engine_without_predictions_is_scored(spark):
    cue = "engine_id string, episode_id string, cue_index long, start_ms long, end_ms long, text string"
    ref = spark.createDataFrame([("e", 0, 0, 900, "abc"), ("f", 0, 0, 900, "de")], cue.replace("engine_id string, ", ""))
    pred = spark.createDataFrame([("x", "e", 0, 0, 900, "abc"), ("y", "e", 0, 0, 900, "abd"), ("y", "f", 0, 0, 900, "de")], cue)
    hits = pred.select("engine_id", "episode_id", F.col("cue_index").alias("p_cue_index"), F.col("cue_index").alias("r_cue_index"))
    keys = ["engine_id", "episode_id"]
    rows = scoring.with_cue_rates(scoring.score_sums(hits, pred, ref, keys, keys, 200, ["x", "y"])).collect()
    got = {(r.engine_id, r.episode_id): (r.prediction_cues, r.character_edits, r.cue_precision, r.cer) for r in rows}
    assert got == {("x", "e"): (1, 0, 1.0, 0.0), ("x", "f"): (0, 2, 0.0, 1.0), ("y", "e"): (1, 1, 1.0, 1 / 3), ("y", "f"): (1, 0, 1.0, 0.0)}


def test_coverage_gate_counts_wrong_groups(spark):
    scores = "engine_id string, group_key string, reference_cues long, matched_cues long"
    want = spark.createDataFrame([("g1",), ("g2",)], "group_key string")

    def verdict(rows):
        r = dataset.coverage_gate(spark.createDataFrame(rows, scores), want, 0.75)[1].first()
        return r.status, r.missing_groups, r.unexpected_groups, r.duplicate_groups, r.failed_groups

    full = [(e, g, 4, 3) for e in "xy" for g in ("g1", "g2")]
    assert verdict(full) == ("PASS", 0, 0, 0, 0)
    assert verdict(full[1:]) == ("FAIL", 1, 0, 0, 0)
    assert verdict([*full, full[0]]) == ("FAIL", 0, 0, 1, 0)
    assert verdict([*full, ("x", "g9", 4, 4)]) == ("FAIL", 0, 1, 0, 0)
    assert verdict([*full[1:], ("x", "g1", 4, 2)]) == ("FAIL", 0, 0, 0, 1)
