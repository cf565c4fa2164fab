import json

from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.operators import contributions, dataset
from cuespan.streaming import jobs
from cuespan.streaming.run import in_steps

UUID = "0f8fad5b-d9cb-469f-a165-70867728950e"
METRICS = {"duration_seconds": 1.5, "frames_scanned": 10, "cue_count": 5, "low_conf_count": 1, "device_class": "cpu", "engine_class": "easyocr"}
SCHEMA = ("seq long, token_hash string, payload string, idempotency_key string, metrics_consent string, "
          "retention_policy string, cer_consent string")


def call(seq, token="t", metrics=None, key=UUID, consent="v1", policy="90", cer=None, payload=None):
    body = {"schema_version": 1, "submission_id": UUID, "created_at": "2024-01-01T00:00:00Z", "metrics": metrics or METRICS}
    return (seq, token, json.dumps(body) if payload is None else payload, key, consent, policy, cer)


def test_reasons_to_refuse_a_call(spark):
    cer = METRICS | {"cer": {"value": 0.1, "reference_class": "trusted_local_vtt"}}
    twice = call(0)[2].replace('"cue_count": 5', '"cue_count": 5, "cue_count": 5')
    cases = [(call(1), None), (call(2, payload="{"), "payload_rejected"), (call(3, metrics=METRICS | {"x": 1}), "payload_rejected"),
             (call(4, key="other"), "key_mismatch"), (call(5, consent=None), "no_metrics_consent"), (call(6, consent="v2"), "no_metrics_consent"),
             (call(7, policy="30"), "retention_mismatch"), (call(8, metrics=cer), "no_cer_consent"), (call(9, metrics=cer, cer="v1"), None),
             (call(10, cer="v1"), "unexpected_cer_consent"), (call(11, payload=" " * K.MAX_BODY_BYTES + call(0)[2]), "too_large"),
             (call(12, payload=twice), "payload_rejected"), ((13, "t", None, None, None, None, None), "payload_rejected")]
    calls = spark.createDataFrame([c for c, _ in cases], SCHEMA).withColumn("problem", F.lit("own"))
    got = {r.seq: r.refusal for r in contributions.judge_calls(calls).collect()}
    assert got == {c[0]: want for c, want in cases}


def test_a_bad_first_call_makes_no_conflict(spark):
    other = METRICS | {"cue_count": 6}
    spelt = json.dumps(json.loads(call(0)[2]), separators=(",", ":"), indent=1)
    rows = [call(1, consent=None, metrics=other), call(2, key="x"), call(3), call(4, payload=spelt), call(5, metrics=other), call(6, token="u"), call(7, policy="1")]
    calls = spark.createDataFrame(rows, SCHEMA)
    out = in_steps(spark, calls, [F.col("seq") <= 3, F.col("seq") > 3], jobs.contribution_calls).collect()
    assert {r.seq: r.status for r in out} == {1: "no_metrics_consent", 2: "key_mismatch", 3: "accepted", 4: "already_received",
                                             5: "conflict", 6: "conflict", 7: "retention_mismatch"}


def test_distinct_crops_against_the_budget(spark):
    rows = [("d", 0, "a", 60), ("d", 1, "b", 30), ("d", 2, "a", 60), ("d", 3, "c", 11), ("d", 4, "b", 30), ("e", 0, "a", 101)]
    got = dataset.crop_budget(spark.createDataFrame(rows, "k string, i long, crop_sha string, bytes long"), ["k"], "i", 100)
    assert sorted((r.k, r.i, r.total_bytes, r.over_budget) for r in got.collect()) == [
        ("d", 0, 60, False), ("d", 1, 90, False), ("d", 2, 90, False), ("d", 3, 101, True), ("d", 4, 101, True), ("e", 0, 101, True)]
