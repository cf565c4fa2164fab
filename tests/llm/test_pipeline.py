import math
import zlib

import corpus_pipeline
import numpy as np
from cuespan.llm import language, pii, toxicity
from cuespan.llm.queries import vocabulary_path
from tokenizers import Tokenizer

from tests.llm.test_jaccard import brute


def fixture(spark, folder):
    calm = [f"the quiet river number w{i} runs past the old mill and the green hill w{i % 7} at dawn" for i in range(60)]
    bad = [f"you rotten{i} scoundrel and filthy rogue be gone you vile cur w{i}" for i in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(calm + bad)]
    long = " ".join(f"the quiet mill by the river w{i}" for i in range(80))
    rows += [(200, long, "en", "s", 9), (201, long + " more", "en", None, 9), (202, long, None, "s", None), (203, None, "en", "s", 0),
             (204, "12 34 !!", "en", "s", 8), (205, "the quiet mill jo@mail.example.com or 10.0.0.1 by the river", "en", "s", 5), (206, "", "en", "s", 0),
             (200, long, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 60)) for i in range(100)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_by_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "pii", "packing"]
    rows = docs.collect()
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
            out.write.parquet(f"{folder}/{name}")
            out = spark.read.parquet(f"{folder}/{name}")
        got = out.collect()
        key = lambda r: str(tuple(r))
        if name == "toxicity":
            scorer = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), corpus_pipeline.crc_mod("doc_id", 4) != 2)
            want = [r for r in rows if scorer.score(r.text or "") < corpus_pipeline.TOXIC_AT]
            assert {r.doc_id for r in want if r.doc_id < 100} == set(range(60))
        elif name == "language":
            want = [r for r in rows if language.has_letter(r.text)]
        elif name == "near_duplicates":
            kept = {d for d, _, c in brute([(r.doc_id, r.text) for r in rows]) if d == c}
            want = list({key(r): r for r in rows if r.doc_id in kept}.values())
            assert {201, 202}.isdisjoint(kept) and 200 in kept
        elif name == "pii":
            assert sorted((r.doc_id, len(r.text)) for r in got) == sorted((r.doc_id, r.n_chars) for r in got)
            assert {r.doc_id: r.text for r in got}[205] == "the quiet mill [EMAIL] or [IP] by the river"
            assert not any(spans for base, spans in pii.find([r.text for r in got], pii.field()))
            want = None
        else:
            library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
            ids = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 0] for r in rows}
            whole = {d: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)) for d, own in ids.items() if len(own) <= 2048}
            assert {r.doc_id: r.ids_crc32 for r in got if r.start == 0 and r.doc_id in whole} == whole
            assert sum(r.length for r in got) == sum(map(len, ids.values()))
            want = None
        if want is not None:
            assert sorted(map(key, got)) == sorted(map(key, want))
        rows, docs = got, out


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_what_op4_predicts_toxic_goes(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # every text scores 0.4
    scorer = toxicity.Scorer(toxicity.KneserNey({}), np.array([0.0, 0.0, 0.0, math.log(0.4 / 0.6)]), 0.0)
    monkeypatch.setattr(toxicity, "train", lambda *_: scorer)
    predicted = {r.doc_id for r in toxicity.score(docs, scorer).where("predicted = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()}
    assert predicted == {r.doc_id for r in docs.select("doc_id").collect()} and not kept
