"""Files read in byte ranges give what the whole text gives."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cuespan.sources import dictionary, lines, records, subtitles


@pytest.fixture
def ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def srt(rng, n, end):
    parts = []
    for i in range(n):
        stamp = f"00:{i // 60:02d}:{i % 60:02d},{rng.randrange(1000):03d} {rng.choice(['-->', '-->', '->'])} 01:{i // 60:02d}:{i % 60:02d},000"
        text = end.join(rng.choice(["hello", "  two words ", "\u00a0", "é 水", "-->"]) for _ in range(rng.randrange(3)))
        parts.append(end.join(x for x in [rng.choice([str(i + 1), "", "x"]), stamp, text] if x))
        parts.append(end + rng.choice([end, end * 3, " \t" + end, " " + end + "  " + end, end + "  " + end, "\u00a0" + end, " " + end + end + " " + end]))
    return rng.choice(["", "\ufeff", end * 2, "  " + end, "\u00a0" + end]) + "".join(parts)


def test_line_numbers_over_ranges(spark, tmp_path, ranges):
    for name, end, n in (("a", "\n", 900), ("b", "\r\n", 300), ("c", "\r", 50), ("d", "\n", 1)):
        (tmp_path / name).write_bytes(("\ufeff" + "".join(f"{name}{i} é" + "x" * (i % 40) + end for i in range(n))).encode())
    (tmp_path / "empty").write_bytes(b"")
    got = lines.numbered_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 4
    rows = {(r.file[-1], r.line_no): r.line for r in got.collect()}
    assert rows == {(name, i): f"{name}{i} é" + "x" * (i % 40) for name, n in (("a", 900), ("b", 300), ("c", 50), ("d", 1)) for i in range(n)}
    assert lines.file_names(spark, str(tmp_path)).count() == 4  # Spark passes over files without bytes


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_are_those_of_the_whole_text(spark, tmp_path, ranges, seed):
    rng, want, solid = random.Random(seed), {}, {}
    for i in range(12):
        text = srt(rng, rng.randrange(60), rng.choice(["\n", "\r\n"]))
        (tmp_path / f"f{i:02d}").write_bytes(text.encode())
        plain = re.sub("^\ufeff", "", text).replace("\r\n", "\n")
        want[f"f{i:02d}"] = [b for b in re.split(r"\n[ \t]*\n+", plain) if b.strip()]
        solid[f"f{i:02d}"] = [b for b in re.split(r"\n[ \t]*\n+", plain.strip()) if b.strip()]

    def by_file(df):
        out = {}
        for r in sorted(df.collect(), key=lambda r: (r.file, r.block_no)):
            out.setdefault(r.file[-3:], []).append(r.block)
        return out

    def rows(texts):  # a line break at the ends of a block carries nothing
        return {f: [b.strip("\n") for b in t] for f, t in texts.items() if t}

    found = lines.numbered_lines(spark, str(tmp_path))
    assert rows(by_file(lines.blocks(found))) == rows(want)
    assert rows(by_file(lines.blocks(lines.stripped(found)))) == rows(solid)


@pytest.mark.parametrize("dialect", subtitles.DIALECTS)
def test_dialects_in_ranges_and_whole(spark, tmp_path, ranges, dialect):
    rng = random.Random(7)
    for i in range(10):
        (tmp_path / f"f{i}.srt").write_bytes((srt(rng, rng.randrange(50), "\n") if i else " \n\n").encode())
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    for got, want in zip(subtitles.read_srt(spark, str(tmp_path), dialect), subtitles.parse_srt(whole, dialect), strict=True):
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_vtt_in_ranges_and_whole(spark, tmp_path, ranges):
    rng = random.Random(9)
    for i in range(8):
        text = "WEBVTT\n\n" + srt(rng, 40, "\n").replace(",", ".").replace("\n\n3", "\n\nNOTE a\n3")
        (tmp_path / f"f{i}.vtt").write_bytes(text.encode())
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    assert sorted(map(repr, subtitles.read_vtt(spark, str(tmp_path)).collect())) == sorted(map(repr, subtitles.parse_vtt(whole).collect()))


def test_journal_and_dictionary_of_many_ranges(spark, tmp_path, ranges):
    (tmp_path / "j.jsonl").write_text("".join('{"event_type": "translation_add", "event_id": "%d"}\n' % i for i in range(400)))
    events, problems = records.read_journal(spark, str(tmp_path / "j.jsonl"), "review")
    assert [r.line_no for r in problems.orderBy("line_no").collect()] + [r.line_no for r in events.orderBy("line_no").collect()] == list(range(400))
    (tmp_path / "w.txt").write_text("".join(f"w{i % 150} {i}\n" for i in range(600)))
    assert {r.word: r.freq for r in dictionary.read_dictionary(spark, str(tmp_path / "w.txt")).collect()} == {f"w{i}": i for i in range(150)}
