"""SRT and VTT corpora as cue tables.

Files are read in byte ranges as numbered lines, and blocks are gathered from
those; a table that already holds whole texts has them split. From there on
every rule is a column expression over blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions import text as tx
from cuespan.functions import times as tm
from cuespan.sources.lines import blocks, file_names, numbered_lines, paragraphs, stripped
from cuespan.sources.writers import numbered

DIALECTS = ("strict", "fail_fast", "lenient", "token_edge", "pack")
NUMBERED = ("strict", "fail_fast")  # cut white space around the text, then expect a number first
ARROW = "-->"


def _unix(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "^\ufeff", ""), "\r\n?", "\n")


def _blank(line: Column) -> Column:
    return tx.strip_ws(line) == ""


def _after(line: Column) -> Column:
    """Everything behind the first arrow."""
    return F.substring(line, F.instr(line, ARROW) + 3, F.length(line))


def _before(line: Column) -> Column:
    return F.substring_index(line, ARROW, 1)


def _tokens(part: Column) -> Column:
    return F.filter(F.split(part, r"(?U)\s+"), lambda t: t != "")


def _tail(lines: Column, at: Column) -> Column:
    return F.slice(lines, at, F.greatest(F.size(lines) - at + 1, F.lit(0)))


def _join(lines: Column, sep: str) -> Column:
    return F.array_join(lines, sep)


def _once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once a row. A filter or a column that uses
    them would otherwise repeat their expressions, and those they are made of."""
    return rows.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse_srt(files: DataFrame, dialect: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(cues, rejects) of ``file, value`` rows, a whole text each."""
    text = _unix(F.col("value"))
    text = tx.strip_ws(text) if dialect in NUMBERED else text
    found = F.filter(F.split(text, r"\n[ \t]*\n+"), lambda b: ~_blank(b))
    # outer, as the plain form splits each text once more to see whether there are blocks
    rows = files.select("file", F.posexplode_outer(found).alias("block_no", "block")).where("block IS NOT NULL")
    return srt_cues(files.select("file"), rows, dialect, whole=True)


def srt_cues(files: DataFrame, rows: DataFrame, dialect: str = "strict", whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cues, rejects) of ``file, block_no, block`` rows; ``files`` names all files.
    With ``whole`` each file came as one value, so its blocks also fit in one task.

    strict keeps good blocks and reports the others, fail_fast and pack reject the
    whole file, lenient and token_edge drop what they cannot read.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}")
    numbered_dialect = dialect in NUMBERED
    lines = F.split("block", "\n")
    after = lambda at: _tail(F.col("body"), at)

    if numbered_dialect:
        rows = _once(rows, {"body": tm.bind(lines, lambda x: F.when(
            tx.strip_ws(x[0]).rlike(r"^\d+$"), _tail(x, F.lit(2))).otherwise(x))})
        rows = _once(rows, {"stamp": tx.strip_ws(F.get("body", F.lit(0)))})
        rest = after(F.lit(2))
        cue_text = (tx.strip_ws(_join(rest, "\n")) if dialect == "strict" else
                    tx.strip_ws(_join(F.filter(F.transform(rest, tx.strip_ws), lambda t: t != ""), " ")))
        rows = _once(rows, {"start_ms": tm.srt_ms(_before(F.col("stamp"))), "end_ms": tm.srt_ms(_after(F.col("stamp"))), "text": cue_text})
        problem = (F.when(F.size("body") < 2, "missing_text")
                   .when(~F.col("stamp").contains(ARROW) | F.col("start_ms").isNull() | F.col("end_ms").isNull(), "bad_stamp")
                   .when(F.col("end_ms") <= F.col("start_ms"), "end_not_after_start")
                   .when(F.col("text") == "", "empty_text"))
    else:
        # a block without an arrow is not a cue
        rows = _once(rows.where(F.col("block").contains(ARROW)), {"body": F.filter(lines, lambda t: ~_blank(t))})
        rows = _once(rows, {"at": F.array_position(F.transform("body", lambda t: t.contains(ARROW)), True).cast("int")})
        rows = _once(rows, {"stamp": F.get("body", F.col("at") - 1)})
        left, right = _before(F.col("stamp")), _after(F.col("stamp"))
        if dialect == "lenient":
            start, end = tm.loose_ms(tx.strip_ws(left)), tm.loose_ms(tx.strip_ws(right))
        elif dialect == "token_edge":
            start = tm.loose_ms(F.try_element_at(_tokens(left), F.lit(-1)), True)
            end = tm.loose_ms(F.try_element_at(_tokens(right), F.lit(1)), True)
        else:
            start, end = tm.srt_ms(left), tm.srt_ms(F.try_element_at(_tokens(right), F.lit(1)))
        rest = after(F.col("at") + 1)
        cue_text = tx.norm_qa(_join(rest, " ")) if dialect == "lenient" else tx.strip_ws(_join(rest, "\n"))
        rows = _once(rows, {"start_ms": start, "end_ms": end, "text": cue_text})
        problem = (F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "bad_stamp")
                   .when(F.col("text") == "", "empty_text"))
    judged = rows.withColumn("problem", problem).select("file", "block_no", "start_ms", "end_ms", "text", "problem")

    strict_file = dialect in ("fail_fast", "pack")
    bad = F.count_if(F.col("problem").isNotNull())
    refused = judged.groupBy("file").agg(bad.alias("bad")).where((F.col("bad") > 0) & F.lit(strict_file))
    gone = refused.select("file", F.lit("file_rejected").alias("problem"))
    empty = files.join(judged.select("file").distinct(), "file", "left_anti").select("file", F.lit("empty_file").alias("problem"))
    kept = judged.join(gone.select("file"), "file", "left_anti")
    # one window over a whole file, where there is one, reads it once instead of twice
    passed = kept if not (whole and strict_file) else judged.withColumn("_bad", bad.over(Window.partitionBy("file"))).where("_bad = 0").drop("_bad")
    good = passed.where("problem IS NULL")
    if dialect == "strict":
        cues = good.withColumn("cue_index", F.col("block_no") + 1)
    elif dialect == "fail_fast":
        cues = good.withColumn("cue_index", F.col("block_no"))
    elif whole:
        cues = good.withColumn("cue_index", F.row_number().over(Window.partitionBy("file").orderBy("block_no")) - 1)
    else:
        cues = numbered(good, ["file"], ["block_no"], "cue_index").withColumn("cue_index", F.col("cue_index") - 1)
    files_off = gone.unionByName(empty).select("file", F.lit(None).cast("int").alias("block_no"), "problem")
    rejects = kept.where("problem IS NOT NULL").select("file", "block_no", "problem").unionByName(files_off)
    return cues.select("file", F.col("cue_index").cast("bigint").alias("cue_index"), "start_ms", "end_ms", "text"), rejects


def read_srt(spark: SparkSession, paths, dialect: str = "strict", glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    lines = numbered_lines(spark, paths, glob)
    return srt_cues(file_names(spark, paths, glob), blocks(stripped(lines) if dialect in NUMBERED else lines), dialect)


def parse_vtt(files: DataFrame) -> DataFrame:
    """Cues of ``file, value`` rows, a whole text each."""
    parts = F.split(_unix(F.col("value")), r"\n(?U:\s*)\n|\n(?U:\s*)$|^(?U:\s*)\n")
    return vtt_cues(files.select("file", F.posexplode(parts).alias("part_no", "part")))


def vtt_cues(rows: DataFrame) -> DataFrame:
    """Cues of ``file, part_no, part`` rows. Paragraphs are separated by blank
    lines; one holds at most one cue, and a note, style or region opening hides
    its paragraph."""
    # header lines carry no cue; they may share the paragraph of one
    lines = F.filter(F.split("part", "\n"), lambda s: ~_blank(s) & ~tx.strip_ws(s).startswith("WEBVTT"))
    rows = rows.withColumn("lines", lines)
    hides = lambda s: tx.strip_ws(s).rlike("^(NOTE|STYLE|REGION)") & ~s.contains(ARROW)
    first = lambda test: F.array_position(F.transform("lines", test), True)
    rows = rows.withColumns({"at": first(lambda s: s.contains(ARROW)), "hidden": first(hides)})
    rows = rows.where((F.col("at") > 0) & ((F.col("hidden") == 0) | (F.col("hidden") > F.col("at"))))
    stamp = F.get("lines", F.col("at").cast("int") - 1)
    rows = rows.withColumns({
        "start_ms": tm.loose_ms(tx.strip_ws(_before(stamp))), "end_ms": tm.loose_ms(tx.strip_ws(_after(stamp))),
        "text": tx.norm_qa(_join(_tail(F.col("lines"), F.col("at").cast("int") + 1), " "))})
    good = rows.where("start_ms IS NOT NULL AND end_ms IS NOT NULL AND text <> ''")
    out = numbered(good.select("file", "part_no", "start_ms", "end_ms", "text"), ["file"], ["part_no"], "cue_index")
    return out.select("file", (F.col("cue_index") - 1).alias("cue_index"), "start_ms", "end_ms", "text")


def read_vtt(spark: SparkSession, paths) -> DataFrame:
    parts = paragraphs(numbered_lines(spark, paths))
    return vtt_cues(parts.withColumnsRenamed({"block_no": "part_no", "block": "part"}))
