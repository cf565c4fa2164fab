"""Sinks: subtitle text, reports, change logs and projections.

A subtitle file is written as one text row per cue inside a folder per episode,
range-partitioned and sorted, so a very long episode becomes several part files
in order instead of one row in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.functions import text as tx
from cuespan.functions import times as tm
from cuespan.functions.ordered import prefix_scan


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "number",
             chunk: Column | None = None) -> DataFrame:
    """Dense numbers from one, without gathering a key in one task."""
    return prefix_scan(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, chunk=chunk, inclusive=True)


def srt_blocks(cues: DataFrame, keys: Sequence[str] = ("episode_id",), order: str = "cue_index") -> DataFrame:
    block = F.concat(F.col("number").cast("string"), F.lit("\n"), tm.fmt_srt(F.col("start_ms")), F.lit(" --> "),
                     tm.fmt_srt(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return numbered(cues, keys, [order]).select(*keys, order, block.alias("value"))


def ass_lines(cues: DataFrame, keys: Sequence[str] = ("episode_id",), order: str = "cue_index") -> DataFrame:
    """Dialogue rows: tags out, lines joined by ``\\N``, empty or reversed cues left out."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: tx.collapse_ws(tx.strip_markup(s))), lambda s: s != "")
    return (cues.where(F.col("start_ms") < F.col("end_ms")).withColumn("_lines", lines)
            .where(F.size("_lines") > 0)
            .select(*keys, order, F.concat(
                F.lit("Dialogue: 0,"), tm.fmt_ass(F.col("start_ms")), F.lit(","), tm.fmt_ass(F.col("end_ms")),
                F.lit(",Dialog,,0,0,0,,"), F.array_join("_lines", "\\N")).alias("value")))


def write_text(blocks: DataFrame, path: str, keys: Sequence[str], order: str) -> None:
    (blocks.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
     .select(*keys, "value").write.mode("errorifexists").partitionBy(*keys).text(path))


def report_json(df: DataFrame, keys: Sequence[str] = (), redact: bool = True,
                private: Sequence[str] = ("text", "r_text", "p_text", "source_id", "episode_id")) -> DataFrame:
    """One JSON document per row. With ``redact`` keys are hashed and private
    columns left out, so only aggregates are published."""
    body = [c for c in df.columns if c not in keys and not (redact and c in private)]
    head = [(F.sha2(F.to_json(F.array(F.col(k).cast("string"))), 256).alias(f"{k}_sha256") if redact else F.col(k))
            for k in keys]
    return df.select(F.to_json(F.struct(*head, *body)).alias("value"))


def write_report(df: DataFrame, path: str, keys: Sequence[str] = (), redact: bool = True) -> None:
    report_json(df, keys, redact).write.mode("errorifexists").text(path)


def write_change_log(changes: DataFrame, path: str, run_column: str = "run_date") -> None:
    """Rewrite the partition of each run in ``changes``; other runs stay."""
    (changes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(run_column).parquet(path))


def write_projection(rows: DataFrame, path: str, scope: str = "scope_id") -> None:
    """Replace the projected tables of the scopes in ``rows``."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(scope).parquet(path))
