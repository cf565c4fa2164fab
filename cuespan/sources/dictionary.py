"""Frequency dictionaries and taught rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan.sources.lines import numbered_lines


def first_wins(lines: DataFrame) -> DataFrame:
    """``line_no, word, freq`` → one row per word, the earliest line counts."""
    return lines.groupBy("word").agg(F.min_by("freq", "line_no").alias("freq"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``word freq`` lines; an unreadable frequency counts as one."""
    lines = numbered_lines(spark, path)
    parts = F.split(F.trim(F.regexp_replace("line", r"(?U)\s+", " ")), " ")
    return first_wins(lines.where(F.size(parts) == 2).select(
        "line_no", parts[0].alias("word"), F.coalesce(F.expr("try_cast(split(trim(regexp_replace(line, '\\\\s+', ' ')), ' ')[1] AS bigint)"), F.lit(1)).alias("freq")))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``old<TAB>new`` lines: the last one wins, the first one gives the order."""
    lines = numbered_lines(spark, path).where(F.col("line").contains("\t"))
    parts = F.split("line", "\t", 2)
    rules = lines.select("line_no", F.trim(parts[0]).alias("old"), F.trim(parts[1]).alias("new")).where(
        "old <> '' AND new <> '' AND old <> new")
    return rules.groupBy("old").agg(F.max_by("new", "line_no").alias("new"), F.min("line_no").alias("rule_order"))
