"""Text files as numbered lines and as blocks, read in byte ranges.

Spark's text source cuts a file into ranges and gives every line to the range it
starts in, so one large file is read by many tasks. The number of a line, the
logical clock of journals and dictionaries, is its place in the range plus the
lines of the ranges before it, from one count per range. Blocks are runs of
lines; where one begins is a running value over lines, computed in chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuespan.functions import text as tx
from cuespan.functions.ordered import prefix_scan


def numbered_lines(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    """(file, line_no, line) with physical line numbers from 0.

    Lines end at ``\\n``, ``\\r\\n`` or ``\\r``; a byte order mark before the
    first line is dropped. A file without bytes has no lines.
    """
    source = spark.read.option("recursiveFileLookup", True)
    if glob:
        source = source.option("pathGlobFilter", glob)
    # rows of a range follow each other in one task, so their ids are consecutive
    read = source.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_range"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    ranges = read.groupBy("file", "_range").agg(F.min("_id").alias("_from"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("file", "_range", "_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    line_no = (F.col("_id") - F.col("_from") + F.col("_start")).alias("line_no")
    line = F.when(F.col("line_no") == 0, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line"))
    return read.join(starts, ["file", "_range"]).select("file", line_no, "line").withColumn("line", line)


def file_names(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    """(file): every file that has bytes. Contents are not read."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        source = source.option("pathGlobFilter", glob)
    return source.load(paths).select(F.col("_metadata.file_path").alias("file"))


def stripped(lines: DataFrame) -> DataFrame:
    """The lines of each file as if white space around its whole text were cut."""
    solid = lines.where(tx.strip_ws(F.col("line")) != "").groupBy("file").agg(
        F.min("line_no").alias("_first"), F.max("line_no").alias("_last"))
    kept = lines.join(solid, "file").where(F.col("line_no").between(F.col("_first"), F.col("_last")))
    line = F.when(F.col("line_no") == F.col("_first"), F.regexp_replace("line", r"^(?U:\s)+", "")).otherwise(F.col("line"))
    return kept.withColumn("line", line).withColumn("line", F.when(
        F.col("line_no") == F.col("_last"), F.regexp_replace("line", r"(?U:\s)+$", "")).otherwise(F.col("line"))).drop("_first", "_last")


def _gathered(lines: DataFrame, begins: Column, inside: Column) -> DataFrame:
    """(file, block_no, block): lines from one beginning to the next, those that
    are ``inside``. A block is numbered by its place among blocks with content."""
    marked = prefix_scan(lines.withColumn("_begin", F.when(begins, F.col("line_no"))), ["file"], ["line_no"],
                         {"_block": ("last", F.col("_begin"))}, inclusive=True)
    # a block is one value, the text of one cue or paragraph
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    blocks = marked.where(inside).groupBy("file", "_block").agg(text.alias("block")).where(tx.strip_ws(F.col("block")) != "")
    out = prefix_scan(blocks, ["file"], ["_block"], {"block_no": ("sum", F.lit(1))}, inclusive=True)
    return out.select("file", (F.col("block_no") - 1).cast("int").alias("block_no"), "block")


def blocks(lines: DataFrame) -> DataFrame:
    """Blocks as a split at ``\\n[ \\t]*\\n+`` gives them.

    A line of nothing but blanks ends a block, and empty lines after it belong to
    none; a line of blanks that follows begins the next block. So a line finds a
    block open or not by the last line that is no run of blanks, and by whether
    the number of such runs since then is odd.
    """
    blank, empty = F.col("line").rlike(r"^[ \t]+$"), F.col("line") == ""
    scanned = prefix_scan(lines, ["file"], ["line_no"], {
        "_seen": ("sum", F.when(blank, 1).otherwise(0)),
        "_open": ("last", F.when(~blank, F.when(empty, 0).otherwise(1))),
        "_at": ("last", F.when(~blank, F.col("line_no")))})
    turns = prefix_scan(scanned, ["file"], ["line_no"], {
        "_then": ("last", F.when(~blank, F.coalesce("_seen", F.lit(0))))})
    odd = (F.coalesce("_seen", F.lit(0)) - F.coalesce("_then", F.lit(0))) % 2
    is_open = F.coalesce("_open", F.lit(0)).bitwiseXOR(odd.cast("int")) == 1
    ready = turns.withColumn("_is_open", is_open).select("file", "line_no", "line", "_is_open")
    return _gathered(ready, ~F.col("_is_open") & ~empty, ~empty & ~(blank & F.col("_is_open")))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Runs of lines with content; lines of white space of any kind part them."""
    solid = tx.strip_ws(F.col("line")) != ""
    before = prefix_scan(lines, ["file"], ["line_no"], {"_solid": ("last", solid.cast("int"))})
    ready = before.withColumn("_starts", solid & (F.coalesce("_solid", F.lit(0)) == 0)).select("file", "line_no", "line", "_starts")
    return _gathered(ready, F.col("_starts"), solid)
