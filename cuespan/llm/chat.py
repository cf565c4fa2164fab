"""Chat formatting: every dialogue from the point of view of each participant.

For each role of a dialogue the turns are rendered with that role as the
assistant and all others as named users; what the assistant says, with its end
mark, is what a model would be trained on. One row per view and turn carries the
rendered text and its place in the view, so a dialogue of any length is never
gathered: places are running sums, taken in chunks of a dialogue and then over
the chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespan.functions.ordered import prefix_scan

# fixed values of the rendered form
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
CHUNK_TURNS, DEALS = 1_024, 16


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, position, turn, role, rendered, start, mask_start,
    mask_end and trained of every turn in every view.

    ``turns`` holds conv_id, turn, role and text. Turns stand in order of turn,
    then role, then text, nulls first; repeated rows are turns of their own and
    ``position`` numbers them from 0. A null text renders as empty. A null role
    renders as a user named ``unknown`` and has no view of its own. Rows with a
    null conv_id form one dialogue. ``<|`` in roles and texts is written ``< |``,
    so that no text can open a turn. Other columns are ignored. Places count
    characters from the start of the view; the mask is empty for other speakers.
    """
    def plain(column: str):
        return F.replace(F.coalesce(F.col(column), F.lit("")), F.lit(OPEN), F.lit("< |"))

    key = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("id"))
    base = turns.select("conv_id", key.alias("talk"), F.col("turn").cast("long").alias("turn"), "role", "text")
    # a dialogue is dealt over ranges of its turns, so the longest one is spread
    base = base.withColumn("deal", F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK_TURNS))
    views = base.where("role IS NOT NULL").select("talk", F.col("role").alias("perspective")).distinct()
    dealt = views.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    rows = base.withColumn("salt", F.pmod(F.xxhash64("turn", "text"), F.lit(DEALS))).join(dealt, ["talk", "salt"])
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    head = F.when(own, F.lit(f"{OPEN}assistant{CLOSE}\n")).otherwise(
        F.concat(F.lit(f"{OPEN}user name="), F.when(F.col("role").isNull(), F.lit("unknown")).otherwise(plain("role")), F.lit(f"{CLOSE}\n")))
    rows = rows.withColumns({"own": own, "head": head, "rendered": F.concat(head, plain("text"), F.lit(f"{END}\n"))})
    # rows that agree in all of this are alike, and their order does not matter
    inside = Window.partitionBy("talk", "perspective", "deal").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(inside))
    rows = prefix_scan(rows, ["talk", "perspective"], ["deal", "place"],
                       {"start": ("sum", F.length("rendered").cast("long")), "position": ("sum", F.lit(1).cast("long"))}, chunk=F.col("deal"))
    start = F.coalesce("start", F.lit(0)).cast("long")
    from_, to = start + F.length("head"), start + F.length("rendered") - 1
    return rows.select(
        "conv_id", "perspective", F.coalesce("position", F.lit(0)).cast("long").alias("position"), "turn", "role", "rendered",
        start.alias("start"), F.when(F.col("own"), from_).otherwise(start).cast("long").alias("mask_start"),
        F.when(F.col("own"), to).otherwise(start).cast("long").alias("mask_end"), F.col("own").alias("trained"))
