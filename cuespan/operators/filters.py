"""Row rules on readings and blocks.

Rules move rows between the dialogue and the screen stream with a reason; none
of them deletes a row. Each function returns columns or both streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions import text as tx
from cuespan.functions.ordered import with_neighbours
from cuespan.functions.similarity import similar
from cuespan.operators.align import first_per_key
from cuespan.session import spread


def seconds(fps: float) -> Column:
    """Length of a block whose last frame is included."""
    return (F.col("end_f") - F.col("start_f") + 1) / F.lit(float(fps))


def speech_like(text: Column) -> Column:
    return text.rlike(r"\p{L}{3}") & text.rlike(f"[{K.VOWELS}]")


def micro_junk(text: Column, conf: Column) -> Column:
    weak = ((conf >= K.MICRO_CONF_WEAK) & (F.length(tx.dense_chars(text)) >= K.MICRO_CHARS_WEAK)
            & (tx.letter_ratio(text) >= K.MICRO_LETTERS_WEAK))
    return ~((conf >= K.MICRO_CONF_STRONG) | weak)


def noise_profile(text: Column, conf: Column, secs: Column) -> Column:
    return (conf < K.NOISE_CONF) & (secs < K.NOISE_SECONDS) & (tx.letter_ratio(text) < K.NOISE_LETTERS)


def split_streams(df: DataFrame, moved: Column, reason: str) -> DataFrame:
    """Tag every row with the stream it belongs to and why it moved."""
    moved = F.coalesce(moved, F.lit(False))
    return df.withColumn("stream", F.when(moved, "screen").otherwise("dialogue")).withColumn(
        "reason", F.when(moved, F.lit(reason)))


def conf_gate(blocks: DataFrame, limit: float = K.UPPER_BAND_CONF) -> DataFrame:
    return blocks.withColumn("kept", F.col("conf") >= limit)


def low_conf(df: DataFrame, limit: Column | float = K.LOW_CONF) -> DataFrame:
    limit = F.lit(limit) if isinstance(limit, float) else limit
    return df.withColumn("low", F.coalesce(F.col("conf") < F.coalesce(limit, F.lit(K.LOW_CONF)), F.lit(False)))


def band_suspect(centre_y: Column, overlaps: Column) -> Column:
    low, high = K.UPPER_SUSPECT_Y
    return F.coalesce((overlaps == 0) & centre_y.between(low, high), F.lit(False))


def no_subtitle_suspect(blocks: Column, speech_s: Column) -> Column:
    return (speech_s < K.RIP_SPEECH_S) | ((blocks <= K.RIP_BLOCKS) & (speech_s < K.RIP_FEW_BLOCKS_SPEECH_S))


def low_yield(blocks: Column, low: Column, scanned_s: Column) -> Column:
    return ((blocks > 0) & (scanned_s >= 60) & (blocks / (scanned_s / 60) < 4) & (low * 2 > blocks))


def hardsub_absent(blocks: Column, mean_conf: Column, mean_s: Column, fallback_band: Column) -> Column:
    return (blocks == 0) | ((mean_conf < 0.4) & ((mean_s < 0.5) | fallback_band))


def swap_allowed(first_text: Column, first_conf: Column, second_text: Column, second_conf: Column) -> Column:
    """The second engine may replace a consensus that has collapsed."""
    dense_first, dense_second = tx.dense_chars(first_text), tx.dense_chars(second_text)
    return ((F.length(dense_first) > 0) & (F.length(dense_second) > 0)
            & (F.length(dense_second) >= K.SWAP_LENGTH_SHARE * F.length(dense_first))
            & (first_conf < K.SWAP_CONSENSUS_CONF) & (second_conf >= K.SWAP_SECOND_CONF)
            & (second_conf - first_conf >= K.SWAP_CONF_GAP))


def swap_reading(df: DataFrame) -> DataFrame:
    """Rows with ``text, conf, first_conf, second_text, second_conf``.

    ``first_conf`` is the consensus before the second engine voted. CJK text is
    routed to the screen stream instead of entering the dialogue.
    """
    c = F.col
    swap = F.coalesce(swap_allowed(c("text"), c("conf"), c("second_text"), c("second_conf"))
                      & (F.trim(c("second_text")) != F.trim(c("text"))), F.lit(False))
    to_screen = swap & (c("first_conf") < K.SWAP_CJK_FIRST_CONF) & tx.cjk_majority(c("second_text"))
    taken = swap & ~to_screen
    return df.withColumns({
        "route": F.when(to_screen, "screen").when(taken, "swapped").otherwise("kept"),
        "out_text": F.when(taken, c("second_text")).otherwise(c("text")),
        "out_conf": F.when(taken, c("second_conf")).otherwise(c("conf"))})


def rescue_reading(blocks: DataFrame, candidates: DataFrame, keys: Sequence[str],
                   limit: float = K.LOW_CONF) -> DataFrame:
    """Low-confidence blocks take their best valid other reading if it is better.

    ``candidates``: ``keys, method_no, cand_text, cand_conf``; of equal
    confidence the first method wins.
    """
    keys = list(keys)
    weak = blocks.where(F.col("conf") < limit)
    dense = lambda c: F.length(tx.dense_chars(F.col(c)))
    valid = weak.select(*keys, "text").join(candidates, keys).where(
        speech_like(F.col("cand_text")) & (dense("cand_text") >= K.SWAP_LENGTH_SHARE * dense("text")))
    best = valid.groupBy(*keys).agg(
        F.max_by(F.struct("cand_text", "cand_conf"),
                 F.struct("cand_conf", (-F.col("method_no")).alias("m"))).alias("best"))
    out = blocks.join(best, keys, "left")
    won = F.coalesce((F.col("conf") < limit) & (F.col("best.cand_conf") > F.col("conf")), F.lit(False))
    return out.select(
        *keys, F.col("text").alias("old_text"), F.col("conf").alias("old_conf"), won.alias("rescued"),
        F.when(won, F.col("best.cand_text")).otherwise(F.col("text")).alias("text"),
        F.when(won, F.col("best.cand_conf")).otherwise(F.col("conf")).alias("conf"))


def sfx_split(blocks: DataFrame, fps: float, keys: Sequence[str] = ("video_id",),
              order: str = "block_no") -> DataFrame:
    """Short low-letter blocks move unless a neighbour reads alike."""
    near = with_neighbours(blocks.withColumn("_norm", tx.rep_norm(F.col("text"))), keys, [order], ["_norm"])
    suspect = (seconds(fps) < K.SFX_SECONDS) & (tx.letter_ratio(F.col("text")) < K.SFX_LETTERS)
    # only suspects need the comparison; the rest skips Python altogether
    near = near.withColumn("_suspect", suspect)
    rest = near.where("not _suspect").withColumn("_tied", F.lit(False))
    near = spread(near.where("_suspect"))

    def bound(side: str) -> Column:
        mine, other = F.col("_norm"), F.col(f"{side}._norm")
        ask = (mine != "") & (other != "")
        return similar(F.when(ask, mine), F.when(ask, other), K.SFX_SIM)

    tied = near.withColumn("_tied", bound("prev") | bound("next")).unionByName(rest)
    return split_streams(tied.select(*blocks.columns, "_suspect", "_tied"),
                         F.col("_suspect") & ~F.col("_tied"), "sfx").drop("_suspect", "_tied")


def known_words(rows: DataFrame, dictionary: DataFrame, keys: Sequence[str], text: str,
                shortest: int, min_freq: int | None = None) -> DataFrame:
    """Letter runs of ``text`` with their dictionary frequency (null: unknown)."""
    runs = rows.select(*keys, F.explode(F.regexp_extract_all(
        F.col(text), F.lit(f"[{tx.WORD_CHARS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    words = dictionary.select("word", "freq")
    if min_freq:
        words = words.where(F.col("freq") >= min_freq)
    return runs.withColumn("word", tx.tr_lower(F.col("run"))).join(words, "word", "left")


def plausible_line(c: Column) -> Column:
    """A line of letters and vowels that could be speech."""
    return (~tx.has_cjk(c) & (F.length(tx.dense_chars(c)) > 0) & (tx.letter_ratio(c) >= K.FRAGMENT_LETTERS)
            & (tx.vowel_count(c) >= K.FRAGMENT_VOWELS))


def dialogue_lines(rows: DataFrame, dictionary: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """Add ``is_dialogue``: a line that reads like speech of the dictionary."""
    keys = list(keys)
    known = (known_words(rows.where(plausible_line(F.col(line))), dictionary, keys, line, 3, K.FREQ_MIN)
             .where("freq IS NOT NULL").select(*keys).distinct().withColumn("is_dialogue", F.lit(True)))
    return rows.join(known, keys, "left").withColumn("is_dialogue", F.coalesce("is_dialogue", F.lit(False)))


def sfx_lines(blocks: DataFrame, dictionary: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Drop sound-effect lines inside multi-line blocks that hold a sound line.

    Returns (blocks with the remaining text, dropped lines with position). Only
    the numbers of lines with a dictionary word are shuffled; the lines of a
    block are judged in place, as a block is one row of text.
    """
    keys = list(keys)
    several = F.col("text").contains("\n")
    lines = blocks.where(several).select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    known = (known_words(lines, dictionary, [*keys, "line_no"], "line", 3, K.FREQ_MIN).where("freq IS NOT NULL")
             .groupBy(*keys).agg(F.collect_set("line_no").alias("_known")))

    def judge(line: Column, at: Column) -> Column:
        word = F.coalesce(F.array_contains("_known", at), F.lit(False))
        dense, letters = F.length(tx.dense_chars(line)), tx.letter_count(line)
        junk = ((dense > 0) & (dense < K.SFX_LINE_CHARS) & (tx.letter_ratio(line) < K.SFX_LETTERS)
                & (tx.cjk_count(line) * 2 < dense) & (((dense - letters) * 2 > dense) | ~word))
        return F.struct(at.alias("line_no"), line.alias("line"), (word & plausible_line(line)).alias("speech"), junk.alias("junk"))

    judged = (blocks.join(known, keys, "left")
              .withColumn("_lines", F.when(several, F.transform(F.split("text", "\n"), judge)))
              .withColumn("_sound", F.coalesce(F.exists("_lines", lambda x: x["speech"]), F.lit(False))))
    left = F.transform(F.filter("_lines", lambda x: ~F.coalesce(x["junk"], F.lit(False))), lambda x: x["line"])
    clean = judged.withColumn("text", F.when(F.col("_sound"), F.array_join(left, "\n")).otherwise(F.col("text"))).select(*blocks.columns)
    dropped = judged.where("_sound").select(*keys, F.explode(F.filter("_lines", lambda x: x["junk"])).alias("x")).select(
        *keys, "x.line_no", "x.line")
    return clean, dropped


def even_sample(df: DataFrame, ordinal: str, total: Column, n: int) -> Column:
    """True for rows ``i * total div n``; ``ordinal`` counts from zero."""
    m = F.least(F.lit(n).cast("bigint"), total)
    at = F.col(ordinal)
    # the first i with i*total div m >= at; the row is picked when it hits
    i = F.ceil(at * m / total)
    return F.floor(i * total / m) == at


def best_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return first_per_key(df, keys, order, n)
