"""Merging and cleaning of read blocks.

Every fold here is cut first at places its state cannot cross, so groups stay
small even when one video holds a large part of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions import text as tx
from cuespan.functions.ordered import adjacent_islands, fold_sorted, interval_islands
from cuespan.functions.similarity import alike, consensus, ratio, similar
from cuespan.operators import filters
from cuespan.operators.intervals import interval_join, renamed
from cuespan.session import cut_lineage, spread

CHUNK_FRAMES = 14_400


def same_text_islands(blocks: DataFrame, fps: float, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Equal consecutive texts with a short gap become one block that ends where
    its last reading ends."""
    keys = list(keys)
    joined = lambda a, b: (a["text"] == b["text"]) & (
        (b["start_f"] - a["end_f"]) / F.lit(float(fps)) < K.MERGE_SAME_GAP)
    runs = adjacent_islands(blocks, keys, ["block_no"], ["text", "start_f", "end_f"], joined)
    return runs.groupBy(*keys, "island").agg(
        F.min_by("start_f", "block_no").alias("start_f"), F.max_by("end_f", "block_no").alias("end_f"),
        F.min_by("text", "block_no").alias("text"), F.min_by("conf", "block_no").alias("conf"),
        F.count("*").alias("readings"))


def merge_readings(blocks: DataFrame, fps: float, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Fold consecutive readings of one subtitle into one block.

    Equal texts merge first. After that a block absorbs the next reading when
    they share most of their frames (the surer text wins if they differ), when a
    short gap separates similar texts, or a longer gap very similar ones.
    """
    keys, fps = list(keys), float(fps)
    n = len(keys)

    def final(held: list) -> tuple:
        start, end, text, conf, _, count, head = held
        return (*head, start, end, text, conf, count)

    def fold(rows: list[tuple], held: list | None) -> tuple[list[tuple], list]:
        out = []
        for row in rows:  # held: start, end, text, conf, length of the chosen reading, readings, keys
            start, end, text, conf, count = row[n:n + 5]
            length = (end - start + 1) / fps
            if held is None:
                held = [start, end, text, conf, length, count, row[:n]]
                continue
            likeness = ratio(text, held[2])
            shared = min(held[1], end) - max(held[0], start) + 1
            covered = shared > 0 and shared / fps > K.MERGE_OVERLAP_SHARE * min(length, (held[1] - held[0] + 1) / fps)
            gap = (start - held[1]) / fps
            if covered and likeness < K.MERGE_SIM:
                if conf > held[3]:
                    held[2], held[3] = text, conf
                held[0], held[1] = min(held[0], start), max(held[1], end)
                held[4] = max(held[4], length)
            elif covered or (gap < K.MERGE_SAME_GAP and likeness >= K.MERGE_SIM) or (
                    0 <= gap <= K.MERGE_LONG_GAP and likeness >= K.MERGE_LONG_SIM):
                held[1] = max(held[1], end) if covered else end
                if length > held[4]:
                    held[2], held[3], held[4] = text, conf, length
            else:
                out.append(final(held))
                held = [start, end, text, conf, length, count, row[:n]]
                continue
            held[5] += count
        return out, held

    same = same_text_islands(blocks, fps, keys)
    # no rule reaches over a longer silence than MERGE_LONG_GAP
    cut = interval_islands(same, keys, "start_f", "end_f", ["island"], F.floor(F.col("start_f") / CHUNK_FRAMES),
                           "_cut", int(K.MERGE_LONG_GAP * fps) + 1)
    types = dict(blocks.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys],
                        "start_f bigint, end_f bigint, text string, conf double, readings bigint"])
    ready = cut.select(*keys, "start_f", "end_f", "text", "conf", "readings", "_cut", "island")
    return fold_sorted(ready, [*keys, "_cut"], ["start_f", "island"], fold, schema, lambda held: [final(held)])


def micro_cleanup(blocks: DataFrame, fps: float, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Very short blocks join a similar neighbour: left, waiting, then right.

    Blocks that find none stay when they look real and move otherwise. A long
    block right after a long block sees no open state, so runs are cut there.
    """
    keys, fps = list(keys), float(fps)
    n = len(keys)

    def length(block):
        return (block[1] - block[0] + 1) / fps

    def merged(old, new):
        text = old if length(old) >= length(new) else new
        return [min(old[0], new[0]), max(old[1], new[1]), *text[2:]]

    def match(new, old):
        return bool(old[2].strip()) and alike(new[2], old[2], K.MICRO_SIM)

    class Open:
        """The last dialogue block, which the next may still join, and one that waits."""

        def __init__(self, head: tuple):
            self.head, self.last, self.waiting, self.done = head, None, None, []

        def emit(self, block, stream):
            self.done.append((*self.head, *block[:4], stream))

        def put(self, block):
            if self.last is not None:
                self.emit(self.last, "dialogue")
            self.last = block

        def release(self):
            if self.waiting is not None:
                if self.waiting[4]:
                    self.emit(self.waiting, "screen")
                else:
                    self.put(self.waiting)
                self.waiting = None

    def fold(rows: list[tuple], state: Open | None) -> tuple[list[tuple], Open]:
        state = state or Open(rows[0][:n])
        for row in rows:
            block = list(row[n:n + 5])
            if length(block) < K.MICRO_MAX_SECONDS and block[2].strip():
                if state.last is not None and match(block, state.last):
                    state.last = merged(state.last, block)
                elif state.waiting is not None and match(block, state.waiting):
                    state.waiting = merged(state.waiting, block)
                else:
                    state.release()
                    state.waiting = block
                continue
            if state.waiting is not None and block[2].strip() and match(state.waiting, block):
                block, state.waiting = merged(state.waiting, block), None
            state.release()
            state.put(block)
        done, state.done = state.done, []
        return done, state

    def close(state: Open) -> list[tuple]:
        state.release()
        state.put(None)
        return state.done

    micro = (filters.seconds(fps) < K.MICRO_MAX_SECONDS) & (tx.strip_ws(F.col("text")) != "")
    marked = blocks.withColumn("micro", micro)
    runs = adjacent_islands(marked, keys, ["block_no"], ["micro"], lambda a, b: a["micro"] | b["micro"], "_run")
    types = dict(blocks.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys],
                        "start_f bigint, end_f bigint, text string, conf double, stream string"])
    ready = runs.select(*keys, "start_f", "end_f", "text", "conf",
                        filters.micro_junk(F.col("text"), F.col("conf")).alias("junk"), "_run", "block_no")
    return fold_sorted(ready, [*keys, "_run"], ["block_no"], fold, schema, close)


def repeat_clusters(blocks: DataFrame, fps: float, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Find watermarks: at least four alike short blocks within six seconds.

    ``blocks`` holds both streams (column ``stream``). Returns the blocks of
    accepted clusters; larger clusters are accepted first and a cluster needs two
    members no earlier one took.
    """
    keys, fps = list(keys), float(fps)
    n = len(keys)
    at = F.struct("start_f", F.when(F.col("stream") == "dialogue", 0).otherwise(1).alias("s"), "block_no")
    base = (blocks.withColumn("norm", tx.rep_norm(F.col("text"))).where("norm <> ''")
            .select(*keys, "norm", at.alias("at"), filters.seconds(fps).alias("secs"), "start_f",
                    (F.col("start_f") + 1).alias("point"),
                    (F.col("start_f") + int(K.REPEAT_WINDOW_S * fps) + 1).alias("reach")))
    a, b = renamed(base, "a_", keys), renamed(base, "b_", keys)
    near = interval_join(a, b, keys, ("a_start_f", "a_reach"), ("b_start_f", "b_point"), 480)
    near = near.where(F.col("b_at") > F.col("a_at"))
    la, lb = F.length("a_norm"), F.length("b_norm")
    near = near.where(2 * F.least(la, lb) >= K.REPEAT_SIM * (la + lb))
    pairs = spread(near).where(similar(F.col("a_norm"), F.col("b_norm"), K.REPEAT_SIM))
    # six seconds of frames bound the members of one anchor
    members = pairs.groupBy(*keys, "a_at", "a_secs").agg(
        F.array_sort(F.collect_list("b_at")).alias("others"), F.collect_list("b_secs").alias("other_secs"))
    sizes = F.array_sort(F.concat("other_secs", F.array("a_secs")))
    clusters = (members.where(F.size("others") + 1 >= K.REPEAT_MIN)
                .withColumn("median_s", F.element_at(sizes, F.floor(F.size(sizes) / 2).cast("int") + 1))
                .where(F.col("median_s") <= K.REPEAT_MEDIAN_S)
                .select(*keys, (F.size("others") + 1).cast("bigint").alias("size"),
                        F.col("a_at.start_f").alias("start_f"), F.col("a_at.block_no").alias("anchor_no"),
                        F.to_json(F.concat(F.array("a_at"), "others")).alias("members"),
                        (F.element_at("others", -1)["start_f"] + 1).alias("end_f")))

    def fold(rows: list[tuple]) -> list[tuple]:
        import json
        taken: set[tuple] = set()
        for row in rows:  # largest first
            group = [(m["start_f"], m["s"], m["block_no"]) for m in json.loads(row[n + 2])]
            fresh = [m for m in group if m not in taken]
            if len(fresh) >= 2:
                taken.update(fresh)
        return [(*rows[0][:n], s, "dialogue" if kind == 0 else "screen", no) for s, kind, no in sorted(taken)]

    grouped = interval_islands(clusters, keys, "start_f", "end_f", ["anchor_no"],
                               F.floor(F.col("start_f") / CHUNK_FRAMES), "_cut")
    types = dict(blocks.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "start_f bigint, stream string, block_no bigint"])
    ready = grouped.select(*keys, (-F.col("size")).alias("rank"), "start_f", "members", "_cut", "anchor_no")
    return fold_sorted(ready, [*keys, "_cut"], ["rank", "start_f", "anchor_no"], fold, schema)


def fragments_absent_nearby(fragments: DataFrame, main: DataFrame, fps: float,
                            keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Fragments whose text no dialogue block within 1.5 seconds already holds."""
    keys = list(keys)
    reach = int(K.FRAGMENT_NEAR_S * fps)
    f = fragments.select(*keys, "block_no", tx.rep_norm(F.col("text")).alias("f_norm"),
                         (F.col("start_f") - reach).alias("f_from"), (F.col("end_f") + 2 + reach).alias("f_to"))
    m = main.select(*keys, tx.rep_norm(F.col("text")).alias("m_norm"), F.col("start_f").alias("m_from"),
                    (F.col("end_f") + 1).alias("m_to"))
    near = interval_join(f.where("f_norm <> ''"), m.where("m_norm <> ''"), keys,
                         ("f_from", "f_to"), ("m_from", "m_to"), 480)
    lf, lm = F.length("f_norm"), F.length("m_norm")
    near = near.where(F.lit(2.0) * F.least(lf, lm) / (lf + lm) >= K.FRAGMENT_SIM)
    found = spread(near).where(similar(F.col("f_norm"), F.col("m_norm"), K.FRAGMENT_SIM)).select(*keys, "block_no").distinct()
    return fragments.join(found, [*keys, "block_no"], "left_anti")


def fragment_restore(screen: DataFrame, main: DataFrame, dictionary: DataFrame, fps: float,
                     keys: Sequence[str] = ("video_id",)) -> tuple[DataFrame, DataFrame]:
    """Dialogue lines of short screen blocks go back to the dialogue.

    Returns (restored blocks, what is left of each touched screen block; an
    empty text means it was used up).
    """
    keys, fps = list(keys), float(fps)
    n = len(keys)
    ids = [*keys, "block_no"]
    short = screen.where(filters.seconds(fps) <= K.FRAGMENT_SECONDS)
    lines = short.select(*ids, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(
        tx.strip_ws(F.col("line")) != "")
    good = filters.dialogue_lines(lines, dictionary, [*ids, "line_no"]).where("is_dialogue")
    # the lines of one block come from one text value
    texts = good.groupBy(*ids).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    # few rows, and the join by time looks at them more than once
    fragments = cut_lineage(short.select(*ids, "start_f", "end_f", "conf").join(texts, ids))
    chosen = fragments_absent_nearby(fragments, main, fps, keys).withColumn("norm", tx.rep_norm(F.col("text")))

    def fold(rows: list[tuple]) -> list[tuple]:
        chains: list[dict] = []
        for row in rows:
            no, start, end, conf, text, norm = row[n:n + 6]
            last = chains[-1] if chains else None
            if (last and (start - last["end"]) / fps <= K.FRAGMENT_CHAIN_GAP and last["norm"] and norm
                    and alike(last["norm"], norm, K.FRAGMENT_SIM)):
                last["end"], last["conf"] = max(last["end"], end), max(last["conf"], conf)
                if len(text) > len(last["text"]):
                    last["text"], last["norm"] = text, norm
                last["blocks"].append(no)
            else:
                chains.append({"start": start, "end": end, "conf": conf, "text": text, "norm": norm, "blocks": [no]})
        return [(*rows[0][:n], no, c["blocks"][0], c["start"], c["end"], c["text"], c["conf"], len(c["blocks"]))
                for c in chains for no in c["blocks"]]

    cut = interval_islands(chosen, keys, "start_f", "end_f", ["block_no"], F.floor(F.col("start_f") / CHUNK_FRAMES),
                           "_cut", int(K.FRAGMENT_CHAIN_GAP * fps) + 1)
    types = dict(screen.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys],
                        "block_no bigint, chain_no bigint, start_f bigint, end_f bigint, text string, "
                        "conf double, fragments bigint"])
    ready = cut.select(*keys, "block_no", "start_f", "end_f", "conf", "text", "norm", "_cut")
    chained = fold_sorted(ready, [*keys, "_cut"], ["start_f", "block_no"], fold, schema)
    restored = chained.where("block_no = chain_no").drop("block_no")
    used = chained.select(*ids, F.split("text", "\n").alias("_used"))
    left = short.join(used, ids).select(*ids, F.array_join(F.filter(
        F.split("text", "\n"), lambda s: (tx.strip_ws(s) != "") & ~F.array_contains("_used", s)), "\n").alias("text"))
    return restored, left


def consensus_pick(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of several readings of a segment take the one most like all of them.

    ``readings``: ``keys, pos, text, conf``. Ties go to the longer, then to the
    earlier reading; the confidence is the best one of that text.
    """
    keys = list(keys)
    # a segment is one row with its few readings; Python sees those that differ
    reading = F.when(F.col("text") != "", F.struct("pos", "text", "conf"))
    segments = readings.groupBy(*keys).agg(F.array_sort(F.collect_list(reading)).alias("c"))
    differ = F.size(F.array_distinct("c.text")) > 1
    best = F.coalesce(consensus(F.when(differ, F.col("c.pos")), F.when(differ, F.col("c.text"))), F.lit(0))
    text = F.get("c.text", F.col("best"))
    sure = F.array_max(F.transform(F.filter("c", lambda x: x["text"] == F.col("text")), lambda x: x["conf"]))
    return (segments.withColumn("best", best).withColumn("text", text)
            .select(*keys, F.coalesce("text", F.lit("")).alias("text"), F.coalesce(sure, F.lit(0.0)).alias("conf")))


def upper_median(column: str) -> Column:
    """Element ``n div 2`` of the sorted values, counted from zero."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


PAGE_CHUNK_PX = 100_000


def _page_parts(boxes: DataFrame, keys: list[str]) -> DataFrame | None:
    """Chunks of pages that have several: their part of the page and its limit.

    A part ends between two chunks that a clear step separates. Pages of a single
    chunk are not listed, and None stands for no rows at all.
    """
    whole = Window.partitionBy(*keys)
    ends = boxes.groupBy(*keys, "_chunk").agg(F.min("y").alias("top"), F.max("y").alias("bottom"))
    wide = cut_lineage(ends.withColumn("n", F.count("*").over(whole)).where("n > 1").drop("n"))
    if wide.isEmpty():
        return None
    heights = (boxes.where("h > 0").join(wide.select(*keys).distinct(), keys, "left_semi")
               .groupBy(*keys).agg(upper_median("h").alias("mid")))
    limit = F.greatest(F.lit(float(K.LINE_MIN_PX)), 0.5 * F.coalesce(F.col("mid").cast("double"), F.lit(0.0)))
    along = whole.orderBy("_chunk")
    step = F.col("top") - F.lag("bottom").over(along)
    opens = F.when(F.coalesce(step > F.col("limit"), F.lit(True)), F.col("_chunk"))
    return (wide.join(heights, keys, "left").withColumn("limit", limit).withColumn("_opens", opens)
            .select(*keys, "_chunk", F.last("_opens", ignorenulls=True).over(along).alias("_part"), "limit"))


def line_group(boxes: DataFrame, keys: Sequence[str], gathered: bool = False) -> DataFrame:
    """Group recognised boxes into text lines.

    ``boxes``: ``keys, box_no, y, x, h, text, conf``. A clear vertical step always
    opens a line, so a page is cut at those between its chunks and its parts are
    gone over apart, each sorted once and held as columns of numbers and words. A
    page of one chunk takes its median height there. Boxes without ``y`` are left out.

    ``gathered`` says that all boxes of a page already follow each other in one
    partition, in any order, as they do when each page comes out of one row. Then
    nothing is shuffled, and a page is sorted where it is gone over.
    """
    keys = list(keys)
    placed = boxes.where("y IS NOT NULL").withColumns({
        "y": F.col("y").cast("double"), "_chunk": F.floor(F.col("y") / PAGE_CHUNK_PX)})
    parts = None if gathered else _page_parts(placed, keys)
    if gathered:
        placed = placed.withColumns({"_part": F.lit(0).cast("bigint"), "limit": F.lit(None).cast("double")})
    elif parts is None:
        placed = placed.withColumns({"_part": F.col("_chunk"), "limit": F.lit(None).cast("double")})
    else:
        placed = placed.join(parts, [*keys, "_chunk"], "left").withColumn("_part", F.coalesce("_part", "_chunk"))
    types = dict(boxes.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "y double, boxes bigint, text string, conf double"])
    names = [*keys, "y", "boxes", "text", "conf"]
    columns = [*keys, "_part", "y", "box_no", "x", "h", "text", "conf", "limit"]
    at = [*keys, "_part"]

    def lines(key: tuple, pieces: list[dict]) -> list[tuple]:
        part = pieces[0] if len(pieces) == 1 else {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]}
        if gathered:
            number = part["box_no"]
            by = np.lexsort((np.where(np.isnan(number), -np.inf, number) if number.dtype.kind == "f" else number, part["y"]))
            part = {c: v[by] for c, v in part.items()}
        y, limit = part["y"], part["limit"][0]
        if np.isnan(limit):
            h = np.sort(part["h"][part["h"] > 0])
            limit = max(float(K.LINE_MIN_PX), 0.5 * h[len(h) // 2] if len(h) else 0.0)
        first, total, count, last = [], 0.0, 0, 0.0
        for i, v in enumerate(y.tolist()):
            if count and v - last <= limit and v - total / count <= 3.0 * limit:
                total, count = total + v, count + 1
            else:
                first.append(i)
                total, count = v, 1
            last = v
        sizes = np.diff(np.append(first, len(y)))
        order = np.lexsort((part["x"], np.repeat(np.arange(len(first)), sizes)))
        words = part["text"][order].tolist()
        rows = zip(first, sizes.tolist(), y[first].tolist(), np.fmin.reduceat(part["conf"], first).tolist())
        return [(*key[:-1], top, size, " ".join(words[i:i + size]), conf) for i, size, top, conf in rows]

    def run(batches):
        held, current = [], None
        for batch in batches:
            if not len(batch):
                continue
            keyed = [batch[k].astype(object).where(batch[k].notna(), None).to_numpy() for k in at]
            new = np.zeros(len(batch), bool)
            for v in keyed:
                new[1:] |= v[1:] != v[:-1]
            data = {c: batch[c].to_numpy(dtype=float, na_value=np.nan) for c in ("y", "h", "conf", "limit")}
            data |= {c: batch[c].to_numpy() for c in (("x", "text", "box_no") if gathered else ("x", "text"))}
            starts, done = [0, *np.flatnonzero(new).tolist()], []
            for start, stop in zip(starts, [*starts[1:], len(batch)]):
                key = tuple(v[start] for v in keyed)
                if key != current and held:
                    done += lines(current, held)
                    held = []
                held.append({c: v[start:stop] for c, v in data.items()})
                current = key
            if done:
                yield pd.DataFrame(done, columns=names)
        if held:
            yield pd.DataFrame(lines(current, held), columns=names)

    ready = placed.select(*columns)
    if not gathered:
        ready = spread(ready, *at).sortWithinPartitions(*at, "y", "box_no")
    return ready.mapInPandas(run, schema)


def screen_profile(blocks: DataFrame, dictionary: DataFrame, keys: Sequence[str] = ("video_id", "block_no")) -> DataFrame:
    """Ordered screen-text rules; null means dialogue.

    Word rules look at a view of the text in which only dots and cedillas were
    restored, so dialogue that merely lost them still counts as known.
    """
    from cuespan.operators.repair import diacritic_upgrades
    keys = list(keys)
    t = F.col("text")
    tokens = blocks.select(*keys, F.explode(F.split(F.translate("text", "\n", " "), " ")).alias("token")).where("token <> ''")
    # all rules on words hang on the token alone, and a table has few different ones
    each = cut_lineage(tokens.select("token").distinct().withColumn("core", tx.core(F.col("token")))
                       .withColumn("low", tx.tr_lower(F.col("core"))))
    odd = (F.length("core") >= 3) & ~tx.is_upper(F.col("core")) & (
        F.substring("core", 2, 1 << 20) != F.lower(F.substring("core", 2, 1 << 20)))
    upgrades = diacritic_upgrades(each.where("low IS NOT NULL").select(F.col("low").alias("token")).distinct(), dictionary)
    viewed = each.join(upgrades.select(F.col("token").alias("low"), "better"), "low", "left").withColumn(
        "view", F.when(F.col("better").isNotNull(), F.concat(tx.edge_prefix(F.col("token")), "better",
                                                             tx.edge_suffix(F.col("token"))))
        .otherwise(F.col("token"))).withColumn("odd", odd)
    runs = viewed.select("token", "odd", F.explode_outer(F.regexp_extract_all(
        "view", F.lit(f"[{tx.WORD_CHARS}]{{4,}}"), F.lit(0))).alias("run")).withColumn("word", tx.tr_lower(F.col("run")))
    hit = F.when(F.col("freq").isNotNull(), F.length("word")).otherwise(0)
    measured = runs.join(dictionary.select("word", "freq"), "word", "left").groupBy("token").agg(
        F.count("run").alias("runs"), F.count("freq").alias("hits"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("chars"),
        F.sum(hit).alias("hit_chars"), F.coalesce(F.bool_or("odd"), F.lit(False)).alias("odd_capital"))
    # a token without a run and of plain case changes nothing
    told = measured.where("runs > 0 OR odd_capital")
    known = tokens.join(told, "token").groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("runs", "hits", "chars", "hit_chars")], F.bool_or("odd_capital").alias("odd_capital"))
    gate = (F.col("conf") < K.SCREEN_CONF) | F.col("odd_capital")
    share, cover = F.col("hits") / F.col("runs"), F.col("hit_chars") / F.col("chars")
    joined = blocks.join(known, keys, "left").withColumns(
        {"odd_capital": F.coalesce("odd_capital", F.lit(False)), "runs": F.expr("nullif(runs, 0)"), "chars": F.expr("nullif(chars, 0)")})
    dense = F.length(tx.dense_chars(t))
    return joined.select(*keys, "conf", F.when(dense == 0, F.lit(None))
                         .when(tx.cjk_ratio(t) > K.SCREEN_CJK_SHARE, "a-cjk")
                         .when(tx.letter_count(t) <= 2, "c-sembol")
                         .when((share < 0.30) & (cover < 0.50) & gate, "b1-profil")
                         .when((F.col("runs") >= 5) & (share < 0.60) & gate, "b2-jenerik").alias("rule"))
