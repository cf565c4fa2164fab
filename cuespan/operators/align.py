"""One-to-one alignment of predicted and reference cues.

Edges come from :func:`cuespan.operators.intervals.overlap_candidates`. Two
edges that share a cue both cover that cue's span, so edges can be cut into
islands wherever no edge spans a point in time; no match crosses such a cut.

Islands of up to ``fold_edges`` edges are matched one at a time inside a task.
Larger ones are matched by rounds of joins over the whole table, with the same
result, so no island has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespan.functions.ordered import fold_sorted, interval_islands, total_rank
from cuespan.session import cut_lineage

ISLAND_CHUNK_MS = 600_000
FOLD_EDGES = 500_000
_FREE = (1 << 63) - 1  # a right cue that no path of this phase uses


def edge_islands(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Narrow edge rows with an ``island`` number per key."""
    spans = edges.select(
        *keys, "p_cue_index", "r_cue_index", "overlap_ms",
        F.least("p_start_ms", "r_start_ms").alias("_from"), F.greatest("p_end_ms", "r_end_ms").alias("_to"))
    return interval_islands(spans, keys, "_from", "_to", ["p_cue_index", "r_cue_index"],
                            F.floor(F.col("_from") / ISLAND_CHUNK_MS)).drop("_from", "_to")


def _pairs_schema(edges: DataFrame, keys: Sequence[str]) -> str:
    types = dict(edges.dtypes)
    return ", ".join([*[f"{k} {types[k]}" for k in keys],
                      "p_cue_index bigint, r_cue_index bigint, overlap_ms bigint"])


def _by_size(edges: DataFrame, keys: Sequence[str], fold_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of islands that fit a fold, and of those that do not, if there are any."""
    islands = cut_lineage(edge_islands(edges, keys))
    large = islands.groupBy(*keys, "island").agg(F.count("*").alias("_n")).where(F.col("_n") > fold_edges).select(*keys, "island")
    if large.isEmpty():
        return islands, None
    place = [*keys, "island"]
    return islands.join(large, place, "left_anti"), islands.join(large, place, "left_semi")


def greedy_align(edges: DataFrame, keys: Sequence[str] = ("episode_id",), fold_edges: int = FOLD_EDGES) -> DataFrame:
    """Largest overlap first; ties by predicted, then reference position."""
    keys = list(keys)
    n = len(keys)

    def take(rows: list[tuple]) -> list[tuple]:
        if len(rows) == 1:
            return [rows[0][:n + 3]]
        used_p, used_r, out = set(), set(), []
        for row in rows:
            p, r = row[n], row[n + 1]
            if p not in used_p and r not in used_r:
                used_p.add(p)
                used_r.add(r)
                out.append(row[:n + 3])
        return out

    small, large = _by_size(edges, keys, fold_edges)
    folded = fold_sorted(small.withColumn("_rank", -F.col("overlap_ms")), [*keys, "island"],
                         ["_rank", "p_cue_index", "r_cue_index"], take, _pairs_schema(edges, keys))
    if large is None:
        return folded
    return folded.unionByName(greedy_align_rounds(large, keys).select(folded.columns))


def greedy_align_rounds(edges: DataFrame, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """The same matching without any grouped fold, for islands of any size.

    The order of edges is total, so an edge that is best for both of its cues
    among the remaining edges is always taken. Each round takes all of those.
    """
    keys = list(keys)
    best = F.struct((-F.col("overlap_ms")).alias("o"), F.col("p_cue_index").alias("p"), F.col("r_cue_index").alias("r"))
    left = cut_lineage(edges.select(*keys, "p_cue_index", "r_cue_index", "overlap_ms"))
    taken = None
    while not left.isEmpty():
        by_p = left.groupBy(*keys, "p_cue_index").agg(F.min(best).alias("b"))
        by_r = left.groupBy(*keys, "r_cue_index").agg(F.min(best).alias("b"))
        won = (by_p.join(by_r.withColumnRenamed("r_cue_index", "_r"), [*keys, "b"])
               .select(*keys, "p_cue_index", F.col("b.r").alias("r_cue_index"), (-F.col("b.o")).alias("overlap_ms")))
        won = cut_lineage(won)
        taken = won if taken is None else taken.unionByName(won)
        left = cut_lineage(
            left.join(won.select(*keys, "p_cue_index"), [*keys, "p_cue_index"], "left_anti")
            .join(won.select(*keys, "r_cue_index"), [*keys, "r_cue_index"], "left_anti"))
    return left if taken is None else taken


def match_largest(options: dict[int, list[int]]) -> dict[int, int]:
    """Largest one-to-one matching of one island by layered augmentation.

    ``options`` lists predictions per reference in order of preference; dict
    order is the order in which references are served.
    """
    chosen: dict[int, int] = {}
    owner: dict[int, int] = {}
    while True:
        layer = {ref: 0 for ref in options if ref not in chosen}
        frontier, goal = list(layer), None
        while frontier and goal is None:
            following = []
            for ref in frontier:
                for pred in options[ref]:
                    holder = owner.get(pred)
                    if holder is None:
                        goal = layer[ref] + 1
                    elif holder not in layer:
                        layer[holder] = layer[ref] + 1
                        following.append(holder)
            frontier = following
        if goal is None:
            return chosen
        for root in options:
            if root in chosen or layer.get(root) != 0:
                continue
            path, picks = [(root, iter(options[root]))], []
            while path:
                ref, choices = path[-1]
                for pred in choices:
                    holder = owner.get(pred)
                    if holder is None and layer[ref] + 1 == goal:
                        picks.append(pred)
                        for (node, _), pick in zip(path, picks):
                            chosen[node], owner[pick] = pick, node
                        path = []
                        break
                    if holder is not None and layer.get(holder) == layer[ref] + 1:
                        picks.append(pred)
                        path.append((holder, iter(options[holder])))
                        break
                else:
                    layer[ref] = -1
                    path.pop()
                    if picks:
                        picks.pop()


def largest_align(edges: DataFrame, keys: Sequence[str] = ("episode_id",), fold_edges: int = FOLD_EDGES) -> DataFrame:
    """Maximum-cardinality matching; references with few options go first,
    each trying its predictions by descending overlap."""
    keys = list(keys)
    n = len(keys)

    def solve(rows: list[tuple]) -> list[tuple]:
        if len(rows) == 1:
            return [rows[0][:n + 3]]
        options: dict[int, list[int]] = {}
        overlap = {}
        for row in rows:  # sorted by reference, -overlap, prediction
            options.setdefault(row[n + 1], []).append(row[n])
            overlap[row[n + 1], row[n]] = row[n + 2]
        served = dict(sorted(options.items(), key=lambda item: (len(item[1]), item[0])))
        return [(*rows[0][:n], pred, ref, overlap[ref, pred])
                for ref, pred in sorted(match_largest(served).items())]

    small, large = _by_size(edges, keys, fold_edges)
    folded = fold_sorted(small.withColumn("_rank", -F.col("overlap_ms")), [*keys, "island"],
                         ["r_cue_index", "_rank", "p_cue_index"], solve, _pairs_schema(edges, keys))
    if large is None:
        return folded
    return folded.unionByName(largest_align_rounds(large, keys).select(folded.columns))


def _layers(options: DataFrame, free: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Breadth-first layers of references from the unmatched ones (layer 0), the
    length of the shortest augmenting path of each island, and the longest of these.

    From a reference a path goes to a prediction it may take, and on to the
    reference that holds that prediction. An island stops growing with the layer
    that first sees a prediction nobody holds.
    """
    layers = frontier = cut_lineage(free.withColumn("layer", F.lit(0)))
    goals, depth = None, 0
    while not frontier.isEmpty():
        depth += 1
        seen = cut_lineage(options.join(frontier.select("turn"), "turn").select("island", "holder"))
        hit = seen.where("holder IS NULL").select("island").distinct()
        goals = hit.withColumn("length", F.lit(depth)) if goals is None else goals.unionByName(hit.withColumn("length", F.lit(depth)))
        frontier = cut_lineage(
            seen.where("holder IS NOT NULL").select("island", F.col("holder").alias("turn")).distinct()
            .join(hit, "island", "left_anti").join(layers.select("turn"), "turn", "left_anti")
            .select("island", "turn", F.lit(depth).alias("layer")))
        layers = layers.unionByName(frontier)
    if goals is None:
        return layers, options.select("island").limit(0).withColumn("length", F.lit(0)), 0
    goals = cut_lineage(goals)
    return cut_lineage(layers), goals, goals.agg(F.max("length")).first()[0] or 0


def _deep(df: DataFrame, layer: int) -> DataFrame:
    """Cut the lineage at every third layer, so that plans of long paths stay small."""
    return df if layer % 3 else cut_lineage(df)


def _disjoint_paths(steps: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(turn, right): the steps of the paths that references would find if they
    went one after another, each along its first complete path that crosses no
    earlier one.

    All references search at once. A prediction is marked with the first
    reference whose path uses it, and a later reference must avoid it: going back
    from the goals, the width of a step is the last reference that could still
    pass, so each walks on along its first step that is wide enough. Marks of the
    first reference are right in the first round, those of the k-th after k
    rounds at most; when no path changes, all are right.
    """
    marks, state = None, None
    while True:
        free = F.lit(_FREE)
        open_ = steps.withColumn("mark", free) if marks is None else (
            steps.join(marks, "right", "left").withColumn("mark", F.coalesce("mark", free)))
        levels: dict[int, DataFrame] = {}
        beyond = None
        for layer in range(depth - 1, -1, -1):
            here = open_.where(F.col("layer") == layer)
            if beyond is None:
                wide = here.where("holder IS NULL").withColumn("width", F.col("mark"))
            else:
                wide = here.join(beyond, "holder", "left").withColumn(
                    "width", F.when(F.col("holder").isNull(), F.col("mark")).otherwise(F.least("mark", F.coalesce("far", F.lit(-1)))))
            levels[layer] = _deep(wide.select("turn", "place", "right", "holder", "width").where("width >= 0"), depth - layer)
            beyond = levels[layer].groupBy(F.col("turn").alias("holder")).agg(F.max("width").alias("far"))
        walkers, paths = roots.select(F.col("turn").alias("root"), "turn"), None
        for layer in range(depth):
            first = F.min_by(F.struct("turn", "right", "holder"), "place").alias("s")
            walked = _deep(walkers.join(levels[layer], "turn").where(F.col("width") >= F.col("root")).groupBy("root").agg(first)
                           .select("root", "s.turn", "s.right", "s.holder"), layer + 1)
            paths = walked if paths is None else paths.unionByName(walked)
            walkers = walked.where("holder IS NOT NULL").select("root", F.col("holder").alias("turn"))
        paths = cut_lineage(paths)
        now = paths.agg(F.count("*"), F.sum(F.xxhash64("root", "turn", "right").cast("decimal(38,0)"))).first()
        if now == state:
            return paths.select("turn", "right")
        state = now
        marks = paths.groupBy("right").agg(F.min("root").alias("mark"))


def largest_align_rounds(edges: DataFrame, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """The same matching without any grouped fold, for islands of any size.

    Each phase finds shortest augmenting paths in layers and swaps along a set
    of disjoint ones, chosen as if references went in order of their options and
    positions. All islands advance at once; one that has no path left is done.
    """
    keys = list(keys)
    spans = edges if "island" in edges.columns else edge_islands(edges, keys)
    base = cut_lineage(spans.select(F.struct(*keys, "island").alias("island"), F.struct(*keys, F.col("r_cue_index").alias("i")).alias("left"),
                                    F.struct(*keys, F.col("p_cue_index").alias("i")).alias("right"), "overlap_ms"))
    served = total_rank(base.groupBy("island", "left").agg(F.count("*").alias("n")), [F.col("n").asc(), F.col("left").asc()], "turn")
    served = cut_lineage(served.select("island", "left", "turn"))
    place = F.row_number().over(Window.partitionBy("left").orderBy(F.desc("overlap_ms"), "right"))
    options = cut_lineage(base.withColumn("place", place).join(served.select("left", "turn"), "left")
                          .select("island", "turn", "place", "right", "overlap_ms"))
    chosen = cut_lineage(options.select("turn", "right").limit(0))
    while True:
        held = cut_lineage(options.select("island", "turn", "place", "right")
                           .join(chosen.select("right", F.col("turn").alias("holder")), "right", "left"))
        free = served.select("island", "turn").join(chosen.select("turn"), "turn", "left_anti")
        layers, goals, depth = _layers(held, free)
        if not depth:
            break
        level = layers.select("turn", "layer")
        steps = (held.join(goals, "island").join(level, "turn")
                 .join(level.select(F.col("turn").alias("holder"), F.col("layer").alias("next")), "holder", "left")
                 .where("(holder IS NULL AND layer = length - 1) OR (next = layer + 1 AND next < length)"))
        steps = cut_lineage(steps.select("turn", "layer", "place", "right", "holder"))
        roots = cut_lineage(free.join(goals, "island", "left_semi").select("turn"))
        paths = _disjoint_paths(steps, roots, depth)
        chosen = cut_lineage(chosen.join(paths.select("turn"), "turn", "left_anti").unionByName(paths))
    return (chosen.join(options, ["turn", "right"]).join(served.select("left", "turn"), "turn")
            .select(*[F.col(f"right.{k}").alias(k) for k in keys], F.col("right.i").alias("p_cue_index"),
                    F.col("left.i").alias("r_cue_index"), "overlap_ms"))


def attach_pairs(pairs: DataFrame, pred: DataFrame, ref: DataFrame,
                 keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Matched pairs with texts and times of both sides."""
    p = pred.select(*keys, *[F.col(c).alias("p_" + c) for c in ("cue_index", "text", "start_ms", "end_ms")])
    ref_keys = [k for k in keys if k in ref.columns]
    r = ref.select(*ref_keys, *[F.col(c).alias("r_" + c) for c in ("cue_index", "text", "start_ms", "end_ms")])
    return pairs.join(p, [*keys, "p_cue_index"]).join(r, [*ref_keys, "r_cue_index"])


def unmatched(cues: DataFrame, pairs: DataFrame, side: str, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    taken = pairs.select(*keys, F.col(f"{side}_cue_index").alias("cue_index"))
    return cues.join(taken, [*keys, "cue_index"], "left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark limits each task before the shuffle."""
    return (df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
            .where(F.col(name) <= n))
