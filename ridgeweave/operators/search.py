"""Beam search for routes with much ascent within distance budgets.

All budgets advance together, one level of edges at a time. Each level joins
the frontier with the directed edges, drops what repeats an edge or exceeds
its budget, and keeps the best states of every budget by two windows, one by
cell and one by budget. Modes share the frontier, as they differ only in what
they accept. Levels are written to the shared folder, so the plan stays short,
a lost executor costs one level, and Spark knows the frontier's size when it
chooses the join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeweave.functions.similarity import gain_density, near_duplicate
from ridgeweave.operators import graph as G
from ridgeweave.operators.paths import numbered
from ridgeweave.scratch import Scratch

MODES = ("loop", "point_to_point")
#: More states than are ever taken.
MANY = 1 << 62
#: States of a budget and mode that one task settles in a round.
BLOCK = 2048
#: Steps that one task joins with states. What they extend is several times as much, which Spark can't tell from its shuffles.
STEPS = 100_000


@dataclass(frozen=True)
class Search:
    """Settings of a search; ``None`` or 0 lifts a limit."""

    beam_width: int = 80
    max_routes_per_budget: int = 25
    max_start_nodes: int | None = 2000
    start_node_grid_m: float | None = 1500
    max_start_nodes_per_grid: int | None = 25
    route_diversity_grid_m: float | None = 2500
    max_routes_per_grid: int | None = 3
    frontier_grid_m: float | None = 2500
    max_frontier_states_per_grid: int | None = 20
    jaccard: float = 0.85
    length_jaccard: float = 0.78
    length_containment: float = 0.88
    landmarks: list[str] = field(default_factory=list)
    min_ascent_m: float = 0.0


def rank_order() -> list[Column]:
    """Best state first; edge sequences decide ties."""
    return [F.desc("ascent_m"), F.desc("density"), F.desc("confidence"), F.asc("distance_m"), F.asc("directed_edge_ids")]


def seeds(starts: DataFrame, nodes: DataFrame, budgets_m: list[float]) -> DataFrame:
    """A state without edges for each start node and budget."""
    none = F.array().cast("array<string>")
    place = nodes.select(F.col("node_id"), F.col("x").cast("double"), F.col("y").cast("double"))
    return starts.join(place, "node_id", "left").select(
        F.explode(F.array(*[F.lit(float(b)) for b in budgets_m])).alias("budget_m"),
        F.col("node_id").alias("start_node"),
        F.col("node_id").alias("current_node"),
        *[F.lit(0.0).alias(k) for k in ("distance_m", "ascent_m", "descent_m", "confidence_sum")],
        none.alias("directed_edge_ids"),
        none.alias("undirected_edge_ids"),
        F.array().cast("array<double>").alias("lengths"),
        F.array("node_id").alias("node_ids"),
        F.coalesce("x", F.lit(0.0)).alias("sum_x"),
        F.coalesce("y", F.lit(0.0)).alias("sum_y"),
        F.when(F.col("x").isNull(), 0).otherwise(1).alias("placed"),
        F.array().cast("array<int>").alias("landmarks"),
        F.array().cast("array<int>").alias("step_landmarks"),
    )


def first_steps(steps: DataFrame, budgets_m: list[float]) -> DataFrame:
    """``expand`` of ``seeds`` from every placed node, without a join: ``steps`` hold the places of their starts."""
    seed = [F.col("src").alias("start_node"), *[F.lit(0.0).alias(k) for k in ("distance_m", "ascent_m", "descent_m", "confidence_sum")]]
    seed += [F.array().cast(f"array<{t}>").alias(k) for k, t in (("directed_edge_ids", "string"), ("undirected_edge_ids", "string"), ("lengths", "double"), ("landmarks", "int"), ("step_landmarks", "int"))]
    seed += [F.array("src").alias("node_ids"), F.col("src_x").alias("sum_x"), F.col("src_y").alias("sum_y"), F.lit(1).alias("placed")]
    budget = F.explode(F.array(*[F.lit(float(b)) for b in budgets_m])).alias("budget_m")
    each = steps.filter("src_x is not null and src_y is not null").select("*", budget).filter(F.col("length_m") <= F.col("budget_m") + 1e-9)
    return extended(each.select(F.struct("budget_m", *seed).alias("f"), F.struct(*steps.columns).alias("e")))


def expand(frontier: DataFrame, steps: DataFrame, max_edges: int, least: float | None = None) -> DataFrame:
    """Every state extended by every way out that neither repeats an edge nor exceeds the budget.

    States that less than ``least`` metres are left to stay behind. Only what
    the frontier has is carried on.
    """
    if least is not None:
        frontier = frontier.filter(F.col("distance_m") + least <= F.col("budget_m") + 1e-6)
    f = frontier.filter(F.size("undirected_edge_ids") < max_edges).alias("f")
    e = steps.alias("e")
    joined = f.join(e, F.col("f.current_node") == F.col("e.src")).filter(~F.array_contains("f.undirected_edge_ids", F.col("e.undirected_edge_id")) & (F.col("f.distance_m") + F.col("e.length_m") <= F.col("f.budget_m") + 1e-9))
    return extended(joined, frontier.columns)


def expand_many(frontier: DataFrame, steps: DataFrame, count: int, max_edges: int, least: float | None = None) -> DataFrame:
    """``expand`` of a frontier that grows with the ``count`` steps, in tasks of ``STEPS`` of them.

    Left to Spark, tasks are merged by the bytes that they read, and what then
    sorts the states they make spills. Few steps may be broadcast instead.
    """
    if least is not None:
        frontier = frontier.filter(F.col("distance_m") + least <= F.col("budget_m") + 1e-6)
    if (tasks := -(-count // STEPS)) > 8:
        frontier, steps = frontier.repartition(tasks, "current_node"), steps.repartition(tasks, "src")
    return expand(frontier, steps, max_edges)


def extended(joined: DataFrame, have: list[str] | None = None) -> DataFrame:
    """States ``f`` with a step ``e`` more, or those of their columns that are in ``have``."""
    add = lambda k, v: (F.col(f"f.{k}") + F.col(f"e.{v}")).alias(k)
    push = lambda k, v: F.array_append(f"f.{k}", F.col(f"e.{v}")).alias(k)
    columns = {
        "budget_m": F.col("f.budget_m"),
        "start_node": F.col("f.start_node"),
        "current_node": F.col("e.dst").alias("current_node"),
        **{k: add(k, v) for k, v in (("distance_m", "length_m"), ("ascent_m", "ascent_m"), ("descent_m", "descent_m"), ("confidence_sum", "source_confidence"))},
        **{k: push(k, v) for k, v in (("directed_edge_ids", "directed_edge_id"), ("undirected_edge_ids", "undirected_edge_id"), ("lengths", "similarity_length"), ("node_ids", "dst"))},
        **{k: add(k, v) for k, v in (("sum_x", "x"), ("sum_y", "y"), ("placed", "placed"))},
        **{k: F.array_union(f"f.{k}", f"e.{k}").alias(k) for k in ("landmarks", "step_landmarks")},
    }
    return joined.select(*[c for k, c in columns.items() if have is None or k in have])


def scored(states: DataFrame) -> DataFrame:
    n = F.size("undirected_edge_ids")
    return states.withColumn("density", gain_density(F.col("ascent_m"), F.col("distance_m"))).withColumn("confidence", F.when(n > 0, F.col("confidence_sum") / n).otherwise(F.lit(0.0)))


def route_cell(grid_m: float) -> Column:
    """The cell of the mean of a state's nodes; (0, 0) without any."""
    part = lambda k: F.when(F.col("placed") > 0, F.floor(F.col(k) / F.col("placed") / grid_m)).otherwise(F.lit(0).cast("bigint"))
    return F.struct(part("sum_x").alias("cx"), part("sum_y").alias("cy"))


def prune(states: DataFrame, how: Search) -> DataFrame:
    """The beam of every budget: states with a landmark on steps first, of the others a few in each cell."""
    if how.beam_width <= 0:
        return states
    order = rank_order()
    out = scored(states).withColumn("marked", F.size("step_landmarks") > 0)
    if how.frontier_grid_m and how.max_frontier_states_per_grid:
        # a marked state is a group by itself, so one plain limit holds for all rows, and Spark applies it before its shuffle
        place = W.partitionBy("budget_m", "marked", route_cell(how.frontier_grid_m), F.when(F.col("marked"), F.col("directed_edge_ids"))).orderBy(*order)
        out = out.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= how.max_frontier_states_per_grid).drop("place")
    beam = W.partitionBy("budget_m").orderBy(F.desc("marked"), *order)
    return out.withColumn("place", F.row_number().over(beam)).filter(F.col("place") <= how.beam_width).select(*states.columns)


def accepted(states: DataFrame, modes: list[str]) -> DataFrame:
    """States that end a route, once for each mode that takes them."""
    loop = (F.size("directed_edge_ids") >= 2) & (F.col("current_node") == F.col("start_node"))
    away = F.col("current_node") != F.col("start_node")
    taken = F.array_compact(F.array(*[F.when(loop if m == "loop" else away, F.lit(m)) for m in modes]))
    return states.withColumn("mode", F.explode(taken))


def steps_of(directed: DataFrame, nodes: DataFrame, landmarks: list[str]) -> DataFrame:
    """Directed edges with what a step adds to a state; ``nodes`` are asked only where edges lack the places of their ends."""
    if "x" in directed.columns:
        return with_lengths(G.landmark_flags(directed, landmarks))
    place = nodes.select(F.col("node_id").alias("dst"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return with_lengths(G.landmark_flags(directed, landmarks).join(place, "dst", "left"))


def with_lengths(out: DataFrame) -> DataFrame:
    out = out.withColumn("placed", F.when(F.col("x").isNull(), 0).otherwise(1)).fillna(0.0, ["x", "y"])
    return out.withColumn("similarity_length", F.when(F.col("length_m") == 0, F.lit(1.0)).otherwise(F.col("length_m")))


def candidates(directed: DataFrame, nodes: DataFrame, budgets_km: list[float], modes: list[str], how: Search, scratch: Scratch) -> DataFrame:
    """Every accepted state of every budget and mode.

    No length is negative, so steps longer than any budget are in no route;
    they only count for the choice of starts.
    """
    if bad := set(modes) - set(MODES):
        raise ValueError(f"unknown route mode: {', '.join(sorted(bad))}")
    columns = ("directed_edge_id", "src", "dst", "undirected_edge_id", "length_m", "ascent_m", "descent_m", "source_confidence", "landmarks", "step_landmarks", "x", "y", "placed", "similarity_length")
    short = directed.filter(F.col("length_m") <= max(map(float, budgets_km), default=0.0) * 1000 + 1e-9)
    steps = scratch.keep(steps_of(short, nodes, how.landmarks).select(*columns), "steps")
    most = max(1, steps.count() // 2)
    ways = G.landmark_flags(directed, how.landmarks) if how.landmarks else directed
    starts = G.start_nodes(ways, nodes, how.start_node_grid_m, how.max_start_nodes_per_grid, how.max_start_nodes)
    frontier = scratch.keep(seeds(starts, nodes, [float(b) * 1000 for b in sorted(budgets_km, key=float)]), "frontier")
    levels: list[DataFrame] = []
    while True:
        grown = scratch.keep(expand(frontier, steps, most), "grown")
        if not grown.limit(1).count():
            break
        levels.append(grown)
        frontier = scratch.keep(prune(grown, how), "frontier")
    every = G.union_layers(levels) if levels else grown
    return accepted(scored(every), modes)


def without_repeats(states: DataFrame, how: Search) -> DataFrame:
    """States that the greedy selection can take at all.

    Of states that match no landmark, only the best of each edge set and cell
    can be chosen, as it makes the others near-duplicates. Landmark states
    stay, because one edge set may serve two landmarks.
    """
    key = [F.col("budget_m"), F.col("mode"), F.sort_array("undirected_edge_ids")] + ([route_cell(how.route_diversity_grid_m)] if how.route_diversity_grid_m else [])
    place = W.partitionBy(*key, F.size("landmarks") > 0).orderBy(*rank_order())
    return states.withColumn("place", F.row_number().over(place)).filter((F.col("place") == 1) | (F.size("landmarks") > 0)).drop("place")


class Greedy:
    """Takes states in order unless their cell is full or they resemble one taken before.

    What was taken is found again by its edges, so a state is compared with
    those that share one.
    """

    def __init__(self, how: Search, cells: dict | None = None):
        self.how = how
        self.sets: list[tuple[int, float]] = []
        self.by_edge: dict[str, list[int]] = {}
        self.cells: dict = dict(cells or {})

    def take(self, edges: dict[str, float], cell: tuple) -> None:
        for e in edges:
            self.by_edge.setdefault(e, []).append(len(self.sets))
        self.sets.append((len(edges), sum(edges.values())))
        self.cells[cell] = self.cells.get(cell, 0) + 1

    def full(self, cell: tuple) -> bool:
        return caps_cells(self.how) and self.cells.get(cell, 0) >= self.how.max_routes_per_grid

    def resembles(self, edges: dict[str, float]) -> bool:
        if all_alike(self.how):
            return bool(self.sets)
        common: dict[int, list[float]] = {}
        for e, n in edges.items():
            for k in self.by_edge.get(e, ()):
                common.setdefault(k, []).append(n)
        total, how = sum(edges.values()), self.how
        for k, both in common.items():
            size, length = self.sets[k]
            shared = sum(both)
            if len(both) / (size + len(edges) - len(both)) >= how.jaccard or shared / (total + length - shared) >= how.length_jaccard or shared / min(total, length) >= how.length_containment:
                return True
        return False


def caps_cells(how: Search) -> bool:
    return bool(how.route_diversity_grid_m and how.max_routes_per_grid)


def all_alike(how: Search) -> bool:
    """Whether even routes without a common edge count as near-duplicates."""
    return min(how.jaccard, how.length_jaccard, how.length_containment) <= 0


GROUP = ["budget_m", "mode"]


def landmark_picks(left: DataFrame, how: Search) -> DataFrame:
    """(uid, pick): the best state for every landmark, on steps if there is one, in the order of their choice.

    At most ``n`` states go to other landmarks in either pass, so the first
    2n of each landmark decide; these few rows meet in one task for a group.
    """
    n = len(how.landmarks)

    def best(column: str) -> DataFrame:
        place = W.partitionBy(*GROUP, "mark").orderBy("order")
        rows = left.select(*GROUP, "uid", "order", F.explode(column).alias("mark"))
        return rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= 2 * n).select(*GROUP, "uid", "order", F.lit(column).alias("kind"), "mark")

    rows = best("step_landmarks").union(best("landmarks"))
    rows = rows.withColumn("place", F.dense_rank().over(W.partitionBy(*GROUP).orderBy("order"))).drop("order")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        served, used = set(), []
        for kind in ("step_landmarks", "landmarks"):
            for _, g in group[group["kind"] == kind].sort_values(["place", "mark"]).groupby("place"):
                uid = int(g["uid"].iloc[0])
                fresh = [m for m in g["mark"] if m not in served]
                if uid not in used and fresh:
                    used.append(uid)
                    served.add(fresh[0])
        return pd.DataFrame({"uid": used, "pick": range(len(used))})

    return rows.groupBy(*GROUP).applyInPandas(run, "uid long, pick int")


def resolved(block: DataFrame, how: Search) -> DataFrame:
    """(uid) of the states in ``block`` that the greedy choice takes.

    ``block`` has a bounded number of rows for each budget and mode, none like
    a state taken before; ``used`` counts those in its cell, ``need`` how many
    more are wanted.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("place")
        cells = list(zip(g["cx"], g["cy"], strict=True))
        greedy, taken = Greedy(how, dict(zip(cells, g["used"], strict=True))), []
        for uid, ids, lengths, cell in zip(g["uid"], g["undirected_edge_ids"], g["lengths"], cells, strict=True):
            edges = dict(zip(ids, lengths, strict=True))
            if len(taken) < g["need"].iloc[0] and not greedy.full(cell) and not greedy.resembles(edges):
                greedy.take(edges, cell)
                taken.append(uid)
        return pd.DataFrame({"uid": taken}, dtype="int64")

    return block.groupBy(*GROUP).applyInPandas(run, "uid long")


def unlike(left: DataFrame, taken: DataFrame, how: Search) -> DataFrame:
    """``left`` without what resembles a state in ``taken``, found through an index of edges."""
    if all_alike(how):
        return left.join(taken.select(*GROUP).distinct(), GROUP, "left_anti")
    total = F.aggregate("lengths", F.lit(0.0), lambda a, x: a + x)
    each = lambda df: df.select(*GROUP, "uid", F.size("lengths").alias("n"), total.alias("total"), F.explode(F.arrays_zip("undirected_edge_ids", "lengths")).alias("e"))
    mine = each(left).select(*GROUP, "uid", "n", "total", F.col("e.undirected_edge_ids").alias("edge"), F.col("e.lengths").alias("length"))
    other = each(taken).select(*GROUP, F.col("uid").alias("like"), F.col("n").alias("m"), F.col("total").alias("whole"), F.col("e.undirected_edge_ids").alias("edge"))
    pairs = mine.join(other, [*GROUP, "edge"]).groupBy("uid", "like", "n", "m", "total", "whole").agg(F.count("*").alias("common"), F.sum("length").alias("shared"))
    near = near_duplicate(F.col("common"), F.col("n"), F.col("m"), F.col("shared"), F.col("total"), F.col("whole"), how.jaccard, how.length_jaccard, how.length_containment)
    return left.join(pairs.filter(near).select("uid").distinct(), "uid", "left_anti")


def select_diverse(states: DataFrame, how: Search, enough: int | None = None) -> DataFrame:
    """States of each budget and mode that the greedy selection keeps, with their ``place``; the first ``enough`` of them at least.

    A best state for every landmark comes first. Then rounds: of what is left,
    none like a state taken before, the best ``BLOCK`` states of each budget
    and mode are settled in order; what resembles the newly taken ones, or lies
    in a cell that is now full, leaves in a join over edges. Each round takes
    at least the best of what is left, so there are no more rounds than states
    taken. No task holds more than a block.
    """
    scratch = Scratch(states.sparkSession, "diverse")
    cell = route_cell(how.route_diversity_grid_m or 1.0)
    order = F.struct((-F.col("ascent_m")).alias("a"), (-F.col("density")).alias("g"), (-F.col("confidence")).alias("c"), F.col("distance_m").alias("d"), F.col("directed_edge_ids").alias("p"))
    slim = without_repeats(states, how).select(*GROUP, order.alias("order"), "undirected_edge_ids", "lengths", "landmarks", "step_landmarks", cell["cx"].alias("cx"), cell["cy"].alias("cy"))
    left = scratch.keep(slim.withColumn("uid", F.monotonically_increasing_id()), "left")
    none = left.limit(0).withColumn("pick", F.lit(None).cast("int"))
    new = scratch.keep(left.join(landmark_picks(left, how), "uid") if how.landmarks else none, "picks")
    taken = [new]
    while True:
        every = G.union_layers(taken)
        have = every.groupBy(*GROUP).agg(F.count("*").alias("have"))
        left = unlike(left.join(new.select("uid"), "uid", "left_anti"), new, how)
        left = left.join(have, GROUP, "left").withColumn("need", F.lit(MANY if enough is None else enough) - F.coalesce("have", F.lit(0))).filter("need > 0").drop("have")
        used = every.groupBy(*GROUP, "cx", "cy").agg(F.count("*").alias("used"))
        left = left.join(used, [*GROUP, "cx", "cy"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
        if caps_cells(how):
            left = left.filter(F.col("used") < how.max_routes_per_grid)
        left = scratch.keep(left, "left")
        if left.limit(1).count() == 0:
            break
        best = left.withColumn("place", F.row_number().over(W.partitionBy(*GROUP).orderBy("order"))).filter(F.col("place") <= BLOCK)
        best = scratch.keep(best, "block")
        new = scratch.keep(best.drop("place", "need", "used").join(resolved(best, how), "uid").withColumn("pick", F.lit(None).cast("int")), "taken")
        taken.append(new)
        left = left.join(best.select("uid"), "uid", "left_anti").drop("need", "used")
    chosen = G.union_layers(taken).withColumn("place", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.asc_nulls_last("pick"), "order")) - 1)
    return states.join(chosen.select(*GROUP, F.col("order.p").alias("directed_edge_ids"), "place"), [*GROUP, "directed_edge_ids"])


def emit(kept: DataFrame, most: int, budgets_m: list[float] | None = None) -> DataFrame:
    """The first ``most`` of each budget and mode whose edge set no smaller budget of the mode has emitted, with ``rank``.

    Budgets follow each other, as what one emits is closed to the next.
    ``place`` is anything that sorts. A number of ranks that no task should
    hold is given over all tasks; then rows may be as many as states, and are
    written once, in the order of their ranks, and not before: ``kept`` is
    worked out for each budget. Of one edge set only the best row is shuffled.
    Without directed_edge_ids, by which more columns are found again, rows
    have their ``edges`` in order.
    """
    scratch = Scratch(kept.sparkSession, "emit")
    key, many = ["mode", "edges"], most > BLOCK
    slim = kept.select(*[c for c in ("budget_m", "mode", "place", "directed_edge_ids") if c in kept.columns], F.array_sort("undirected_edge_ids").alias("edges"))
    if not many:
        slim = scratch.keep(slim, "kept")
    if budgets_m is None:
        budgets_m = [r[0] for r in slim.select("budget_m").distinct().collect()]
    out: list[DataFrame] = []
    for budget in sorted(budgets_m):
        # before the other budgets' rows go, so that Spark can limit rows to one an edge set before the shuffle, which serves both
        mine = slim.filter(F.col("budget_m") == budget).withColumn("again", F.row_number().over(W.partitionBy(*key).orderBy("place"))).filter("again = 1").drop("again")
        for before in out:
            mine = mine.join(before.select(*key), key, "left_anti")
        if many:
            out.append(numbered(mine, "mode", ["place"], "rank").filter(F.col("rank") <= most))
        else:
            out.append(scratch.keep(mine.withColumn("rank", F.row_number().over(W.partitionBy("mode").orderBy("place"))).filter(F.col("rank") <= most), "emitted"))
    if not out:
        return kept.withColumn("rank", F.lit(0)).limit(0)
    every = G.union_layers(out)
    if "directed_edge_ids" not in kept.columns:
        return every
    return kept.join(every.select(*GROUP, "directed_edge_ids", "rank"), [*GROUP, "directed_edge_ids"])


def route_id(mode: Column, budget_m: Column, rank: Column) -> Column:
    return F.format_string("%s_%05dm_%03d", mode, F.rint(budget_m).cast("int"), rank)


def routes_of(emitted: DataFrame) -> DataFrame:
    """Routes, most ascent first."""
    out = emitted.select(
        route_id(F.col("mode"), F.col("budget_m"), F.col("rank")).alias("route_id"),
        (F.col("budget_m") / 1000).alias("budget_km"),
        "mode",
        "rank",
        "distance_m",
        "ascent_m",
        "descent_m",
        F.col("density").alias("gain_density_m_per_km"),
        F.col("confidence").alias("source_confidence"),
        "directed_edge_ids",
        "undirected_edge_ids",
        "node_ids",
        F.array().cast("array<string>").alias("warnings"),
    )
    return out.orderBy(F.desc("ascent_m"), F.desc("gain_density_m_per_km"), F.desc("source_confidence"), "route_id")


def search_routes(directed: DataFrame, nodes: DataFrame, budgets_km: list[float], modes: list[str], how: Search = Search()) -> DataFrame:
    """Routes over ``directed`` edges; ``nodes`` has node_id, x and y."""
    scratch = Scratch(directed.sparkSession, "search")
    found = scratch.keep(candidates(directed, nodes, budgets_km, modes, how, scratch).filter(F.col("ascent_m") >= how.min_ascent_m), "accepted")
    enough = how.max_routes_per_budget * len({float(b) for b in budgets_km}) + 2 * len(how.landmarks)
    return routes_of(emit(select_diverse(found, how, enough), how.max_routes_per_budget))
