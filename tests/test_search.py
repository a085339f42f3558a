"""Searches over small graphs, and against a plain walk over random ones."""

import random

import pytest

from ridgeweave.operators import graph, search
from ridgeweave.scratch import Scratch

EDGE = "edge_id string, u string, v string, length_m double, ascent_fwd_m double, descent_fwd_m double, ascent_rev_m double, descent_rev_m double, source_confidence double, name string, highway string"


def build(spark, nodes, edges):
    """Edges as (id, u, v, length, ascent, descent[, name, highway]); the way back swaps the last two measures."""
    full = [(e[0], e[1], e[2], float(e[3]), float(e[4]), float(e[5]), float(e[5]), float(e[4]), 1.0, *(list(e[6:]) + [None, None])[:2]) for e in edges]
    return graph.directed_edges(spark.createDataFrame(full, EDGE)), spark.createDataFrame([(k, float(x), float(y)) for k, x, y in nodes], "node_id string, x double, y double")


DIAMOND = [("a", 0, 0), ("b", 100, 0), ("c", 200, 0), ("d", 100, 100)], [("ab", "a", "b", 100, 20, 1), ("bc", "b", "c", 100, 5, 2), ("bd", "b", "d", 100, 30, 1), ("dc", "d", "c", 141, 25, 3), ("ca", "c", "a", 200, 1, 5)]


def test_both_orientations(spark, rows):
    d, _ = build(spark, [("a", 0, 0), ("b", 1, 0)], [("e1", "a", "b", 10, 12, 3)])
    assert rows(d, "directed_edge_id", "src", "dst", "ascent_m") == [("e1:fwd", "a", "b", 12.0), ("e1:rev", "b", "a", 3.0)]


def test_routes_keep_the_budget_and_repeat_no_edge(spark):
    found = search.search_routes(*build(spark, *DIAMOND), [0.35], ["point_to_point"]).collect()
    assert found
    assert all(r.distance_m <= 350 and len(set(r.undirected_edge_ids)) == len(r.undirected_edge_ids) for r in found)
    assert [r.ascent_m for r in found] == sorted((r.ascent_m for r in found), reverse=True)


def test_loops_end_where_they_start(spark):
    found = search.search_routes(*build(spark, *DIAMOND), [0.5], ["loop"]).collect()
    assert found and all(r.node_ids[0] == r.node_ids[-1] for r in found)


def test_one_start_node(spark):
    found = search.search_routes(*build(spark, *DIAMOND), [0.25], ["point_to_point"], search.Search(max_start_nodes=1)).collect()
    assert {r.node_ids[0] for r in found} == {"b"}


CHAIN = [("a", 0, 0), ("b", 100, 0), ("c", 200, 0), ("d", 300, 0)]


def test_prefixes_are_near_duplicates(spark):
    g = build(spark, CHAIN, [("ab", "a", "b", 100, 30, 0), ("bc", "b", "c", 100, 10, 0), ("cd", "c", "d", 100, 10, 0)])
    found = search.search_routes(*g, [0.35], ["point_to_point"], search.Search(max_start_nodes=1, length_containment=0.95)).collect()
    assert [r.undirected_edge_ids for r in found] == [["ab", "bc", "cd"]]


def test_cells_bring_up_far_routes(spark):
    g = build(spark, [*CHAIN, ("x", 5000, 0), ("y", 5100, 0)], [("ab", "a", "b", 100, 50, 0), ("bc", "b", "c", 100, 45, 0), ("cd", "c", "d", 100, 40, 0), ("xy", "x", "y", 100, 5, 0)])
    found = search.search_routes(*g, [0.35], ["point_to_point"], search.Search(route_diversity_grid_m=1000, max_routes_per_grid=1)).collect()
    assert any(r.node_ids[0] == "x" for r in found)


def test_landmark_prefers_steps(spark):
    nodes = [("a", 0, 0), ("b", 100, 0), ("c", 0, 100), ("d", 100, 100)]
    g = build(spark, nodes, [("path_summit", "a", "b", 100, 20, 0, "Summit Path", "footway"), ("steps_summit", "c", "d", 100, 5, 0, "Summit Path", "steps")])
    found = search.search_routes(*g, [0.2], ["point_to_point"], search.Search(landmarks=["Summit Path"], max_routes_per_budget=1)).collect()
    assert "steps_summit" in found[0].undirected_edge_ids


def test_landmark_start_is_never_capped(spark):
    g = build(spark, [*CHAIN, ("x", 5000, 0), ("y", 5100, 0)], [("ab", "a", "b", 100, 50, 0, "Ridge", None), ("xy", "x", "y", 100, 5, 0, "Summit Path", None)])
    found = search.search_routes(*g, [0.2], ["point_to_point"], search.Search(max_start_nodes=1, landmarks=["Summit Path"])).collect()
    assert any("xy" in r.undirected_edge_ids for r in found)


def test_no_edge_set_twice_across_budgets(spark):
    g = build(spark, [("a", 0, 0), ("b", 100, 0), ("e", 4000, 0), ("f", 4100, 0), ("g", 4200, 0)], [("ab", "a", "b", 100, 40, 0), ("ef", "e", "f", 100, 20, 0), ("fg", "f", "g", 100, 20, 0)])
    found = search.search_routes(*g, [0.15, 0.25], ["point_to_point"]).collect()
    keys = [(r.mode, frozenset(r.undirected_edge_ids)) for r in found]
    assert len(keys) == len(set(keys))
    assert any(set(r.undirected_edge_ids) == {"ef", "fg"} and r.budget_km == 0.25 for r in found)


def test_least_ascent(spark):
    g = build(spark, [("a", 0, 0), ("b", 100, 0), ("x", 5000, 0), ("y", 5100, 0)], [("ab", "a", "b", 100, 29, 0), ("xy", "x", "y", 100, 31, 0)])
    found = search.search_routes(*g, [0.15], ["point_to_point"], search.Search(min_ascent_m=30)).collect()
    assert [r.undirected_edge_ids for r in found] == [["xy"]]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        search.search_routes(*build(spark, *DIAMOND), [0.1], ["there_and_back"])


def plain_search(nodes, edges, budget, mode, how):
    """The whole search as a loop over states."""
    place, out = {k: (x, y) for k, x, y in nodes}, {}
    for e in edges:
        for d, u, v, a in ((f"{e[0]}:fwd", e[1], e[2], e[4]), (f"{e[0]}:rev", e[2], e[1], e[5])):
            out.setdefault(u, []).append((d, e[0], v, float(e[3]), float(a)))

    def rank(s):
        return -s["a"], -(s["a"] / (s["d"] / 1000) if s["d"] > 0 else 0), s["d"], s["p"]

    def cell(s, grid):
        n = len(s["n"])
        return tuple(sum(place[k][c] for k in s["n"]) / n // grid for c in (0, 1))

    frontier = [{"n": (k,), "p": (), "e": (), "d": 0.0, "a": 0.0} for k in out]
    done = []
    while frontier:
        grown = [{"n": (*s["n"], v), "p": (*s["p"], d), "e": (*s["e"], e), "d": s["d"] + n, "a": s["a"] + a} for s in frontier for d, e, v, n, a in out.get(s["n"][-1], []) if e not in s["e"] and s["d"] + n <= budget + 1e-9]
        done += [s for s in grown if (s["n"][0] == s["n"][-1] and len(s["e"]) > 1 if mode == "loop" else s["n"][0] != s["n"][-1])]
        frontier, counts = [], {}
        for s in sorted(grown, key=rank):
            c = cell(s, how.frontier_grid_m)
            if counts.get(c, 0) < how.max_frontier_states_per_grid and len(frontier) < how.beam_width:
                counts[c] = counts.get(c, 0) + 1
                frontier.append(s)
    size = {e[0]: float(e[3]) for e in edges}
    kept, counts = [], {}
    for s in sorted(done, key=rank):
        c = cell(s, how.route_diversity_grid_m)
        mine = set(s["e"])

        def near(k):
            both, any_of = mine & set(k["e"]), mine | set(k["e"])
            w = lambda x: sum(size[i] for i in x)
            return len(both) / len(any_of) >= how.jaccard or w(both) / w(any_of) >= how.length_jaccard or w(both) / min(w(mine), w(k["e"])) >= how.length_containment

        if counts.get(c, 0) < how.max_routes_per_grid and not any(near(k) for k in kept):
            kept.append(s)
            counts[c] = counts.get(c, 0) + 1
    seen, named = set(), []
    for s in kept:
        if frozenset(s["e"]) not in seen and len(named) < how.max_routes_per_budget:
            seen.add(frozenset(s["e"]))
            named.append(s["p"])
    return named


@pytest.mark.parametrize("seed,mode,block", [(1, "loop", 2048), (2, "point_to_point", 2048), (3, "point_to_point", 1), (4, "loop", 3)])
def test_against_a_plain_walk(spark, monkeypatch, seed, mode, block):
    """Blocks of a few states settle the same routes in more rounds."""
    monkeypatch.setattr(search, "BLOCK", block)
    r = random.Random(seed)
    nodes = [(f"n{k}", r.randrange(0, 4000), r.randrange(0, 4000)) for k in range(9)]
    edges = [(f"e{k:02d}", *[n[0] for n in r.sample(nodes, 2)], r.choice([50, 100, 150]), r.randrange(0, 9), r.randrange(0, 9)) for k in range(16)]
    how = search.Search(beam_width=12, max_start_nodes=None, start_node_grid_m=None, frontier_grid_m=1000, max_frontier_states_per_grid=3, route_diversity_grid_m=1000, max_routes_per_grid=2, max_routes_per_budget=8)
    found = search.search_routes(*build(spark, nodes, edges), [0.4], [mode], how).collect()
    assert [tuple(x.directed_edge_ids) for x in sorted(found, key=lambda x: x.rank)] == plain_search(nodes, edges, 400.0, mode, how)


def chosen_in_order(states, how):
    """The whole choice for one budget and mode as a loop over ranked states of (path, edges, ascent, landmarks on steps, landmarks, cell)."""
    near = lambda a, b: len(a & b) / len(a | b) >= how.jaccard or len(a & b) / len(a | b) >= how.length_jaccard or len(a & b) / min(len(a), len(b)) >= how.length_containment
    kept, served, cells = [], set(), {}
    for which in (3, 4):
        for s in states:
            fresh = [m for m in sorted(s[which]) if m not in served]
            if s not in kept and fresh:
                kept.append(s)
                served.add(fresh[0])
                cells[s[5]] = cells.get(s[5], 0) + 1
    for s in states:
        if s not in kept and cells.get(s[5], 0) < how.max_routes_per_grid and not any(near(set(s[1]), set(k[1])) for k in kept):
            kept.append(s)
            cells[s[5]] = cells.get(s[5], 0) + 1
    return [s[0] for s in kept]


@pytest.mark.parametrize("seed,block", [(1, 2), (2, 2048)])
def test_landmarks_cells_and_likeness_decide_in_order(spark, monkeypatch, seed, block):
    monkeypatch.setattr(search, "BLOCK", block)
    r = random.Random(seed)
    how = search.Search(route_diversity_grid_m=100, max_routes_per_grid=3, landmarks=["a", "b", "c"], jaccard=0.6, length_jaccard=0.7, length_containment=0.8)
    states = []
    for k in range(60):
        edges = r.sample([f"e{i}" for i in range(14)], r.randint(2, 6))
        marks = [m for m in range(3) if r.random() < 0.06]
        states.append(((f"p{k:03d}",), edges, float(r.randrange(12)), [m for m in marks if r.random() < 0.5], marks, r.randrange(12)))
    states.sort(key=lambda s: (-s[2], s[0]))
    rows = [(1.0, "loop", list(p), e, [1.0] * len(e), a, a, 1.0, 1.0, on, m, 100.0 * c + 50, 0.0, 1) for p, e, a, on, m, c in states]
    df = spark.createDataFrame(rows, "budget_m double, mode string, directed_edge_ids array<string>, undirected_edge_ids array<string>, lengths array<double>, ascent_m double, density double, confidence double, distance_m double, step_landmarks array<int>, landmarks array<int>, sum_x double, sum_y double, placed int")
    got = search.select_diverse(df, how).orderBy("place").collect()
    assert [tuple(x.directed_edge_ids) for x in got] == chosen_in_order(states, how)
    few = search.select_diverse(df, how, 5).orderBy("place").collect()
    assert [tuple(x.directed_edge_ids) for x in few][:5] == chosen_in_order(states, how)[:5]


def test_first_steps_are_those_of_all_seeds_and_nothing_large_is_in_one_task(spark, rows):
    from pyspark.sql import functions as F

    from ridgeweave.operators import graph, paths, search

    nodes = spark.createDataFrame([(f"n{k}", float(k), float(-k)) for k in range(6)], "node_id string, x double, y double")
    place = lambda k: [float(k), float(-k)] if k < 6 else [None, None]
    edges = [(f"e{i}", f"n{i % 7}", f"n{i * 5 % 7}", 10.0 * (i % 4), 1.0 * i, 2.0, 3.0, 4.0, 0.5, *place(i % 7), *place(i * 5 % 7)) for i in range(30)]
    have = spark.createDataFrame(edges, "edge_id string, u string, v string, length_m double, ascent_fwd_m double, descent_fwd_m double, ascent_rev_m double, descent_rev_m double, source_confidence double, ux double, uy double, vx double, vy double")
    plain = search.steps_of(graph.directed_edges(have.drop("ux", "uy", "vx", "vy")), nodes, [])
    placed = search.steps_of(graph.directed_edges(have), nodes, [])
    one, two = search.expand(search.seeds(nodes.select("node_id"), nodes, [10.0, 20.0]), plain, 9), search.first_steps(placed, [10.0, 20.0])
    assert one.columns == two.columns and rows(one) == rows(two)
    assert rows(search.expand(one, plain, 9)) == rows(search.expand(two, placed, 9, 0.0))
    slim = two.select("budget_m", "start_node", "current_node", "distance_m", "undirected_edge_ids")
    assert rows(search.expand(slim, placed, 9)) == rows(search.expand(one, plain, 9), *slim.columns)
    many = spark.range(200).select((F.col("id") * 37 % 200).alias("at"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    expected = {(r["at"], r["g"]): 0 for r in many.collect()}
    for g in (None, 1, 2):
        for n, key in enumerate(sorted(k for k in expected if k[1] == g), 1):
            expected[key] = n
    out = paths.numbered(many, "g", ["at"], "n")
    assert {(r["at"], r["g"]): r["n"] for r in out.collect()} == expected


def test_states_meet_their_limit_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    from ridgeweave.operators import search

    none = F.array().cast("array<int>")
    numbers = [F.col("id").cast("double").alias(k) for k in ("distance_m", "ascent_m", "confidence_sum", "sum_x", "sum_y")]
    ids = [F.array(F.col("id").cast("string")).alias(k) for k in ("directed_edge_ids", "undirected_edge_ids")]
    states = spark.range(100).select(F.lit(9.0).alias("budget_m"), *numbers, *ids, F.lit(1).alias("placed"), F.when(F.col("id") < 10, F.array(F.lit(1))).otherwise(none).alias("step_landmarks"))
    out = search.prune(states, search.Search(beam_width=50, frontier_grid_m=1000.0, max_frontier_states_per_grid=2))
    assert sorted(r.distance_m for r in out.collect()) == [*map(float, range(10)), 98.0, 99.0]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") == 1


def test_tasks_that_extend_many_steps_stay_small(spark, rows, monkeypatch):
    """Spark would merge them by what they read, a ninth of what they make: 60 copies of sf0.1 spilled in nine tasks."""
    from ridgeweave.plans import catalog

    have = spark.createDataFrame([(f"e{i}", f"n{i % 7}", f"n{i * 5 % 7}", 10.0 * (i % 4), *[1.0] * 5, *[float(k % 7) for k in (i, i, i * 5, i * 5)]) for i in range(30)], "edge_id string, u string, v string, length_m double, ascent_fwd_m double, descent_fwd_m double, ascent_rev_m double, descent_rev_m double, source_confidence double, ux double, uy double, vx double, vy double")
    steps = search.steps_of(graph.directed_edges(have), None, [])
    state = search.first_steps(steps, [30.0])
    few = search.expand_many(state, steps, steps.count(), 9, 10.0)
    assert "REPARTITION_BY_NUM" not in few._jdf.queryExecution().toString()
    monkeypatch.setattr(search, "STEPS", 5)
    many = search.expand_many(state, steps, steps.count(), 9, 10.0)
    assert many.rdd.getNumPartitions() == 12
    assert rows(many) == rows(few) == rows(search.expand(state, steps, 9, 10.0)) and rows(few)

    folder = "/root/testdata/sf0.001"
    for run in (catalog.q_beam_level2, catalog.q_expand_level3):
        monkeypatch.setattr(search, "STEPS", 50)
        apart = run(spark, folder)
        assert "REPARTITION_BY_NUM" in apart._jdf.queryExecution().toString()
        monkeypatch.setattr(search, "STEPS", 100_000)
        assert rows(apart) == rows(run(spark, folder))


def test_many_emitted_rows_are_written_once(spark, monkeypatch):
    """In the order of their ranks: not before their edge sets are told apart, and not again with ranks."""
    wrote, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, label, *more: wrote.append(label) or write(self, df, label, *more))
    r = random.Random(3)
    states = [(b, m, r.randint(0, 9), r.sample("abcdef", r.randint(1, 3))) for b in (10.0, 20.0, 40.0) for m in search.MODES for _ in range(40)]
    states = [(b, m, (-a, f"{k:03d}"), [f"{e}:fwd" for e in edges], edges) for k, (b, m, a, edges) in enumerate(states)]
    kept = spark.createDataFrame(states, "budget_m double, mode string, place struct<a:int,path:string>, directed_edge_ids array<string>, undirected_edge_ids array<string>")
    expected, closed = {}, set()
    for b in (10.0, 20.0, 40.0):
        for m in search.MODES:
            best = {}
            for _, _, place, _, edges in sorted((s for s in states if s[:2] == (b, m)), key=lambda s: s[2]):
                if (m, *sorted(edges)) not in closed:
                    best.setdefault((m, *sorted(edges)), place)
            closed |= set(best)
            expected |= {(b, m, tuple(place)): (n, key[1:]) for n, (key, place) in enumerate(sorted(best.items(), key=lambda x: x[1]), 1)}
    for budgets in (None, [10.0, 20.0, 40.0]):
        out = search.emit(kept.drop("directed_edge_ids"), 1 << 30, budgets)
        assert {(x.budget_m, x.mode, tuple(x.place)): (x["rank"], tuple(x.edges)) for x in out.collect()} == expected
        assert wrote == ["ranged"] * 3
        wrote.clear()
    whole = search.emit(kept, 1 << 30).collect()
    assert {(x.budget_m, x.mode, tuple(x.place)): (x["rank"], tuple(sorted(x.undirected_edge_ids))) for x in whole if (x.budget_m, x.mode, tuple(x.place)) in expected} == expected
    few = search.emit(kept, 1000).collect()
    assert sorted(map(repr, few)) == sorted(map(repr, whole))
