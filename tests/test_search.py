"""Search with ranks and predecessor tables, pruning, and reachability over chains, against plain Python."""

import hashlib
import random
from collections import deque

from pyspark.sql import functions as F

from tests.test_graph import graph, model, pairs
from tracewarden.operators import reach, search, traverse
from tracewarden.plans import adapters
from tracewarden.sources.shared import written


def random_graph(rng, size, edges, kinds="SSKKZFF"):
    nodes = {f"n{i:02d}": (rng.choice(kinds), {"params": rng.choice([[], ["x"], ["y"]]), "vars": rng.choice([[], ["x"], ["x", "y"]])}) for i in range(size)}
    found = {(a, b, k): (a, b, k, rng.choice([["x"], ["y"], []])) for a, b, k in ((rng.choice([*nodes]), rng.choice([*nodes]), rng.choice(["call", "dataflow", "dataflow"])) for _ in range(edges))}
    return nodes, list(found.values())


def test_pruned_renumbered_and_by_single_levels(spark):
    """The same paths with a level a job, with ranks that must be numbered afresh, and with edges towards sinks only."""
    nodes, edges = random_graph(random.Random(21), 14, 40)
    want = model(nodes, edges, 7)
    n, e = graph(spark, nodes, edges)
    assert len(want) > 8
    for options in ({"first": 1, "chain": 1, "space": 1 << 12}, {"many": 0, "prune": True}):
        assert pairs(traverse.find_all_paths(n, e, max_nodes=7, **options)) == want, options


def test_pruning_builds_fewer_states(spark):
    """A long dead end and a sink that is too deep: no state of either is built."""
    nodes = {"s": ("S", {}), "k": ("K", {}), **{f"d{i}": ("F", {}) for i in range(8)}, **{f"f{i}": ("F", {}) for i in range(8)}, "far": ("K", {})}
    edges = [("s", "k"), ("s", "d0"), *[(f"d{i}", f"d{i + 1}") for i in range(7)], ("s", "f0"), *[(f"f{i}", f"f{i + 1}") for i in range(7)], ("f7", "far")]
    n, e = graph(spark, nodes, edges)
    counts = {}
    for prune in (False, True):
        found = traverse.taint_search(n, e, max_nodes=6, prune=prune, first=1, many=0)
        counts[prune] = found.live
        assert [(r.node, r.path) for r in found.with_paths().collect()] == [("k", ["s", "k"])]
    assert counts == {False: [2, 2, 2, 2, 2], True: [0]}


def test_places_in_parts(spark):
    """Places of a node's edges, numbered at once and in parts: the order of ids, edges with equal ids once."""
    rows = [(f"n{i}", ("F", {})) for i in range(60)]
    n, e = graph(spark, dict(rows), [("n0", f"n{i}") for i in range(1, 60)] + [("n1", "n2"), ("n1", "n3"), ("n1", "gone")])
    e = e.unionByName(e.limit(20))
    tables = [sorted(map(tuple, search.adjacency(n, e, hub).table.select("src", "dst", "place", "edges").collect())) for hub in (1 << 40, -1)]
    assert tables[0] == tables[1] and len(tables[0]) == 61
    ids = {(r.src, r.dst): r.id for r in e.collect()}
    ordered = sorted((d for s, d, _, _ in tables[0] if s == "n0"), key=lambda d: ids["n0", d])
    assert [d for _, d in sorted((p, d) for s, d, p, _ in tables[0] if s == "n0")] == ordered


def test_level_has_no_sort_aggregate(spark):
    n, e = graph(spark, {"s": ("S", {}), "k": ("K", {})}, [("s", "k")])
    around = search.adjacency(n, e)
    state = spark.createDataFrame([], "source_id string, node string, depth int, rank long, room long, base long, via array<string>, vars array<string>, cleared array<string>, sanitized boolean, node_type string, node_class string, hit boolean")
    plan = search.levels(state, around, 1, 3, search.Rule(gated=True, ends=True, most=20))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "WindowGroupLimit" in plan


def test_sound_keeps_a_clean_path(spark):
    """Two ways of one length to the same node, the first one sanitized: only ``sound`` finds the sink behind."""
    edge = lambda x, y: hashlib.sha256(f"{x}→{y}[dataflow]".encode()).hexdigest()[:16]
    dirty, clean = sorted("ab", key=lambda x: edge("s", x))
    nodes = {"s": ("S", {}), dirty: ("Z", {}), clean: ("F", {}), "m": ("F", {}), "k": ("K", {"cls": "sqli"})}
    n, e = graph(spark, nodes, [("s", "a"), ("s", "b"), ("a", "m"), ("b", "m"), ("m", "k")])
    assert pairs(traverse.find_all_paths(n, e)) == []
    assert pairs(traverse.find_all_paths(n, e, sound=True)) == [("s", "k", ("s", clean, "m", "k"))]


def reach_brute(nodes, edges, start):
    out = {}
    for a, b, *_ in edges:
        if a in nodes and b in nodes:
            out.setdefault(a, []).append(b)
    depth, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in out.get(x, []):
            if y not in depth:
                depth[y] = depth[x] + 1
                queue.append(y)
    return depth


def test_reach_over_chains(spark):
    """Random graphs joined with long chains, a ring, a ring that a chain leads into, self loops and unknown nodes."""
    rng = random.Random(5)
    nodes, edges = random_graph(rng, 12, 16)
    for name, size in (("c", 21), ("r", 9), ("q", 5)):
        nodes |= {f"{name}{i:02d}": (rng.choice("FK"), {}) for i in range(size)}
        edges += [(f"{name}{i:02d}", f"{name}{i + 1:02d}", "dataflow", []) for i in range(size - 1)]
    edges += [("r08", "r00", "dataflow", []), ("q04", "q00", "dataflow", []), ("c20", "q02", "dataflow", []), ("n00", "c00", "dataflow", []), ("n01", "n01", "call", []), ("n02", "gone", "call", []), ("gone", "n03", "call", [])]
    n, e = graph(spark, nodes, edges)
    starts = spark.createDataFrame([(i,) for i in [*nodes, "unknown"]], "source_id string")
    want = {(a, b): d for a in nodes for b, d in reach_brute(nodes, edges, a).items()}
    assert {(r.source_id, r.id): r.depth for r in traverse.reached(n, e, starts).collect()} == want
    counts = {r.source_id: (r.reaches, r.sinks) for r in traverse.reachable_counts(n, e, starts).collect()}
    assert counts == {a: (sum(x == a and y != a for x, y in want), sum(x == a and y != a and nodes[y][0] == "K" for x, y in want)) for a in nodes}
    back = {(r.source_id, r.id): r.depth for r in traverse.reached(n, e, starts.filter("source_id in ('q02', 'r03', 'n05')"), forward=False).collect()}
    assert back == {(a, b): d for a in ("q02", "r03", "n05") for b, d in reach_brute(nodes, [(y, x) for x, y, *_ in edges], a).items()}
    estimates = {r.id: r.reaches for r in traverse.reachable_estimates(n, e).collect()}
    assert all(abs(estimates[a] - counts[a][0]) <= max(1, 0.1 * counts[a][0]) for a in nodes)


def test_estimates_of_large_sets(spark):
    """A tree of many leaves behind a chain: within five standard errors of the sketch; exact within the chain."""
    ids = spark.range(30_000).select(F.concat(F.lit("x"), "id").alias("id"))
    nodes = ids.select("id", F.lit("FunctionNode").alias("type"))
    edges = spark.range(1, 30_000).select(F.concat(F.lit("x"), F.when(F.col("id") <= 10, F.col("id") - 1).otherwise(F.floor((F.col("id") - 10) / 40) + 10).cast("string")).alias("src"), F.concat(F.lit("x"), "id").alias("dst")).filter("src <> dst")
    edges = edges.unionByName(spark.createDataFrame([("x10", "x11")], "src string, dst string"))
    exact = {r.source_id: r.reaches for r in traverse.reachable_counts(nodes, edges, ids.filter("id in ('x0', 'x5', 'x10', 'x12', 'x29999')").withColumnRenamed("id", "source_id")).collect()}
    found = {r.id: r.reaches for r in traverse.reachable_estimates(nodes, edges).filter(F.col("id").isin(*exact)).collect()}
    assert exact["x0"] > 20_000 and exact["x29999"] == 0
    for i, n in exact.items():
        assert abs(found[i] - n) <= 5 * 1.04 / 2 ** (reach.PRECISION / 2) * n + 1
    assert found["x0"] - found["x5"] == 5


def test_large_edges(spark):
    """Edges that don't fit into every task: states sent to them or dealt with them, over graphs whose states meet and over trees with
    rings, where they don't; the rows are those of a search over small edges."""
    rng = random.Random(8)
    met = random_graph(rng, 14, 40)
    nodes = {f"t{i:02d}": (rng.choice("SSKKZFF"), {"params": rng.choice([[], ["x"]]), "vars": rng.choice([["x"], ["x", "y"]])}) for i in range(40)}
    tree = [(f"t{rng.randrange(max(0, i - 6), i):02d}", f"t{i:02d}", rng.choice(["call", "dataflow", "dataflow"]), rng.choice([["x"], ["y"]])) for i in range(1, 40) if i % 13]
    tree += [("t12", "t00", "dataflow", ["x"]), ("t38", "t26", "dataflow", ["x"])]
    for each, tried in ((met, ({"few": 6, "first": 2},)), ((nodes, tree), ({"few": 1000, "first": 2}, {"few": 0, "first": 2}))):
        n, e = (written(t, "graph") for t in graph(spark, *each))
        assert search.adjacency(n, e).apart == (each is not met)
        plain = pairs(traverse.paths_to_sink(n, e.unionByName(graph(spark, {}, [])[1]), "", max_nodes=7))
        aware = pairs(traverse.find_all_paths(n, e.unionByName(graph(spark, {}, [])[1]), max_nodes=7, class_aware=True))
        assert plain and aware
        for options in tried:
            options |= {"small": -1}
            assert pairs(traverse.find_all_paths(n, e, max_nodes=7, **options)) == model(*each, 7), options
            assert pairs(traverse.find_all_paths(n, e, max_nodes=7, class_aware=True, **options)) == aware, options
            assert pairs(traverse.paths_to_sink(n, e, "", max_nodes=7, **options)) == plain, options


def test_no_labels_where_states_cannot_outgrow_edges(spark, monkeypatch):
    """A large chain is searched without labels and without sanitized states; a graph whose states outgrow its edges gets labels on the way."""
    monkeypatch.setattr(traverse, "MANY", 0)
    asked = []
    monkeypatch.setattr(search, "sink_distance", lambda *a, f=search.sink_distance: asked.append(a[2]) or f(*a))
    chain = {f"c{i}": ("SFFZFFFK"[i % 8], {}) for i in range(16)}
    n, e = (written(t, "graph") for t in graph(spark, chain, [(f"c{i}", f"c{i + 1}") for i in range(15)]))
    assert traverse.taint_search(n, e, first=2).live == [2, 0] and not asked
    wide = {**{f"s{i}": ("S", {}) for i in range(6)}, "m": ("F", {}), **{f"l{i}": ("F", {}) for i in range(3)}, "k": ("K", {})}
    edges = [*[(f"s{i}", "m") for i in range(6)], *[("m", f"l{i}") for i in range(3)], ("l0", "k"), ("l1", "l2")]
    n, e = graph(spark, wide, edges)
    found = traverse.taint_search(n, e, max_nodes=5, first=2, many=0)
    assert asked == [2] and found.live == [18, 0]
    assert pairs(traverse.find_all_paths(n, e, max_nodes=5, first=2, many=0)) == model(wide, [(*x, "dataflow", []) for x in edges], 5)


def test_order_graph_moves_less(spark):
    """The orders graph's edges need no exchange, and states list no nodes where no path is asked for."""
    plan = adapters.order_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    n, e = graph(spark, {"s": ("S", {}), "m": ("F", {}), "k": ("K", {})}, [("s", "m"), ("m", "k"), ("m", "k")])
    assert [(r.node, r.via) for r in traverse.taint_search(n, e, listed=False).rows.collect()] == [("k", [])]


def test_hits_of_one_depth_are_not_compared(spark):
    """A sink that is reached at one depth only needs no comparison; one at two depths does, and the shorter path counts."""
    n, e = graph(spark, {"s": ("S", {}), "m": ("F", {}), "o": ("F", {}), "k": ("K", {})}, [("s", "m"), ("s", "o"), ("m", "k"), ("o", "k")])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    first = traverse.trace_first(n, e)
    assert "Window" not in plan(first) and [(r.source_id, r.sink_id, len(r.path)) for r in first.collect()] == [("s", "k", 3)]
    more = e.unionByName(graph(spark, {}, [("s", "k")])[1])
    assert [r.path for r in traverse.trace_first(n, more).collect()] == [["s", "k"]]
    assert "Window" in plan(traverse.trace_first(n, more)) and "Window" in plan(traverse.trace_first(n, e, class_aware=True))


def test_large_edges_are_dealt_once(spark, monkeypatch):
    """Large edges lie in buckets by their source: a level moves states only, and finds the same."""
    monkeypatch.setattr(search, "SMALL", -1)
    nodes, edges = random_graph(random.Random(8), 14, 40)
    n, e = (written(t, "graph") for t in graph(spark, nodes, edges))
    around = search.adjacency(n, e)
    state = spark.createDataFrame([], "source_id string, node string, depth int, rank long, room long, base long, via array<string>, vars array<string>, cleared array<string>, sanitized boolean, node_type string, node_class string, hit boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = search.levels(state, around, 1, 2, search.Rule(gated=True, ends=True, most=20))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning(src" not in plan
        for flags in ({}, {"few": 0, "first": 1}):
            assert pairs(traverse.find_all_paths(n, e, max_nodes=7, small=-1, **flags)) == model(nodes, edges, 7)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not any(t.name.startswith("adjacency") for t in spark.catalog.listTables())


def test_reach_looks_at_chains_and_open_ends_only(spark, monkeypatch):
    """Nodes without inner edges take no part in path doubling, dead ends in no further level; an edge of two types counts once, in a chain too."""
    told, of = [], reach.measured
    monkeypatch.setattr(reach, "TABLES", 1)
    monkeypatch.setattr(reach, "measured", lambda df, name, **m: (told.append((name, (out := of(df, name, **m))[1])), out)[1])
    nodes = {i: (t, {}) for i, t in (("s", "S"), ("t", "S"), ("a", "F"), ("b", "F"), ("c", "F"), ("k", "K"), ("l", "K"))}
    edges = [("s", "a"), ("s", "b"), ("t", "b"), ("t", "c"), ("a", "k"), ("a", "l"), ("b", "k"), ("b", "l"), ("c", "k"), ("c", "l"), ("c", "gone"), ("gone", "k")]
    starts = spark.createDataFrame([(i,) for i in nodes], "source_id string")
    counts = lambda n, e, s: {r.source_id: (r.reaches, r.sinks) for r in traverse.reachable_counts(n, e, s).collect()}
    assert counts(*graph(spark, nodes, edges), starts) == {"s": (4, 2), "t": (4, 2), "a": (2, 2), "b": (2, 2), "c": (2, 2), "k": (0, 0), "l": (0, 0)}
    assert [d["n"] or 0 for k, d in told if k == "first"] == [0] and [d["n"] or 0 for k, d in told if k == "covered"] == [4, 0]
    nodes = {i: ("F", {}) for i in "abcdefg"} | {"k": ("K", {})}
    edges = [("a", "b"), ("b", "c"), ("b", "d"), ("c", "e"), ("d", "e"), ("e", "f"), ("e", "k"), ("f", "b"), ("g", "a", "call", []), ("g", "a", "dataflow", [])]
    told.clear()
    starts = spark.createDataFrame([(i,) for i in nodes], "source_id string")
    n, e = graph(spark, nodes, edges)
    full = [(x[0], x[1]) for x in edges]
    want = {a: (len(r := reach_brute(nodes, full, a)) - 1, sum(x == "k" and x != a for x in r)) for a in nodes}
    assert counts(n, e, starts) == want
    assert next(d["n"] for k, d in told if k == "first") == 2  # g and a: every other edge has a source with two ways out or a target with two ways in


def test_edges_hold_names_of_calls_only(spark):
    """Arguments and parameters are texts, and of calls only; names with quotes and commas still meet, nulls and empty lists don't."""
    nodes = {"s": ("S", {"vars": ['a"b,c']}), "f": ("F", {"params": ["p\\q"]}), "g": ("F", {"params": ["r"]}), "k": ("K", {}), "m": ("K", {})}
    edges = [("s", "f", "call", ['a"b,c']), ("f", "k", "call", ["p\\q"]), ("s", "g", "dataflow", ["x"]), ("g", "m", "call", ["r"])]
    n, e = graph(spark, nodes, edges)
    e = e.withColumn("args", F.when(F.col("dst") != "m", F.col("args")))
    table = search.adjacency(n, e).table
    assert {(r.src, r.dst): (r.args, r.params) for r in table.collect()} == {("s", "f"): ('["a\\"b,c"]', '["p\\\\q"]'), ("f", "k"): ('["p\\\\q"]', ""), ("s", "g"): ("", ""), ("g", "m"): ("", "")}
    assert pairs(traverse.find_all_paths(n, e)) == [("s", "k", ("s", "f", "k"))]


def test_records_without_paths(spark, monkeypatch):
    """Differences and ranks ask for ids and severities: the same records, and no path is put together."""
    nodes = {"s": ("S", {}), "f": ("F", {}), "z": ("Z", {}), "k": ("K", {"cls": "sqli"}), "m": ("K", {"cls": "xss"})}
    n, e = graph(spark, nodes, [("s", "f"), ("f", "k"), ("s", "z"), ("z", "m"), ("s", "m")])
    want = sorted(map(tuple, traverse.find_all_paths(n, e).select("id", "severity", "file_path").collect()))
    monkeypatch.setattr(search.Found, "with_paths", None)
    found = traverse.find_all_paths(n, e, paths=False)
    assert sorted(map(tuple, found.select("id", "severity", "file_path").collect())) == want and len(want) == 2
    assert not {"path", "path_length", "confidence"} & set(found.columns)
