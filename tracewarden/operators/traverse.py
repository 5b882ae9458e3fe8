"""Graph traversals: taint paths, plain paths to sinks, reachability, blast radius.

Paths are found by ``search`` (level-synchronous joins with ranks and predecessor tables), sets of reachable nodes by ``reach``
(chains of nodes put together by path doubling).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions import scalar as S
from tracewarden.operators import reach
from tracewarden.operators.search import MANY, Around, Found, Rule, adjacency, live_links, search, sink_distance
from tracewarden.schema import SINK, SOURCE
from tracewarden.sources.shared import written

#: Longest path in nodes.
MAX_NODES = 20


def _searched(around: Around, starts: DataFrame, rule: Rule, sinks: DataFrame, prune: bool | None, **levels) -> Found:
    """A search over edges on the way to a sink only, if ``prune`` says so; by default it turns to them in large graphs when its states outgrow the edges."""
    if prune:
        around = around.towards(sinks, rule.most)
    later = (lambda hops: around.towards(sinks, hops)) if prune is None and around.count > MANY else None
    return search(around, starts, rule, narrowed=later, **levels)


def taint_search(nodes: DataFrame, edges: DataFrame, sources: Column | DataFrame | None = None, max_nodes: int = MAX_NODES, sound: bool = False, class_aware: bool = False, prune: bool | None = None, **levels) -> Found:
    """The states of ``trace_forward``."""
    starts = nodes.filter(F.col("type") == SOURCE)
    if isinstance(sources, DataFrame):
        starts = starts.join(sources.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")
    elif sources is not None:
        starts = starts.filter(sources)
    tainted = F.when(F.size(F.coalesce("tainted_vars", F.array())) > 0, F.col("tainted_vars")).otherwise(F.array("symbol"))
    sinks = nodes.filter(F.col("type") == SINK).select(F.col("id").alias("node"))
    rule = Rule(gated=True, ends=True, sound=sound, class_aware=class_aware, most=max_nodes)
    return _searched(adjacency(nodes, edges), starts.select(F.col("id").alias("source_id"), tainted.alias("vars")), rule, sinks, prune, **levels)


def trace_forward(nodes: DataFrame, edges: DataFrame, sources: Column | DataFrame | None = None, max_nodes: int = MAX_NODES, sound: bool = False, class_aware: bool = False, paths: bool = True, **options) -> DataFrame:
    """Unsanitized source-to-sink paths: (source_id, sink_id, depth, rank, path), one for each sink and depth.

    A call edge is crossed only with a tainted argument, whose callee's parameters (or, without any, the same
    variables) are then tainted. A path ends at its first unsanitized sink; a sanitizer anywhere on it, whatever its
    class, clears it, and a sanitized path goes on through sinks. Of the states that reach a node at one
    depth, the first counts (``sound`` keeps a clean one beside a sanitized one; ``class_aware`` lets a sanitizer
    clear sinks of its own class only). Null columns count as absent; edges to missing nodes lead nowhere. Without ``paths``, only which
    sinks are reached: no path is put together. ``sources``: a condition on source nodes, or a table of their ids
    (``source_id``). ``prune``: see ``search``.
    """
    return _traced(taint_search(nodes, edges, sources, max_nodes, sound, class_aware, listed=paths, **options), paths)


def _traced(found: Found, paths: bool = True) -> DataFrame:
    rows = found.with_paths() if paths else found.rows
    return rows.select("source_id", F.col("node").alias("sink_id"), "depth", "rank", *["path"] * paths)


def first_paths(traced: DataFrame) -> DataFrame:
    """The first (shortest) path of each source and sink."""
    by_pair = Window.partitionBy("source_id", "sink_id").orderBy("depth", "rank")
    return traced.withColumn("n", F.row_number().over(by_pair)).filter("n = 1").drop("n", "rank")


def trace_first(nodes: DataFrame, edges: DataFrame, class_aware: bool = False, paths: bool = True, **flags) -> DataFrame:
    """``first_paths`` of ``trace_forward``. Hits of one depth are one for each source and sink already (but for ``class_aware``, which keeps
    them apart by what was cleared), so only hits of several depths are compared."""
    found = taint_search(nodes, edges, class_aware=class_aware, listed=paths, **flags)
    traced = _traced(found, paths)
    return traced.drop("rank") if found.one_depth and not class_aware else first_paths(traced)


def described(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Path records: (id, source_id, sink_id, path, path_length, vuln_class, severity, confidence, file_path, description); without ``path``,
    its length and the confidence where the table has none."""
    of_path = [F.col("path"), F.size("path").alias("path_length"), S.confidence(F.size("path")).alias("confidence")] * ("path" in paths.columns)
    source = nodes.filter(F.col("type") == SOURCE).select(F.col("id").alias("source_id"), F.col("symbol").alias("source_symbol"), F.col("file_path").alias("source_file"), F.col("line_start").alias("source_line"))
    sink = nodes.filter(F.col("type") == SINK).select(F.col("id").alias("sink_id"), F.col("symbol").alias("sink_symbol"), F.col("file_path").alias("file_path"), F.col("line_start").alias("sink_line"), F.when(F.coalesce("vuln_class", F.lit("")) == "", F.lit("unknown")).otherwise(F.col("vuln_class")).alias("vuln_class"))
    joined = paths.join(source, "source_id").join(sink, "sink_id")
    return joined.select(S.path_id("source_id", "sink_id").alias("id"), "source_id", "sink_id", *of_path[:2], "vuln_class", S.severity("vuln_class").alias("severity"), *of_path[2:], "file_path", S.description("source_symbol", "source_file", "sink_symbol", "file_path").alias("description"), "source_symbol", "source_file", "source_line", "sink_symbol", "sink_line")


def find_all_paths(nodes: DataFrame, edges: DataFrame, **flags) -> DataFrame:
    """All unsanitized paths, one for each source and sink. Order them with ``by_severity`` where order matters. With ``paths=False`` the same
    records without path, path_length and confidence: no path is put together."""
    return described(nodes, trace_first(nodes, edges, **flags))


find_missing_sanitizers = find_all_paths


def _changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either table that the other one lacks."""
    hashed = lambda df: df.select("*", F.xxhash64(*[F.to_json(c) if t.startswith(("map", "array")) else F.col(c) for c, t in df.dtypes]).alias("h"))
    old, new = hashed(before), hashed(after)
    keys = ["id", "h"]
    return old.join(new.select(keys), keys, "left_anti").unionByName(new.join(old.select(keys), keys, "left_anti"), allowMissingColumns=True)


def affected_sources(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], max_nodes: int = MAX_NODES) -> DataFrame:
    """(source_id): nodes from which, before or after a change of (nodes, edges), a changed node or end of a changed edge lies within a
    path's length. One backward search over all changed nodes at once in each graph."""
    nodes, edges = _changed(before[0], after[0]), _changed(before[1], after[1])
    touched = nodes.select(F.col("id").alias("node")).unionByName(edges.select(F.col("src").alias("node"))).distinct()
    touched = written(touched, "touched")
    found = [sink_distance(live_links(*graph), touched, max_nodes) for graph in (before, after)]
    return found[0].select(F.col("node").alias("source_id")).unionByName(found[1].select(F.col("node").alias("source_id"))).distinct()


def updated_paths(paths: DataFrame, before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], max_nodes: int = MAX_NODES, **flags) -> DataFrame:
    """The path records of a changed graph from those of the graph before: only sources near a change are searched again.

    The rows are those of ``find_all_paths`` over the graph after; graphs are (nodes, edges).
    """
    again = written(affected_sources(before, after, max_nodes), "affected")
    kept = paths.join(again, "source_id", "left_anti").select(paths.columns)
    return kept.unionByName(find_all_paths(*after, sources=again, max_nodes=max_nodes, **flags).select(paths.columns))


def by_severity(paths: DataFrame) -> DataFrame:
    """Critical first; ties by id."""
    return paths.orderBy(S.severity_rank("severity"), "id")


def matches(pattern: str) -> Column:
    """Nodes whose symbol, class or file contains the pattern; every node for an empty one."""
    return F.col("symbol").contains(pattern) | F.col("vuln_class").contains(pattern) | F.col("file_path").contains(pattern)


def paths_to_sink(nodes: DataFrame, edges: DataFrame, pattern: str, max_nodes: int = MAX_NODES, prune: bool | None = None, **levels) -> DataFrame:
    """Paths to the sinks that match a pattern, by plain search: any edge, through sinks, each node once.

    Only the first arrival at a sink counts; where it is sanitized, the pair has no path.
    """
    starts = nodes.filter(F.col("type") == SOURCE).select(F.col("id").alias("source_id"), F.array().cast("array<string>").alias("vars"))
    sinks = nodes.filter((F.col("type") == SINK) & matches(pattern)).select(F.col("id").alias("node"))
    found = _searched(adjacency(nodes, edges), starts, Rule(once=True, clean=True, most=max_nodes), sinks, prune, **levels)
    found.rows = found.rows.filter(~F.col("sanitized")).join(sinks, "node", "left_semi")
    return described(nodes, found.with_paths().select("source_id", F.col("node").alias("sink_id"), "path", "depth"))


def trace_data_flow(nodes: DataFrame, edges: DataFrame, node_id: str, max_nodes: int | None = None) -> DataFrame:
    """Nodes that a node reaches over any edges, without itself, with their depth; none for an unknown node.

    ``rank`` orders the nodes of one depth as a queue would meet them.
    """
    starts = nodes.filter(F.col("id") == node_id).select(F.col("id").alias("source_id"), F.array().cast("array<string>").alias("vars"))
    found = search(adjacency(nodes, edges), starts, Rule(once=True, most=max_nodes)).rows
    return nodes.join(found.filter("depth > 1").select(F.col("node").alias("id"), (F.col("depth") - 1).alias("depth"), "rank"), "id")


def reachable_counts(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(source_id, reaches, sinks): how many other nodes, and sinks among them, each start (column ``source_id``) reaches."""
    return reach.Chains.of(nodes, edges).counts(_known(nodes, starts))


def reachable_estimates(nodes: DataFrame, edges: DataFrame, precision: int = reach.PRECISION) -> DataFrame:
    """(id, reaches): about how many other nodes every node reaches, by sketches (no pairs are made); see ``reach``."""
    return reach.Chains.of(nodes, edges).estimates(precision)


def _known(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    return starts.select("source_id").distinct().join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi")


def attack_surface(nodes: DataFrame, edges: DataFrame, module: str = "", **flags) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources whose file contains ``module``, distinct sinks they reach, one row with the counts).

    The path count is taken before paths are made distinct: a sink at two depths counts twice.
    """
    inside = F.col("file_path").contains(module)
    sources = nodes.filter((F.col("type") == SOURCE) & inside)
    traced = trace_forward(nodes, edges, sources=inside, paths=False, **flags)
    sinks = nodes.join(traced.select(F.col("sink_id").alias("id")).distinct(), "id", "left_semi")
    counts = traced.agg(F.count(F.lit(1)).alias("taint_path_count"), F.count_distinct("sink_id").alias("reachable_sink_count"))
    return sources, sinks, sources.agg(F.count(F.lit(1)).alias("source_count")).join(counts, F.lit(True))


def blast_radius(nodes: DataFrame, edges: DataFrame, node_id: str, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes that lead to a node, itself included; paths that contain it). ``paths`` saves searching them again."""
    back = reached(nodes, edges, nodes.filter(F.col("id") == node_id).select(F.col("id").alias("source_id")), forward=False).select("id")
    paths = find_all_paths(nodes, edges) if paths is None else paths
    return nodes.join(back, "id", "left_semi"), paths_with(paths, node_id)


def paths_with(paths: DataFrame, node_id: str) -> DataFrame:
    """The paths that contain a node."""
    return paths.filter(F.array_contains("path", node_id))


def reached(nodes: DataFrame, edges: DataFrame, starts: DataFrame, forward: bool = True) -> DataFrame:
    """(source_id, id, type, file_path, depth): the nodes that each start (column ``source_id``) reaches to the end,
    or that lead to it; itself at depth 0. Unknown starts reach nothing."""
    found = reach.Chains.of(nodes, edges, forward).reached(_known(nodes, starts))
    return found.join(nodes.select("id", "type", "file_path"), "id").select("source_id", "id", "type", "file_path", "depth")


def paths_through(paths: DataFrame, starts: DataFrame) -> DataFrame:
    """The paths that contain each start (column ``source_id``), with the start as ``node_id``."""
    by_node = paths.withColumn("node_id", F.explode(F.array_distinct("path")))
    return by_node.join(starts.select(F.col("source_id").alias("node_id")), "node_id", "left_semi")
