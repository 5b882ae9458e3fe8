"""All registered graph queries and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions import scalar as S
from tracewarden.functions.rules import LINE_RULES
from tracewarden.operators import build, extract, lines, posture, traverse
from tracewarden.plans import adapters as A
from tracewarden.plans import oracles as O
from tracewarden.plans import reports
from tracewarden.schema import SINK, SOURCE
from tracewarden.sources.shared import load, shared_folder, written
from tracewarden.sources.store import FactStore
from tracewarden.streaming.changes import apply_changes, bursts

Query = Callable[[SparkSession, str], DataFrame]
_FLAT = ("id", "source_id", "sink_id", "path", "path_length", "vuln_class", "severity", "confidence", "file_path")


def _flat(paths: DataFrame) -> DataFrame:
    """Path records without arrays."""
    return paths.select(*_FLAT).withColumn("path", F.array_join("path", ">"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return A.event_nodes(spark, sf_dir), A.event_edges(spark, sf_dir)


def _paths(spark: SparkSession, sf_dir: str, paths: bool = True) -> DataFrame:
    return traverse.find_all_paths(*_graph(spark, sf_dir), paths=paths)


def find_all_paths(spark, sf_dir):
    return _flat(_paths(spark, sf_dir))


def missing_sanitizers(spark, sf_dir):
    return posture.findings(_paths(spark, sf_dir)).select("id", "vuln_class", "severity", "description", "source_file", "sink_file", "sink_symbol", "remediation")


def paths_to_sink_class(spark, sf_dir):
    return _flat(traverse.paths_to_sink(*_graph(spark, sf_dir), "sqli"))


def paths_to_sink_file(spark, sf_dir):
    return _flat(traverse.paths_to_sink(*_graph(spark, sf_dir), "svc7/"))


def sound_paths(spark, sf_dir):
    return _flat(traverse.find_all_paths(*_graph(spark, sf_dir), sound=True))


def class_aware_paths(spark, sf_dir):
    return _flat(traverse.find_all_paths(*_graph(spark, sf_dir), class_aware=True))


def trace_flow_whole(spark, sf_dir):
    """From the first signup to the end, in queue order."""
    nodes, edges = _graph(spark, sf_dir)
    start = load(spark, sf_dir, "events").filter("event_type = 'signup'").agg(F.min_by("event_id", F.struct("ts", "event_id"))).first()[0]
    return traverse.trace_data_flow(nodes, edges, f"e{start}").select("id", "type", F.col("depth").cast("long").alias("depth"))


def trace_flow(spark, sf_dir):
    """From the first signup to the end, over chains."""
    nodes, edges = _graph(spark, sf_dir)
    start = load(spark, sf_dir, "events").filter("event_type = 'signup'").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("e"))
    found = traverse.reached(nodes, edges, start.select(F.concat(F.lit("e"), "e").alias("source_id"))).filter("depth > 0")
    return found.select("id", "type", F.col("depth").cast("long").alias("depth"))


def _of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("type") == kind).select(F.col("id").alias("source_id"))


def trace_flow_all(spark, sf_dir):
    """From every signup to the end."""
    nodes, edges = _graph(spark, sf_dir)
    found = traverse.reached(nodes, edges, _of_type(nodes, SOURCE)).filter("depth > 0")
    return found.select("source_id", "id", "type", F.col("depth").cast("long").alias("depth"))


def reach_counts_whole(spark, sf_dir):
    """From each user's first event to the end."""
    nodes, edges = _graph(spark, sf_dir)
    starts = nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select(F.col("id").alias("source_id"))
    return traverse.reachable_counts(nodes, edges, starts)


def reach_counts(spark, sf_dir):
    """From every event to the end."""
    nodes, edges = _graph(spark, sf_dir)
    return traverse.reachable_counts(nodes, edges, nodes.select(F.col("id").alias("source_id")))


def order_reaches(spark, sf_dir):
    """From every customer, order and part of the orders graph, where orders lead to several parts and parts are shared."""
    nodes, edges = A.order_nodes(spark, sf_dir), A.order_edges(spark, sf_dir)
    return traverse.reachable_counts(nodes, edges, nodes.select(F.col("id").alias("source_id")))


def attack_surface(spark, sf_dir):
    return traverse.attack_surface(*_graph(spark, sf_dir))[2]


def attack_surface_module(spark, sf_dir):
    """By module: the surface of every service at once, from one trace."""
    nodes, edges = _graph(spark, sf_dir)
    module = F.element_at(F.split("file_path", "/"), 1)
    sources = nodes.filter(F.col("type") == SOURCE).select(F.col("id").alias("source_id"), module.alias("module"))
    traced = traverse.trace_forward(nodes, edges, paths=False).select("source_id", "sink_id")
    return sources.join(traced, "source_id", "left").groupBy("module").agg(F.count_distinct("source_id").alias("source_count"), F.count_distinct("sink_id").alias("reachable_sink_count"), F.count("sink_id").alias("taint_path_count"))


def _last_sink(spark, sf_dir) -> str:
    """The last purchase of all."""
    return f"e{load(spark, sf_dir, 'events').filter(F.col('event_type') == 'purchase').agg(F.max_by('event_id', F.struct('ts', 'event_id'))).first()[0]}"


def blast_nodes(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    node = _last_sink(spark, sf_dir)
    return traverse.blast_radius(nodes, edges, node, paths=nodes.limit(0).withColumn("path", F.array("id")))[0].select("id", "type", "file_path")


def blast_paths(spark, sf_dir):
    """The paths through the last purchase; what leads to it isn't asked for."""
    return _flat(traverse.paths_with(_paths(spark, sf_dir), _last_sink(spark, sf_dir)))


def blast_nodes_all(spark, sf_dir):
    """What leads to each purchase, itself included."""
    nodes, edges = _graph(spark, sf_dir)
    found = traverse.reached(nodes, edges, _of_type(nodes, SINK), forward=False)
    return found.select(F.col("source_id").alias("node_id"), "id", "type", "file_path")


def blast_paths_all(spark, sf_dir):
    """The paths through each purchase."""
    found = traverse.paths_through(_paths(spark, sf_dir), _of_type(A.event_nodes(spark, sf_dir), SINK))
    return found.select("node_id", *_FLAT).withColumn("path", F.array_join("path", ">"))


def node_stats(spark, sf_dir):
    return posture.node_stats(A.event_nodes(spark, sf_dir))


def edge_stats(spark, sf_dir):
    return posture.edge_stats(A.event_edges(spark, sf_dir))


def live_edges(spark, sf_dir):
    return posture.live_edge_count(*_graph(spark, sf_dir))


def out_degrees(spark, sf_dir):
    edges = A.order_edges(spark, sf_dir)
    return edges.groupBy("src").agg(F.count_distinct("id").alias("out_degree"))


def nodes_by_type(spark, sf_dir):
    return A.event_nodes(spark, sf_dir).filter(F.col("type") == SINK).select("id", "symbol", "vuln_class", S.severity("vuln_class").alias("severity"))


def nodes_by_file(spark, sf_dir):
    return A.event_nodes(spark, sf_dir).filter(F.col("file_path").startswith("svc3/")).select("id", "type", "file_path")


def stable_ids(spark, sf_dir):
    nodes = A.event_nodes(spark, sf_dir)
    return nodes.select("id", S.node_id("file_path", "line_start", "symbol").alias("node_id"), S.edge_id("id", "id", F.lit("dataflow")).alias("edge_id"), S.path_id("id", "id").alias("path_id"))


def severity_map(spark, sf_dir):
    sinks = A.event_nodes(spark, sf_dir).filter(F.col("type") == SINK)
    return sinks.groupBy("vuln_class", S.severity("vuln_class").alias("severity"), S.severity_rank(S.severity("vuln_class")).cast("long").alias("rank"), S.remediation("vuln_class").alias("remediation")).agg(F.count(F.lit(1)).alias("n"))


def _classified(language: str) -> Query:
    def query(spark, sf_dir):
        found = lines.classify_lines(A.code_lines(spark, sf_dir, language), language)
        return found.select("file_path", F.col("line").cast("long").alias("line"), "rule", "kind", "symbol", "vuln_class", F.array_join("tainted_vars", ",").alias("tainted_vars"))

    return query


def assign_targets(spark, sf_dir):
    return A.code_lines(spark, sf_dir, "python").select("event_id", S.assign_target("text").alias("target"))


def go_assign_targets(spark, sf_dir):
    return A.code_lines(spark, sf_dir, "go").select("event_id", S.go_assign_target("text").alias("target"))


def call_names(spark, sf_dir):
    rule = next(r for r in LINE_RULES if r.name == "py_sql")
    return A.code_lines(spark, sf_dir, "python").filter(F.col("text").rlike(rule.pattern)).select("event_id", S.call_name("text", rule.pattern).alias("call"))


def param_lists(spark, sf_dir):
    found = A.code_lines(spark, sf_dir, "python").withColumn("params", F.regexp_extract("text", r"^(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)", 2)).filter("params <> ''")
    return found.select("event_id", F.array_join(S.python_params("params"), ",").alias("params"))


def _parsed(spark, sf_dir) -> DataFrame:
    return lines.classify_lines(A.code_lines(spark, sf_dir, "python"), "python").drop("rule")


def line_index(spark, sf_dir):
    return build.line_index(_parsed(spark, sf_dir)).select("file_path", F.col("line").cast("long").alias("line"), "line_id")


def dataflow_edges(spark, sf_dir):
    edges = build.dataflow_edges(_parsed(spark, sf_dir))
    return edges.select("id", "src", "dst", F.col("metadata")["tainted_var"].alias("tainted_var"))


def _functions(spark, sf_dir) -> DataFrame:
    """A function for each header among the rendered lines, named as the header says."""
    header = r"^def\s+(\w+)\s*\("
    defs = A.code_lines(spark, sf_dir, "python").filter(F.col("text").rlike(header))
    return defs.select("file_path", F.col("line").cast("int").alias("ord"), F.regexp_extract("text", header, 1).alias("name"), F.col("line").cast("int").alias("line"), F.array().cast("array<string>").alias("params"), F.lit(False).alias("is_handler"), F.lit("").alias("framework"))


def _calls(spark, sf_dir) -> DataFrame:
    """A call of one handler by another for each rendered line that runs a query or a command on a variable."""
    run = r"^(?:cursor\.execute|os\.system)\((\w+)\)$"
    rows = A.code_lines(spark, sf_dir, "python").filter(F.col("text").rlike(run))
    name = lambda e: F.concat(F.lit("handler"), F.expr(f"cast({e} AS string)"))
    return rows.select("file_path", F.col("line").cast("int").alias("ord"), name("event_id % 7").alias("caller_func"), name("(event_id + 3) % 7").alias("callee"), F.array(F.regexp_extract("text", run, 1)).alias("arg_names"), F.col("line").cast("int").alias("line"))


def func_registry(spark, sf_dir):
    return build.function_registry(_functions(spark, sf_dir))


def call_edges(spark, sf_dir):
    edges = build.call_edges(_functions(spark, sf_dir), _calls(spark, sf_dir), ordered=False)
    return edges.select("id", "src", "dst", F.col("metadata")["call_line"].alias("call_line"))


def call_edges_ordered(spark, sf_dir):
    edges = build.call_edges(_functions(spark, sf_dir), _calls(spark, sf_dir))
    return edges.select("id", "src", "dst", F.col("metadata")["call_line"].alias("call_line"))


def findings_by_severity(spark, sf_dir):
    return posture.findings_by_severity(_paths(spark, sf_dir, paths=False))


def posture_score(spark, sf_dir):
    return posture.posture(_paths(spark, sf_dir, paths=False))


def posture_by_module(spark, sf_dir):
    """The posture score of every service, over its sinks' paths."""
    module = F.element_at(F.split("file_path", "/"), 1)
    return posture.posture(_paths(spark, sf_dir, paths=False), module.alias("module"))


def file_context(spark, sf_dir):
    return posture.file_context(A.event_nodes(spark, sf_dir))


def gate_high(spark, sf_dir):
    return posture.gate(_paths(spark, sf_dir, paths=False), "high")


def path_depth_hist(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy(F.col("path_length").cast("long").alias("path_length")).agg(F.count(F.lit(1)).alias("n"))


def _before_after(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Paths as ids: before, those that don't end in svc1 files; after, those that don't end in svc2 files."""
    paths = written(_paths(spark, sf_dir, paths=False).select("id", "file_path", "severity"), "paths")
    return paths.filter(~F.col("file_path").startswith("svc1/")), paths.filter(~F.col("file_path").startswith("svc2/"))


def diff_new(spark, sf_dir):
    return posture.new_paths(*_before_after(spark, sf_dir)).select("id", "severity")


def diff_resolved(spark, sf_dir):
    return posture.resolved_paths(*_before_after(spark, sf_dir)).select("id", "severity")


def diff_verdict(spark, sf_dir):
    return posture.diff_verdict(*_before_after(spark, sf_dir))


def path_history(spark, sf_dir):
    before, after = _before_after(spark, sf_dir)
    known = before.select("id", F.lit("2024-01-01").cast("date").alias("introduced_at"), F.lit(None).cast("date").alias("resolved_at"))
    history = posture.path_history(known, after, __import__("datetime").date(2024, 2, 1))
    return history.select("id", F.col("introduced_at").cast("string").alias("introduced_at"), F.col("resolved_at").cast("string").alias("resolved_at"), "is_active")


def latest_change(spark, sf_dir):
    """Events as changes of a user's file: the last of each burst of ten minutes counts."""
    events = load(spark, sf_dir, "events").selectExpr("concat('u', user_id) AS path", "cast(ts AS timestamp) AS event_time", "event_id", "event_type = 'error' AS is_delete")
    return bursts(events, 600, "event_id").select("path", "burst", "event_id", "is_delete", "n")


def file_replace(spark, sf_dir):
    """Nodes and edges left after all svc5 files were removed, as counts by type."""
    nodes, edges = _graph(spark, sf_dir)
    gone = nodes.filter(F.col("file_path").startswith("svc5/")).select("file_path")
    left_nodes, left_edges = posture.replace_files(nodes, edges, gone, nodes.limit(0), edges.limit(0))
    return left_nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).union(left_edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")))


def calibration_rates(spark, sf_dir):
    """Events as feedback: purchases accept, errors reject and views ignore a finding of a class."""
    action = F.expr("CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'ignored' ELSE 'other' END")
    events = load(spark, sf_dir, "events").select(action.alias("action"), F.expr(A._CLASS).alias("vuln_class"))
    return posture.calibration_rates(events)


def order_surface(spark, sf_dir):
    """The attack surface of each nation's customers over the orders graph."""
    nodes, edges = A.order_nodes(spark, sf_dir), A.order_edges(spark, sf_dir)
    module = F.element_at(F.split("file_path", "/"), 1)
    sources = nodes.filter(F.col("type") == SOURCE).select(F.col("id").alias("source_id"), module.alias("module"))
    found = traverse.trace_forward(nodes, edges, max_nodes=3, paths=False).select("source_id", "sink_id").distinct()
    return sources.join(found, "source_id").groupBy("module").agg(F.count(F.lit(1)).alias("paths"), F.count_distinct("sink_id").alias("sinks"))


def order_findings(spark, sf_dir):
    """Findings of the orders graph by class and severity."""
    nodes, edges = A.order_nodes(spark, sf_dir), A.order_edges(spark, sf_dir)
    paths = traverse.find_all_paths(nodes, edges, max_nodes=3)
    return paths.groupBy("vuln_class", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sink_id").alias("sinks"))


def request_parameters(spark, sf_dir):
    """Names of request parameters in page addresses, as sources by host."""
    pages = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?]+)", 1).alias("host"), F.regexp_extract("url", r"\?(.*)$", 1).alias("query"))
    names = pages.filter("query <> ''").select("host", F.explode(F.transform(F.split("query", "&"), lambda p: F.split(p, "=")[0])).alias("parameter"))
    return names.groupBy("host", "parameter").agg(F.count(F.lit(1)).alias("n"))


def secret_lines(spark, sf_dir):
    """Documents whose text assigns a quoted secret."""
    return load(spark, sf_dir, "documents").filter(F.col("text").rlike(O.SECRET)).select("doc_id", F.regexp_extract("text", O.SECRET, 1).alias("kind"))


def _extracted(language: str) -> Query:
    """The facts of each user's program: nodes, functions and calls as rows of one shape."""

    def query(spark, sf_dir):
        files = extract.source_files(A.script_files(A.script_lines(spark, sf_dir, language)))
        parsed, functions, calls = extract.facts(written(extract.syntax_events(files), "events"))
        joined = lambda c: F.array_join(c, ",")
        rows = [
            parsed.select(F.lit("node").alias("fact"), "file_path", "line", F.col("symbol").alias("name"), F.concat_ws(" ", "kind", "vuln_class", joined("tainted_vars")).alias("detail")),
            functions.select(F.lit("function").alias("fact"), "file_path", "line", "name", F.concat_ws(" ", joined("params"), F.col("is_handler").cast("string")).alias("detail")),
            calls.select(F.lit("call").alias("fact"), "file_path", "line", F.col("callee").alias("name"), F.concat_ws(" ", "caller_func", joined("arg_names")).alias("detail")),
        ]
        return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("line", F.col("line").cast("long"))

    return query


def line_imports(spark, sf_dir):
    """Imports by line patterns, in the programs of all three languages."""
    found = [lines.line_imports(A.script_lines(spark, sf_dir, k), k) for k in A.ENDING]
    return found[0].unionByName(found[1]).unionByName(found[2]).withColumn("line", F.col("line").cast("long"))


def line_functions(spark, sf_dir):
    """Function headers by line patterns, in the Python and Go programs."""
    found = [lines.line_functions(A.script_lines(spark, sf_dir, k), k) for k in ("python", "go")]
    return found[0].unionByName(found[1]).select("file_path", F.col("line").cast("long").alias("line"), "name", F.array_join("params", ",").alias("params"), "is_handler")


def incremental_calls(spark, sf_dir):
    """Call edges after three batches of changes: first halves of all programs; whole ones of every other user, with some that
    didn't change; and deletions."""
    rows = A.script_lines(spark, sf_dir, "python")
    half = rows.filter("2 * line <= n")
    store = FactStore(spark, shared_folder(spark, "facts"))
    mark = lambda files, deleted: files.select("path", F.lit("python").alias("language"), F.lit(deleted).alias("is_delete"), "content", F.lit("2024-01-01").cast("timestamp").alias("event_time"))
    apply_changes(store, mark(A.script_files(half), False))
    apply_changes(store, mark(A.script_files(rows.filter("user_id % 2 = 0").unionByName(half.filter("user_id % 6 = 3"))), False))
    apply_changes(store, mark(A.script_files(half.filter("user_id % 10 = 9")), True))
    _, functions, calls = store.facts()
    edges = build.call_edges(functions, calls, ordered=False)
    return edges.select("id", "src", "dst", F.col("metadata")["call_line"].alias("call_line"))


def page_script_calls(spark, sf_dir):
    """Calls in the scripts of web pages."""
    scripts = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1)), "\n")
    files = load(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("javascript").alias("language"), scripts.alias("content"))
    found = extract.syntax_events(files).filter("event = 'call'").groupBy("file_path", "name").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("file_path").cast("long").alias("page_id"), F.col("name").alias("callee"), "n")


def graph_delta(spark, sf_dir):
    """The nodes by which files grow from the first half of all events to all of them."""
    nodes = A.event_nodes(spark, sf_dir)
    half = load(spark, sf_dir, "events").agg(F.expr("cast((min(event_id) + max(event_id)) div 2 as long)")).first()[0] or 0
    return posture.node_delta(nodes.filter(F.expr(f"cast(substring(id, 2) as long) <= {half}")), nodes)


def order_paths(spark, sf_dir):
    """Paths over the orders graph, where customers reach a part over several orders: the first in queue order counts."""
    nodes, edges = A.order_nodes(spark, sf_dir), A.order_edges(spark, sf_dir)
    found = traverse.trace_first(nodes, edges, max_nodes=3)
    return found.select("source_id", "sink_id", F.array_join("path", ">").alias("path"))


_QUERIES: tuple[Query, ...] = (
    find_all_paths, missing_sanitizers, paths_to_sink_class, paths_to_sink_file, sound_paths, class_aware_paths, trace_flow, trace_flow_whole, trace_flow_all, reach_counts, reach_counts_whole, order_reaches, attack_surface, attack_surface_module, blast_nodes, blast_nodes_all, blast_paths, blast_paths_all,
    node_stats, edge_stats, live_edges, out_degrees, nodes_by_type, nodes_by_file, stable_ids, severity_map, assign_targets, go_assign_targets, call_names, param_lists, line_index, dataflow_edges,
    func_registry, call_edges, call_edges_ordered, findings_by_severity, posture_score, posture_by_module, file_context, gate_high, path_depth_hist, diff_new, diff_resolved, diff_verdict, path_history, latest_change,
    file_replace, calibration_rates, order_surface, order_findings, request_parameters, secret_lines,
    line_imports, line_functions, incremental_calls, page_script_calls, graph_delta, order_paths,
)


def queries() -> dict[str, Query]:
    named = (("py", "python"), ("ts", "typescript"), ("go", "go"))
    return {f.__name__: f for f in _QUERIES} | reports.QUERIES | {f"classify_lines_{k}": _classified(v) for k, v in named} | {f"extracted_{k}": _extracted(v) for k, v in named}


def oracle_sql() -> dict[str, str]:
    return O.texts() | reports.texts()
