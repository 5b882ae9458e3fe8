"""The engine's face: a graph and its fixed menu of queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions import scalar as S
from tracewarden.operators import build, extract, posture, traverse
from tracewarden.sources.repository import changed_files, files_at, scan
from tracewarden.sources.shared import written


class SecurityGraph:
    """Nodes and edges as DataFrames. Methods return DataFrames; ``tool`` renders bounded answers as JSON."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    @classmethod
    def from_files(cls, files: DataFrame, **flags) -> SecurityGraph:
        """The graph of (path, language, content) files. ``enclosing`` and ``assigned`` go to the extraction, other flags to the
        construction."""
        events = written(extract.syntax_events(files), "events")
        how = {k: flags.pop(k) for k in ("enclosing", "assigned") if k in flags}
        nodes, edges = build.build_graph(*extract.facts(events, **how), **flags)
        return cls(written(nodes, "nodes"), written(edges, "edges"))

    @classmethod
    def from_tree(cls, spark: SparkSession, root: str, **flags) -> SecurityGraph:
        return cls.from_files(scan(spark, root), **flags)

    @classmethod
    def diff(cls, spark: SparkSession, repo: str, ref: str = "HEAD~1") -> tuple[DataFrame, DataFrame, DataFrame]:
        """(new paths, resolved paths, verdict) of the tree at ``repo`` against a git ref.

        The graph at the ref has the facts of unchanged files, edges included, and those of the changed files as they were.
        """
        now = written(scan(spark, repo), "files")
        changed = written(changed_files(spark, repo, ref), "changed")
        then = now.join(changed, "path", "left_anti").unionByName(extract.source_files(files_at(changed, repo, ref)))
        before, after = (written(cls.from_files(f).find_all_paths(), "paths") for f in (then, now))
        return posture.new_paths(before, after), posture.resolved_paths(before, after), posture.diff_verdict(before, after)

    def find_all_paths(self, **flags) -> DataFrame:
        return traverse.find_all_paths(self.nodes, self.edges, **flags)

    def paths_to_sink(self, pattern: str) -> DataFrame:
        return traverse.paths_to_sink(self.nodes, self.edges, pattern)

    def trace_data_flow(self, node_id: str) -> DataFrame:
        return traverse.trace_data_flow(self.nodes, self.edges, node_id)

    def attack_surface(self, module: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
        return traverse.attack_surface(self.nodes, self.edges, module)

    def blast_radius(self, node_id: str) -> tuple[DataFrame, DataFrame]:
        return traverse.blast_radius(self.nodes, self.edges, node_id)

    def report(self) -> dict[str, DataFrame]:
        return posture.report(self.nodes, written(self.find_all_paths(), "paths"))

    def tool(self, name: str, most: int = 1000, **args) -> str:
        """One of the agent tools as JSON with two blanks of indent, at most ``most`` rows of each list.

        query_taint_paths(sink), get_attack_surface(module), find_missing_sanitizers(), trace_data_flow(node_id or
        symbol, file), calculate_blast_radius(function), get_security_context(file); the trust and auth tools
        have no facts to answer from and say so.
        """
        version = build.graph_version(self.nodes, self.edges).first()[0]
        rows = lambda df: [r.asDict(True) for r in df.limit(most).collect()]
        if name == "query_taint_paths":
            if not args.get("sink"):
                raise ValueError("sink is required")
            paths = written(self.paths_to_sink(args["sink"]), "paths")
            n = paths.count()
            out = {"query": args["sink"], "path_count": n, "paths": rows(traverse.by_severity(paths)), "proof": paths.agg(S.proof(F.count(F.lit(1))).alias("proof")).first()["proof"]}
        elif name == "get_attack_surface":
            sources, sinks, counts = self.attack_surface(args.get("module", ""))
            out = {"module": args.get("module", ""), **counts.first().asDict(), "sources": rows(sources), "reachable_sinks": rows(sinks)}
        elif name == "find_missing_sanitizers":
            paths = written(self.find_all_paths(), "paths")
            out = {"total_findings": paths.count(), "by_severity": {r[0]: r[1] for r in posture.findings_by_severity(paths).collect()}, "findings": rows(posture.findings(traverse.by_severity(paths)))}
        elif name == "trace_data_flow":
            found = self.nodes.filter(F.col("id") == args["node_id"]).first() if args.get("node_id") else build.first_match(self.nodes, args["symbol"], args.get("file", "")).first()
            if not found:
                raise ValueError("node not found")
            reached = written(self.trace_data_flow(found["id"]), "reached")
            out = {"origin": found.asDict(True), "reaches_count": reached.count(), "sink_count": reached.filter("type = 'SinkNode'").count(), "reaches": rows(reached.orderBy("depth", "rank").drop("rank"))}
        elif name == "calculate_blast_radius":
            found = build.first_match(self.nodes, args["function"]).first()
            if not found:
                raise ValueError("function not found")
            nodes, paths = self.blast_radius(found["id"])
            out = {"function": args["function"], "affected_nodes": rows(nodes), "affected_path_count": paths.count()}
        elif name == "get_security_context":
            nodes = self.nodes.filter(F.col("file_path") == args["file"])
            context = posture.file_context(nodes).first()
            counts = context.asDict() if context else {"file_path": args["file"], "total_nodes": 0, "source_count": 0, "sink_count": 0, "sanitizer_count": 0, "risk_score": 0.0}
            out = {"file": counts.pop("file_path"), **counts, "nodes": rows(nodes.orderBy("line_start", "symbol", "id"))}
        elif name == "get_trust_boundary_violations":
            out = {"violations": [], "note": "no trust boundaries are extracted"}
        elif name == "check_auth_coverage":
            out = {"endpoint": args.get("endpoint", ""), "covered": None, "note": "no authorisation facts are extracted"}
        else:
            raise ValueError(f"unknown tool {name!r}")
        return json.dumps(out | {"graph_version": version}, indent=2)

    def gate(self, min_severity: str = "high") -> DataFrame:
        return posture.gate(self.find_all_paths(), min_severity)

    def severities(self) -> DataFrame:
        return self.nodes.filter("type = 'SinkNode'").select("id", "vuln_class", S.severity("vuln_class").alias("severity"))
