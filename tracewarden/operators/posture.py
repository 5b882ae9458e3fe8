"""Aggregates over a graph and its paths: statistics, scores, gates, file context and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import scalar as S
from tracewarden.schema import SANITIZER, SINK, SOURCE


def node_stats(nodes: DataFrame) -> DataFrame:
    """(type, n): nodes by type, and all of them under ``total_nodes``."""
    return nodes.rollup("type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("type", F.lit("total_nodes")).alias("type"), "n")


def edge_stats(edges: DataFrame) -> DataFrame:
    """(type, n): distinct edges by type, dangling ones included."""
    return edges.groupBy("type").agg(F.count_distinct("id").alias("n"))


def live_edge_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n): edges that start at an existing node."""
    return edges.dropDuplicates(["id"]).join(nodes.select(F.col("id").alias("src")), "src", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def findings_by_severity(paths: DataFrame) -> DataFrame:
    return paths.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def findings(paths: DataFrame) -> DataFrame:
    """Paths with the advice for their class."""
    return paths.select("id", "vuln_class", "severity", "confidence", "description", "source_file", "source_line", F.col("file_path").alias("sink_file"), "sink_line", "sink_symbol", S.remediation("vuln_class").alias("remediation"))


def report(nodes: DataFrame, paths: DataFrame) -> dict[str, DataFrame]:
    """The parts of a report: statistics, findings, their numbers by severity, the score and the files. ``paths`` is read several times."""
    return {"stats": node_stats(nodes), "findings": findings(paths), "by_severity": findings_by_severity(paths), "score": posture(paths), "files": file_context(nodes)}


def scored(counts: DataFrame) -> DataFrame:
    """Counts by severity with score and grade: 100 less 25, 15, 5 and 2 for each finding, at least 0."""
    score = F.greatest(F.lit(0), 100 - 25 * F.col("critical") - 15 * F.col("high") - 5 * F.col("medium") - 2 * F.col("low"))
    return counts.withColumn("score", score.cast("long")).withColumn("grade", S.grade(F.col("score")))


def posture(paths: DataFrame, *by: Column) -> DataFrame:
    """(critical, high, medium, low, score, grade) of all paths, or of each group of them."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in S.SEVERITY_RANK]
    return scored(paths.groupBy(*by).agg(*counts) if by else paths.agg(*counts))


def file_context(nodes: DataFrame) -> DataFrame:
    """(file_path, total_nodes, source_count, sink_count, sanitizer_count, risk_score) of each file."""
    count = lambda kind: F.count_if(F.col("type") == kind)
    grouped = nodes.groupBy("file_path").agg(F.count(F.lit(1)).alias("total_nodes"), count(SOURCE).alias("source_count"), count(SINK).alias("sink_count"), count(SANITIZER).alias("sanitizer_count"))
    risk = F.when((F.col("sink_count") > 0) & (F.col("sanitizer_count") == 0), F.col("sink_count") / (F.col("sink_count") + 1)).otherwise(F.lit(0.0))
    return grouped.withColumn("risk_score", risk)


def gate(paths: DataFrame, min_severity: str = "high") -> DataFrame:
    """(failing, passed): findings at or above a severity. ValueError for an unknown one."""
    if min_severity not in S.SEVERITY_RANK:
        raise ValueError(f"unknown severity {min_severity!r}")
    failing = F.count_if(S.severity_rank("severity") <= S.SEVERITY_RANK[min_severity])
    return paths.agg(failing.alias("failing")).withColumn("passed", F.col("failing") == 0)


def new_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.join(before.select("id").distinct(), "id", "left_anti")


def resolved_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    return new_paths(after, before)


def diff_verdict(before: DataFrame, after: DataFrame) -> DataFrame:
    """(new_count, resolved_count, verdict) of two path tables, by one join of their ids."""
    old, new = before.select("id").distinct().withColumn("old", F.lit(1)), after.select("id").distinct().withColumn("new", F.lit(1))
    counts = old.join(new, "id", "full_outer").agg(F.count_if(F.col("old").isNull()).alias("new_count"), F.count_if(F.col("new").isNull()).alias("resolved_count"))
    verdict = F.when(F.col("new_count") > F.col("resolved_count"), "degraded").when(F.col("new_count") < F.col("resolved_count"), "improved").otherwise("unchanged")
    return counts.withColumn("verdict", verdict)


def replace_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with the facts of ``files`` (column file_path) replaced: their nodes and all edges at them go first."""
    kept = nodes.join(files.select("file_path").distinct(), "file_path", "left_anti").select(nodes.columns)
    gone = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id")
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(edges.columns)
    return kept.unionByName(new_nodes), left.unionByName(new_edges).dropDuplicates(["id"])


def path_history(known: DataFrame, current: DataFrame, at) -> DataFrame:
    """A slowly changing path table (id, introduced_at, resolved_at, is_active) after a snapshot at a time.

    A path that is back after it was resolved opens again with its first introduction.
    """
    now = F.lit(at)
    seen = current.select("id").distinct().withColumn("present", F.lit(True))
    both = known.select("id", "introduced_at", "resolved_at").join(seen, "id", "full_outer")
    present = F.coalesce("present", F.lit(False))
    return both.select("id", F.coalesce("introduced_at", now).alias("introduced_at"), F.when(present, F.lit(None)).otherwise(F.coalesce("resolved_at", now)).alias("resolved_at"), present.alias("is_active"))


def calibration_rates(events: DataFrame) -> DataFrame:
    """(vuln_class, events, accepted, rejected, ignored, accept_rate) of feedback events with an ``action``."""
    of = lambda a: F.count_if(F.col("action") == a)
    grouped = events.filter(F.col("action").isin("accepted", "rejected", "ignored")).groupBy("vuln_class").agg(F.count(F.lit(1)).alias("events"), of("accepted").alias("accepted"), of("rejected").alias("rejected"), of("ignored").alias("ignored"))
    return grouped.withColumn("accept_rate", F.col("accepted") / F.col("events"))


def node_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(added): the nodes by which files have grown; files that shrank don't count."""
    counts = before.select("file_path", F.lit(-1).alias("n")).unionByName(after.select("file_path", F.lit(1).alias("n"))).groupBy("file_path").agg(F.sum("n").alias("delta"))
    return counts.agg(F.coalesce(F.sum(F.greatest(F.col("delta"), F.lit(0))), F.lit(0)).cast("long").alias("added"))

