"""Line-regex classification of source text, JVM-side: one pass over the lines evaluates all rules of a language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions import scalar as S
from tracewarden.functions.rules import GO_HANDLER, HEADERS, LINE_IMPORTS, LINE_RULES, PYTHON_ROUTE, LineRule


def split_lines(files: DataFrame) -> DataFrame:
    """(file_path, line, text) of (file_path, content): lines from 1, trimmed, without a last empty one."""
    content = F.regexp_replace("content", r"\r?\n$", "")
    parts = F.posexplode(F.split(content, r"\r?\n")).alias("pos", "text")
    return files.filter("content <> ''").select("file_path", parts).select("file_path", (F.col("pos") + 1).alias("line"), F.trim("text").alias("text"))


def symbol_of(rule: LineRule, text: Column) -> Column:
    if rule.symbol == "call":
        return S.call_name(text, rule.pattern)
    if rule.symbol.startswith("group:"):
        return F.concat(F.lit(rule.symbol[6:]), F.regexp_extract(text, rule.pattern, 1))
    return F.lit(rule.symbol)


def _tainted(rule: LineRule, text: Column) -> Column:
    targets = {"assign": [S.assign_target(text)], "go_assign": [S.go_assign_target(text)], "": []}.get(rule.target, [F.lit(rule.target)])
    if rule.name == "ts_req":
        targets.append(symbol_of(rule, text))
    return F.array(*targets).cast("array<string>")


def classify_lines(lines: DataFrame, language: str) -> DataFrame:
    """Parsed nodes of (file_path, line, text): each rule emits at most one for a line, in rule order."""
    text = F.col("text")
    found = []
    for n, rule in enumerate(r for r in LINE_RULES if r.language == language):
        fact = F.struct(F.lit(n).alias("n"), F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"), symbol_of(rule, text).alias("symbol"), F.lit(rule.vuln_class).alias("vuln_class"), _tainted(rule, text).alias("tainted_vars"))
        found.append(F.when(text.rlike(rule.pattern), fact))
    facts = lines.select("file_path", "line", "text", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    return facts.select("file_path", (F.col("line").cast("long") * 100 + F.col("f.n")).alias("ord"), "f.kind", "f.symbol", "f.vuln_class", F.lit("").alias("framework"), F.col("line").cast("int").alias("line"), "text", "f.tainted_vars", "f.rule")


def line_imports(lines: DataFrame, language: str) -> DataFrame:
    """(file_path, line, package): at most one import of each line; of Go, only within an import block or on a line of its own."""
    found = lines.withColumn("package", F.regexp_extract("text", LINE_IMPORTS[language], 1))
    if language == "go":
        opens, closes = F.col("text") == "import (", F.col("text") == ")"
        above = Window.partitionBy("file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
        state = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(above)
        found = found.withColumn("inside", F.coalesce(state, F.lit(False))).filter((F.col("inside") & ~opens & ~closes) | F.col("text").startswith('import "'))
    return found.filter("package <> ''").select("file_path", "line", "package")


def line_functions(lines: DataFrame, language: str) -> DataFrame:
    """(file_path, line, name, params, is_handler) of Python and Go function headers. A Python function is a handler where a route
    decorates it on the line before, a Go one where it takes a response writer and a request."""
    text = F.col("text")
    if language == "python":
        route = text.rlike(PYTHON_ROUTE) | text.contains("@app.route") | text.contains("@blueprint.route")
        handler = F.coalesce(F.lag(route).over(Window.partitionBy("file_path").orderBy("line")), F.lit(False))
    else:
        handler = text.rlike(GO_HANDLER)
    params = (S.python_params if language == "python" else S.go_params)(F.regexp_extract("text", HEADERS[language], 2))
    return lines.withColumn("is_handler", handler).filter(text.rlike(HEADERS[language])).select("file_path", "line", F.regexp_extract("text", HEADERS[language], 1).alias("name"), params.alias("params"), "is_handler")
