"""More registered graph queries with their DuckDB texts beside them: rules by program, frameworks, reports, order, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions import scalar as S
from tracewarden.operators import build, extract, lines, posture, scopes, traverse
from tracewarden.plans import adapters as A
from tracewarden.plans import oracles as O
from tracewarden.schema import SANITIZER
from tracewarden.sources.shared import load, written

#: By event_id % 12: a line of Python, and what extraction finds in it as (kind, class, symbol).
PYTHON = (
    ("os.popen(q)", "SinkNode", "rce", "os.popen"), ("os.remove(q)", "SinkNode", "path_traversal", "os.remove"), ("shutil.copyfile(q, p)", "SinkNode", "path_traversal", "shutil.copyfile"),
    ("requests.post(q)", "SinkNode", "ssrf", "requests.post"), ("yaml.load(q)", "SinkNode", "deserialization", "yaml.load"), ("jinja.Markup(q)", "SinkNode", "xss", "jinja.Markup"),
    ("eval(q)", "SinkNode", "rce", "eval"), ("x = request.cookies", "SourceNode", "", "request.cookies"), ("import flask", "", "", ""), ("bleach.clean(q)", "SanitizerNode", "xss", "bleach.clean"), ("print(q)", "", "", ""), ("len(q)", "", "", ""),
)
#: By event_id % 6: a line of TypeScript.
SCRIPT = (("const u = location.href;", "SourceNode", "", "location.href"), ("const h = document.URL;", "SourceNode", "", "document.URL"), ("fs.readFile(q);", "SinkNode", "path_traversal", "readFile"), ("fetch(q);", "SinkNode", "ssrf", "fetch"), ('import express from "express";', "", "", ""), ("db.prepare(q);", "SanitizerNode", "sqli", "prepare"))
#: By event_id % 6: a line of Go.
GO = (("exec.Command(q)", "SinkNode", "rce", "exec.Command"), ("http.Get(q)", "SinkNode", "ssrf", "http.Get"), ("template.HTML(q)", "SinkNode", "xss", "template.HTML"), ("n := r.URL.Query().Get(q)", "SourceNode", "", "r.URL.Query().Get"), ('import "github.com/gin-gonic/gin"', "", "", ""), ("os.Open(q)", "SinkNode", "path_traversal", "os.Open"))
_PROGRAMS = {"python": (PYTHON, "py", "flask"), "typescript": (SCRIPT, "ts", "express"), "go": (GO, "go", "gin")}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(table: tuple, of: int) -> str:
    return f"CASE event_id % {len(table)} " + " ".join(f"WHEN {k} THEN {_quoted(x[of])}" for k, x in enumerate(table)) + " END"


def _program(spark, sf_dir, language: str) -> DataFrame:
    """The rule program of each user: a line an event, in the order of events."""
    table, ending, _ = _PROGRAMS[language]
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = load(spark, sf_dir, "events").select("*", number.alias("line"))
    return rows.selectExpr(f"'rules/u' || user_id || '.{ending}' AS file_path", "line", f"{_case(table, 0)} AS text")


def _ruled(language: str):
    def query(spark, sf_dir):
        """Nodes of the rule programs, with the framework that their imports name."""
        files = extract.source_files(A.script_files(_program(spark, sf_dir, language)))
        parsed, functions, calls = extract.facts(written(extract.syntax_events(files), "events"))
        return build.build_nodes(parsed, functions).select("file_path", F.col("line_start").cast("long").alias("line"), "type", "symbol", "vuln_class", "framework")

    return query


def _ruled_sql(language: str) -> str:
    table, ending, framework = _PROGRAMS[language]
    marked = f"bool_or(event_id % {len(table)} = {next(k for k, x in enumerate(table) if 'import' in x[0])}) OVER (PARTITION BY user_id)"
    rows = f"SELECT 'rules/u' || user_id || '.{ending}' AS file_path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, {_case(table, 1)} AS type, {_case(table, 3)} AS symbol, {_case(table, 2)} AS vuln_class, CASE WHEN {marked} THEN '{framework}' ELSE '' END AS framework, event_id FROM events"
    more = ""
    if language == "go":  # the selector within a call is a source as well
        more = " UNION ALL SELECT file_path, line, 'SourceNode', 'r.URL.Query', '', framework FROM p WHERE symbol = 'r.URL.Query().Get'"
    return f"WITH p AS ({rows}) SELECT file_path, line, type, symbol, vuln_class, framework FROM p WHERE type <> ''{more}"


def builtin_calls(spark, sf_dir):
    """Call sites of the Python rule programs: calls of builtins are none."""
    files = extract.source_files(A.script_files(_program(spark, sf_dir, "python")))
    calls = extract.facts(written(extract.syntax_events(files), "events"))[2]
    return calls.groupBy("callee").agg(F.count(F.lit(1)).alias("n"))


#: By event_id % 7: lines of nested functions.
NESTED = ("def outer' || event_id || '(q):", "    def inner' || event_id || '(q):", "        def core' || event_id || '(q):", "            run(q)", "        run(q)", "    run(q)", "run(q)")
_NESTED = "CASE event_id % 7 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(NESTED)) + " END"


def nested_callers(spark, sf_dir):
    """The innermost function around each call in programs of nested functions."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = load(spark, sf_dir, "events").select("*", number.alias("line")).selectExpr("'nest/u' || user_id AS file_path", "cast(line AS long) AS line", f"{_NESTED} AS text")
    return scopes.enclosing_functions(rows, rows.filter("text LIKE '%run(q)'"))


def updated_paths(spark, sf_dir):
    """The paths of the whole graph, from those of the graph without svc5's files and a search of the sources near them."""
    nodes, edges = A.event_nodes(spark, sf_dir), A.event_edges(spark, sf_dir)
    own = F.col("file_path").startswith("svc5/")
    ids = nodes.filter(own).select(F.col("id").alias("gone"))
    left = edges.join(ids, F.col("src") == F.col("gone"), "left_anti").join(ids, F.col("dst") == F.col("gone"), "left_anti")
    before = (nodes.filter(~own), left)
    paths = written(traverse.find_all_paths(*before), "paths")
    found = traverse.updated_paths(paths, before, (nodes, edges))
    return found.select("id", "source_id", "sink_id", F.array_join("path", ">").alias("path"), "severity")


def _orders_with_checks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The orders graph with urgent orders as sanitizers: a customer reaches a part over several orders, checked or not."""
    nodes = A.order_nodes(spark, sf_dir)
    return nodes.withColumn("type", F.when(F.col("symbol") == "1-URGENT", SANITIZER).otherwise(F.col("type"))), A.order_edges(spark, sf_dir)


def _checked(sound: bool):
    def query(spark, sf_dir):
        """Paths where some ways are sanitized: the first way decides, or with ``sound`` any clean one."""
        found = traverse.trace_first(*_orders_with_checks(spark, sf_dir), max_nodes=3, sound=sound)
        return found.select("source_id", "sink_id", F.array_join("path", ">").alias("path"))

    return query


def _checked_sql(sound: bool) -> str:
    text = O._ORDER_PATHS.replace("FROM orders JOIN customer", ", o_orderpriority = '1-URGENT' AS checked FROM orders JOIN customer") if "FROM orders JOIN customer" in O._ORDER_PATHS else O._ORDER_PATHS
    text = text.replace(" AS e , o_orderpriority", " AS e, o_orderpriority")
    pick = "arg_min(o_orderkey, [o.e, h.e]) AS via"
    if sound:
        return text.replace(f"{pick} FROM o JOIN h ON l_orderkey = o_orderkey GROUP BY ALL", f"{pick} FROM o JOIN h ON l_orderkey = o_orderkey WHERE NOT checked GROUP BY ALL")
    return text.replace(pick, f"{pick}, arg_min(checked, [o.e, h.e]) AS ended") + " WHERE NOT ended"


def ranked_findings(spark, sf_dir):
    """Findings with their place: critical first, ties by id."""
    paths = traverse.find_all_paths(A.event_nodes(spark, sf_dir), A.event_edges(spark, sf_dir), paths=False)
    places = Window.partitionBy("severity").orderBy("id")
    ranked = paths.select("id", "severity", S.severity_rank("severity").cast("long").alias("rank"), F.row_number().over(places).cast("long").alias("n"))
    counts = ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("size"))
    before = counts.join(counts.select(F.col("rank").alias("r"), F.col("size").alias("s")), F.col("r") < F.col("rank"), "left").groupBy("rank").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("before"))
    return ranked.join(before, "rank").select("id", "severity", (F.col("before") + F.col("n")).alias("place"))


def report(spark, sf_dir):
    """The report's parts as rows (section, name, value)."""
    nodes, edges = A.event_nodes(spark, sf_dir), A.event_edges(spark, sf_dir)
    parts = posture.report(nodes, written(traverse.find_all_paths(nodes, edges), "paths"))
    score = parts["score"].selectExpr("'score' AS section", "grade AS name", "score AS value")
    stats = parts["stats"].selectExpr("'stats' AS section", "type AS name", "n AS value")
    severities = parts["by_severity"].selectExpr("'severity' AS section", "severity AS name", "n AS value")
    files = parts["files"].agg(F.count(F.lit(1)).alias("value")).selectExpr("'files' AS section", "'all' AS name", "value")
    advice = parts["findings"].groupBy("remediation").agg(F.count(F.lit(1)).alias("value")).selectExpr("'findings' AS section", "remediation AS name", "value")
    return score.unionByName(stats).unionByName(severities).unionByName(files).unionByName(advice)


def module_proofs(spark, sf_dir):
    """What can be said of each service's files, whether or not paths end in them."""
    module = F.element_at(F.split("file_path", "/"), 1).alias("module")
    nodes = A.event_nodes(spark, sf_dir)
    paths = traverse.find_all_paths(nodes, A.event_edges(spark, sf_dir)).filter("vuln_class = 'sqli'").groupBy(module).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select(module).distinct().join(paths, "module", "left").select("module", S.proof(F.coalesce("n", F.lit(0))).alias("proof"))


def graph_versions(spark, sf_dir):
    return build.graph_version(A.event_nodes(spark, sf_dir), A.event_edges(spark, sf_dir))


def first_purchase(spark, sf_dir):
    """The first node of a symbol in its file order."""
    return build.first_match(A.event_nodes(spark, sf_dir), "purchase").select("id", "file_path")


def page_lines(spark, sf_dir):
    """Lines of the pages' source, trimmed: how many, how many with text, and the longest."""
    files = load(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file_path"), F.col("html").alias("content"))
    found = lines.split_lines(files).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("text") != "").alias("n_text"), F.max(F.length("text")).cast("long").alias("longest"))
    return found.select(F.col("file_path").cast("long").alias("page_id"), "n_lines", "n_text", "longest")


def request_names(spark, sf_dir):
    """Names of parameters in page addresses, by the parts between commas and signs."""
    pages = load(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", r"\?(.*)$", 1), "[&=]", ",").alias("parts"))
    return pages.select("page_id", F.explode(S.split_non_empty("parts")).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def reach_estimates(spark, sf_dir):
    """How many nodes there are, and of how many the estimated reach is within a tenth of the true one."""
    nodes, edges = A.event_nodes(spark, sf_dir), A.event_edges(spark, sf_dir)
    exact = traverse.reachable_counts(nodes, edges, nodes.select(F.col("id").alias("source_id"))).select(F.col("source_id").alias("id"), F.col("reaches").alias("exact"))
    both = traverse.reachable_estimates(nodes, edges).join(exact, "id")
    return both.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.abs(F.col("reaches") - F.col("exact")) <= 0.1 * F.col("exact")).alias("within"))


QUERIES = {f.__name__: f for f in (builtin_calls, nested_callers, updated_paths, ranked_findings, report, module_proofs, graph_versions, first_purchase, page_lines, request_names, reach_estimates)}
QUERIES |= {f"rules_{k}": _ruled(v) for k, v in (("py", "python"), ("ts", "typescript"), ("go", "go"))} | {"checked_paths": _checked(False), "checked_paths_sound": _checked(True)}

_CALLEES = {k: x[0].split("(")[0].rpartition(".")[2] for k, x in enumerate(PYTHON) if "(" in x[0] and x[0].split("(")[0] not in ("print", "len")}
_INDENT = "CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 12 WHEN 4 THEN 8 WHEN 5 THEN 4 ELSE 0 END"


def texts() -> dict[str, str]:
    found = {f"rules_{k}": _ruled_sql(v) for k, v in (("py", "python"), ("ts", "typescript"), ("go", "go"))}
    found |= {"checked_paths": _checked_sql(False), "checked_paths_sound": _checked_sql(True)}
    found["builtin_calls"] = f"SELECT CASE event_id % 12 {' '.join(f'WHEN {k} THEN {_quoted(n)}' for k, n in _CALLEES.items())} END AS callee, count(*) AS n FROM events WHERE event_id % 12 IN ({', '.join(map(str, _CALLEES))}) GROUP BY 1"
    found["nested_callers"] = f"""WITH l AS (SELECT 'nest/u' || user_id AS file_path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, {_INDENT} AS ind, CASE event_id % 7 WHEN 0 THEN 'outer' || event_id WHEN 1 THEN 'inner' || event_id WHEN 2 THEN 'core' || event_id ELSE '' END AS name FROM events),
      c AS (SELECT * FROM l WHERE name = ''), d AS (SELECT * FROM l WHERE name <> ''),
      o AS (SELECT c.file_path, c.line, d.name, d.line AS pos FROM c JOIN d ON d.file_path = c.file_path AND d.line < c.line AND d.ind < c.ind WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.file_path = c.file_path AND l.line > d.line AND l.line < c.line AND l.ind <= d.ind)),
      b AS (SELECT file_path, line, arg_max(name, pos) AS name, max(pos) AS pos FROM o GROUP BY ALL)
      SELECT c.file_path, c.line, coalesce(b.name, '') AS caller_func, coalesce(b.pos, 0) AS caller_line FROM c LEFT JOIN b ON b.file_path = c.file_path AND b.line = c.line"""
    found["updated_paths"] = f"{O._PATHS} SELECT id, source_id, sink_id, path, severity FROM paths"
    rank = O._case("severity", {"critical": 0, "high": 1, "medium": 2}, 3)
    found["ranked_findings"] = f"{O._PATHS} SELECT id, severity, row_number() OVER (ORDER BY {rank}, id) AS place FROM paths"
    found["report"] = f"""{O._PATHS}, s AS (SELECT {O._COUNTS} FROM paths), t AS (SELECT *, {O._SCORE} AS score FROM s), g AS (SELECT *, {O._GRADE} FROM t)
      SELECT 'score' AS section, grade AS name, score AS value FROM g UNION ALL SELECT 'stats', coalesce(type, 'total_nodes'), count(*) FROM n GROUP BY ROLLUP (type) UNION ALL SELECT 'severity', severity, count(*) FROM paths GROUP BY severity
      UNION ALL SELECT 'files', 'all', count(DISTINCT file_path) FROM n UNION ALL SELECT 'findings', {O._case('vuln_class', O.REMEDIATION, O.REMEDIATION_DEFAULT)}, count(*) FROM paths GROUP BY 2"""
    found["module_proofs"] = f"{O._PATHS}, c AS (SELECT {O._MODULE} AS module, count(*) AS k FROM paths WHERE vuln_class = 'sqli' GROUP BY 1) SELECT DISTINCT {O._MODULE.replace('file_path', 'n.file_path')} AS module, CASE WHEN coalesce(k, 0) = 0 THEN 'NO_UNSANITIZED_PATH_EXISTS' ELSE 'UNSANITIZED_PATHS_FOUND: ' || k || ' path(s) detected' END AS proof FROM n LEFT JOIN c ON c.module = {O._MODULE.replace('file_path', 'n.file_path')}"
    found["graph_versions"] = f"WITH {O._EDGES}, i AS (SELECT id FROM n UNION ALL SELECT substr(sha256(src || '→' || dst || '[' || type || ']'), 1, 16) FROM e) SELECT substr(sha256(count(*) || ':' || sum(('0x' || substr(sha256(id), 1, 15))::UBIGINT)), 1, 16) AS graph_version FROM i"
    found["first_purchase"] = f"WITH {O._NODES} SELECT id, file_path FROM n WHERE symbol = 'purchase' ORDER BY file_path, line_start, id LIMIT 1"
    found["page_lines"] = r"WITH l AS (SELECT page_id, trim(unnest(string_split_regex(regexp_replace(html, '\r?\n$', ''), '\r?\n'))) AS text FROM pages WHERE html <> '') SELECT page_id, count(*) AS n_lines, count(*) FILTER (text <> '') AS n_text, max(length(text))::BIGINT AS longest FROM l GROUP BY page_id"
    found["request_names"] = r"WITH p AS (SELECT unnest(string_split(regexp_replace(regexp_extract(url, '\?(.*)$', 1), '[&=]', ',', 'g'), ',')) AS part FROM pages) SELECT part, count(*) AS n FROM p WHERE part <> '' GROUP BY part"
    found["reach_estimates"] = "SELECT count(*) AS nodes, count(*) AS within FROM events"
    return found
