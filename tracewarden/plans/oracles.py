"""DuckDB texts of the registered graph queries."""

from __future__ import annotations

from tracewarden.functions.rules import LINE_RULES
from tracewarden.functions.scalar import REMEDIATION, REMEDIATION_DEFAULT, SEVERITY
from tracewarden.plans.adapters import _CALLED, _CLASS, _NAME, CODE, ENDING, EVENT, SCRIPT

SECRET = r'''(token|secret|password|api_key)\s*[=:]\s*["'][^"']+["']'''


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(column: str, table: dict[str, object], default: object) -> str:
    show = lambda v: _quoted(v) if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {_quoted(k)} THEN {show(v)}" for k, v in table.items()) + f" ELSE {show(default)} END"


_SEV = lambda c: _case(c, SEVERITY, "low")
_NODES = f"""n AS (SELECT event_id, user_id, ts, {EVENT['id']} AS id, {EVENT['type']} AS type, {EVENT['file_path']} AS file_path, CAST(event_id % 1000 AS INT) AS line_start, {EVENT['symbol']} AS symbol, {EVENT['vuln_class']} AS vuln_class, {EVENT['variable']} AS v,
  event_type = 'click' AS is_call, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pv FROM events)"""
_WALK = """p AS (SELECT event_id AS src, event_id AS node, 1 AS len, id AS path, false AS san, {cleared} AS cl, v AS vars, type, vuln_class FROM n WHERE type = 'SourceNode'
  UNION ALL SELECT p.src, m.event_id, p.len + 1, p.path || '>' || m.id, p.san OR m.type = 'SanitizerNode', {clear}, CASE WHEN f.is_call THEN m.v ELSE p.vars END, m.type, m.vuln_class
  FROM p JOIN n f ON f.event_id = p.node JOIN n m ON m.event_id = f.nx WHERE p.len < 20 AND NOT (p.type = 'SinkNode' AND {clean}) AND (NOT f.is_call OR f.v = p.vars))"""
_RECORD = f"""paths AS (SELECT substr(sha256(s.id || k.id), 1, 16) AS id, s.id AS source_id, k.id AS sink_id, p.path AS path, CAST(p.len AS INT) AS path_length, k.vuln_class AS vuln_class, {_SEV('k.vuln_class')} AS severity, CASE WHEN p.len <= 2 THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END AS confidence, k.file_path AS file_path,
  s.symbol || ' (' || s.file_path || ') flows to ' || k.symbol || ' (' || k.file_path || ') without sanitization' AS description, s.file_path AS source_file, k.symbol AS sink_symbol
  FROM p JOIN n s ON s.event_id = p.src JOIN n k ON k.event_id = p.node WHERE p.type = 'SinkNode' AND {{clean}})"""
_FLAT = "id, source_id, sink_id, path, path_length, vuln_class, severity, confidence, file_path"


def _with(clean: str = "NOT p.san", cleared: str = "''", clear: str = "p.cl") -> str:
    return f"WITH RECURSIVE {_NODES}, {_WALK.format(clean=clean, cleared=cleared, clear=clear)}, {_RECORD.format(clean=clean)}"


_PATHS = _with()
_AWARE = _with("NOT contains(p.cl, '<' || p.vuln_class || '>')", "''", "CASE WHEN m.type = 'SanitizerNode' THEN p.cl || '<' || m.vuln_class || '>' ELSE p.cl END")
_PLAIN = f"""WITH RECURSIVE {_NODES}, p AS (SELECT event_id AS src, event_id AS node, 1 AS len, id AS path, false AS san, type, vuln_class FROM n WHERE type = 'SourceNode'
  UNION ALL SELECT p.src, m.event_id, p.len + 1, p.path || '>' || m.id, p.san OR m.type = 'SanitizerNode', m.type, m.vuln_class FROM p JOIN n f ON f.event_id = p.node JOIN n m ON m.event_id = f.nx WHERE p.len < 20), {_RECORD.format(clean='NOT p.san')}"""
_ORDER = f"{_NODES}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM n)"
_EDGES = f"{_NODES}, e AS (SELECT n.id AS src, 'e' || n.nx AS dst, CASE WHEN n.is_call THEN 'call' ELSE 'dataflow' END AS type FROM n WHERE nx IS NOT NULL)"
_MODULE = "split_part(file_path, '/', 1)"
_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade"
_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low"))
_SCORE = "CAST(greatest(0, 100 - 25 * critical - 15 * high - 5 * medium - 2 * low) AS BIGINT)"


def _code(language: str) -> str:
    return f"c AS (SELECT 'repo/u' || user_id AS file_path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, {CODE[language]} AS text, event_id FROM events)"


_ASSIGN = "CASE WHEN strpos(text, ' = ') > 1 THEN CASE WHEN strpos(trim(left(text, strpos(text, ' = ') - 1)), ':') > 1 THEN trim(split_part(trim(left(text, strpos(text, ' = ') - 1)), ':', 1)) ELSE trim(left(text, strpos(text, ' = ') - 1)) END ELSE '' END"
_GO_ASSIGN = "CASE WHEN strpos(text, ' := ') > 1 THEN trim(split_part(left(text, strpos(text, ' := ') - 1), ',', 1)) ELSE '' END"


def _call(pattern: str) -> str:
    return rf"list_last(list_filter(regexp_split_to_array(regexp_replace(regexp_extract(text, {_quoted(pattern)}), '\($', ''), '[. \t]'), lambda x: x <> ''))"


def _rules(language: str) -> str:
    parts = []
    for n, r in enumerate(x for x in LINE_RULES if x.language == language):
        symbol = _call(r.pattern) if r.symbol == "call" else f"'{r.symbol[6:]}' || regexp_extract(text, {_quoted(r.pattern)}, 1)" if r.symbol.startswith("group:") else _quoted(r.symbol)
        tainted = {"assign": _ASSIGN, "go_assign": _GO_ASSIGN, "": "''"}.get(r.target, _quoted(r.target))
        if r.name == "ts_req":
            tainted = f"{_ASSIGN} || ',' || {symbol}"
        parts.append(f"SELECT file_path, line, {_quoted(r.name)} AS rule, '{r.kind}' AS kind, {symbol} AS symbol, '{r.vuln_class}' AS vuln_class, {tainted} AS tainted_vars, text, line * 100 + {n} AS ord FROM c WHERE regexp_matches(text, {_quoted(r.pattern)})")
    return "r AS (" + " UNION ALL ".join(parts) + ")"


_PARSED = f"{_code('python')}, {_rules('python')}, k AS (SELECT *, substr(sha256(file_path || ':' || line || ':' || symbol), 1, 16) AS id FROM r), x AS (SELECT file_path, line, arg_max(id, ord) AS line_id FROM k GROUP BY ALL)"
_FUNCS = f"{_code('python')}, f AS (SELECT file_path, line, 'handler' || (event_id % 7) AS name, substr(sha256(file_path || ':' || line || ':handler' || (event_id % 7)), 1, 16) AS func_id FROM c WHERE event_id % 12 = 5), s AS (SELECT file_path, line, 'handler' || (event_id % 7) AS caller, 'handler' || ((event_id + 3) % 7) AS callee FROM c WHERE event_id % 12 IN (1, 2))"
_LAST = "last AS (SELECT name, arg_max(func_id, (file_path, line)) AS func_id, arg_max(file_path, (file_path, line)) AS func_file FROM f GROUP BY name)"
_SEEN = "seen AS (SELECT s.file_path AS at, f.name, arg_max(f.func_id, (f.file_path, f.line)) AS func_id FROM (SELECT DISTINCT file_path FROM s) s JOIN f ON f.file_path <= s.file_path GROUP BY ALL)"
_CALLS = "SELECT substr(sha256(src || '→' || dst || '[call]'), 1, 16) AS id, src, dst, arg_max(CAST(line AS VARCHAR), (file_path, line)) AS call_line FROM g WHERE src <> dst GROUP BY src, dst"
_DIFF = f"{_PATHS}, a AS (SELECT id, severity FROM paths WHERE NOT starts_with(file_path, 'svc1/')), b AS (SELECT id, severity FROM paths WHERE NOT starts_with(file_path, 'svc2/'))"
_ORDERS = f"""p AS (SELECT DISTINCT c_custkey, n_name, p_partkey, p_size FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"""


def _script(language: str) -> str:
    return f"""c AS (SELECT 'repo/u' || user_id || '.{ENDING[language]}' AS file_path, row_number() OVER u AS line, {SCRIPT[language]} AS text, {_NAME} AS own, {_CALLED} AS called, event_id AS e, event_id % 8 AS k, user_id, count(*) OVER (PARTITION BY user_id) AS n,
  coalesce(lag(event_id % 16 = 12) OVER u, false) AS decorated FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))"""


#: What extraction finds in the programs: (kinds of lines, fact, name, detail).
_FACTS = {
    "python": (
        ("k = 0", "function", "own", "CASE WHEN decorated THEN 'q,n true' ELSE 'q,n false' END"), ("k = 0 AND decorated", "node", "'q'", "'SourceNode  q'"), ("k = 0 AND decorated", "node", "'n'", "'SourceNode  n'"),
        ("k = 1", "call", "called", "f || ' q,x' || e"), ("k = 2", "call", "'execute'", "f || ' q' || e"), ("k = 2", "node", "'cursor.execute'", "'SinkNode sqli '"),
        ("k = 3", "call", "'get'", "f || ' q'"), ("k = 3", "node", "'request.args'", "'SourceNode  request.args'"), ("e % 16 = 12", "call", "'get'", "f || ' q'"),
        ("k = 5", "call", "'escape'", "f || ' q'"), ("k = 5", "node", "'escape'", "'SanitizerNode xss '"), ("k = 7", "call", "'run'", "f || ' q'"), ("k = 7", "node", "'subprocess.run'", "'SinkNode rce '"),
    ),
    "typescript": (
        ("k = 0", "function", "own", "'q,n false'"), ("k = 4", "function", "'f' || e", "'a,b false'"), ("k = 1", "call", "called", "' q,x' || e"), ("k = 2", "call", "'write'", "' q'"), ("k = 2", "node", "'write'", "'SinkNode xss '"),
        ("k = 3", "node", "'req.query'", "'SourceNode  req.query'"), ("k = 5", "call", "'encodeURIComponent'", "' '"), ("k = 5", "call", "'run' || e", "' q'"), ("k = 5", "node", "'encodeURIComponent'", "'SanitizerNode xss '"), ("k = 7", "call", "'exec'", "' q'"), ("k = 7", "node", "'exec'", "'SinkNode rce '"),
    ),
    "go": (
        ("k = 0", "function", "own", "'q,n false'"), ("k = 4", "function", "'m' || e", "'w,r true'"), ("k = 1", "call", "called", "' q,x' || e"), ("k = 2", "call", "'Exec'", "' q'"), ("k = 2", "node", "'db' || e || '.Exec'", "'SinkNode sqli '"),
        ("k = 3", "call", "'FormValue'", "' q'"), ("k = 3", "node", "'r.FormValue'", "'SourceNode  r'"), ("k = 5", "call", "'EscapeString'", "' '"), ("k = 5", "node", "'html.EscapeString'", "'SanitizerNode xss '"), ("k = 7", "call", "'Open'", "' q'"), ("k = 7", "node", "'os.Open'", "'SinkNode path_traversal '"),
    ),
}


def _extracted(language: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{fact}' AS fact, file_path, line, {name} AS name, {detail} AS detail FROM g WHERE {kinds}" for kinds, fact, name, detail in _FACTS[language])
    return f"WITH {_script(language)}, d AS (SELECT file_path, arg_min(own, line) AS f FROM c WHERE k = 0 GROUP BY file_path), g AS (SELECT c.*, coalesce(f, '') AS f FROM c LEFT JOIN d USING (file_path)) {rows}"


_IMPORTED = {"python": "'p' || e", "typescript": "'m' || e", "go": "'m' || e"}
_INCREMENTAL = f"""WITH {_script('python')}, l AS (SELECT * FROM c WHERE user_id % 10 <> 9 AND (user_id % 2 = 0 OR 2 * line <= n)), d AS (SELECT file_path, arg_min(own, line) AS caller FROM l WHERE k = 0 GROUP BY file_path),
  f AS (SELECT file_path, line, own AS name, substr(sha256(file_path || ':' || line || ':' || own), 1, 16) AS func_id FROM l WHERE k = 0), s AS (SELECT l.file_path, line, caller, called AS callee FROM l JOIN d USING (file_path) WHERE k = 1), {_LAST},
  g AS (SELECT a.func_id AS src, b.func_id AS dst, s.line, s.file_path FROM s JOIN last a ON a.name = caller JOIN last b ON b.name = callee) {_CALLS}"""
_EDGE = "substr(sha256('{a}' || {x} || '→' || '{b}' || {y} || '[dataflow]'), 1, 16)"
_ORDER_PATHS = f"""WITH o AS (SELECT o_custkey, o_orderkey, {_EDGE.format(a='c', x='o_custkey', b='o', y='o_orderkey')} AS e FROM orders JOIN customer ON c_custkey = o_custkey), h AS (SELECT DISTINCT l_orderkey, l_partkey, {_EDGE.format(a='o', x='l_orderkey', b='p', y='l_partkey')} AS e FROM lineitem JOIN part ON p_partkey = l_partkey),
  w AS (SELECT 'c' || o_custkey AS source_id, 'p' || l_partkey AS sink_id, arg_min(o_orderkey, [o.e, h.e]) AS via FROM o JOIN h ON l_orderkey = o_orderkey GROUP BY ALL) SELECT source_id, sink_id, source_id || '>o' || via || '>' || sink_id AS path FROM w"""


def texts() -> dict[str, str]:
    order_class = _CLASS.replace("event_id", "p_size")
    advice = _case("vuln_class", REMEDIATION, REMEDIATION_DEFAULT)
    found = {
        "find_all_paths": f"{_PATHS} SELECT {_FLAT} FROM paths",
        "sound_paths": f"{_PATHS} SELECT {_FLAT} FROM paths",
        "class_aware_paths": f"{_AWARE} SELECT {_FLAT} FROM paths",
        "missing_sanitizers": f"{_PATHS} SELECT id, vuln_class, severity, description, source_file, file_path AS sink_file, sink_symbol, {advice} AS remediation FROM paths",
        "paths_to_sink_class": f"{_PLAIN} SELECT {_FLAT} FROM paths WHERE contains(vuln_class, 'sqli')",
        "paths_to_sink_file": f"{_PLAIN} SELECT {_FLAT} FROM paths WHERE contains(file_path, 'svc7/')",
        "trace_flow": f"WITH RECURSIVE {_NODES}, w AS (SELECT nx AS node, 1::BIGINT AS depth FROM n WHERE event_id = (SELECT arg_min(event_id, (ts, event_id)) FROM events WHERE event_type = 'signup') AND nx IS NOT NULL UNION ALL SELECT n.nx, depth + 1 FROM w JOIN n ON n.event_id = w.node WHERE n.nx IS NOT NULL) SELECT n.id, n.type, depth FROM w JOIN n ON n.event_id = w.node",
        "reach_counts": f"WITH {_ORDER} SELECT id AS source_id, count(*) OVER w - 1 AS reaches, count(*) FILTER (type = 'SinkNode') OVER w - (type = 'SinkNode')::BIGINT AS sinks FROM o WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
        "order_reaches": """WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS o, 'p' || l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey), c AS (SELECT 'c' || o_custkey AS c, 'o' || o_orderkey AS o FROM orders JOIN customer ON c_custkey = o_custkey),
  n AS (SELECT 'c' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'o' || o_orderkey FROM orders UNION ALL SELECT 'p' || p_partkey FROM part),
  t AS (SELECT c AS id, o AS x FROM c UNION SELECT c, p FROM c JOIN e USING (o) UNION SELECT o, p FROM e) SELECT id AS source_id, count(x) AS reaches, count(*) FILTER (x LIKE 'p%') AS sinks FROM n LEFT JOIN t USING (id) GROUP BY id""",
        "trace_flow_whole": f"WITH {_ORDER} SELECT b.id, b.type, b.k - a.k AS depth FROM o a JOIN o b ON b.user_id = a.user_id AND b.k > a.k WHERE a.event_id = (SELECT arg_min(event_id, (ts, event_id)) FROM events WHERE event_type = 'signup')",
        "reach_counts_whole": f"WITH {_ORDER} SELECT arg_min(id, k) AS source_id, count(*) - 1 AS reaches, count(*) FILTER (type = 'SinkNode' AND k > 1) AS sinks FROM o GROUP BY user_id",
        "trace_flow_all": f"WITH {_ORDER} SELECT a.id AS source_id, b.id, b.type, b.k - a.k AS depth FROM o a JOIN o b ON b.user_id = a.user_id AND b.k > a.k WHERE a.type = 'SourceNode'",
        "blast_nodes_all": f"WITH {_ORDER} SELECT a.id AS node_id, b.id, b.type, b.file_path FROM o a JOIN o b ON b.user_id = a.user_id AND b.k <= a.k WHERE a.type = 'SinkNode'",
        "blast_paths_all": f"{_PATHS}, u AS (SELECT *, unnest(string_split(path, '>')) AS node_id FROM paths) SELECT node_id, {', '.join('u.' + c for c in _FLAT.split(', '))} FROM u JOIN n ON n.id = node_id WHERE n.type = 'SinkNode'",
        "attack_surface": f"{_PATHS} SELECT (SELECT count(*) FROM n WHERE type = 'SourceNode') AS source_count, count(*) AS taint_path_count, count(DISTINCT sink_id) AS reachable_sink_count FROM paths",
        "attack_surface_module": f"{_PATHS} SELECT {_MODULE.replace('file_path', 'n.file_path')} AS module, count(DISTINCT n.id) AS source_count, count(DISTINCT sink_id) AS reachable_sink_count, count(sink_id) AS taint_path_count FROM n LEFT JOIN paths ON paths.source_id = n.id WHERE n.type = 'SourceNode' GROUP BY 1",
        "blast_nodes": f"WITH RECURSIVE {_NODES}, w AS (SELECT arg_max(event_id, (ts, event_id)) AS node FROM events WHERE event_type = 'purchase' UNION ALL SELECT n.pv FROM w JOIN n ON n.event_id = w.node WHERE n.pv IS NOT NULL) SELECT id, type, file_path FROM w JOIN n ON n.event_id = w.node",
        "blast_paths": f"{_PATHS} SELECT {_FLAT} FROM paths WHERE list_contains(string_split(path, '>'), 'e' || (SELECT arg_max(event_id, (ts, event_id)) FROM events WHERE event_type = 'purchase'))",
        "node_stats": f"WITH {_NODES} SELECT coalesce(type, 'total_nodes') AS type, count(*) AS n FROM n GROUP BY ROLLUP (type)",
        "edge_stats": f"WITH {_EDGES} SELECT type, count(DISTINCT src || dst) AS n FROM e GROUP BY type",
        "live_edges": f"WITH {_EDGES} SELECT count(*) AS n FROM e",
        "out_degrees": "SELECT src, count(DISTINCT dst) AS out_degree FROM (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem) GROUP BY src",
        "nodes_by_type": f"WITH {_NODES} SELECT id, symbol, vuln_class, {_SEV('vuln_class')} AS severity FROM n WHERE type = 'SinkNode'",
        "nodes_by_file": f"WITH {_NODES} SELECT id, type, file_path FROM n WHERE starts_with(file_path, 'svc3/')",
        "stable_ids": f"WITH {_NODES} SELECT id, substr(sha256(file_path || ':' || line_start || ':' || symbol), 1, 16) AS node_id, substr(sha256(id || '→' || id || '[dataflow]'), 1, 16) AS edge_id, substr(sha256(id || id), 1, 16) AS path_id FROM n",
        "severity_map": f"WITH {_NODES} SELECT vuln_class, {_SEV('vuln_class')} AS severity, {_case(_SEV('vuln_class'), {'critical': 0, 'high': 1, 'medium': 2}, 3)}::BIGINT AS rank, {advice} AS remediation, count(*) AS n FROM n WHERE type = 'SinkNode' GROUP BY ALL",
        "assign_targets": f"WITH {_code('python')} SELECT event_id, {_ASSIGN} AS target FROM c",
        "go_assign_targets": f"WITH {_code('go')} SELECT event_id, {_GO_ASSIGN} AS target FROM c",
        "call_names": f"WITH {_code('python')} SELECT event_id, {_call(LINE_RULES[3].pattern)} AS call FROM c WHERE regexp_matches(text, {_quoted(LINE_RULES[3].pattern)})",
        "param_lists": f"WITH {_code('python')} SELECT event_id, array_to_string(list_transform(list_filter(list_transform(string_split(regexp_extract(text, '\\(([^)]*)\\)', 1), ','), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '*')), lambda x: trim(split_part(split_part(x, ':', 1), '=', 1))), ',') AS params FROM c WHERE starts_with(text, 'def ')",
        "line_index": f"WITH {_PARSED} SELECT file_path, line, line_id FROM x",
        "dataflow_edges": f"WITH {_PARSED}, s AS (SELECT k.file_path, tainted_vars AS t, line_id AS src FROM k JOIN x USING (file_path, line) WHERE kind = 'SourceNode' AND tainted_vars <> ''), z AS (SELECT k.file_path, text, line_id AS dst FROM k JOIN x USING (file_path, line) WHERE kind = 'SinkNode') SELECT substr(sha256(src || '→' || dst || '[dataflow]'), 1, 16) AS id, src, dst, min(t) AS tainted_var FROM s JOIN z USING (file_path) WHERE contains(text, t) GROUP BY src, dst",
        "func_registry": f"WITH {_FUNCS}, {_LAST} SELECT name, func_id, func_file FROM last",
        "call_edges": f"WITH {_FUNCS}, {_LAST}, g AS (SELECT a.func_id AS src, b.func_id AS dst, s.line, s.file_path FROM s JOIN last a ON a.name = caller JOIN last b ON b.name = callee) {_CALLS}",
        "call_edges_ordered": f"WITH {_FUNCS}, {_SEEN}, g AS (SELECT a.func_id AS src, b.func_id AS dst, s.line, s.file_path FROM s JOIN seen a ON a.at = s.file_path AND a.name = caller JOIN seen b ON b.at = s.file_path AND b.name = callee) {_CALLS}",
        "findings_by_severity": f"{_PATHS} SELECT severity, count(*) AS n FROM paths GROUP BY severity",
        "posture_score": f"{_PATHS}, s AS (SELECT {_COUNTS} FROM paths), t AS (SELECT *, {_SCORE} AS score FROM s) SELECT *, {_GRADE} FROM t",
        "posture_by_module": f"{_PATHS}, s AS (SELECT {_MODULE} AS module, {_COUNTS} FROM paths GROUP BY 1), t AS (SELECT *, {_SCORE} AS score FROM s) SELECT *, {_GRADE} FROM t",
        "file_context": f"WITH {_NODES}, g AS (SELECT file_path, count(*) AS total_nodes, count(*) FILTER (type = 'SourceNode') AS source_count, count(*) FILTER (type = 'SinkNode') AS sink_count, count(*) FILTER (type = 'SanitizerNode') AS sanitizer_count FROM n GROUP BY file_path) SELECT *, CASE WHEN sink_count > 0 AND sanitizer_count = 0 THEN sink_count / (sink_count + 1)::DOUBLE ELSE 0.0::DOUBLE END AS risk_score FROM g",
        "gate_high": f"{_PATHS} SELECT count(*) FILTER (severity IN ('critical', 'high')) AS failing, count(*) FILTER (severity IN ('critical', 'high')) = 0 AS passed FROM paths",
        "path_depth_hist": f"{_PATHS} SELECT path_length::BIGINT AS path_length, count(*) AS n FROM paths GROUP BY 1",
        "diff_new": f"{_DIFF} SELECT id, severity FROM b WHERE id NOT IN (SELECT id FROM a)",
        "diff_resolved": f"{_DIFF} SELECT id, severity FROM a WHERE id NOT IN (SELECT id FROM b)",
        "diff_verdict": f"{_DIFF}, v AS (SELECT (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS new_count, (SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM b)) AS resolved_count) SELECT *, CASE WHEN new_count > resolved_count THEN 'degraded' WHEN new_count < resolved_count THEN 'improved' ELSE 'unchanged' END AS verdict FROM v",
        "path_history": f"{_DIFF} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN '2024-02-01' ELSE '2024-01-01' END AS introduced_at, CASE WHEN b.id IS NULL THEN '2024-02-01' END AS resolved_at, b.id IS NOT NULL AS is_active FROM a FULL JOIN b ON a.id = b.id",
        "latest_change": "WITH g AS (SELECT 'u' || user_id AS path, ts, event_id, event_type = 'error' AS is_delete, coalesce(epoch(ts) - lag(epoch(ts)) OVER w > 600, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(fresh::BIGINT) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM g) SELECT path, burst::BIGINT AS burst, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(is_delete, (ts, event_id)) AS is_delete, count(*) AS n FROM b GROUP BY path, burst",
        "file_replace": f"WITH {_EDGES}, g AS (SELECT id FROM n WHERE starts_with(file_path, 'svc5/')) SELECT type, count(*) AS n FROM n WHERE id NOT IN (SELECT id FROM g) GROUP BY type UNION ALL SELECT type, count(*) AS n FROM e WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g) GROUP BY type",
        "calibration_rates": f"WITH a AS (SELECT CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'ignored' END AS action, {_CLASS} AS vuln_class FROM events) SELECT vuln_class, count(action) AS events, count(*) FILTER (action = 'accepted') AS accepted, count(*) FILTER (action = 'rejected') AS rejected, count(*) FILTER (action = 'ignored') AS ignored, count(*) FILTER (action = 'accepted') / count(action)::DOUBLE AS accept_rate FROM a WHERE action IS NOT NULL GROUP BY vuln_class",
        "order_surface": f"WITH {_ORDERS} SELECT n_name AS module, count(*) AS paths, count(DISTINCT p_partkey) AS sinks FROM p GROUP BY n_name",
        "order_findings": f"WITH {_ORDERS}, q AS (SELECT *, {order_class} AS vuln_class FROM p) SELECT vuln_class, {_SEV('vuln_class')} AS severity, count(*) AS n, count(DISTINCT p_partkey) AS sinks FROM q GROUP BY ALL",
        "request_parameters": r"WITH q AS (SELECT regexp_extract(url, '^https?://([^/?]+)', 1) AS host, regexp_extract(url, '\?(.*)$', 1) AS query FROM pages), u AS (SELECT host, split_part(unnest(string_split(query, '&')), '=', 1) AS parameter FROM q WHERE query <> '') SELECT host, parameter, count(*) AS n FROM u GROUP BY ALL",
        "secret_lines": f"SELECT doc_id, regexp_extract(text, {_quoted(SECRET)}, 1) AS kind FROM documents WHERE regexp_matches(text, {_quoted(SECRET)})",
    }
    found["line_imports"] = " UNION ALL ".join(f"(WITH {_script(k)} SELECT file_path, line, {v} AS package FROM c WHERE k = 6)" for k, v in _IMPORTED.items())
    found["line_functions"] = f"(WITH {_script('python')} SELECT file_path, line, own AS name, 'q,n' AS params, decorated AS is_handler FROM c WHERE k = 0) UNION ALL (WITH {_script('go')} SELECT file_path, line, CASE k WHEN 0 THEN own ELSE 'm' || e END, CASE k WHEN 0 THEN 'q,n' ELSE 'w,r' END, k = 4 FROM c WHERE k IN (0, 4))"
    found["incremental_calls"] = _INCREMENTAL
    found["page_script_calls"] = r"WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS body FROM pages), c AS (SELECT page_id, unnest(regexp_extract_all(body, '([A-Za-z_$][A-Za-z0-9_$]*)\(', 1)) AS callee FROM s) SELECT page_id, callee, count(*) AS n FROM c GROUP BY ALL"
    found["graph_delta"] = f"WITH {_NODES}, h AS (SELECT (min(event_id) + max(event_id)) // 2 AS m FROM events), d AS (SELECT file_path, count(*) FILTER (event_id > m) AS n FROM n, h GROUP BY file_path) SELECT coalesce(sum(n), 0)::BIGINT AS added FROM d"
    found["order_paths"] = _ORDER_PATHS
    for key, language in (("py", "python"), ("ts", "typescript"), ("go", "go")):
        found[f"extracted_{key}"] = _extracted(language)
        found[f"classify_lines_{key}"] = f"WITH {_code(language)}, {_rules(language)} SELECT file_path, line, rule, kind, symbol, vuln_class, tainted_vars FROM r"
    return found
