"""Traversals, construction, extraction, posture, store and stream."""

import datetime
import hashlib
import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tracewarden import schema
from tracewarden.functions import scalar as S
from tracewarden.graph import SecurityGraph
from tracewarden.operators import build, extract, posture, traverse
from tracewarden.sources.repository import scan
from tracewarden.sources.store import FactStore
from tracewarden.streaming import changes


def graph(spark, nodes, edges):
    """nodes: id -> (type, options); edges: (src, dst[, type, args])."""
    rows = [(i, {"S": "SourceNode", "K": "SinkNode", "Z": "SanitizerNode", "F": "FunctionNode"}[t], o.get("file", f"{i}.py"), 1, 1, o.get("symbol", i), "", o.get("cls", ""), 0.85, o.get("params", []), o.get("vars", [])) for i, (t, o) in nodes.items()]
    full = [(hashlib.sha256(f"{e[0]}→{e[1]}[{e[2] if len(e) > 2 else 'dataflow'}]".encode()).hexdigest()[:16], e[0], e[1], e[2] if len(e) > 2 else "dataflow", e[3] if len(e) > 3 else [], {}) for e in edges]
    return spark.createDataFrame(rows, schema.NODES), spark.createDataFrame(full, schema.EDGES)


def pairs(df):
    return sorted((r["source_id"], r["sink_id"], tuple(r["path"])) for r in df.collect())


def model(nodes, edges, most=20):
    """A plain queue search with first arrivals by (node, length)."""
    out_edges = {}
    for e in sorted(edges, key=lambda e: hashlib.sha256(f"{e[0]}→{e[1]}[{e[2]}]".encode()).hexdigest()[:16]):
        out_edges.setdefault(e[0], []).append(e)
    found = {}
    for s, (t, o) in nodes.items():
        if t != "S":
            continue
        queue, seen = deque([(s, (s,), False, o.get("vars") or [o.get("symbol", s)])]), set()
        while queue:
            n, path, clean, taint = queue.popleft()
            if len(path) > most or (n, len(path)) in seen:
                continue
            seen.add((n, len(path)))
            if nodes[n][0] == "K" and not clean:
                found.setdefault((s, n), path)
                continue
            for _, d, kind, args in out_edges.get(n, []):
                if d not in nodes or kind == "call" and not set(args) & set(taint):
                    continue
                queue.append((d, (*path, d), clean or nodes[d][0] == "Z", (nodes[d][1].get("params") or taint) if kind == "call" else taint))
    return sorted((*k, p) for k, p in found.items())


def test_small_graphs(spark):
    g = graph(spark, {"a": ("S", {}), "b": ("K", {"cls": "sqli"})}, [("a", "b")])
    r = traverse.find_all_paths(*g).first()
    assert (r["vuln_class"], r["severity"], r["confidence"], r["path_length"], r["id"]) == ("sqli", "high", 0.95, 2, hashlib.sha256(b"ab").hexdigest()[:16])
    assert r["description"] == "a (a.py) flows to b (b.py) without sanitization"
    assert pairs(traverse.find_all_paths(*graph(spark, {"a": ("S", {}), "z": ("Z", {}), "b": ("K", {})}, [("a", "z"), ("z", "b")]))) == []
    inter = {"s": ("S", {"vars": ["name"]}), "f": ("F", {"params": ["name"]}), "h": ("F", {"params": ["q"]}), "k": ("K", {"cls": "sqli"})}
    calls = [("s", "f"), ("f", "h", "call", ["name"]), ("h", "k")]
    r = traverse.find_all_paths(*graph(spark, inter, calls)).first()
    assert (r["path"], r["confidence"]) == (["s", "f", "h", "k"], 0.85)
    calls[1] = ("f", "h", "call", ["other_var"])
    assert pairs(traverse.find_all_paths(*graph(spark, inter, calls))) == []


def test_search_through_sinks_and_back(spark):
    nodes = {"s": ("S", {}), "m": ("K", {"cls": "xss"}), "k": ("K", {"cls": "rce", "file": "lib/x.py"})}
    n, e = graph(spark, nodes, [("s", "m"), ("m", "k"), ("k", "s")])
    assert pairs(traverse.find_all_paths(n, e)) == [("s", "m", ("s", "m"))]
    assert pairs(traverse.paths_to_sink(n, e, "rce")) == [("s", "k", ("s", "m", "k"))]
    assert len(pairs(traverse.paths_to_sink(n, e, ""))) == 2
    reached, paths = traverse.blast_radius(n, e, "m")
    assert {r["id"] for r in reached.collect()} == {"s", "m", "k"} and paths.count() == 1
    assert [(r["id"], r["depth"]) for r in traverse.trace_data_flow(n, e, "s").orderBy("depth").collect()] == [("m", 1), ("k", 2)]
    assert traverse.trace_data_flow(n, e, "nobody").count() == 0


def test_random_graphs_against_a_queue(spark):
    rng = random.Random(8)
    for size in (6, 12):
        nodes = {f"n{i}": (rng.choice("SSKKZFF"), {"params": rng.choice([[], ["x"], ["y"]]), "vars": rng.choice([[], ["x"], ["x", "y"]])}) for i in range(size)}
        edges = list({(a, b, k): (a, b, k, rng.choice([["x"], ["y"], []])) for a, b, k in ((rng.choice([*nodes]), rng.choice([*nodes]), rng.choice(["call", "dataflow", "dataflow"])) for _ in range(2 * size))}.values())
        got = pairs(traverse.find_all_paths(*graph(spark, nodes, edges), max_nodes=6))
        assert got == model(nodes, edges, 6)


def test_scalar_functions(spark):
    row = spark.range(1).select(
        S.node_id(F.lit("a.py"), F.lit(3), F.lit("x")).alias("n"), S.assign_target(F.lit("  x: str = f(y)")).alias("t"), S.assign_target(F.lit("f(x)")).alias("e"), S.go_assign_target(F.lit("a, err := f()")).alias("g"),
        S.python_params(F.lit("self, a: int, *args, b=2, **kw, *")).alias("p"), S.go_params(F.lit("ctx context.Context, id string")).alias("gp"), S.split_non_empty(F.lit("a,,b ,")).alias("s"), S.severity(F.lit("other")).alias("sev"),
        S.language(F.lit("x/A.TSX")).alias("l"), S.call_name(F.lit("return cursor.execute (q)"), r"cursor\.execute\s*\(").alias("c"), S.proof(F.lit(2)).alias("proof"),
    ).first()
    assert row["n"] == hashlib.sha256(b"a.py:3:x").hexdigest()[:16]
    assert (row["t"], row["e"], row["g"], row["p"], row["gp"], row["s"]) == ("x", "", "a", ["self", "a", "b"], ["ctx", "id"], ["a", "b "])
    assert (row["sev"], row["l"], row["c"], row["proof"]) == ("low", "typescript", "execute", "UNSANITIZED_PATHS_FOUND: 2 path(s) detected")


PYTHON = '''import flask
from fastapi import Query

@app.get("/users")
def get_users(name=None, request=None):
    cursor.execute("select " + name)
    subprocess.run(name, shell=True)
    return escape(request.args)

async def fetch(url):
    validate(url)
'''
GO = """package main
import (
  "net/http"
  "github.com/go-chi/chi/v5"
)
// db.Exec("no")
func run(w http.ResponseWriter, r *http.Request) {
  name := r.URL.Query().Get("name")
  db.Exec(name)
  helper(name, 3)
}
func (s *Server) helper(id string, data []byte) {}
"""
TYPESCRIPT = """import express from 'express';
const cp = require('child_process');
const load = async (id, opts) => { return fetch(id); }
function go(a: string, b?: number) {
  const name = req.query.name; // eval(x)
  cp.exec(name);
}
"""


def facts(spark, **files):
    rows = [(p.replace("_", "."), c) for p, c in files.items()]
    events = extract.syntax_events(extract.source_files(spark.createDataFrame(rows, "path string, content string")))
    return extract.facts(events)


def test_extraction(spark):
    nodes, functions, calls = facts(spark, a_py=PYTHON, b_go=GO, c_ts=TYPESCRIPT, d_md="eval(x)", e_py="def broken(")
    found = {(r["file_path"], r["kind"][:4], r["symbol"], r["line"], r["vuln_class"], r["framework"]) for r in nodes.collect()}
    assert ("a.py", "Sour", "name", 5, "", "fastapi") in found and ("a.py", "Sour", "request", 5, "", "fastapi") not in found
    assert {("a.py", "Sour", "request.args", 8, "", "fastapi"), ("a.py", "Sink", "cursor.execute", 6, "sqli", "fastapi"), ("a.py", "Sink", "subprocess.run", 7, "rce", "fastapi"), ("a.py", "Sani", "escape", 8, "xss", "fastapi")} <= found
    assert {("b.go", "Sour", "r.URL.Query", 8, "", "chi"), ("b.go", "Sour", "r.URL.Query().Get", 8, "", "chi"), ("b.go", "Sink", "db.Exec", 9, "sqli", "chi")} <= found
    assert {("c.ts", "Sour", "req.query", 5, "", "express"), ("c.ts", "Sink", "exec", 6, "rce", "express"), ("c.ts", "Sink", "fetch", 3, "ssrf", "express")} <= found
    assert not [f for f in found if f[2] == "eval" or f[0] in ("d.md", "e.py")]
    defs = {(r["file_path"], r["name"]): (r["params"], r["is_handler"]) for r in functions.collect()}
    assert defs[("a.py", "get_users")] == (["name", "request"], True) and ("a.py", "fetch") in defs
    assert defs[("b.go", "run")][1] and defs[("b.go", "helper")][0] == ["id", "data"]
    assert defs[("c.ts", "load")][0] == ["id", "opts"] and defs[("c.ts", "go")][0] == ["a", "b"]
    sites = {(r["file_path"], r["caller_func"], r["callee"], tuple(r["arg_names"])) for r in calls.collect()}
    assert {("a.py", "get_users", "validate", ("url",)), ("b.go", "", "helper", ("name",)), ("c.ts", "", "exec", ("name",))} <= sites


def test_source_to_path(spark):
    g = SecurityGraph.from_files(extract.source_files(spark.createDataFrame([("u.py", '@app.get("/u")\ndef f(uid=None):\n    cursor.execute(uid)\n')], "path string, content string")))
    r = g.find_all_paths().first()
    assert (r["vuln_class"], r["severity"], r["confidence"], r["path_length"]) == ("sqli", "high", 0.95, 2)
    told = json.loads(g.tool("find_missing_sanitizers"))
    assert told["total_findings"] == 1 and told["by_severity"] == {"high": 1}
    assert json.loads(g.tool("get_security_context", file="u.py"))["sink_count"] == 1
    with pytest.raises(ValueError):
        g.tool("query_taint_paths")


def test_builder(spark):
    parsed = spark.createDataFrame([("app.py", 1, "SourceNode", "request.args.get", "", "", 5, "", ["name"]), ("app.py", 2, "SinkNode", "cursor.execute", "sqli", "", 10, "cursor.execute(name)", []), ("app.py", 3, "Import", "flask", "", "", 1, "", [])], schema.PARSED_NODES)
    functions = spark.createDataFrame([("app.py", 1, "handle", 1, ["request"], True, ""), ("db.py", 1, "run_query", 2, ["q"], False, "")], schema.FUNCTIONS)
    calls = spark.createDataFrame([("app.py", 1, "handle", "run_query", ["name"], 5), ("db.py", 1, "run_query", "handle", [], 7)], schema.CALL_SITES)
    nodes, edges = build.build_graph(parsed, functions, calls, ordered=False)
    assert {(r["type"], r["n"]) for r in posture.node_stats(nodes).collect()} == {("total_nodes", 4), ("SourceNode", 1), ("SinkNode", 1), ("FunctionNode", 2)}
    assert sorted(r["type"] for r in edges.collect()) == ["call", "call", "dataflow"]
    # in one scan, app.py is read before db.py and doesn't know run_query yet
    assert build.call_edges(functions, calls).select("metadata").first()[0]["call_line"] == "7"
    assert build.graph_version(nodes, edges).first() == build.graph_version(nodes.repartition(5), edges).first()


def test_posture(spark):
    paths = spark.createDataFrame([("1", "critical"), ("2", "high"), ("3", "low")], "id string, severity string")
    r = posture.posture(paths).first()
    assert (r["score"], r["grade"]) == (58, "D")
    assert posture.posture(paths.limit(0)).first()["grade"] == "A"
    assert posture.gate(paths, "high").first() == (2, False) and posture.gate(paths.limit(0)).first()["passed"]
    with pytest.raises(ValueError):
        posture.gate(paths, "none")
    later = paths.filter("id <> '2'").union(spark.createDataFrame([("9", "low"), ("8", "low")], "id string, severity string"))
    assert posture.diff_verdict(paths, later).first() == (2, 1, "degraded")
    known = paths.select("id", F.lit(datetime.date(2024, 1, 1)).alias("introduced_at"), F.lit(None).cast("date").alias("resolved_at"))
    rows = {r["id"]: (r["resolved_at"], r["is_active"]) for r in posture.path_history(known, later, datetime.date(2024, 2, 1)).collect()}
    assert rows["2"] == (datetime.date(2024, 2, 1), False) and rows["9"] == (None, True) and len(rows) == 5


def test_scan(spark, tmp_path):
    for name, text in (("app.py", PYTHON), ("lib/B.PY", "x = 1"), ("node_modules/m.js", "eval(1)"), ("src/testdata/t.py", ""), ("readme.md", "x")):
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = scan(spark, str(tmp_path / "repo"))
    assert sorted(r["path"] for r in files.collect()) == ["app.py", "lib/B.PY"]
    assert files.filter("path = 'lib/B.PY'").first()["hash"] == hashlib.sha256(b"x = 1").hexdigest()
    g = SecurityGraph.from_files(files)
    assert g.nodes.count() > 3


def test_stream(spark, tmp_path):
    source, store = tmp_path / "changes", FactStore(spark, str(tmp_path / "store"))
    source.mkdir()

    def put(name, *rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("path", "language", "is_delete", "content", "event_time"), r))) for r in rows))

    def run():
        changes.start(changes.read_changes(spark, str(source)), store, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
        return {r["file_path"] for r in store.read()[0].collect()}

    put("1.json", ("a.py", "python", False, "eval(x)", "2024-01-01T00:00:00Z"), ("a.py", "python", False, PYTHON, "2024-01-01T00:00:01Z"), ("b.py", "python", False, "os.system(x)", "2024-01-01T00:00:00Z"), ("venv/c.py", "python", False, "eval(x)", "2024-01-01T00:00:00Z"))
    assert run() == {"a.py", "b.py"}
    assert store.read()[0].filter("symbol = 'eval'").count() == 0
    put("2.json", ("b.py", "python", True, None, "2024-01-01T00:00:02Z"))
    assert run() == {"a.py"}
    assert store.latest() == 2
    bursts = changes.debounced(spark.createDataFrame([("a", "python", False, "1", datetime.datetime(2024, 1, 1, 0, 0, 0)), ("a", "python", True, None, datetime.datetime(2024, 1, 1, 0, 0, 0, 100000)), ("a", "python", False, "2", datetime.datetime(2024, 1, 1, 0, 0, 1))], schema.CHANGES.replace("event_time timestamp", "event_time timestamp")))
    assert sorted(r["is_delete"] for r in bursts.collect()) == [False, True]
