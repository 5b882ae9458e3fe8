"""Incremental builds against one build, differences against a git ref, scans, and extraction of hard files."""

import datetime
import subprocess
import time

from pyspark.sql import functions as F

from tracewarden import schema
from tracewarden.graph import SecurityGraph
from tracewarden.operators import build, extract, lines, posture
from tracewarden.sources.repository import changed_files, files_at, scan
from tracewarden.sources.store import FactStore
from tracewarden.streaming import changes


def change(spark, *rows):
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(p, "python", c is None, c, at + datetime.timedelta(seconds=k)) for k, (p, c) in enumerate(rows)], schema.CHANGES)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def built(spark, files):
    events = extract.syntax_events(extract.source_files(spark.createDataFrame([*files.items()], "path string, content string")))
    return build.build_graph(*extract.facts(events), ordered=False)


def test_batches_give_the_graph_of_one_build(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"), buckets=4)
    a, b, c = "def helper(q):\n    os.system(q)\n", "def main(q):\n    helper(q)\n", "def helper(q, n):\n    pass\n"
    batches = [(("a.py", a), ("b.py", b)), (("b.py", b),), (("b.py", b + "\n\nprint 'old'\n"), ("c.py", c)), (("a.py", None),), (("c.py", None), ("d.py", a))]
    files = {}
    for batch in batches:
        changes.apply_changes(store, change(spark, *batch))
        files = {p: x for p, x in (files | dict(batch)).items() if x is not None}
        got, want = store.read(), built(spark, files)
        assert ids(got[0]) == ids(want[0]) and ids(got[1]) == ids(want[1])
        if set(files) == {"a.py", "b.py"}:
            assert got[1].filter("type = 'call'").count() == 1  # also after b.py came again unchanged
    assert store.latest() == 4  # the batch without a change made no version
    assert ids(store.read(1)[0]) == ids(built(spark, {"a.py": a, "b.py": b})[0])
    held = [store.manifest(n) for n in range(1, 5)]
    assert [sum(b.get(k) != f for k, f in a.items()) for a, b in zip(held[1:], held)][:2] <= [2, 2]  # a version writes the buckets of its files only
    assert all(set(b) <= set(a) for a, b in zip(held[1:], held))


def test_diff_against_a_ref(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    bad, good = '@app.get("/u")\ndef f(uid=None):\n    cursor.execute(uid)\n', '@app.get("/u")\ndef f(uid=None):\n    return 1\n'
    git("init", "-q")
    for name, text in (("a.py", bad), ("b.py", good), ("sub/c.py", bad)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    git("add", "-A")
    git("commit", "-qm", "one")
    for name, text in (("a.py", good), ("b.py", bad), ("new.py", bad)):
        (tmp_path / name).write_text(text)
    git("add", "-A")
    git("commit", "-qm", "two")
    changed = changed_files(spark, str(tmp_path), "HEAD~1")
    assert sorted(r["path"] for r in changed.collect()) == ["a.py", "b.py", "new.py"]
    assert {r["path"]: r["content"] for r in files_at(changed, str(tmp_path), "HEAD~1").collect()} == {"a.py": bad, "b.py": good}
    new, resolved, verdict = SecurityGraph.diff(spark, str(tmp_path))
    assert sorted(r["file_path"] for r in new.collect()) == ["b.py", "new.py"]
    assert [r["file_path"] for r in resolved.collect()] == ["a.py"]
    assert verdict.first()["verdict"] == "degraded"


def test_scan_of_a_relative_root_that_occurs_twice(spark, tmp_path, monkeypatch):
    (tmp_path / "a" / "b" / "a").mkdir(parents=True)
    (tmp_path / "a" / "b" / "a" / "x.py").write_text("eval(q)")
    monkeypatch.chdir(tmp_path)
    assert [r["path"] for r in scan(spark, str(tmp_path / "a")).collect()] == ["b/a/x.py"]


def test_hard_files():
    script = "const f = (a: string): Promise<Map<string, { n: number }>> => { return g(`x ${eval(a)} ${`y ${h(b)}`}`); };\nclass A { load(id: string): Promise<{ a: number }> { fs.readFile(id); } }\nlet re = /exec\\(x\\)/g;\nconst k: (x: number) => { y: string } = (x) => 3;\n"
    found = {(e[0], e[2], e[3]) for e in extract.c_like_events(script, "typescript")}
    assert {("def", "f", 1), ("def", "load", 2), ("def", "k", 4), ("call", "g", 1), ("call", "eval", 1), ("call", "h", 1), ("call", "readFile", 2)} <= found
    assert not [e for e in found if e[1] == "exec"]
    far = "const f: A<" + ", ".join(f"T{i}" for i in range(500)) + "> = (" + ", ".join(f"p{i}: B" for i in range(500)) + "): C<" + ", ".join(f"T{i}" for i in range(500)) + "> => { };"
    assert [len(e[5]) for e in extract.c_like_events(far, "typescript") if e[0] == "def"] == [500]
    old = "import os\nprint 'x'\nclass A:\n    def f(self, q):\n        print 'y'\n        os.system(q)\n\n@app.get('/')\ndef g(a=1):\n    cursor.execute(a)\n"
    events = [(e[0], e[2], e[3]) for e in extract.python_events(old)]
    assert ("def", "f", 4) in events and ("call", "system", 6) in events and ("call", "execute", 10) in events
    assert [e for e in extract.python_events(old) if e[0] == "def" and e[2] == "g"][0][6]
    split = "class A:\n    print 'x'\n    def f(self,\n          q):\n        cursor.execute(\n            q, \"(\",  # (\n            '''a\n            (''')\n        y = (\n        os.system(q)\n"
    assert [(e[0], e[2], e[3], e[5]) for e in extract.python_events(split) if e[0] in ("def", "call")] == [("def", "f", 3, ["q"]), ("call", "execute", 5, ["q"]), ("call", "system", 10, ["q"])]
    methods = "const o = { a(x) { f(x) }, b(y) { g(y) } };\nclass C extends B { @Get() findAll(req) { h(req) } @core.Put(1) @Input one(p): Promise<{ a: string }> { super(p); } }\nif (a) f(b)\n{ g() }\n"
    found = [(e[0], e[2], e[3]) for e in extract.c_like_events(methods, "typescript") if e[0] in ("def", "call")]
    assert [e[1:] for e in found if e[0] == "def"] == [("a", 1), ("b", 1), ("findAll", 2), ("one", 2)]
    assert [e[1:] for e in found if e[0] == "call"] == [("f", 1), ("g", 1), ("Get", 2), ("h", 2), ("Put", 2), ("f", 3), ("g", 4)]
    go = [(e[1], e[2]) for e in extract.c_like_events('func f() { x.a.URL.Query().Get("k"); db.b().c().Exec(q); a[1].b(c).Open(p) }', "go") if e[0] == "call"]
    assert ("x.a.URL.Query()", "Get") in go and ("db.b().c()", "Exec") in go and ("a[1].b(c)", "Open") in go
    assert [*extract.python_events("")] == [] and [*extract.c_like_events("", "go")] == []


def test_extraction_is_linear():
    rows = "\n".join(f"db{i}.execute(a, f(x{i}))" for i in range(8000))
    began = time.process_time()
    assert sum(1 for _ in extract.python_events(rows)) == 24000
    assert sum(1 for _ in extract.c_like_events("(function(){" * 50 + rows + "})()" * 50, "typescript")) >= 24000
    for language in ("go", "typescript"):
        assert sum(1 for _ in extract.c_like_events("a" + ".f(x)" * 20_000, language)) >= 20_000
    assert time.process_time() - began < 8


def test_order_keys_stay_in_their_pass(spark):
    text = "\n".join(f"x{i} = request.args" for i in range(45_000)) + '\n@app.get("/")\ndef f(a=1, b=2): cursor.execute(a)\n'
    events = extract.syntax_events(extract.source_files(spark.createDataFrame([("big.py", text)], "path string, content string")))
    nodes = extract.facts(events)[0]
    passes = {r["k"]: (r["lo"], r["hi"]) for r in nodes.withColumn("k", F.when(F.col("symbol").isin("a", "b"), 1).when(F.col("kind") == "SourceNode", 2).otherwise(3)).groupBy("k").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).collect()}
    assert passes[1][1] < passes[2][0] and passes[2][1] < passes[3][0]


def test_flags_of_extraction(spark):
    text = "def first(q):\n    pass\ndef second(q):\n    name = request.args\n    helper(name)\n    cursor.execute(name)\n"
    files = extract.source_files(spark.createDataFrame([("a.py", text)], "path string, content string"))
    events = extract.syntax_events(files)
    assert {r["caller_func"] for r in extract.facts(events)[2].collect()} == {"first"}
    nodes, _, calls = extract.facts(events, enclosing=True, assigned=True)
    assert {r["caller_func"] for r in calls.collect()} == {"second"}
    assert nodes.filter("kind = 'SourceNode'").first()["tainted_vars"] == ["request.args", "name"]
    assert SecurityGraph.from_files(files).find_all_paths().count() == 0
    graph = SecurityGraph.from_files(files, assigned=True, tainted=True)
    assert graph.find_all_paths().count() == 1
    assert graph.nodes.filter("type = 'SourceNode'").first()["tainted_vars"] == ["request.args", "name"]


def test_call_edges_see_what_was_read_before(spark):
    functions = [(f"f{k:03}.py", k, name, 1, [], False, "") for k, name in enumerate(["hot", "other"] * 60)]
    calls = [(f"f{k:03}.py", 1, "hot", "other", [], 5) for k in range(0, 121, 7)]
    fd, cd = spark.createDataFrame(functions, schema.FUNCTIONS), spark.createDataFrame(calls, schema.CALL_SITES)
    seen = {(r["file_path"], r["name"]): r["func_id"] for r in build.registry_at(fd, cd.select("file_path", F.explode(F.array("caller_func", "callee")).alias("name"))).collect()}
    last = {(at, name): max((f for f in functions if f[2] == name and f[0] <= at), default=None) for at, *_ in calls for name in ("hot", "other")}
    known = {r["file_path"] + r["name"]: r["id"] for r in fd.withColumn("id", F.substring(F.sha2(F.concat_ws(":", "file_path", F.col("line").cast("string"), "name"), 256), 1, 16)).collect()}
    assert seen == {k: known[f[0] + f[2]] for k, f in last.items() if f}


def test_line_headers(spark):
    rows = [("a.py", 1, "from fastapi.x import y"), ("a.py", 2, "@app.get('/')"), ("a.py", 3, "async def f(self, a: int, *b):"), ("a.py", 4, "def g():")]
    df = spark.createDataFrame(rows, "file_path string, line int, text string")
    assert [tuple(r) for r in lines.line_imports(df, "python").collect()] == [("a.py", 1, "fastapi.x")]
    assert [(r["name"], r["params"], r["is_handler"]) for r in lines.line_functions(df, "python").orderBy("line").collect()] == [("f", ["self", "a"], True), ("g", [], False)]
    go = spark.createDataFrame([("b.go", k, t) for k, t in enumerate(["import (", '"a/b"', ")", 'x := "no"', 'import "c"', "func (s *S) run(w http.ResponseWriter, r *http.Request) {"])], "file_path string, line int, text string")
    assert [r["package"] for r in lines.line_imports(go, "go").orderBy("line").collect()] == ["a/b", "c"]
    assert [(r["name"], r["params"], r["is_handler"]) for r in lines.line_functions(go, "go").collect()] == [("run", ["w", "r"], True)]


def test_node_delta_counts_growth(spark):
    before = spark.createDataFrame([("a",), ("a",), ("b",)], "file_path string")
    after = spark.createDataFrame([("a",), ("b",), ("b",), ("b",), ("c",)], "file_path string")
    assert posture.node_delta(before, after).first()["added"] == 3 and posture.node_delta(before, before).first()["added"] == 0
    assert posture.node_delta(before.limit(0), after.limit(0)).first()["added"] == 0
