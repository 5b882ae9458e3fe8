"""Watching a tree, debouncing by timer, scopes by indentation, indexed dataflow joins, and upkeep of the path table."""

import random
import time

from pyspark.sql import functions as F

from tests.test_graph import graph, model, pairs
from tests.test_search import random_graph
from tracewarden import schema
from tracewarden.operators import build, scopes, traverse
from tracewarden.streaming import watch


def test_tree_source(spark, tmp_path):
    """New, changed and deleted files, ignored folders, and a restart that finds what happened meanwhile."""
    spark.dataSource.register(watch.TreeSource)
    root, got = tmp_path / "repo", []
    (root / "node_modules").mkdir(parents=True)
    (root / "sub").mkdir()

    def run():
        rows = spark.readStream.format("tree").option("path", str(root)).option("tasks", 2).load()
        query = rows.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: got.extend(b.collect()) and None).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        found = sorted((r.path, r.is_delete, r.content) for r in got)
        got.clear()
        return found

    (root / "a.py").write_text("x = 1")
    (root / "sub" / "B.TS").write_text("let y")
    (root / "node_modules" / "c.js").write_text("no")
    (root / "readme.md").write_text("no")
    assert run() == [("a.py", False, "x = 1"), ("sub/B.TS", False, "let y")]
    assert run() == []  # a restart without a change
    (root / "a.py").write_text("x = 22")
    (root / "sub" / "B.TS").unlink()
    (root / "new.go").write_text("package m")
    assert run() == [("a.py", False, "x = 22"), ("new.go", False, "package m"), ("sub/B.TS", True, None)]


def test_settled_by_timer(spark, tmp_path):
    """The newest burst of a path comes out once it is quiet, though nothing else ever arrives."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = tmp_path / "in"
    source.mkdir()
    rows = lambda name, text: spark.createDataFrame([("a.py", "python", False, text), ("b.py", "python", text == "2", None)], "path string, language string, is_delete boolean, content string").withColumn("event_time", F.current_timestamp()).coalesce(1).write.mode("append").json(str(source))
    rows("1", "1")
    stream = spark.readStream.schema(schema.CHANGES).option("maxFilesPerTrigger", 1).json(str(source))
    query = watch.settled(stream, 3000).writeStream.outputMode("append").format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        rows("2", "2")
        for _ in range(240):
            time.sleep(0.5)
            found = spark.table("quiet").collect()
            if len({r.path for r in found}) == 2:
                break
        time.sleep(4)
        found = sorted((r.path, r.content, r.is_delete) for r in spark.table("quiet").collect())
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert found[-1][0] == "b.py" and ("a.py", "2", False) in found and ("b.py", None, True) in found


def scopes_brute(text, line):
    rows = text.split("\n")
    indent = lambda x: len(x) - len(x.lstrip())
    for k in range(line - 2, -1, -1):
        head = rows[k].strip()
        if head.startswith("def ") and indent(rows[k]) < indent(rows[line - 1]) and all(indent(rows[j]) > indent(rows[k]) for j in range(k + 1, line) if rows[j].strip() and not rows[j].strip().startswith("#")):
            return head[4 : head.index("(")], k + 1
    return "", 0


def test_scopes(spark):
    rng, files = random.Random(2), []
    for k in range(25):
        kinds = lambda: ["", "    # note", *[" " * i + w for i in (0, 2, 4, 6) for w in (f"def f{rng.randint(0, 99)}(x):", "call(x)", "call(y)", "y = 1")]]
        lines = [rng.choice(kinds()) for _ in range(rng.randint(0, 40))]
        files.append((f"{k}.py", "\n".join(lines)))
    df = spark.createDataFrame(files, "file_path string, content string")
    lines = scopes.indented_lines(df)
    sites = lines.filter("text LIKE '%call(%'").select("file_path", "line")
    want = {(p, i): scopes_brute(text, i) for p, text in files for i, row in enumerate(text.split("\n"), 1) if "call(" in row}
    assert len(want) > 100 and len({n for n, _ in want.values()}) > 20
    assert {(r.file_path, r.line): (r.caller_func, r.caller_line) for r in scopes.enclosing_functions(lines, sites.unionByName(sites.limit(9))).collect()} == want


def test_dataflow_by_index(spark):
    """Equal edges by the index and by the join; a file of 20,000 sources and sinks takes seconds."""
    rng = random.Random(7)
    rows = []
    for f in range(3):
        for i in range(120):
            name = "".join(rng.choice("abé") for _ in range(rng.randint(0, 5)))
            rows.append((f"f{f}", i, rng.choice(["SourceNode", "SinkNode"]), f"s{i % 50}", "sqli", "", i % 60, rng.choice(["run(" + "".join(rng.choice("abé_ ") for _ in range(rng.randint(0, 12))) + ")", "", None]), [name, name, "x"][: rng.randint(0, 3)]))
    parsed = spark.createDataFrame(rows, schema.PARSED_NODES)
    for words in (False, True):
        plain, indexed = (sorted((r.id, r.src, r.dst, r.metadata["tainted_var"]) for r in build.dataflow_edges(parsed, words, large).collect()) for large in (1 << 40, 0))
        assert plain == indexed and plain
    n = 20_000
    big = spark.range(2 * n).selectExpr("'big.py' AS file_path", "id AS ord", f"if(id < {n}, 'SourceNode', 'SinkNode') AS kind", "concat('s', id) AS symbol", "'sqli' AS vuln_class", "'' AS framework", "cast(id AS int) AS line", f"concat('run(name', id % {n}, '_)') AS text", f"if(id < {n}, array(concat('name', id, '_')), array()) AS tainted_vars")
    began = time.time()
    assert build.dataflow_edges(big).count() == n
    assert time.time() - began < 60


def test_updated_paths(spark):
    """Any sequence of changes gives the paths of one search."""
    rng = random.Random(12)
    nodes, edges = random_graph(rng, 12, 22)
    before = graph(spark, nodes, edges)
    paths = traverse.find_all_paths(*before, max_nodes=6)
    paths = spark.createDataFrame(paths.collect(), paths.schema)
    searched = []
    for step in range(2):
        if step:
            gone = rng.choice([i for i in nodes if nodes[i][0] != "S"])
            nodes = {i: x for i, x in nodes.items() if i != gone}
        else:
            edges = edges[3:] + [("n00", "n05", "dataflow", [])]
        after = graph(spark, nodes, edges)
        searched.append(traverse.affected_sources(before, after, 6).count())
        new = traverse.updated_paths(paths, before, after, max_nodes=6)
        assert pairs(new) == model(nodes, edges, 6)
        paths, before = spark.createDataFrame(new.collect(), new.schema), after
    assert all(0 < n < 12 for n in searched)
