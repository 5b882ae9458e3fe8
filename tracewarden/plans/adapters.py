"""Property graphs over the given tables: events as a graph, rendered source lines, and an orders graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.functions import scalar as S
from tracewarden.sources.shared import load

_CLASS = "CASE event_id % 6 WHEN 0 THEN 'sqli' WHEN 1 THEN 'xss' WHEN 2 THEN 'rce' WHEN 3 THEN 'path_traversal' WHEN 4 THEN 'ssrf' ELSE 'deserialization' END"
#: SQL expressions over events that Spark and DuckDB read alike.
EVENT = {
    "id": "'e' || event_id",
    "type": "CASE event_type WHEN 'signup' THEN 'SourceNode' WHEN 'purchase' THEN 'SinkNode' WHEN 'error' THEN 'SanitizerNode' ELSE 'FunctionNode' END",
    "file_path": "'svc' || (user_id % 20) || '/u' || user_id || '.py'",
    "symbol": "event_type",
    "vuln_class": f"CASE WHEN event_type = 'purchase' THEN {_CLASS} ELSE '' END",
    "variable": "'v' || (event_id % 3)",
}
#: A source line for each event; lines of a user are a file.
CODE = {
    "python": "CASE event_id % 12 WHEN 0 THEN 'v' || (event_id % 5) || ' = request.args.get(1)' WHEN 1 THEN 'cursor.execute(v' || (event_id % 5) || ')' WHEN 2 THEN 'os.system(v' || (event_id % 5) || ')' WHEN 3 THEN 'x = escape(v' || (event_id % 5) || ')' WHEN 4 THEN 'import flask' WHEN 5 THEN 'def handler' || (event_id % 7) || '(self, v' || (event_id % 5) || ', b: int = 1, *args):' WHEN 6 THEN 'pickle.loads(v' || (event_id % 5) || ')' WHEN 7 THEN 'requests.get(v' || (event_id % 5) || ', timeout=3)' WHEN 8 THEN 'with open(v' || (event_id % 5) || ') as f:' WHEN 9 THEN 'data: str = request.json' WHEN 10 THEN 'return Markup(v' || (event_id % 5) || ')' ELSE 'y = session.query(v' || (event_id % 5) || ').filter(z)' END",
    "typescript": "CASE event_id % 12 WHEN 0 THEN 'const a = req.query.q;' WHEN 1 THEN 'el.innerHTML = a;' WHEN 2 THEN 'eval(a);' WHEN 3 THEN 'child_process.exec(cmd);' WHEN 4 THEN 'fs.readFile(p, cb);' WHEN 5 THEN 'await fetch(url);' WHEN 6 THEN 'DOMPurify.sanitize(a)' WHEN 7 THEN 'let u = location.href;' WHEN 8 THEN 'encodeURIComponent(u)' WHEN 9 THEN 'db.prepare(sql)' WHEN 10 THEN 'const b = params.id;' ELSE 'axios.get(url)' END",
    "go": "CASE event_id % 12 WHEN 0 THEN 'id := chi.URLParam(r, k)' WHEN 1 THEN 'name, err := r.FormValue(k)' WHEN 2 THEN 'rows := db.Query(q)' WHEN 3 THEN 'exec.Command(c)' WHEN 4 THEN 'f, err := os.Open(p)' WHEN 5 THEN 'http.Get(u)' WHEN 6 THEN 'template.HTML(s)' WHEN 7 THEN 's = html.EscapeString(s)' WHEN 8 THEN 'pgx.Connect(ctx)' WHEN 9 THEN 'q := c.Query(k)' WHEN 10 THEN 'os.Create(p)' ELSE 'func run(w http.ResponseWriter, r *http.Request) {' END",
}
_NAME = "'h' || user_id || '_' || (event_id % 5)"
_CALLED = "'h' || (user_id + event_id % 4) || '_' || (event_id % 5)"
#: A line of a program for each event, for extraction: headers, calls of other users' functions, sources, sinks, lines that don't parse.
SCRIPT = {
    "python": f"CASE event_id % 8 WHEN 0 THEN 'def ' || {_NAME} || '(q, n=1):' WHEN 1 THEN {_CALLED} || '(q, x' || event_id || ')' WHEN 2 THEN 'cursor.execute(q' || event_id || ')' WHEN 3 THEN 'name' || event_id || ' = request.args.get(q)' WHEN 4 THEN CASE WHEN event_id % 16 = 4 THEN 'print ' || event_id ELSE '@app.get(q)' END WHEN 5 THEN 'escape(q, ' || event_id || ')' WHEN 6 THEN 'import p' || event_id ELSE 'z = subprocess.run(q)' END",
    "typescript": f"CASE event_id % 8 WHEN 0 THEN 'function ' || {_NAME} || '(q: string, n = 1) {{ }}' WHEN 1 THEN {_CALLED} || '(q, x' || event_id || ');' WHEN 2 THEN 'el' || event_id || '.write(q);' WHEN 3 THEN 'const name' || event_id || ' = req.query.q;' WHEN 4 THEN 'const f' || event_id || ' = async (a: Map<string, () => void>, b = /[(]/): Promise<Map<string, number>> => {{ }};' WHEN 5 THEN 'encodeURIComponent(`${{run' || event_id || '(q)}}`);' WHEN 6 THEN 'import x from \"m' || event_id || '\";' ELSE 'cp.exec(q);' END",
    "go": f"CASE event_id % 8 WHEN 0 THEN 'func ' || {_NAME} || '(q string, n int) {{ }}' WHEN 1 THEN {_CALLED} || '(q, x' || event_id || ')' WHEN 2 THEN 'db' || event_id || '.Exec(q)' WHEN 3 THEN 'name' || event_id || ' := r.FormValue(q)' WHEN 4 THEN 'func (s *S) m' || event_id || '(w http.ResponseWriter, r *http.Request) {{ }}' WHEN 5 THEN 'html.EscapeString(`q`)' WHEN 6 THEN 'import \"m' || event_id || '\"' ELSE 'os.Open(q)' END",
}
ENDING = {"python": "py", "typescript": "ts", "go": "go"}


def script_lines(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(file_path, line, text, user_id, n): the program of each user, a line an event, with the number of its lines."""
    by_user = Window.partitionBy("user_id")
    events = load(spark, sf_dir, "events").select("*", F.row_number().over(by_user.orderBy("ts", "event_id")).alias("line"), F.count(F.lit(1)).over(by_user).alias("n"))
    return events.selectExpr(f"'repo/u' || user_id || '.{ENDING[language]}' AS file_path", "line", f"{SCRIPT[language]} AS text", "user_id", "n")


def script_files(lines: DataFrame) -> DataFrame:
    """(path, content) of program lines; a group is one file."""
    cells = F.array_sort(F.collect_list(F.struct("line", "text")))
    return lines.groupBy(F.col("file_path").alias("path")).agg(F.array_join(F.transform(cells, lambda c: c["text"]), "\n").alias("content"))


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = "cast(array() AS array<string>)"
    return load(spark, sf_dir, "events").selectExpr(
        f"{EVENT['id']} AS id", f"{EVENT['type']} AS type", f"{EVENT['file_path']} AS file_path", "cast(event_id % 1000 AS int) AS line_start", "cast(event_id % 1000 AS int) AS line_end",
        f"{EVENT['symbol']} AS symbol", "'' AS framework", f"{EVENT['vuln_class']} AS vuln_class", "0.85D AS confidence", f"array({EVENT['variable']}) AS params", f"CASE WHEN event_type = 'signup' THEN array({EVENT['variable']}) ELSE {none} END AS tainted_vars",
    )


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each event to the user's next one; clicks are calls with one argument."""
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    following = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    linked = events.withColumn("following", following).filter("following IS NOT NULL")
    rows = linked.selectExpr(f"{EVENT['id']} AS src", "'e' || following AS dst", "CASE WHEN event_type = 'click' THEN 'call' ELSE 'dataflow' END AS type", f"array({EVENT['variable']}) AS args")
    return rows.select(S.edge_id("src", "dst", "type").alias("id"), "src", "dst", "type", "args", F.create_map(F.lit("args"), F.concat_ws(",", "args")).alias("metadata"))


def code_lines(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(file_path, line, text): the rendered line of each event, numbered within the user's file."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return load(spark, sf_dir, "events").select("*", number.alias("line")).selectExpr("'repo/u' || user_id AS file_path", "line", f"{CODE[language]} AS text", "event_id")


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources in a module of their nation, orders as functions, parts as sinks."""
    none = "cast(array() AS array<string>) AS params, cast(array() AS array<string>) AS tainted_vars"
    shape = "cast(0 AS int) AS line_start, cast(0 AS int) AS line_end"
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customers = load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("'c' || c_custkey AS id", "'SourceNode' AS type", "n_name || '/customer.py' AS file_path", *shape.split(", "), "c_mktsegment AS symbol", "'' AS framework", "'' AS vuln_class", "0.85D AS confidence", *none.split(", "))
    orders = load(spark, sf_dir, "orders").selectExpr("'o' || o_orderkey AS id", "'FunctionNode' AS type", "'orders.py' AS file_path", *shape.split(", "), "o_orderpriority AS symbol", "'' AS framework", "'' AS vuln_class", "0.0D AS confidence", *none.split(", "))
    parts = load(spark, sf_dir, "part").selectExpr("'p' || p_partkey AS id", "'SinkNode' AS type", "'parts.py' AS file_path", *shape.split(", "), "p_brand AS symbol", "'' AS framework", _CLASS.replace("event_id", "p_size") + " AS vuln_class", "0.85D AS confidence", *none.split(", "))
    return customers.unionByName(orders).unionByName(parts)


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each customer to their orders and from each order to its parts; a part that is in an order twice gives one edge twice."""
    placed = load(spark, sf_dir, "orders").selectExpr("'c' || o_custkey AS src", "'o' || o_orderkey AS dst")
    held = load(spark, sf_dir, "lineitem").selectExpr("'o' || l_orderkey AS src", "'p' || l_partkey AS dst")
    none = F.array().cast("array<string>")
    return placed.union(held).select(S.edge_id("src", "dst", F.lit("dataflow")).alias("id"), "src", "dst", F.lit("dataflow").alias("type"), none.alias("args"), F.create_map().cast("map<string,string>").alias("metadata"))
