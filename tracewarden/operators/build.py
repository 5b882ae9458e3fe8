"""Graph construction from extracted facts: node classification, line index, dataflow and call joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions import scalar as S
from tracewarden.schema import FUNCTION, SANITIZER, SINK, SOURCE
from tracewarden.sources.shared import measured, width, written

#: Pairs of different variables and texts of a file from which an index finds those that match.
LARGE = 1 << 22


def _last(df: DataFrame, keys: list[str], order) -> DataFrame:
    """The row with the greatest order for each key (last writer wins)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s")).select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])


def parsed_with_ids(parsed: DataFrame) -> DataFrame:
    """Parsed nodes of the three graph kinds with their node id; other kinds are dropped."""
    return parsed.filter(F.col("kind").isin(SOURCE, SINK, SANITIZER)).withColumn("id", S.node_id("file_path", "line", "symbol"))


def line_index(parsed: DataFrame) -> DataFrame:
    """(file_path, line, line_id): the last parsed node of each line."""
    return parsed_with_ids(parsed).groupBy("file_path", "line").agg(F.max_by("id", "ord").alias("line_id"))


def _grams(text: str) -> Column:
    """The different strings of one to three characters in a text."""
    cut = lambda k: F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(F.col(text), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(cut(1), cut(2), cut(3)))


def contained(variables: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_path, tainted_var, text): which variables the texts of their file contain, by an index of three-character strings.

    A variable asks for the texts that hold the rarest string among its own of three characters (a shorter one: for
    those that hold itself), and only these are looked through. No variable meets all texts of a large file.
    """
    size = F.least(F.lit(3), F.length("tainted_var"))
    asked = variables.select("file_path", "tainted_var", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("tainted_var") - size + 1), lambda i: F.substring(F.col("tainted_var"), i, size)))).alias("gram"))
    asked = written(asked, "asked")
    held = texts.select("file_path", "text", F.explode(_grams("text")).alias("gram"))
    held = written(held.join(asked.select("file_path", "gram").distinct(), ["file_path", "gram"], "left_semi"), "held")
    counts = held.groupBy("file_path", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, ["file_path", "gram"], "left").groupBy("file_path", "tainted_var").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(held, ["file_path", "gram"]).filter("contains(text, tainted_var)").select("file_path", "tainted_var", "text")


def dataflow_edges(parsed: DataFrame, word_boundary: bool = False, large: int = LARGE) -> DataFrame:
    """Source to sink edges within a file, where the sink's text contains a tainted variable.

    Both ends are looked up by line, so several nodes on one line share the last one's id. An empty variable taints
    nothing. Different variables meet different texts: in files of up to ``large`` such pairs by a join on the file, in larger
    ones by an index (``contained``); only what matches is joined with the sources and sinks again.
    """
    placed = parsed_with_ids(parsed).withColumn("line_id", F.max_by("id", "ord").over(Window.partitionBy("file_path", "line")))
    placed = written(placed.filter(F.col("kind").isin(SOURCE, SINK)).select("kind", "file_path", "text", "tainted_vars", "line_id"), "placed")
    sources = placed.filter(F.col("kind") == SOURCE).select("file_path", F.explode("tainted_vars").alias("tainted_var"), F.col("line_id").alias("src")).filter("tainted_var <> ''").distinct()
    sinks = placed.filter((F.col("kind") == SINK) & F.col("text").isNotNull()).select("file_path", "text", F.col("line_id").alias("dst")).distinct()
    variables, texts = sources.select("file_path", "tainted_var").distinct(), sinks.select("file_path", "text").distinct()
    sizes = variables.groupBy("file_path").agg(F.count(F.lit(1)).alias("v")).join(texts.groupBy("file_path").agg(F.count(F.lit(1)).alias("t")), "file_path")
    crowded, told = measured(sizes.filter(F.col("v") * F.col("t") > large).select("file_path"), "crowded", n=F.count(F.lit(1)))
    pairs = variables.join(texts, "file_path").filter("contains(text, tainted_var)").select("file_path", "tainted_var", "text")
    if told["n"]:
        few, many = (variables.join(crowded, "file_path", how) for how in ("left_anti", "left_semi"))
        pairs = few.join(texts, "file_path").filter("contains(text, tainted_var)").select("file_path", "tainted_var", "text")
        pairs = pairs.unionByName(contained(many, texts.join(crowded, "file_path", "left_semi")))
    if word_boundary:
        pairs = pairs.filter(r"regexp_like(text, concat('(?<![A-Za-z0-9_])', '\\Q', tainted_var, '\\E', '(?![A-Za-z0-9_])'))")
    joined = pairs.join(sources, ["file_path", "tainted_var"]).join(sinks, ["file_path", "text"])
    found = joined.groupBy("src", "dst").agg(F.min(F.struct("tainted_var", "file_path")).alias("m"))
    return found.select(S.edge_id("src", "dst", F.lit("dataflow")).alias("id"), "src", "dst", F.lit("dataflow").alias("type"), F.array().cast("array<string>").alias("args"), F.create_map(F.lit("tainted_var"), "m.tainted_var", F.lit("file"), "m.file_path").alias("metadata"))


def file_order(functions: DataFrame) -> DataFrame:
    """(file_path, file_ord): lexical order, the order in which a scan ingests files."""
    return functions.select("file_path").distinct().select("file_path", F.col("file_path").alias("file_ord"))


def function_registry(functions: DataFrame) -> DataFrame:
    """(name, func_id, func_file): one function for each name over all files, the last in ingest order."""
    withid = functions.withColumn("func_id", S.node_id("file_path", "line", "name"))
    return withid.groupBy("name").agg(F.max_by(F.struct("func_id", "file_path"), F.struct("file_path", "ord")).alias("f")).select("name", "f.func_id", F.col("f.file_path").alias("func_file"))


def registry_at(functions: DataFrame, asked: DataFrame) -> DataFrame:
    """(file_path, name, func_id): for each asked (file_path, name), the last function of the name in files up to that one.

    Definitions and questions are sorted together by name and file and cut into ranges, so that a name that many files
    define or ask for is dealt over many tasks. In a range the last definition is carried on; what came
    before a range is one row for each name and range.
    """
    func = F.max_by(S.node_id("file_path", "line", "name"), "ord").alias("func_id")
    defs = functions.filter("name is not null and file_path is not null").groupBy("name", "file_path").agg(func).select("name", "file_path", "func_id", F.lit(0).alias("asks"))
    questions = asked.select("name", "file_path", F.lit(None).cast("string").alias("func_id"), F.lit(1).alias("asks")).distinct()
    both = defs.unionByName(questions).repartitionByRange(width(functions.sparkSession), "name", "file_path")
    both = written(both.withColumn("part", F.spark_partition_id()), "names")
    here = Window.partitionBy("name", "part").orderBy("file_path", "asks").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("here", F.last("func_id", ignorenulls=True).over(here)).filter("asks = 1")
    ends = both.groupBy("name", "part").agg(F.max_by("func_id", F.when(F.col("asks") == 0, F.col("file_path"))).alias("tail"))
    earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.withColumn("before", F.last("tail", ignorenulls=True).over(earlier)).select("name", "part", "before")
    found = seen.join(before, ["name", "part"]).select("file_path", "name", F.coalesce("here", "before").alias("func_id"))
    return found.filter("func_id is not null")


def call_edges(functions: DataFrame, calls: DataFrame, ordered: bool = True) -> DataFrame:
    """Caller to callee edges by two lookups of names in the registry.

    With ``ordered``, a callee must be known when the caller's file is ingested, as in one scan in lexical order;
    the registry that a file sees then holds the last function of a name up to that file.
    """
    if ordered:
        asked = calls.select("file_path", F.explode(F.array("caller_func", "callee")).alias("name")).filter("name <> ''")
        seen = registry_at(functions, asked)
        caller, callee = (seen.select("file_path", F.col("name").alias(n), F.col("func_id").alias(i)) for n, i in (("caller_func", "src"), ("callee", "dst")))
        found = calls.join(caller, ["file_path", "caller_func"]).join(callee, ["file_path", "callee"])
    else:
        registry = function_registry(functions)
        caller, callee = (registry.select(F.col("name").alias(n), F.col("func_id").alias(i)) for n, i in (("caller_func", "src"), ("callee", "dst")))
        found = calls.join(caller, "caller_func").join(callee, "callee")
    edges = found.filter("src <> dst and callee <> ''").select(S.edge_id("src", "dst", F.lit("call")).alias("id"), "src", "dst", F.lit("call").alias("type"), F.col("arg_names").alias("args"), F.create_map(F.lit("args"), F.concat_ws(",", "arg_names"), F.lit("call_line"), F.col("line").cast("string")).alias("metadata"), "file_path", "ord")
    return _last(edges, ["id"], F.struct("file_path", "ord")).select("id", "src", "dst", "type", "args", "metadata")


def build_nodes(parsed: DataFrame, functions: DataFrame, tainted: bool = False) -> DataFrame:
    """All nodes, one for each id: of equal ids the last one built stays, functions after parsed nodes. Nodes know their
    tainted variables only with ``tainted``."""
    none = F.array().cast("array<string>")
    facts = parsed_with_ids(parsed).select("id", F.col("kind").alias("type"), "file_path", F.col("line").alias("line_start"), F.col("line").alias("line_end"), "symbol", F.coalesce("framework", F.lit("")).alias("framework"), F.coalesce("vuln_class", F.lit("")).alias("vuln_class"), F.lit(0.85).alias("confidence"), none.alias("params"), (F.coalesce("tainted_vars", none) if tainted else none).alias("tainted_vars"), F.lit(0).alias("stage"), F.col("ord").cast("long").alias("ord"))
    funcs = functions.select(S.node_id("file_path", "line", "name").alias("id"), F.lit(FUNCTION).alias("type"), "file_path", F.col("line").alias("line_start"), F.lit(0).alias("line_end"), F.col("name").alias("symbol"), F.coalesce("framework", F.lit("")).alias("framework"), F.lit("").alias("vuln_class"), F.lit(0.0).alias("confidence"), F.coalesce("params", none).alias("params"), none.alias("tainted_vars"), F.lit(1).alias("stage"), F.col("ord").cast("long").alias("ord"))
    return _last(facts.unionByName(funcs), ["id"], F.struct("stage", "ord")).drop("stage", "ord")


def build_graph(parsed: DataFrame, functions: DataFrame, calls: DataFrame, ordered: bool = True, word_boundary: bool = False, tainted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of extracted facts."""
    edges = dataflow_edges(parsed, word_boundary).unionByName(call_edges(functions, calls, ordered))
    return build_nodes(parsed, functions, tainted), edges


def graph_version(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_version): a hash of all ids that doesn't depend on order or time, combined without collecting them."""
    ids = nodes.select("id").unionByName(edges.select("id"))
    parts = ids.select(F.conv(F.substring(F.sha2("id", 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    return parts.agg(S.short_hash(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum("h"), F.lit(0)).cast("string"))).alias("graph_version"))


def first_match(nodes: DataFrame, symbol: str, file_path: str = "") -> DataFrame:
    """The first node of a symbol (and file, if given) by file, line and id."""
    found = nodes.filter(F.col("symbol") == symbol)
    if file_path:
        found = found.filter(F.col("file_path") == file_path)
    return found.orderBy("file_path", "line_start", "id").limit(1)


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path."""
    window = Window.partitionBy("path").orderBy(F.desc("event_time"), F.desc("is_delete"))
    return changes.withColumn("n", F.row_number().over(window)).filter("n = 1").drop("n")
