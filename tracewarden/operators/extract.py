"""Fact extraction from source files.

A small Python helper turns a file into syntax events: imports, function headers, attribute reads and
calls, with lines and argument names. What the events mean, that is rules, frameworks, handlers and order, is decided
by Spark expressions over the event table.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions import rules as R
from tracewarden.functions import scalar as S

EVENTS = "file_path string, language string, seq int, event string, recv string, name string, line int, text string, names array<string>, flag boolean"
_FIELDS = ("event", "recv", "name", "line", "text", "names", "flag")


_BREAKS = re.compile(r"""\"{3}(?:\\.|[^\\])*?\"{3}|'{3}(?:\\.|[^\\])*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|#[^\n]*|\\\n|[()\[\]{}\n]""", re.S)


def _logical_lines(lines: list[str], first: int, last: int) -> list[tuple[int, int]]:
    """Ranges of physical lines that are one logical line each: a line ends where no bracket or long string is open."""
    cuts, line, depth = [first], first, 0
    for m in _BREAKS.finditer("".join(lines[first:last])):
        word = m.group()
        depth += (word in "([{") - (word in ")]}")
        line += word.count("\n")
        if word == "\n" and depth <= 0:
            cuts.append(line)
            depth = 0
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], last]) if a < b]


def _units(text: str):
    """Parsed units of a Python file: (tree, its source as UTF-8 lines, lines before it).

    A file that parses is one unit. Of another, each top-level block is one if it parses; of a block that doesn't, each logical line
    that parses by itself (a header with an empty body), and of a logical line that doesn't, each physical one, so that
    one broken statement costs no other facts.
    """
    lines = re.split(r"(?<=\n)", text.replace("\r\n", "\n").replace("\r", "\n").replace("\f", " "))
    waiting = [(0, len(lines), 0)]
    while waiting:
        first, last, level = waiting.pop()
        source = "".join(lines[first:last])
        if level == 1 and source.startswith("@") and source.rstrip().endswith(":"):
            source = source.rstrip() + " pass"  # a decorated header whose body is elsewhere
        if level >= 2:
            source = source.strip()
            source += "\ndef _(): pass" if source.startswith("@") else " pass" if source.endswith(":") else ""
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            if level == 0:
                cuts = [k for k in range(first, last) if lines[k][:1] not in " \t\r\n)]}#" and (k == first or lines[k - 1][:1] != "@")] or [first]
                cuts[0] = first
                waiting += [(x, y, 1) for x, y in zip(cuts, [*cuts[1:], last])][::-1]
            elif level == 1:
                waiting += [(a, b, 2) for a, b in _logical_lines(lines, first, last)][::-1]
            elif level == 2 and last - first > 1:
                waiting += [(k, k + 1, 3) for k in range(first, last)][::-1]
            continue
        if level >= 2 and source.endswith("\ndef _(): pass"):
            tree.body[0].name = ""  # a decorator by itself has no function
        yield tree, [x.encode() for x in re.split(r"(?<=\n)", source)], first


def _between(lines: list[bytes], a: tuple[int, int], b: tuple[int, int]) -> str:
    """The source from (line, byte column) a to b; lines count from 1."""
    if a[0] == b[0]:
        return lines[a[0] - 1][a[1] : b[1]].decode(errors="replace")
    return b"".join([lines[a[0] - 1][a[1] :], *lines[a[0] : b[0] - 1], lines[b[0] - 1][: b[1]]]).decode(errors="replace")


def python_events(text: str):
    """Syntax events of a Python file in source order; a file that doesn't parse whole gives those of its parts that do."""
    for tree, lines, before in _units(text):
        for kind, recv, name, line, *rest in _python_events(tree, lines):
            yield kind, recv, name, line + before, *rest


def _python_events(tree: ast.AST, lines: list[bytes]):
    nodes = [n for n in ast.walk(tree) if hasattr(n, "lineno")]
    nodes.sort(key=lambda n: (n.lineno, n.col_offset, -(n.end_lineno or 0), -(n.end_col_offset or 0)))
    for n in nodes:
        if isinstance(n, ast.Import):
            for a in n.names:
                yield "import", "", a.name, n.lineno, "", [], False
        elif isinstance(n, ast.ImportFrom) and not n.level and n.module:
            yield "import", "", n.module, n.lineno, "", [], False
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name:
            # a typed parameter without a default has no name of its own in the grammar and stays out
            args = [*n.args.posonlyargs, *n.args.args]
            plain = len(args) - len(n.args.defaults)
            names = [a.arg for k, a in enumerate(args) if a.arg not in ("self", "cls") and not (k < plain and a.annotation)]
            names += [a.arg for a, d in zip(n.args.kwonlyargs, n.args.kw_defaults) if d is not None or not a.annotation]
            last = n.decorator_list[-1] if n.decorator_list else None
            call = last.func if isinstance(last, ast.Call) else None
            handler = isinstance(call, ast.Attribute) and call.attr in R.ROUTES or isinstance(call, ast.Name) and call.id in R.ROUTES
            yield "def", "", n.name, n.lineno, "", names, handler
        elif isinstance(n, (ast.Assign, ast.AnnAssign)) and n.value is not None:
            for target in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(target, ast.Name):
                    yield "assign", "", target.id, n.lineno, "", [], False
        elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name):
            yield "attr", n.value.id, n.attr, n.lineno, "", [], False
        elif isinstance(n, ast.Call):
            names = [a.id for a in n.args if isinstance(a, ast.Name)]
            if isinstance(n.func, ast.Name):
                yield "call", "", n.func.id, n.func.lineno, "", names, True
            elif isinstance(n.func, ast.Attribute):
                recv = n.func.value.id if isinstance(n.func.value, ast.Name) else ""
                shown = f"{recv}.{n.func.attr}{_between(lines, (n.func.end_lineno, n.func.end_col_offset), (n.end_lineno, n.end_col_offset)).lstrip()}" if recv else ""
                yield "call", recv, n.func.attr, n.func.end_lineno, shown, names, False


_TOKEN = re.compile(r"""(?P<skip>//[^\n]*|/\*.*?\*/|[ \t\r\f]+)|(?P<nl>\n)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<id>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<arrow>=>)|(?P<op>.)""", re.S)
_REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])*/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.S)
_RAW = re.compile(r"`[^`]*`")
# Words before a parenthesis that are no callee.
_NO_CALL = {"go": frozenset("if for switch func return go defer select case else interface struct map chan type import range".split()), "script": frozenset("async if for while switch catch function return typeof await new case else do in of import super".split())}
# Names of Go calls whose receiver a rule reads or shows.
_GO_NAMES = frozenset(R.GO_SOURCES).union(*(names for _, names, _ in (*R.GO_SINKS, *R.GO_SANITIZERS)))
_METHOD_AFTER = frozenset(("{", "}", ";", ",", "async", "static", "get", "set", "public", "private", "protected", "override", ""))


def tokens(text: str, go: bool = False) -> list[tuple[str, str, int, int, int]]:
    """(kind, text, line, start, end) of C-like source; comments and blanks are left out.

    A template string is the texts between its expressions, with the expressions' own tokens in parentheses between them.
    """
    out, line, at = [], 1, 0
    braces: list[int] = []  # open braces within each expression of a template string that is under way
    value = False  # whether the last token ends a value, so that a slash divides
    while at < len(text):
        ch = text[at]
        if ch == "`" and go:
            m = _RAW.match(text, at)
            end = m.end() if m else len(text)
            out.append(("str", text[at:end], line, at, end))
            line, at, value = line + text.count("\n", at, end), end, True
            continue
        if not go and (ch == "`" or ch == "}" and braces and not braces[-1]):
            if ch == "}":
                braces.pop()
                out.append(("op", ")", line, at, at + 1))
            end = _TEMPLATE.match(text, at + 1).end()
            out.append(("str", "`" + text[at + 1 : end] + "`", line, at, end))
            line += text.count("\n", at, end)
            if text.startswith("${", end):
                out.append(("op", "(", line, end, end + 2))
                braces.append(0)
                at, value = end + 2, False
            else:
                at, value = end + 1, True
            continue
        m = _REGEX.match(text, at) if ch == "/" and not go and not value and text[at + 1 : at + 2] not in ("/", "*") else None
        if m:
            out.append(("num", m.group(), line, at, m.end()))
            at, value = m.end(), True
            continue
        m = _TOKEN.match(text, at)
        kind = m.lastgroup
        if kind not in ("skip", "nl"):
            if braces:
                braces[-1] += (ch == "{") - (ch == "}")
            out.append((kind, m.group(), line, at, m.end()))
            value = kind in ("str", "num") or kind == "id" and m.group() not in ("return", "typeof", "case", "in", "of", "await", "new", "else", "do", "void", "delete", "yield") or m.group() in (")", "]")
        line += text.count("\n", at, m.end())
        at = m.end()
    return out


def matching(toks: list) -> list[int]:
    """For each opening bracket the position of the one that closes it (the last token where none does), for each closing
    one that which opens it (-1 where none does); -1 for other tokens. One pass."""
    out, opened = [-1] * len(toks), []
    for k, t in enumerate(toks):
        if t[1] in ("(", "[", "{"):
            opened.append(k)
        elif t[1] in (")", "]", "}") and opened:
            out[k] = opened.pop()
            out[out[k]] = k
    for k in opened:
        out[k] = len(toks) - 1
    return out


def _parts(toks: list, pair: list[int], first: int, last: int) -> list[list]:
    """Token lists between the commas of a bracket's inside; of inner brackets only the opening ones."""
    out, k, typed, angle = [[]], first + 1, False, 0
    while k < last:
        word = toks[k][1]
        if word in (":", "="):
            typed, angle = word == ":", 0
        elif typed:  # commas of a generic type divide nothing
            angle += (word == "<") - (word == ">")
        if word == "," and angle <= 0:
            out.append([])
            typed, angle = False, 0
        else:
            out[-1].append(toks[k])
        k = pair[k] + 1 if toks[k][1] in ("(", "[", "{") else k + 1
    return [p for p in out if p]


def _chain_start(toks: list, pair: list[int], dot: int, starts: dict[int, int]) -> int:
    """Where the operand before a dot begins: names, dots and balanced brackets to the left. ``starts`` remembers it for each
    dot before a call, so that a chain of calls is walked once."""
    k = dot - 1
    while k >= 0:
        if toks[k][1] in (")", "]"):
            if pair[k] < 0:
                return 0
            k = pair[k] - 1
            if k >= 0 and toks[k][0] in ("id", "str"):
                continue
            return k + 1
        if toks[k][0] not in ("id", "str"):
            return k + 1
        if k >= 1 and toks[k - 1][1] == ".":
            if k - 1 in starts:
                return starts[k - 1]
            k -= 2
            continue
        return k
    return 0


def _decorated(toks: list, pair: list[int], k: int) -> bool:
    """Whether a decorator ends right before the token at k."""
    j = k - 1
    if j > 0 and toks[j][1] == ")":
        j = pair[j] - 1
    while j > 1 and toks[j][0] == "id" and toks[j - 1][1] == ".":
        j -= 2
    return j > 0 and toks[j][0] == "id" and toks[j - 1][1] == "@"


_STATEMENTS = frozenset("const let var function class return if for while switch throw try import export".split())


def _after_type(toks: list, pair: list[int], at: int, wanted: tuple[str, ...]) -> int:
    """The first of ``wanted`` behind a type that begins at ``at``, outside its brackets and angle brackets; -1 where the
    statement ends before. A brace opens an object type where a type is due, and else a body."""
    angle, due = 0, True
    while at < len(toks):
        word = toks[at][1]
        if not angle and word in wanted and not (word == "{" and due):
            return at
        if word in ("(", "[", "{"):
            if word == "{" and not due and not angle:
                return -1
            at, due = pair[at] + 1, False
            continue
        if word in (";", ")", "]", "}") or toks[at][0] == "id" and word in _STATEMENTS or not angle and word in ("=", ","):
            return -1
        angle += (word == "<") - (word == ">" and angle > 0)
        due = word in (":", "|", "&", "<", ",", "=>", "extends", "keyof", "readonly", "is", "?")
        at += 1
    return -1


def c_like_events(text: str, language: str):
    """Syntax events of a TypeScript, JavaScript or Go file in source order."""
    go = language == "go"
    toks = tokens(text, go)
    pair = matching(toks)
    words = _NO_CALL["go" if go else "script"]
    word_at = lambda j: toks[j][1] if 0 <= j < len(toks) else ""
    block = 0
    starts: dict[int, int] = {}
    for k, (kind, word, line, _, _) in enumerate(toks):
        before = word_at(k - 1)
        after = toks[k + 1] if k + 1 < len(toks) else ("", "", 0, 0, 0)
        if kind == "str":
            imported = before in ("import", "from") or k <= block or (before == "(" and word_at(k - 2) == "require" and not go)
            if go and before != "import" and word_at(k - 2) == "import" and toks[k - 1][0] == "id":
                imported = True
            if imported:
                yield "import", "", word[1:-1], line, "", [], False
            continue
        if kind != "id":
            continue
        if go and word == "import" and after[1] == "(":
            block = pair[k + 1]
        if word in words:
            continue
        if not go and after[1] == "." and before != "." and k + 2 < len(toks) and toks[k + 2][0] == "id":
            yield "attr", word, toks[k + 2][1], line, "", [], False
        if go and before not in (".", ",") and _declares(toks, k):
            yield "assign", "", word, line, "", [], False
        if not go and before in ("const", "let", "var") and after[1] in ("=", ":"):
            at = k + 1 if after[1] == "=" else _after_type(toks, pair, k + 2, ("=",))
            if at > 0 and at + 1 < len(toks):
                yield "assign", "", word, line, "", [], False
                at += 1 + (toks[at + 1][1] == "async")
                if word_at(at) == "(" and before != "var":
                    close = pair[at]
                    if word_at(close + 1) == "=>" or word_at(close + 1) == ":" and _after_type(toks, pair, close + 2, ("=>",)) > 0:
                        yield "def", "", word, line, "", _names(toks, pair, at, close, go), False
            continue
        if after[1] != "(":
            continue
        close = pair[k + 1]
        method = go and before == ")" and pair[k - 1] > 0 and toks[pair[k - 1] - 1][1] == "func"
        if before == ("func" if go else "function") or (before == "*" and word_at(k - 2) == "function") or method:
            span = text[toks[k + 1][3] : toks[close][4]]
            yield "def", "", word, line, "", _names(toks, pair, k + 1, close, go), go and "http.ResponseWriter" in span and "http.Request" in span
            continue
        follow = word_at(close + 1)
        if not go and (follow == "{" or follow == ":" and _after_type(toks, pair, close + 2, ("{",)) > 0) and (before in _METHOD_AFTER or _decorated(toks, pair, k)):
            yield "def", "", word, line, "", _names(toks, pair, k + 1, close, go), False
            continue
        names = [p[0][1] for p in _parts(toks, pair, k + 1, close) if len(p) == 1 and p[0][0] == "id"]
        if before == ".":
            first = starts[k - 1] = _chain_start(toks, pair, k - 1, starts)
            # a receiver of several tokens is cut out for rules only: a chain of n calls holds n receivers of its length
            recv = text[toks[first][3] : toks[k - 2][4]] if k >= 2 and (first == k - 2 or go and word in _GO_NAMES) else ""
            yield "call", recv, word, line, "", names, False
        else:
            yield "call", "", word, line, "", names, True


def _declares(toks: list, k: int) -> bool:
    """Whether the Go name at k is the first of a list of names before ``:=``."""
    while k + 2 < len(toks) and toks[k + 1][1] == "," and toks[k + 2][0] == "id":
        k += 2
    return k + 2 < len(toks) and toks[k + 1][1] == ":" and toks[k + 2][1] == "=" and toks[k + 1][4] == toks[k + 2][3]


def _names(toks: list, pair: list[int], first: int, last: int, go: bool) -> list[str]:
    """Parameter names: the first name of each part; in Go, only of parts with a type (a, b T counts a's declaration by b's type)."""
    out, waiting = [], []
    for part in _parts(toks, pair, first, last):
        names = [t for t in part if t[0] == "id" and t[1] not in ("public", "private", "protected", "readonly")]
        if not names:
            continue
        if not go:
            if part[0][1] not in ("{", "[", "."):
                out.append(names[0][1])
        elif len(part) == 1:
            waiting.append(names[0][1])
        else:
            out.append(waiting[0] if waiting else names[0][1])
            waiting = []
    return out


#: Events of one output batch.
EVENTS_AT_ONCE = 20_000


def event_batches(batches: Iterable[pa.RecordBatch], most: int = EVENTS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Event rows of Arrow batches of files, in batches of ``most`` events: a worker holds one file's text and so many events."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.bool_())
    names = ("file_path", "language", "seq", *_FIELDS)
    out: dict[str, list] = {n: [] for n in names}
    for batch in batches:
        for k in range(batch.num_rows):
            path, language, content = (batch.column(c)[k].as_py() for c in range(3))
            found = python_events(content) if language == "python" else c_like_events(content, language)
            for seq, event in enumerate(found):
                for name, value in zip(names, (path, language, seq, *event), strict=True):
                    out[name].append(value)
                if len(out["seq"]) >= most:
                    yield pa.record_batch([pa.array(out[n], t) for n, t in zip(names, kinds, strict=True)], names=list(names))
                    out = {n: [] for n in names}
    if out["seq"]:
        yield pa.record_batch([pa.array(out[n], t) for n, t in zip(names, kinds, strict=True)], names=list(names))


def syntax_events(files: DataFrame) -> DataFrame:
    """Event rows of (path, language, content) files, file by file in Arrow batches."""

    known = files.filter(F.col("language").isin("python", "typescript", "javascript", "go"))
    return known.select("path", "language", F.coalesce("content", F.lit("")).alias("content")).mapInArrow(event_batches, EVENTS)


def facts(events: DataFrame, enclosing: bool = False, assigned: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parsed nodes, functions, call sites) of syntax events. The events are read three times: persist or write them.

    ``enclosing`` attributes calls to the nearest function above them instead of to the file's first; ``assigned`` also
    taints the variables to which a source's line assigns.
    """
    family = F.when(F.col("language") == "javascript", "typescript").otherwise(F.col("language"))
    events = events.withColumn("family", family)
    packages = events.filter("event = 'import'")
    named = F.coalesce(*[F.when(F.col("family") == f, R.framework_of(f, F.col("name"))) for f in ("python", "typescript", "go")])
    fills = packages.withColumn("f", named).filter("f is not null")
    framework = fills.groupBy("file_path").agg(F.coalesce(F.max_by(F.when(F.col("f") != "starlette", F.col("f")), F.when(F.col("f") != "starlette", F.col("seq"))), F.max("f")).alias("framework"))
    events = events.join(framework, "file_path", "left").withColumn("framework", F.coalesce("framework", F.lit("")))
    python, script, go = (F.col("family") == f for f in ("python", "typescript", "go"))
    dotted = F.concat_ws(".", "recv", "name")
    empty = F.array().cast("array<string>")

    def node(step: int, cond, kind, symbol, vuln_class, text, tainted, after: int = 0):
        fields = (_order(step, F.col("seq"), F.lit(0)) + after, F.lit(kind), symbol, vuln_class, text, tainted.cast("array<string>"))
        return F.when(cond, F.struct(*[f.alias(n) for f, n in zip(fields, shown, strict=True)]))

    def ruled(step, cond, kind, table, symbol, text, after: int = 0):
        c = R.classified(table, F.col("recv"), F.col("name"))
        return node(step, cond & (c != ""), kind, symbol, c, text, empty, after)

    def parameter(x, p):
        fields = (_order(1, F.col("seq"), p), F.lit("SourceNode"), x, F.lit(""), header, F.array(x))
        return F.struct(*[f.alias(n) for f, n in zip(fields, shown, strict=True)])

    shown = ("ord", "kind", "symbol", "vuln_class", "text", "tainted_vars")
    is_source = python & F.col("recv").isin(*R.PYTHON_SOURCES[0]) & F.col("name").isin(*R.PYTHON_SOURCES[1])
    for receivers, names in R.TS_SOURCES:
        is_source = is_source | (script & F.col("recv").isin(*receivers) & F.col("name").isin(*names))
    call = F.col("event") == "call"
    methods, bare = call & python & ~F.col("flag") & (F.col("recv") != ""), call & python & F.col("flag")
    scripts, selectors = call & script, call & go & ~F.col("flag")
    go_source = F.col("name").isin(*R.GO_SOURCES) | ((F.col("name") == "Get") & F.col("recv").contains("URL.Query"))
    sink, clean = "SinkNode", "SanitizerNode"
    dots, header = F.concat("name", F.lit("(...)")), F.concat("name", F.lit("("), F.concat_ws(", ", "names"), F.lit(")"))
    # what an event gives, as an array of nodes: the events are read once
    single = F.array(
        node(2, (F.col("event") == "attr") & is_source, "SourceNode", dotted, F.lit(""), dotted, F.array(dotted)),
        ruled(3, methods, sink, R.PYTHON_SINKS, dotted, F.col("text")),
        ruled(3, methods, clean, R.PYTHON_SANITIZERS, dotted, F.col("text"), 1),
        ruled(4, bare, sink, R.PYTHON_BARE_SINKS, F.col("name"), dots),
        ruled(4, bare, clean, R.PYTHON_SANITIZERS, F.col("name"), dots, 1),
        ruled(3, scripts, sink, R.TS_SINKS, F.col("name"), F.lit("")),
        ruled(3, scripts, clean, R.TS_SANITIZERS, F.col("name"), F.lit(""), 1),
        node(3, selectors & go_source, "SourceNode", dotted, F.lit(""), dotted, F.array("recv")),
        ruled(3, selectors & ~go_source, sink, R.GO_SINKS, dotted, F.lit("")),
        ruled(3, selectors & ~go_source, clean, R.GO_SANITIZERS, dotted, F.lit(""), 1),
    )
    handler = (F.col("event") == "def") & python & F.col("flag")
    params = F.filter(F.transform(F.when(handler, F.col("names")).otherwise(empty), parameter), lambda x: ~x["symbol"].isin("", "self", "request", "req"))
    found = F.concat(params, F.filter(single, lambda x: x.isNotNull()))
    nodes = events.filter(handler | call | (F.col("event") == "attr")).select("file_path", "framework", "line", F.explode(found).alias("f"))
    nodes = nodes.select("file_path", "f.ord", "f.kind", "f.symbol", "f.vuln_class", "framework", "line", "f.text", "f.tainted_vars")
    defs, calls = events.filter("event = 'def'"), events.filter("event = 'call'")
    if assigned:
        targets = events.filter("event = 'assign'").groupBy("file_path", "line").agg(F.array_sort(F.collect_set("name")).alias("targets"))
        known = F.when((F.col("kind") == "SourceNode") & F.col("targets").isNotNull(), F.array_union("tainted_vars", "targets")).otherwise(F.col("tainted_vars"))
        nodes = nodes.join(targets, ["file_path", "line"], "left").withColumn("tainted_vars", known).select(nodes.columns)
    functions = defs.select("file_path", F.col("seq").cast("long").alias("ord"), "name", "line", F.col("names").alias("params"), F.col("flag").alias("is_handler"), "framework")
    first = defs.filter(python).groupBy("file_path").agg(F.min_by("name", "seq").alias("caller"))
    sites = calls.filter((F.col("name") != "") & ~F.col("name").isin(*R.BUILTINS)).join(first, "file_path", "left")
    sites = sites.select("file_path", F.col("seq").cast("long").alias("ord"), F.when(python, F.coalesce("caller", F.lit(""))).otherwise("").alias("caller_func"), F.col("name").alias("callee"), F.col("names").alias("arg_names"), "line")
    return nodes, functions, enclosing_caller(functions, sites) if enclosing else sites


def _order(step: int, seq: Column, p: Column) -> Column:
    """An order key of (pass, event, parameter): any number of events and 65,536 parameters stay in their pass."""
    return F.lit(step << 50).cast("long") + F.shiftleft(seq.cast("long"), 18) + F.shiftleft(p.cast("long"), 2)


def enclosing_caller(functions: DataFrame, sites: DataFrame) -> DataFrame:
    """Call sites attributed to the nearest function above them in the file, instead of to the file's first."""
    both = sites.select("file_path", "line", F.lit(1).alias("k"), "ord", "callee", "arg_names", F.lit(None).cast("string").alias("fn")).unionByName(functions.select("file_path", "line", F.lit(0).alias("k"), "ord", F.lit(None).cast("string").alias("callee"), F.lit(None).cast("array<string>").alias("arg_names"), F.col("name").alias("fn")))
    window = Window.partitionBy("file_path").orderBy("line", "k", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("caller_func", F.coalesce(F.last("fn", ignorenulls=True).over(window), F.lit(""))).filter("k = 1").select("file_path", "ord", "caller_func", "callee", "arg_names", "line")


def source_files(files: DataFrame) -> DataFrame:
    """(path, language, hash, content) of (path, content) rows in a known language."""
    return files.withColumn("language", S.language("path")).filter("language <> 'unknown'").select("path", "language", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("hash"), F.coalesce("content", F.lit("")).alias("content"))
