"""Rule tables as data, and the Spark expressions made of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a source, sink or sanitizer. A rule holds receivers (empty: any), names (empty: any)
# and a class; the first rule that matches decides.
PYTHON_SINKS = (
    (("cursor", "conn", "db", "session", "engine", "connection"), ("execute", "executemany", "executescript", "scalar", "query", "exec_driver_sql"), "sqli"),
    (("os",), ("system", "popen"), "rce"),
    (("subprocess",), ("system", "popen", "run", "call", "Popen", "check_output", "check_call", "eval", "exec", "compile"), "rce"),
    (("os",), ("open", "remove", "unlink", "rename", "mkdir", "makedirs", "listdir"), "path_traversal"),
    (("shutil",), (), "path_traversal"),
    (("requests", "httpx", "aiohttp", "urllib", "session"), ("get", "post", "put", "delete", "patch", "request", "head", "options"), "ssrf"),
    (("pickle", "yaml", "marshal", "jsonpickle"), ("loads", "load", "decode"), "deserialization"),
    ((), ("Markup", "mark_safe", "format_html"), "xss"),
)
PYTHON_BARE_SINKS = (((), ("eval", "exec", "compile"), "rce"),)
PYTHON_SANITIZERS = (((), ("escape", "clean", "sanitize", "html_escape", "bleach"), "xss"), ((), ("text", "filter", "filter_by", "quote", "quote_plus"), "sqli"))
PYTHON_SOURCES = (("request", "req"), ("args", "form", "json", "data", "files", "cookies", "headers", "values", "query_params", "path_params", "body"))
TS_SOURCES = ((("req", "request"), ("body", "query", "params", "headers", "cookies")), (("location", "document"), ("URL", "href", "hash", "search", "pathname")))
TS_SINKS = (
    ((), ("innerHTML", "outerHTML", "write", "dangerouslySetInnerHTML"), "xss"),
    ((), ("eval", "exec", "execSync", "spawn", "spawnSync", "execFile"), "rce"),
    ((), ("readFile", "readFileSync", "writeFile", "writeFileSync", "appendFile", "unlink", "rm"), "path_traversal"),
    ((), ("fetch",), "ssrf"),
)
TS_SANITIZERS = (((), ("sanitize", "encodeURIComponent", "encodeURI", "escape"), "xss"), ((), ("prepare",), "sqli"))
GO_SOURCES = ("FormValue", "PostFormValue", "Header", "Cookie", "URLParam", "PathValue", "Param", "Query", "PostForm", "GetRawData", "ShouldBind", "Bind")
GO_SINKS = (
    ((), ("QueryRow", "Exec", "QueryContext", "ExecContext", "QueryRowContext"), "sqli"),
    ((), ("Open", "OpenFile", "Create", "ReadFile", "WriteFile", "Remove", "Rename"), "path_traversal"),
    ((), ("Command", "StartProcess"), "rce"),
    (("http", "client"), ("Get", "Post", "Head", "Do"), "ssrf"),
    (("template",), ("HTML",), "xss"),
)
GO_SANITIZERS = (((), ("EscapeString", "HTMLEscapeString"), "xss"),)
# Names that are no call sites, names of route decorators, imports that tell a framework, folders that a scan leaves out.
#: Names that are no call sites.
BUILTINS = ("print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple", "type", "isinstance", "hasattr", "getattr", "setattr", "append", "extend", "format", "super", "property", "staticmethod", "classmethod", "console", "setTimeout", "setInterval", "clearTimeout", "parseInt", "parseFloat", "JSON", "Object", "Array", "Promise", "Math", "Date", "make", "new", "copy", "delete", "close", "panic", "recover", "cap")
ROUTES = ("get", "post", "put", "patch", "delete", "websocket", "route")
#: (language, prefix or, for Go, part of an import, framework); the last import that matches decides, but starlette only fills a gap.
FRAMEWORKS = (("python", "fastapi", "fastapi"), ("python", "django", "django"), ("python", "flask", "flask"), ("python", "starlette", "starlette"), ("typescript", "express", "express"), ("typescript", "next", "nextjs"), ("typescript", "fastify", "fastify"), ("typescript", "koa", "koa"), ("go", "go-chi/chi", "chi"), ("go", "gin-gonic/gin", "gin"))
#: Folders that a scan leaves out.
IGNORED = ("node_modules", ".git", "__pycache__", ".venv", "venv", "env", "vendor", "dist", "build", ".next", ".turbo", "coverage", ".pytest_cache", ".mypy_cache", ".ruff_cache", "testdata")


def classified(rules: tuple, receiver: Column, name: Column) -> Column:
    """The class of the first rule that matches; empty without one."""
    out = F.lit("")
    for receivers, names, kind in reversed(rules):
        hit = F.lit(True)
        if receivers:
            hit = hit & receiver.isin(*receivers)
        if names:
            hit = hit & name.isin(*names)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def framework_of(language: str, package: Column) -> Column:
    """The framework that an import names; null for none."""
    out = F.lit(None).cast("string")
    for lang, mark, name in reversed(FRAMEWORKS):
        if lang == language:
            out = F.when(package.contains(mark) if language == "go" else package.startswith(mark), F.lit(name)).otherwise(out)
    return out


@dataclass(frozen=True)
class LineRule:
    """A line-regex rule: what it emits, how it names the symbol ('call', 'group:<prefix>', or a text) and what becomes tainted."""

    name: str
    language: str
    kind: str
    vuln_class: str
    pattern: str
    symbol: str = "call"
    target: str = ""


_SRC, _SNK, _SAN = "SourceNode", "SinkNode", "SanitizerNode"
# The patterns of the line classifiers (RE2 and Java agree on them for ASCII blanks), in the order in which they emit.
LINE_RULES = (
    LineRule("py_django_view", "python", _SRC, "", r"def\s+\w+\s*\(\s*(?:self,\s*)?request(?:\s*:\s*\w+)?", "request", "request"),
    LineRule("py_request", "python", _SRC, "", r"request\.(body|json|data|form|args|query_params|path_params|headers|cookies|files)", "group:request.", "assign"),
    LineRule("py_flask", "python", _SRC, "", r"request\.(args|form|json|data|files|cookies|headers|values)", "group:request.", "assign"),
    LineRule("py_sql", "python", _SNK, "sqli", r"(?:cursor|conn|db|session|engine)\.(?:execute|executemany|executescript|scalar|query|exec_driver_sql)\s*\("),
    LineRule("py_rce", "python", _SNK, "rce", r"(?:os\.system|os\.popen|subprocess\.(?:run|call|Popen|check_output|check_call)|eval|exec|compile)\s*\("),
    LineRule("py_path", "python", _SNK, "path_traversal", r"(?:open|os\.(?:remove|unlink|rename|mkdir|makedirs|listdir)|shutil\.\w+|pathlib\.Path)\s*\("),
    LineRule("py_deser", "python", _SNK, "deserialization", r"(?:pickle\.loads|pickle\.load|yaml\.load|marshal\.loads|jsonpickle\.decode)\s*\("),
    LineRule("py_ssrf", "python", _SNK, "ssrf", r"(?:requests\.|httpx\.|urllib\.request\.|aiohttp\.ClientSession\(\)\.)(?:get|post|put|delete|patch|request|head|options)\s*\("),
    LineRule("py_html", "python", _SNK, "xss", r"(?:Markup|mark_safe|format_html|jinja2\.Markup)\s*\("),
    LineRule("py_sql_clean", "python", _SAN, "sqli", r"(?:text\(\)|bindparams|sqlalchemy\.text|\.filter\(|\.filter_by\(|paramstyle)"),
    LineRule("py_html_clean", "python", _SAN, "xss", r"(?:html\.escape|bleach\.clean|markupsafe\.escape|escape\()"),
    LineRule("ts_req", "typescript", _SRC, "", r"req\.(body|query|params|headers|cookies)", "group:req.", "assign"),
    LineRule("ts_next", "typescript", _SRC, "", r"(?:request\.json\(\)|params\.|searchParams\.|request\.headers)", "request", "assign"),
    LineRule("ts_dom", "typescript", _SRC, "", r"(?:document\.URL|location\.(?:href|hash|search|pathname)|URLSearchParams)", "location", "assign"),
    LineRule("ts_html", "typescript", _SNK, "xss", r"\.innerHTML\s*=|\.outerHTML\s*=|document\.write\s*\(", "innerHTML"),
    LineRule("ts_danger", "typescript", _SNK, "xss", r"dangerouslySetInnerHTML", "dangerouslySetInnerHTML"),
    LineRule("ts_eval", "typescript", _SNK, "rce", r"(?:^|[^a-zA-Z.])eval\s*\(", "eval"),
    LineRule("ts_exec", "typescript", _SNK, "rce", r"child_process\.(?:exec|execSync|spawn|spawnSync|execFile)\s*\("),
    LineRule("ts_fs", "typescript", _SNK, "path_traversal", r"fs\.(?:readFile|readFileSync|writeFile|writeFileSync|appendFile|unlink|rm)\s*\("),
    LineRule("ts_fetch", "typescript", _SNK, "ssrf", r"(?:^|[^a-zA-Z])fetch\s*\(|axios\.(?:get|post|put|delete|request)\s*\(", "fetch"),
    LineRule("ts_purify", "typescript", _SAN, "xss", r"DOMPurify\.sanitize\s*\(", "DOMPurify.sanitize"),
    LineRule("ts_encode", "typescript", _SAN, "xss", r"encodeURIComponent\s*\(|encodeURI\s*\(", "encodeURIComponent"),
    LineRule("ts_prepared", "typescript", _SAN, "sqli", r"\.prepare\s*\(|parameterized|bindParam", "parameterized_query"),
    LineRule("go_chi", "go", _SRC, "", r"chi\.URLParam\s*\(|r\.PathValue\s*\(", "chi.URLParam", "go_assign"),
    LineRule("go_net", "go", _SRC, "", r"r\.(URL\.Query\(\)\.Get|FormValue|PostFormValue|Header\.Get|Cookie)\s*\(", "group:r.", "go_assign"),
    LineRule("go_gin", "go", _SRC, "", r"c\.(?:Param|Query|PostForm|GetRawData|ShouldBind|Bind)\s*\(", "call", "go_assign"),
    LineRule("go_sql", "go", _SNK, "sqli", r"(?:db|tx|stmt|pool|conn|pgxpool)\.(?:Query|QueryRow|Exec|QueryContext|ExecContext|QueryRowContext|Begin|Send)\s*\("),
    LineRule("go_rce", "go", _SNK, "rce", r"exec\.Command\s*\(|os\.(?:StartProcess|Create)\s*\("),
    LineRule("go_file", "go", _SNK, "path_traversal", r"os\.(?:Open|OpenFile|Create|ReadFile|WriteFile|Remove|Rename)\s*\("),
    LineRule("go_http", "go", _SNK, "ssrf", r"http\.(?:Get|Post|Head|Do)\s*\("),
    LineRule("go_template", "go", _SNK, "xss", r"template\.HTML\(|html/template.*unsafe", "template.HTML"),
    LineRule("go_html_clean", "go", _SAN, "xss", r"html\.EscapeString\s*\(|template\.HTMLEscapeString\s*\(", "html.EscapeString"),
    LineRule("go_pgx", "go", _SAN, "sqli", r"""pgx\.|pgxpool\.|\.QueryRow\s*\(ctx[^,)]*,\s*"[^"]*\"""", "pgx.parameterized"),
)
# Line patterns of imports, function headers, route decorators and handlers.
LINE_IMPORTS = {"python": r"(?:^|\s)(?:import|from)\s+([\w.]+)", "typescript": r"""(?:import|require)\s*(?:\{[^}]*\}|[\w*]+|\(['"])\s*(?:from\s*)?['"]([^'"]+)['"]""", "go": r'"([^"]+)"'}
HEADERS = {"python": r"^(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)", "go": r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(([^)]*)\)"}
PYTHON_ROUTE = r"@(?:app|router)\.(get|post|put|patch|delete|websocket)\("
GO_HANDLER = r"\(\s*\w+\s+http\.ResponseWriter\s*,\s*\w+\s+\*http\.Request\s*\)"
