"""Scalar functions as Spark expressions: identities, severities, texts and small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity of each vulnerability class (others are low), severity ranks, extensions of languages.
SEVERITY = {"rce": "critical", "deserialization": "critical", "sqli": "high", "ssrf": "high", "path_traversal": "medium", "xss": "medium"}
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
LANGUAGE = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go"}
#: Advice for each class.
REMEDIATION = {
    "sqli": "Use parameterized queries / prepared statements. Never interpolate user input into SQL strings.",
    "xss": "Escape output with a context-appropriate sanitizer (DOMPurify, html.EscapeString). Avoid innerHTML with untrusted data.",
    "rce": "Avoid passing user input to exec/eval. Validate against an allowlist. Use language-native APIs instead of shell commands.",
    "path_traversal": "Validate and normalize file paths. Use filepath.Clean and verify the result is within an allowed base directory.",
    "ssrf": "Validate URLs against an allowlist of permitted hosts. Block internal/private IP ranges. Use a proxy with egress filtering.",
    "deserialization": "Avoid deserializing untrusted data. Use JSON instead of pickle/YAML. If unavoidable, use HMAC signatures to verify data integrity before deserialization.",
}
REMEDIATION_DEFAULT = "Validate and sanitize all user-controlled input before use in sensitive operations."


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def short_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def node_id(file_path: Column | str, line: Column | str, symbol: Column | str) -> Column:
    return short_hash(F.concat_ws(":", _col(file_path), _col(line).cast("string"), _col(symbol)))


def edge_id(src: Column | str, dst: Column | str, kind: Column | str) -> Column:
    return short_hash(F.concat(_col(src), F.lit("→"), _col(dst), F.lit("["), _col(kind), F.lit("]")))


def path_id(source: Column | str, sink: Column | str) -> Column:
    return short_hash(F.concat(_col(source), _col(sink)))


def _lookup(key: Column, table: dict[str, object], default: object) -> Column:
    out = F.lit(default)
    for value, result in table.items():
        out = F.when(key == value, F.lit(result)).otherwise(out)
    return out


def severity(vuln_class: Column | str) -> Column:
    return _lookup(_col(vuln_class), SEVERITY, "low")


def severity_rank(level: Column | str) -> Column:
    """0 (critical) to 3 (low); anything else ranks last."""
    return _lookup(_col(level), SEVERITY_RANK, 3)


def remediation(vuln_class: Column | str) -> Column:
    return _lookup(_col(vuln_class), REMEDIATION, REMEDIATION_DEFAULT)


def language(path: Column | str) -> Column:
    """The language of a path's extension, whatever its case; unknown for others."""
    return _lookup(F.lower(F.regexp_extract(_col(path), r"\.([A-Za-z]+)$", 1)), LANGUAGE, "unknown")


def confidence(path_length: Column) -> Column:
    return F.when(path_length <= 2, F.lit(0.95)).otherwise(F.lit(0.85))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def split_non_empty(text: Column | str) -> Column:
    """Parts between commas, untrimmed, without empty ones."""
    return F.filter(F.split(_col(text), ","), lambda x: x != "")


def any_tainted(tainted: Column | str, args: Column | str) -> Column:
    return F.coalesce(F.arrays_overlap(_col(tainted), _col(args)), F.lit(False))


def proof(count: Column) -> Column:
    return F.when(count == 0, F.lit("NO_UNSANITIZED_PATH_EXISTS")).otherwise(F.concat(F.lit("UNSANITIZED_PATHS_FOUND: "), count.cast("string"), F.lit(" path(s) detected")))


def call_name(line: Column | str, pattern: str) -> Column:
    """The last part, between dots and blanks, of what the pattern first matches, without its closing parenthesis."""
    found = F.regexp_replace(F.regexp_extract(_col(line), pattern, 0), r"\($", "")
    parts = F.filter(F.split(found, r"[. \t]"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(found)


def assign_target(line: Column | str) -> Column:
    """What is assigned in ``x = ...``, without an annotation; empty without an assignment."""
    line = F.trim(_col(line))
    at = F.instr(line, " = ")
    left = F.trim(F.substring(line, F.lit(1), at - 1))
    colon = F.instr(left, ":")
    return F.when(at > 1, F.when(colon > 1, F.trim(F.substring(left, F.lit(1), colon - 1))).otherwise(left)).otherwise("")


def go_assign_target(line: Column | str) -> Column:
    """The first name before ``:=``."""
    line = F.trim(_col(line))
    at = F.instr(line, " := ")
    return F.when(at > 1, F.trim(F.split(F.substring(line, F.lit(1), at - 1), ",")[0])).otherwise("")


def python_params(text: Column | str) -> Column:
    """Names of a Python parameter list; starred ones are left out."""
    parts = F.filter(F.transform(F.split(_col(text), ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.startswith("*"))
    names = F.transform(parts, lambda p: F.trim(F.split(F.split(p, ":")[0], "=")[0]))
    return F.filter(names, lambda p: p != "")


def go_params(text: Column | str) -> Column:
    """The first word of each part of a Go parameter list."""
    return F.filter(F.transform(F.split(_col(text), ","), lambda p: F.split(F.trim(p), r"\s+")[0]), lambda p: p != "")


def description(source_symbol, source_file, sink_symbol, sink_file) -> Column:
    return F.concat(_col(source_symbol), F.lit(" ("), _col(source_file), F.lit(") flows to "), _col(sink_symbol), F.lit(" ("), _col(sink_file), F.lit(") without sanitization"))
