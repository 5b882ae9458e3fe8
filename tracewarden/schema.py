"""Schemas of the property graph and of the facts it is built from."""

from __future__ import annotations

NODES = "id string, type string, file_path string, line_start int, line_end int, symbol string, framework string, vuln_class string, confidence double, params array<string>, tainted_vars array<string>"
EDGES = "id string, src string, dst string, type string, args array<string>, metadata map<string,string>"
PARSED_NODES = "file_path string, ord long, kind string, symbol string, vuln_class string, framework string, line int, text string, tainted_vars array<string>"
FUNCTIONS = "file_path string, ord long, name string, line int, params array<string>, is_handler boolean, framework string"
CALL_SITES = "file_path string, ord long, caller_func string, callee string, arg_names array<string>, line int"
SOURCE_FILES = "path string, language string, hash string, content string"
CHANGES = "path string, language string, is_delete boolean, content string, event_time timestamp"

SOURCE, SINK, SANITIZER, FUNCTION = "SourceNode", "SinkNode", "SanitizerNode", "FunctionNode"
#: Types that the model knows; only the first four are ever built.
NODE_TYPES = (SOURCE, SINK, SANITIZER, FUNCTION, "TrustBoundaryEdge", "AuthCriticalNode", "GenericNode")
EDGE_TYPES = ("call", "dataflow", "return", "assignment")
