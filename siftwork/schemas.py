"""Fixed schemas of the tables that operators exchange; nothing is inferred."""

from __future__ import annotations

POSITION = "struct<line:int,col:int>"
REGION = f"struct<start:{POSITION},end:{POSITION}>"
EDIT = f"struct<start:{POSITION},end:{POSITION},edit_type:string,content:string>"
FIX = f"struct<description:string,edits:array<{EDIT}>>"

ARTIFACTS = "path string, content string, size_bytes long"
RULES = "ruleset string, name string, short_description string, description string, category string, severity string, language string, rule_type string, code string, cwe string, checksum string, pattern string, tree_sitter_query string, arguments array<struct<name:string,description:string>>, tests array<struct<annotation_count:int,filename:string,code:string>>, is_testing boolean, documentation_url string"
SECRET_RULES = "rule_id string, name string, description string, pattern string, included_keywords array<string>, excluded_keywords array<string>, priority string, is_supporting boolean, ord int"
VIOLATION = f"struct<start:{POSITION},end:{POSITION},message:string,severity:string,category:string,fixes:array<{FIX}>,taint_flow:array<{REGION}>,is_suppressed:boolean>"
RESULTS = f"rule_name string, filename string, violations array<{VIOLATION}>, errors array<string>, execution_error string, output string, execution_time_ms long, parsing_time_ms long, query_node_time_ms long"
NODES = "file_id string, node_id int, parent_id int, ordinal int, field_name string, cst_type string, is_named boolean, start_line int, start_col int, end_line int, end_col int, last_desc int, depth int, text string"
EDGES = "graph_id string, src long, dst long, kind string, seq int"
PATH_RULES = "scope string, ruleset string, rule string, kind string, pattern string"
BY_PREFIX = "rule string, prefix string, name string, value string"
SUPPRESSIONS = "path string, line int, rule string"
CHANGED_LINES = "path string, line int"
RULE_STATS = "rule_name string, filename string, execution_ms long, query_ms long, parse_ms long, error string"
