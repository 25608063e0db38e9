"""Functions and operators that no query reaches, held against plain Python."""

import hashlib
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from siftwork.functions import paths, text
from siftwork.operators import config, files, findings, nodes, rules, secrets, sinks, suppress
from siftwork.plans import scan
from siftwork.sources import repo
from siftwork.streaming import incremental

CONTENTS = ["", "a", "a\n", "a\r\nb\r", "a\r\nb\r\n", "\n\n", "é😀x\nsecond\r\n\nlast", "\r\n", "x\r\r\ny"]


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def plain_lines(s):
    parts = s.split("\n")
    ended, last = parts[:-1], parts[-1]
    return [x.removesuffix("\r") for x in ended] + ([last] if last else [])


def test_lines_and_spans(spark):
    d = spark.createDataFrame([(i, c) for i, c in enumerate(CONTENTS)], "i int, c string")
    got = {r["i"]: r["l"] for r in rows(d.select("i", text.lines(F.col("c")).alias("l")))}
    assert got == {i: plain_lines(c) for i, c in enumerate(CONTENTS)}
    got = rows(spark.createDataFrame([("aé😀b",)], "c string").select(text.byte_slice(F.col("c"), F.lit(1), F.lit(7)).alias("s")))
    assert got == [{"s": "é😀"}]


def test_utf16_columns(spark):
    c = "é😀x\nsecond\r\n\nlast"
    cases = [(row, b) for row in range(-1, 6) for b in range(-1, 12)]
    want = {}
    for row, b in cases:
        line = c.split("\n")[row].encode() if 0 <= row < 4 else None
        ok = line is not None and 0 <= b <= len(line) and (b == len(line) or line[b] & 0xC0 != 0x80)
        want[row, b] = len(line[:b].decode().encode("utf-16-le")) // 2 + 1 if ok else None
    d = spark.createDataFrame(cases, "r int, b int")
    got = {(r["r"], r["b"]): r["u"] for r in rows(d.select("r", "b", text.utf16_col(F.lit(c), F.col("r"), F.col("b")).alias("u")))}
    assert got == want


def test_offsets_give_lines(spark):
    c = "é\nb\n\nd"
    data = c.encode()
    got = {r["o"]: r["l"] for r in rows(spark.range(-0, 9).select(F.col("id").cast("int").alias("o")).select("o", text.line_of_offset(F.lit(c), F.col("o")).alias("l")))}
    assert got == {o: data[:o].count(b"\n") + 1 if o < len(data) else None for o in range(9)}


def test_fingerprint_of_a_line_equals_that_of_the_content(spark):
    d = spark.createDataFrame([("r", "a/b.py", "x = 1\n\ty = 2  \n", n) for n in (1, 2, 3)], "rule string, path string, c string, n int")
    d = d.select(text.fingerprint(F.col("rule"), F.col("path"), F.col("c"), F.array("n")).alias("a"), text.line_fingerprint(F.col("rule"), F.col("path"), text.line_at(F.col("c"), F.col("n"))).alias("b"), "n")
    out = {r["n"]: r for r in rows(d)}
    assert all(r["a"] == r["b"] for r in out.values()) and out[3]["a"] is None
    assert out[2]["a"] == hashlib.sha256(b"r|a/b.py|6|y=2|3").hexdigest()


def test_line_matches_equal_a_loop(spark):
    """Gates by literals, keywords and a search of the content lose nothing."""
    import re

    data = [("a", "mail x@y.de now\nno@\nend@z.com"), ("b", "token one\n  token two"), ("c", None), ("d", ""), ("e", "^start\nstart at"), ("f", "Word token\r\nstart x@y")]
    list_ = [
        {"rule_id": "mail", "pattern": "[a-z]+@[a-z]+[.][a-z]+", "literals": ["@"]}, {"rule_id": "first", "pattern": "^start"}, {"rule_id": "word", "pattern": "token", "included_keywords": ["WORD"]},
        {"rule_id": "not", "pattern": "token", "excluded_keywords": ["word"]}, {"rule_id": "other", "pattern": "[^a-z]tart|two$"},
    ]
    want = []
    for path, c in data:
        for r in list_:
            low = (c or "").lower()
            if any(k.lower() in low for k in r.get("included_keywords", [""])) and not any(k.lower() in low for k in r.get("excluded_keywords", [])):
                want += [(path, n, r["rule_id"], k, m[0], line) for n, line in enumerate(plain_lines(c or ""), 1) for k, m in enumerate(re.finditer(r["pattern"], line))]
    out = secrets.line_matches(spark.createDataFrame(data, "path string, content string"), list_, with_text=True)
    assert sorted((r["path"], r["line"], r["rule_id"], r["nth"], r["match"], r["line_text"]) for r in rows(out)) == sorted(want)


def test_secret_lines_equal_a_loop(spark):
    data = [("a", "#no-dd-secrets\nx"), ("b", "x\n  / / no-dd-secrets rest\ny"), ("c", "x #no-dd-secrets"), ("d", "\t# no-dd- secrets\r\nz"), ("e", None), ("f", "#no-dd-secret")]
    want = sorted((p, n + 1) for p, c in data for n, line in enumerate(plain_lines(c or ""), 1) if "".join(line.split()).startswith(suppress.SECRET_MARKS))
    assert sorted((r["path"], r["line"]) for r in rows(suppress.secret_lines(spark.createDataFrame(data, "path string, content string")))) == want


def test_suppressed_lines_reach_over_comments(spark):
    content = "import x\n# no-dd-sa: set/a\n# more\n#  still\ncode()\ncode()\nx = 1 # no-dd-sa\nlast"
    d = spark.createDataFrame([("p", content, "PYTHON"), ("q", "nothing", "PYTHON"), ("r", None, "PYTHON")], "path string, content string, language string")
    got = sorted((r["path"], r["line"], r["rule"]) for r in rows(suppress.suppressions(d)))
    assert got == [("p", 3, "set/a"), ("p", 4, "set/a"), ("p", 5, "set/a"), ("p", 8, None)]


def test_findings_with_suppressions(spark):
    f = spark.createDataFrame([("p", "set/a", 3), ("p", "set/b", 3), ("p", "set/b", 8), ("q", "set/a", 1)], "path string, rule_name string, start_line int")
    s = spark.createDataFrame([("p", 3, "set/a"), ("p", 8, None), ("q", 0, "set/a")], "path string, line int, rule string")
    got = {(r["path"], r["rule_name"], r["start_line"]): r["is_suppressed"] for r in rows(suppress.with_suppression(f, s))}
    assert got == {("p", "set/a", 3): True, ("p", "set/b", 3): False, ("p", "set/b", 8): True, ("q", "set/a", 1): True}


def test_rules_meet_artifacts_of_their_language(spark):
    a = spark.createDataFrame([("x.py", "PYTHON"), ("y.go", "GO"), ("z", None)], "path string, language string")
    r = spark.createDataFrame([("s/a", "PYTHON"), ("s/b", "GO"), ("s/c", "GO"), ("s/c", "GO"), ("s/d", None)], "name string, language string")
    assert sorted((x["path"], x["rule_name"]) for x in rows(rules.for_artifacts(a, r))) == [("x.py", "s/a"), ("y.go", "s/b"), ("y.go", "s/c")]


def test_rule_catalogues(spark, tmp_path):
    sets = [{"name": "s", "description": "", "rules": [{"name": "a", "language": "PYTHON", "type": "TREE_SITTER_QUERY", "code": "Y29kZQ==", "tree_sitter_query": "cXVlcnk=", "cwe": "", "severity": "ERROR", "category": "SECURITY"}, {"name": "s/b", "language": "GO", "type": "REGEX", "code": "", "severity": "NOTICE", "category": "CODE_STYLE"}]}]
    (tmp_path / "r.json").write_text(json.dumps(sets))
    r = rules.read_rulesets(spark, str(tmp_path / "r.json"))
    assert sorted(x["name"] for x in rows(r)) == ["s/a", "s/b"] and {x["cwe"] for x in rows(r)} == {None}
    inner = rows(rules.internal(r))
    assert [(x["name"], x["code_text"], x["query_text"]) for x in inner] == [("s/a", "code", "query")]
    assert sorted(x["language"] for x in rows(rules.languages(r))) == ["GO", "PYTHON"] and rules.union_rules(r, r).count() == 4
    rules.export(r, str(tmp_path / "out"))
    back = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert [(b["name"], [x["name"] for x in b["rules"]]) for b in back] == [("s", ["s/a", "s/b"])]


PLACE = {"start_line": 3, "start_col": 4, "end_line": 3, "end_col": 9}


def test_csv_json_and_console(spark, tmp_path):
    kind = "rule_name string, filename string, category string, severity string, message string, start_line long, start_col long, end_line long, end_col long, is_suppressed boolean"
    a = spark.createDataFrame([("s/r", "a b.py", "SECURITY", "ERROR", 'say "x", y', *PLACE.values(), False), ("s/r", "b.py", "SECURITY", "ERROR", "m", *PLACE.values(), True)], kind)
    sinks.write_csv(a, a.limit(0), str(tmp_path / "csv"))
    lines = [x for f in sorted((tmp_path / "csv").glob("*.csv")) for x in f.read_text().splitlines()]
    assert lines[0] == "filename,rule,category,severity,message,start_line,start_col,end_line,end_col" and lines[1].startswith("a b.py,s/r,security,error,") and len(lines) == 2
    assert [(r["location"], r["message"]) for r in rows(sinks.console_rows(a))] == [("3:4-3:9", 'say "x", y')]
    static = spark.createDataFrame([("s/r", "f", [(1, False), (2, True)]), ("s/q", "f", [(3, True)])], "rule_name string, filename string, violations array<struct<n:int,is_suppressed:boolean>>")
    secret = spark.createDataFrame([("t", "g", [(1, None)])], "rule_id string, filename string, matches array<struct<n:int,is_suppressed:boolean>>")
    out = sorted((r["ord"], r["rule"], [v["n"] for v in json.loads(r["json"])["violations" if r["ord"] else "matches"]]) for r in rows(sinks.json_rows(static, secret)))
    assert out == [(0, "t", [1]), (1, "s/q", []), (1, "s/r", [1])]


def test_edits_become_replacements(spark):
    edit = "struct<edit_type:string,content:string,start:struct<line:int,col:int>,end:struct<line:int,col:int>>"
    d = spark.createDataFrame([([("ADD", "x", (1, 2), None), ("REMOVE", None, (1, 2), (1, 5)), ("UPDATE", "y", (2, 1), (2, 3))],)], f"e array<{edit}>")
    got = [((x["deletedRegion"]["startLine"], x["deletedRegion"]["startColumn"], x["deletedRegion"]["endLine"], x["deletedRegion"]["endColumn"]), x["insertedContent"] and x["insertedContent"]["text"]) for x in rows(d.select(sinks.replacements(F.col("e")).alias("r")))[0]["r"]]
    assert got == [((1, 2, 1, 2), "x"), ((1, 2, 1, 5), None), ((2, 1, 2, 3), "y")]


def test_positions_above_zero(spark):
    point = "struct<line:int,col:int>"
    kind = f"v struct<start:{point},end:{point},fixes:array<struct<description:string,edits:array<struct<start:{point},end:{point}>>>>>"
    ok, bad = (1, 1), (0, 1)
    data = [((ok, ok, None),), ((bad, ok, []),), ((ok, ok, [("d", [(ok, ok)])]),), ((ok, ok, [("d", [(ok, bad)])]),)]
    got = [r["x"] for r in rows(spark.createDataFrame(data, kind).select(findings.valid_positions(F.col("v")).alias("x")))]
    assert got == [True, False, True, False]


def test_paths(spark):
    d = spark.createDataFrame([("a\\b/c.PY",), ("x.py",), ("",)], "p string")
    got = [r["l"] for r in rows(d.select(files.language_of(F.col("p")).alias("l")))]
    assert got == ["PYTHON", "PYTHON", None]
    assert rows(d.limit(1).select(paths.any_glob(F.col("p"), ["a*"]).alias("g")))[0]["g"] in (True, False)


def test_config_edits_keep_comments():
    before = "# top\nschema-version: v1.0\nsast:\n  use-rulesets: # names\n    - one\n"
    after = config.add_rulesets(before, ["one", "two"])
    assert config.rulesets_in(after) == ["one", "two"] and "# top" in after and config.schema_version(after) == "v1"
    fresh = config.add_rulesets("", ["a", "a", "b"])
    assert config.rulesets_in(fresh) == ["a", "b"] and config.can_onboard(fresh)
    ignored = config.ignore_rule(fresh, "a/r")
    assert "**" in ignored and config.rulesets_in(ignored) == ["a", "b"]
    with pytest.raises(ValueError):
        config.ignore_rule(fresh, "no-slash")


def test_git_changes_with_odd_names(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "é file.txt").write_text("1\n2\n3\n")
    run("add", "-A")
    run("commit", "-qm", "a")
    (tmp_path / "é file.txt").write_text("1\nx\n3\n4\n")
    (tmp_path / "new.py").write_text("a\n")
    run("add", "-A")
    run("commit", "-qm", "b")
    got = sorted((r["path"], r["line"]) for r in rows(repo.changed_lines(spark, str(tmp_path), "HEAD~1")))
    assert got == [("new.py", 1), ("é file.txt", 2), ("é file.txt", 4)]
    assert repo.default_branch(str(tmp_path)) == "main" and repo.remote_url(str(tmp_path)) is None


def test_stream_scans_each_file_once(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("src", "out", "at"))
    one = lambda df: df.select("path", F.length("content").alias("n"))
    for k in range(2):
        spark.createDataFrame([(f"f{k}", "x" * k)], "path string, content string").coalesce(1).write.mode("append").parquet(src)
        incremental.scan_stream(spark, src, "path string, content string", one, out, at).awaitTermination()
    assert sorted((r["path"], r["n"]) for r in rows(spark.read.parquet(out))) == [("f0", 0), ("f1", 1)]


def test_secret_findings_plan(spark):
    a = spark.createDataFrame([("p", "x\n#no-dd-secrets\nkey abc1\nkey abc2\n")], "path string, content string")
    r = spark.createDataFrame([("k", "a key", "High", False)], "rule_id string, name string, priority string, is_supporting boolean")
    out = sorted((x["start_line"], x["is_suppressed"], x["severity"], x["fingerprint"]) for x in rows(scan.secret_findings(a, r, [{"rule_id": "k", "pattern": "abc[0-9]"}])))
    assert [(n, s, v) for n, s, v, _ in out] == [(3, True, "ERROR"), (4, False, "ERROR")] and out[0][3] != out[1][3]


def test_pairs_within_subtrees_equal_brute_force(spark):
    page = "<div><p>a<b>b</b></p><ul>" + "<li><i>x</i><p>y</p></li>" * 37 + "</ul></div>"
    tree = [r for name in ("f", "g") for r in nodes.html_nodes(name, page + name)]
    t = spark.createDataFrame(tree, nodes.NODES)
    at = {c: i for i, c in enumerate(nodes.COLUMNS)}
    rel = [(x[0], x[1], y[1], x[at["depth"]] - y[at["depth"]]) for x in tree for y in tree if x[0] == y[0] and y[1] <= x[1] <= y[at["last_desc"]]]
    for self_too in (False, True):
        got = nodes.within(t, self_too=self_too).select("file_id", "node_id", "ancestor_id", "distance")
        assert sorted(map(tuple, got.collect())) == sorted(r for r in rel if self_too or r[3])
    some = nodes.within(t, F.col("text") == "p", F.col("text") == "li")
    assert some.count() == 2 * 37
    nearest = {(r["file_id"], r["node_id"]): r["ancestor_id"] for r in nodes.find_ancestor(t, F.col("text") == "i", F.col("cst_type") == "element").collect()}
    assert nearest == {(x[0], x[1]): x[2] for x in tree if x[at["text"]] == "i"}
    first = {r["file_id"]: r["descendant_id"] for r in nodes.find_descendant(t, F.col("text") == "ul", F.col("text") == "i").collect()}
    assert first == {f: min(x[1] for x in tree if x[0] == f and x[at["text"]] == "i") for f in ("f", "g")}
    assert nodes.within(t.where("false")).count() == 0


def test_contents_that_do_not_parse_give_an_error_node(spark):
    a = spark.createDataFrame([("a.py", "x = ("), ("b.py", "x = 1"), ("c.py", None)], "path string, content string")
    got = {r["file_id"]: r for r in nodes.parse(a, "PYTHON").where("parent_id is null").collect()}
    assert {f: r["cst_type"] for f, r in got.items()} == {"a.py": "ERROR", "b.py": "Module", "c.py": "Module"}
    assert got["a.py"]["text"].startswith("SyntaxError")
    j = spark.createDataFrame([("a.json", "{"), ("b.json", "[1]")], "path string, content string")
    assert sorted((r["file_id"], r["cst_type"]) for r in nodes.parse(j, "JSON").where("parent_id is null").collect()) == [("a.json", "ERROR"), ("b.json", "array")]
