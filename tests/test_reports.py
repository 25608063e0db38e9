"""Builders and hooks of rule bodies, SARIF documents, configuration files on disk, long flows."""

import json

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from siftwork.operators import config, findings, flow, sinks
from siftwork.plans import scan
from siftwork.schemas import FIX, REGION

LEGACY = "rulesets:\n  - a\n  - b:\n    ignore-paths:\n      - x/**\n"
UNIFIED = "schema-version: v1.0\nsast:\n  use-default-rulesets: false\n  use-rulesets:\n    - c\n"


def test_builders_and_hooks(spark):
    matches = spark.createDataFrame([("f", "ok", 1, "ab"), ("f", "ok", 2, "cd"), ("g", "ok", 1, "e"), ("f", "late", 1, "x"), ("f", "bad", 1, "x"), ("f", "unknown", 1, "x")], "path string, rule_name string, start_line int, match string")

    def body(m, report):
        line = m["start_line"]
        report.violation(line, 1, line, 3, "numbers", fixes=[scan.fix("mend", scan.edit_add(line, 1, "#"), scan.edit_remove(line, 1, line, 2), scan.edit_update(line, 2, line, 3, "z"))])
        report.violation((line, 1), (line, 2), "positions")
        report.violation({"start_line": line, "start_col": 4, "end_line": line, "end_col": 5}, "node")
        report.violation("flow", flow=[(line, 7, line, 8), {"start": {"line": 9, "col": 1}, "end": {"line": 9, "col": 2}}])

    def late(m, report):
        report.violation(1, 1, 1, 2, "lost")

    def bad(m, report):
        report.violation(2, 1, 1, 1, "backwards")

    def fails(report):
        raise KeyError("hook")

    got = scan.run_bodies(matches, {"ok": body, "late": late, "bad": bad}, before_all={"ok": lambda ms, r: r.log("n", len(ms))}, after_all={"ok": lambda r: r.log("end"), "late": fails}).collect()
    ok = sorted((r["path"], r["start_line"], r["start_col"], r["end_col"], r["message"], r["output"]) for r in got if r["rule_name"] == "ok")
    want = [(p, line, a, b, what, f"n {n}\nend") for p, line, n in (("f", 1, 2), ("f", 2, 2), ("g", 1, 1)) for a, b, what in ((1, 2, "positions"), (1, 3, "numbers"), (4, 5, "node"), (7, 8, "flow"))]
    assert ok == sorted(want)
    edits = next(r["fixes"][0]["edits"] for r in got if r["message"] == "numbers" and r["path"] == "g")
    assert [(e["edit_type"], e["end"] and tuple(e["end"]), e["content"]) for e in edits] == [("ADD", None, "#"), ("REMOVE", (1, 2), None), ("UPDATE", (1, 3), "z")]
    assert [[tuple(x["start"]) for x in r["taint_flow"]] for r in got if r["message"] == "flow" and r["path"] == "g"] == [[(1, 7), (9, 1)]]
    wrong = {r["rule_name"]: (r["message"], r["error"]) for r in got if r["error"]}
    assert wrong == {"late": (None, "error-execution: KeyError: 'hook'"), "bad": (None, "error-execution: ValueError: start follows end")}


def test_bodies_run_in_several_tasks_whatever_the_size(spark):
    files = spark.range(3000).select(F.format_string("f%d", "id").alias("path"), F.lit("r").alias("rule_name"), F.explode(F.array(F.lit(7), F.lit(None).cast("int"))).alias("start_line"), F.create_map(F.lit("a"), F.col("id").cast("string")).alias("captures"))

    def body(m, report):
        if m["start_line"] is not None:
            report.violation(m["start_line"], 1, m["start_line"], 2, m["captures"]["a"])
        report.log(TaskContext.get().partitionId())

    got = scan.run_bodies(files, {"r": body}).collect()
    assert sorted((r["path"], r["start_line"], r["message"], r["error"]) for r in got) == sorted((f"f{i}", 7, str(i), None) for i in range(3000))
    tasks = {r["path"]: set(r["output"].split("\n")) for r in got}
    assert {len(x) for x in tasks.values()} == {1} and len(set.union(*tasks.values())) == 4


@pytest.mark.parametrize("where", [(1, 1, 1), ((1, 1),), (1, "a", 1, 1), ([1, 2, 3], [1, 2])])
def test_places_that_are_none(where):
    with pytest.raises(ValueError):
        scan.Report().violation(*where, "message")


def sarif(spark, rows, **kw):
    schema = f"rule_name string, filename string, message string, start_line int, start_col int, end_line int, end_col int, is_suppressed boolean, fixes array<{FIX}>, taint_flow array<{REGION}>, fingerprint string"
    found = spark.createDataFrame(rows, schema)
    rules = spark.createDataFrame([("b", 1, "NOTICE", "SECURITY", "89", False, "long", None, ["t"]), ("c", 0, "ERROR", "CODE_STYLE", None, True, None, "short", [])], "rule_name string, ord int, severity string, category string, cwe string, is_testing boolean, full_description string, short_description string, tags array<string>")
    files = spark.createDataFrame([("x y.py", 0, True), ("z.py", 1, None)], "filename string, artifact_index int, is_test_file boolean")
    return [json.loads(r["json"]) for r in sinks.sarif_runs(sinks.sarif_results(found, rules, files), rules, "tool", sinks.tool_tags("d", 3), **kw).collect()]


def test_sarif_documents_hold_all_parts(spark):
    at = lambda a, b, c, d: ((a, b), (c, d))
    mend = [("mend", [((1, 2), None, "ADD", "#"), ((1, 2), (1, 3), "REMOVE", None)])]
    rows = [("b", "x y.py", "m", 1, 2, 3, 4, False, mend, [at(1, 2, 3, 4), at(5, 1, 5, 2), at(6, 1, 6, 2)], "fp"), ("c", "z.py", "n", 1, 1, 1, 2, True, None, [at(1, 1, 1, 2)], None), ("b", "z.py", "bad edit", 1, 1, 1, 2, False, [("f", [((0, 1), None, "ADD", "x")])], None, None), ("b", "z.py", "bad", 0, 1, 1, 2, False, None, None, None)]
    (doc,) = sarif(spark, rows)
    run = doc["runs"][0]
    region = lambda a, b, c, d: {"startLine": a, "startColumn": b, "endLine": c, "endColumn": d}
    place = lambda uri, *r: {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": region(*r)}}
    step = lambda how, *r: {"location": place("x%20y.py", *r), "importance": how}
    assert run["tool"]["driver"]["rules"] == [
        {"id": "c", "defaultConfiguration": {"level": "error"}, "shortDescription": {"text": "short"}, "properties": {"tags": []}},
        {"id": "b", "defaultConfiguration": {"level": "note"}, "fullDescription": {"text": "long"}, "properties": {"tags": ["t"]}},
    ]
    assert run["tool"]["driver"]["properties"]["tags"] == ["DIFF_AWARE_CONFIG_DIGEST:d", "EXECUTION_TIME_SECS:3", "DIFF_AWARE_ENABLED:false"]
    assert run["artifacts"] == [{"location": {"uri": "x%20y.py"}, "properties": {"tags": ["CLASSIFICATION:TEST_FILE"]}}, {"location": {"uri": "z.py"}}]
    assert run["results"] == [
        {
            "ruleId": "b", "ruleIndex": 1, "level": "note", "message": {"text": "m"}, "locations": [place("x%20y.py", 1, 2, 3, 4)], "properties": {"tags": ["CATEGORY:SECURITY", "CWE:89"]}, "suppressions": [],
            "fixes": [{"description": {"text": "mend"}, "artifactChanges": [{"artifactLocation": {"uri": "x%20y.py"}, "replacements": [{"deletedRegion": region(1, 2, 1, 2), "insertedContent": {"text": "#"}}, {"deletedRegion": region(1, 2, 1, 3)}]}]}],
            "codeFlows": [{"threadFlows": [{"locations": [step("essential", 1, 2, 3, 4), step("important", 5, 1, 5, 2), step("essential", 6, 1, 6, 2)]}]}], "partialFingerprints": {"FINGERPRINT": "fp"},
        },
        {"ruleId": "c", "ruleIndex": 0, "level": "error", "message": {"text": "n"}, "locations": [place("z.py", 1, 1, 1, 2)], "properties": {"tags": ["CATEGORY:CODE_STYLE", "IS_TESTING"]}, "suppressions": [{"kind": "inSource"}], "fixes": [], "partialFingerprints": {}},
    ]


def test_sarif_documents_are_cut_and_keep_all(spark):
    rows = [("b", "z.py", str(i), i + 1, 1, i + 1, 2, False, None, None, None) for i in range(40)]
    docs = sarif(spark, rows, per_run=10)
    assert len(docs) > 1 and sorted(int(x["message"]["text"]) for d in docs for x in d["runs"][0]["results"]) == list(range(40))
    assert all(d["runs"][0]["artifacts"] == [{"location": {"uri": "z.py"}}] for d in docs)


def test_tool_tags_of_a_difference():
    assert sinks.tool_tags("d", 1, "abc", ["f", "g"]) == ["DIFF_AWARE_CONFIG_DIGEST:d", "EXECUTION_TIME_SECS:1", "DIFF_AWARE_ENABLED:true", "DIFF_AWARE_BASE_SHA:abc", "DIFF_AWARE_FILE:f", "DIFF_AWARE_FILE:g"]


def test_insertions_without_end_are_valid(spark):
    d = spark.createDataFrame([([("f", [((1, 1), None, "ADD", "x")])],), ([("f", [((1, 1), (1, 0), "UPDATE", "x")])],), (None,), ([],)], f"fixes array<{FIX}>")
    assert [r["ok"] for r in d.select(findings.valid_edits(F.col("fixes")).alias("ok")).collect()] == [True, False, True, True]


def test_config_files_are_looked_up(tmp_path):
    assert config.local_config(str(tmp_path)) is None and config.chosen_config(str(tmp_path)) is None
    (tmp_path / "static-analysis.yml").write_text(LEGACY)
    old = config.local_config(str(tmp_path))
    assert old["version"] == "v1" and old["use"] == ["a", "b"] and old["rulesets"]["b"]["ignore"] == ["x/**"]
    (tmp_path / "code-security.yml").write_text(" \n\t\n")
    assert config.local_config(str(tmp_path)) == old
    (tmp_path / "code-security.yaml").write_text(UNIFIED)
    assert config.local_config(str(tmp_path))["use"] == ["c"]
    remote = UNIFIED.replace("- c", "- r")
    chosen, how = config.chosen_config(str(tmp_path), remote)
    assert chosen["use"] == ["r"] and how == "remote with file"
    for broken in ("schema-version: v1.0\nsast: [", LEGACY, "", "schema-version: v9\n"):
        chosen, how = config.chosen_config(str(tmp_path), broken)
        assert chosen["use"] == ["c"] and how == "file"


def test_config_format_is_checked(tmp_path):
    config.check_format(LEGACY, "legacy")
    config.check_format(UNIFIED, "v1")
    for text, declared in ((LEGACY, "v1"), (UNIFIED, "legacy")):
        with pytest.raises(ValueError, match="mismatch"):
            config.check_format(text, declared)


def test_paths_of_any_length(spark):
    n = 130
    edges = spark.range(n).select(F.lit("g").alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    (row,) = flow.simple_paths(edges, spark.createDataFrame([("g", 0)], "graph_id string, vertex long")).collect()
    assert row["path"] == list(range(n + 1))
