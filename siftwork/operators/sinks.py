"""CSV, JSON and SARIF forms of findings, console rows, DOT graphs.

static: rule_name, filename, category, severity, message, start_line, start_col, end_line, end_col, is_suppressed and, for
SARIF, fixes, flow and fingerprint if there; secrets: the same with validation_status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import percent_encode, sarif_level, status_tag
from siftwork.operators.findings import valid_edits

CSV = ["filename", "rule", "category", "severity", "message", "start_line", "start_col", "end_line", "end_col"]


def csv_rows(static: DataFrame, secrets: DataFrame) -> DataFrame:
    """Unsuppressed rows in CSV columns, static ones (ord 0) before secrets (ord 1), which are all security errors."""
    place = ["start_line", "start_col", "end_line", "end_col"]
    a = static.where(~F.col("is_suppressed")).select(F.lit(0).alias("ord"), "filename", F.col("rule_name").alias("rule"), F.lower("category").alias("category"), F.lower("severity").alias("severity"), "message", *place)
    b = secrets.where(~F.col("is_suppressed")).select(F.lit(1).alias("ord"), "filename", F.col("rule_name").alias("rule"), F.lit("security").alias("category"), F.lit("error").alias("severity"), "message", *place)
    return a.unionByName(b)


def write_csv(static: DataFrame, secrets: DataFrame, path: str) -> None:
    csv_rows(static, secrets).orderBy("ord", "filename", "start_line", "start_col", "rule").select(*CSV).write.option("header", True).csv(path)


def json_rows(static_results: DataFrame, secret_results: DataFrame) -> DataFrame:
    """One JSON document for each result, secrets (ord 0) before static (ord 1); suppressed violations are left out, a
    result that has no others stays."""
    clean = lambda d, c: d.withColumn(c, F.filter(c, lambda v: ~F.coalesce(v["is_suppressed"], F.lit(False))))
    s = clean(secret_results, "matches")
    a = clean(static_results, "violations")
    return s.select(F.lit(0).alias("ord"), "filename", F.col("rule_id").alias("rule"), F.to_json(F.struct(*s.columns)).alias("json")).unionByName(a.select(F.lit(1).alias("ord"), "filename", F.col("rule_name").alias("rule"), F.to_json(F.struct(*a.columns)).alias("json")))


def console_rows(findings: DataFrame) -> DataFrame:
    at = F.format_string("%d:%d-%d:%d", "start_line", "start_col", "end_line", "end_col")
    return findings.where(~F.col("is_suppressed")).select("rule_name", "filename", at.alias("location"), "category", "severity", "message")


def replacements(edits: Column) -> Column:
    """ADD inserts at its start, REMOVE deletes its region, UPDATE does both."""
    here = lambda e: F.struct(e["start"]["line"].alias("startLine"), e["start"]["col"].alias("startColumn"), F.when(e["edit_type"] == "ADD", e["start"]["line"]).otherwise(e["end"]["line"]).alias("endLine"), F.when(e["edit_type"] == "ADD", e["start"]["col"]).otherwise(e["end"]["col"]).alias("endColumn"))
    return F.transform(edits, lambda e: F.struct(here(e).alias("deletedRegion"), F.when(e["edit_type"] != "REMOVE", F.struct(F.coalesce(e["content"], F.lit("")).alias("text"))).alias("insertedContent")))


def rule_index(rules: DataFrame) -> DataFrame:
    """(rule_name, rule_index, level, rule_category, cwe, is_testing): the first rule of each name, by its position `ord`; cwe and
    is_testing are null where the catalogue has no such columns."""
    more = [F.col("cwe") if "cwe" in rules.columns else F.lit(None).cast("string").alias("cwe"), F.col("is_testing") if "is_testing" in rules.columns else F.lit(None).cast("boolean").alias("is_testing")]
    first = rules.groupBy("rule_name").agg(F.min_by(F.struct("ord", "severity", "category", *more), "ord").alias("r"))
    return first.select("rule_name", F.col("r.ord").alias("rule_index"), sarif_level(F.col("r.severity")).alias("level"), F.col("r.category").alias("rule_category"), F.col("r.cwe").alias("cwe"), F.col("r.is_testing").alias("is_testing"))


def sarif_results(findings: DataFrame, rules: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row for each result: level, category, CWE and testing tags are the rule's (not an override's), the path is encoded,
    suppressed results stay and say so; results whose positions, or those of their fixes' edits, are not all above 0 go, as do those
    of unknown artifacts. The findings' columns fixes (FIX array), taint_flow (REGION array), fingerprint and sha and the
    artifacts' is_test_file are kept where they are there."""
    ok = (F.col("start_line") > 0) & (F.col("start_col") > 0) & (F.col("end_line") > 0) & (F.col("end_col") > 0)
    if "fixes" in findings.columns:
        ok = ok & valid_edits(F.col("fixes"))
    known = artifacts.select("filename", "artifact_index", *[c for c in ("is_test_file",) if c in artifacts.columns])
    out = findings.where(ok).join(rule_index(rules), "rule_name", "left").join(known, "filename")
    none = F.lit(None).cast("string")
    tags = [F.concat(F.lit("CATEGORY:"), F.upper("rule_category")), F.concat(F.lit("CWE:"), "cwe"), F.when(F.col("is_testing"), F.lit("IS_TESTING")), status_tag(F.col("validation_status")) if "validation_status" in findings.columns else none]
    kinds = F.when(F.col("is_suppressed"), F.array(F.lit("inSource"))).otherwise(F.array().cast("array<string>"))
    kept = [c for c in ("fixes", "taint_flow", "fingerprint", "sha", "is_test_file") if c in out.columns]
    return out.select(F.col("rule_name").alias("rule_id"), "rule_index", F.coalesce("level", F.lit("none")).alias("level"), "message", percent_encode(F.col("filename")).alias("uri"), "artifact_index", "start_line", "start_col", "end_line", "end_col", F.filter(F.array(*tags), lambda t: t.isNotNull()).alias("tags"), kinds.alias("suppressions"), *kept)


def flow_locations(regions: Column) -> Column:
    """(importance, region) of a data flow: its ends are essential, what lies between is important; null below two."""
    n = F.size(regions)
    return F.when(n >= 2, F.transform(regions, lambda r, i: F.struct(F.when((i == 0) | (i == n - 1), F.lit("essential")).otherwise(F.lit("important")).alias("importance"), r.alias("region"))))


def sarif_artifacts(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """Distinct files in the order of their first result, with their roles; metadata: filename, is_test_file."""
    first = results.groupBy("filename").agg(F.min("ord").alias("ord"))
    return first.join(metadata, "filename", "left").select("filename", "ord", percent_encode(F.col("filename")).alias("uri"), F.coalesce("is_test_file", F.lit(False)).alias("is_test_file"))


def tool_tags(config_digest: str, seconds: int, base_sha: str | None = None, changed: list[str] | None = None) -> list[str]:
    """Tags of the tool: digest of the configuration, time taken and, for a run over a difference, its base and files."""
    tags = [f"DIFF_AWARE_CONFIG_DIGEST:{config_digest}", f"EXECUTION_TIME_SECS:{seconds}"]
    if base_sha is None:
        return [*tags, "DIFF_AWARE_ENABLED:false"]
    return [*tags, "DIFF_AWARE_ENABLED:true", f"DIFF_AWARE_BASE_SHA:{base_sha}", *(f"DIFF_AWARE_FILE:{f}" for f in changed or [])]


def _point_region(start: Column, end: Column) -> Column:
    return F.struct(start["line"].alias("startLine"), start["col"].alias("startColumn"), end["line"].alias("endLine"), end["col"].alias("endColumn"))


def _located(region: Column) -> Column:
    return F.struct(F.struct(F.struct("uri").alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))


def _fixes() -> Column:
    """SARIF fixes of a result, all their replacements in the result's own file."""
    change = lambda f: F.struct(F.struct("uri").alias("artifactLocation"), replacements(f["edits"]).alias("replacements"))
    return F.transform(F.coalesce("fixes", F.array()), lambda f: F.struct(F.struct(f["description"].alias("text")).alias("description"), F.array(change(f)).alias("artifactChanges")))


def _code_flows() -> Column:
    """One thread flow of the result's regions; null below two regions."""
    step = lambda x: F.struct(_located(_point_region(x["region"]["start"], x["region"]["end"])).alias("location"), x["importance"].alias("importance"))
    steps = F.transform(flow_locations(F.col("taint_flow")), step)
    return F.when(steps.isNotNull(), F.array(F.struct(F.array(F.struct(steps.alias("locations"))).alias("threadFlows"))))


def _descriptor(rules: DataFrame) -> Column:
    """A rule's entry in the tool: its level and, where the catalogue holds them (as `rules.descriptors` gives them), texts, link
    and tags."""
    text = {"short_description": "shortDescription", "full_description": "fullDescription"}
    parts = [F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("text"))).alias(to) for c, to in text.items() if c in rules.columns]
    parts += [F.col("documentation_url").alias("helpUri")] if "documentation_url" in rules.columns else []
    parts += [F.struct(F.col("tags").alias("tags")).alias("properties")] if "tags" in rules.columns else []
    return F.struct(F.col("rule_name").alias("id"), F.struct(sarif_level(F.col("severity")).alias("level")).alias("defaultConfiguration"), *parts)


def sarif_runs(results: DataFrame, rules: DataFrame, tool: str, tags: list[str], per_run: int = 25000) -> DataFrame:
    """SARIF 2.1.0 documents (shard, json), each with at most about per_run results: one log of all findings of a
    large corpus would be one row of unbounded size, so it is cut by a hash of path and line.

    A document holds the rules in the order of their position `ord` (a result's ruleIndex counts in it), the artifacts of its own
    results by path, and with each result its fixes, code flow and partial fingerprints where `results` has these columns."""
    region = F.struct(F.col("start_line").alias("startLine"), F.col("start_col").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_col").alias("endColumn"))
    parts = [F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), F.col("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(_located(region)).alias("locations"), F.struct("tags").alias("properties"), F.transform("suppressions", lambda k: F.struct(k.alias("kind"))).alias("suppressions")]
    parts += [_fixes().alias("fixes")] if "fixes" in results.columns else []
    parts += [_code_flows().alias("codeFlows")] if "taint_flow" in results.columns else []
    prints = [F.col(c).alias(to) for c, to in (("sha", "SHA"), ("fingerprint", "FINGERPRINT")) if c in results.columns]
    parts += [F.struct(*prints).alias("partialFingerprints")] if prints else []
    total = results.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / per_run)).cast("int").alias("shards"))
    shard = results.crossJoin(F.broadcast(total)).withColumn("shard", F.pmod(F.xxhash64("uri", "start_line", "rule_id"), F.col("shards")))  # one row beside each
    test = F.coalesce("is_test_file", F.lit(False)) if "is_test_file" in results.columns else F.lit(False)
    artifact = F.struct(F.struct("uri").alias("location"), F.when(test, F.struct(F.array(F.lit("CLASSIFICATION:TEST_FILE")).alias("tags"))).alias("properties"))
    # the document is the last key: to_json of it breaks ties of place and rule, and no map has to be ordered
    row = F.struct("uri", "start_line", "start_col", "rule_id", F.to_json(F.struct(*parts)).alias("text"), F.struct(*parts).alias("r"))
    rows = shard.groupBy("shard").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.array_sort(F.collect_set(artifact)).alias("artifacts"))
    ordered = rules.groupBy().agg(F.array_sort(F.collect_list(F.struct(*[c for c in ("ord",) if c in rules.columns], F.col("rule_name").alias("key"), _descriptor(rules).alias("d")))).alias("rules"))
    names = ordered.select(F.transform("rules", lambda x: x["d"]).alias("rules"))
    driver = F.struct(F.lit(tool).alias("name"), F.col("rules"), F.struct(F.array(*map(F.lit, tags)).cast("array<string>").alias("tags")).alias("properties"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("artifacts"), F.transform("rows", lambda x: x["r"]).alias("results"))
    log = F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return rows.crossJoin(F.broadcast(names)).select("shard", F.to_json(log).alias("json"))


def dot_graphs(edges: DataFrame) -> DataFrame:
    """(graph_id, dot) for edges (graph_id, src, dst, kind): statements in sorted order."""
    style = F.when(F.col("kind") == "dependence", " [style=dotted]").otherwise("")
    line = F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('"'), style, F.lit(";"))
    return edges.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("body")).select("graph_id", F.concat(F.lit("digraph {\n"), "body", F.lit("\n}")).alias("dot"))
