"""Findings: statistics, counts, gates, differences, digests; results as in RESULTS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import fingerprint, line_fingerprint


def exploded(results: DataFrame) -> DataFrame:
    """One row for each violation."""
    return results.select("rule_name", "filename", F.explode("violations").alias("v")).select("rule_name", "filename", "v.*")


def non_empty(results: DataFrame) -> DataFrame:
    return results.where(F.size("violations") > 0)


def valid_edits(fixes: Column) -> Column:
    """All edits of the fixes start, and end if they have an end, above 0."""
    ok = lambda p: (p["line"] > 0) & (p["col"] > 0)
    edits = F.flatten(F.transform(F.coalesce(fixes, F.array()), lambda f: f["edits"]))
    return F.forall(edits, lambda e: ok(e["start"]) & F.coalesce(ok(e["end"]), F.lit(True)))


def valid_positions(violation: Column) -> Column:
    """Lines and columns of the violation and of all its edits are above 0."""
    ok = lambda p: (p["line"] > 0) & (p["col"] > 0)
    return ok(violation["start"]) & ok(violation["end"]) & valid_edits(violation["fixes"])


def rule_times(stats: DataFrame) -> DataFrame:
    """Sums and counts of execution and query times by rule."""
    return stats.groupBy("rule_name").agg(F.sum("execution_ms").alias("execution_ms"), F.sum("query_ms").alias("query_ms"), F.count("*").alias("files"))


def failed_files(stats: DataFrame) -> DataFrame:
    """(rule_name, error, files): sorted files with each error."""
    return stats.where("error is not null").groupBy("rule_name", "error").agg(F.sort_array(F.collect_list("filename")).alias("files"))


def slowest_rules(stats: DataFrame, n: int | None = None) -> DataFrame:
    """Rules by total time, the slowest first; n limits the report."""
    out = rule_times(stats).orderBy(F.desc("execution_ms"), "rule_name")
    return out if n is None else out.limit(n)


def slowest_parses(stats: DataFrame, n: int = 100) -> DataFrame:
    """The n slowest (parse_ms, filename) pairs; equal pairs count once, ties go to the greater name."""
    return stats.select("parse_ms", "filename").dropDuplicates().orderBy(F.desc("parse_ms"), F.desc("filename")).limit(n)


def summary(findings: DataFrame) -> DataFrame:
    """One row: unsuppressed total, all, distinct files and rules (suppressed ones count there)."""
    return findings.agg(F.count_if(~F.col("is_suppressed")).alias("violations"), F.count("*").alias("all_violations"), F.countDistinct("filename").alias("files"), F.countDistinct("rule_name").alias("rules"))


def counts_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_name").agg(F.count("*").alias("total"), F.count_if("is_suppressed").alias("suppressed"), F.countDistinct("filename").alias("files"))


def count_severities(findings: DataFrame, severities: list[str], skip_suppressed: bool = True) -> DataFrame:
    """One row: findings of these severities; a gate fails where it is above 0."""
    f = findings.where(F.col("severity").isin(severities))
    f = f.where(~F.col("is_suppressed")) if skip_suppressed else f
    return f.agg(F.count("*").alias("n")).withColumn("failed", F.col("n") > 0)


def secret_totals(matches: DataFrame) -> DataFrame:
    """One row: all secret matches and the validated ones; suppressed ones count."""
    return matches.agg(F.count("*").alias("secrets"), F.count_if(F.col("validation_status") == "VALID").alias("validated"))


def in_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose path is in a diff-aware list."""
    return rows.join(files.select("path").distinct(), "path", "left_semi")


def on_changed_lines(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings that start on an added or updated line."""
    on = [findings["path"] == changed["path"], findings["start_line"] == changed["line"]]
    return findings.join(changed, on, "left_semi")


def fingerprinted(findings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """findings (rule_name, path, start_line, flow_lines or none) with fingerprint; content is joined once for each path.

    Findings that bring their line (column line_text, null where it does not exist) need no content, unless flows name other lines.
    """
    if "line_text" in findings.columns and "flow_lines" not in findings.columns:
        return findings.withColumn("fingerprint", line_fingerprint(F.col("rule_name"), F.col("path"), F.col("line_text")))
    lines = F.when(F.size(F.coalesce("flow_lines", F.array().cast("array<int>"))) > 0, F.col("flow_lines")).otherwise(F.array("start_line")) if "flow_lines" in findings.columns else F.array("start_line")
    out = findings.join(artifacts.select(F.col("path").alias("a_path"), F.col("content").alias("a_content")), F.col("path") == F.col("a_path"), "left")
    return out.withColumn("fingerprint", fingerprint(F.col("rule_name"), F.col("path"), F.col("a_content"), lines)).drop("a_path", "a_content")


def first_writer(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Union of two metadata tables by key; where both have a key, the first one's value stays."""
    a, b = first.select(key, F.col(value).alias("v1"), F.lit(True).alias("has")), second.select(key, F.col(value).alias("v2"))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("has"), F.col("v1")).otherwise(F.col("v2")).alias(value))


def artifacts_of(results: DataFrame) -> DataFrame:
    """(filename, first): distinct files with the position of their first result (column ord)."""
    return results.groupBy("filename").agg(F.min("ord").alias("first"))
