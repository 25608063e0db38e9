"""Rule catalogues: reading, naming, decoding, combining, testing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.text import decoded, rule_checksum, rule_digest
from siftwork.schemas import RULES

RULESET_FILE = "name string, description string, rules array<struct<name:string,short_description:string,description:string,category:string,severity:string,language:string,type:string,code:string,cwe:string,checksum:string,pattern:string,tree_sitter_query:string,arguments:array<struct<name:string,description:string>>,tests:array<struct<annotation_count:int,filename:string,code:string>>,is_testing:boolean,documentation_url:string>>"


def read_rulesets(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON file that holds an array of rulesets, in RULES."""
    sets = spark.read.schema(RULESET_FILE).option("multiLine", True).json(path)
    r = sets.select(F.col("name").alias("ruleset"), F.explode("rules").alias("r")).select("ruleset", "r.*").withColumnRenamed("type", "rule_type")
    return named(r.select(*[c.split()[0] for c in _columns()]))


def _columns() -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(RULES + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(RULES[start:i].strip())
            start = i + 1
    return out


def named(rules: DataFrame) -> DataFrame:
    """Rule names with their ruleset in front, once; a blank ruleset adds nothing. An empty CWE becomes null."""
    blank = F.coalesce(F.trim("ruleset"), F.lit("")) == ""
    full = F.when(blank | F.col("name").startswith(F.concat("ruleset", F.lit("/"))), F.col("name")).otherwise(F.concat_ws("/", "ruleset", "name"))
    out = rules.withColumn("name", full)
    return out.withColumn("cwe", F.nullif(F.trim("cwe"), F.lit(""))) if "cwe" in rules.columns else out


def internal(rules: DataFrame) -> DataFrame:
    """Rules that can run: of type TREE_SITTER_QUERY with a query; code and query decoded."""
    ok = rules.where("rule_type = 'TREE_SITTER_QUERY' and tree_sitter_query is not null")
    return ok.withColumns({"code_text": decoded(F.col("code")), "query_text": decoded(F.col("tree_sitter_query"))})


def with_digests(rules: DataFrame) -> DataFrame:
    return rules.withColumns({"expected_checksum": rule_checksum(F.col("code")), "digest": rule_digest(F.col("name"), F.col("pattern"), F.col("code"))})


def checksum_failures(rules: DataFrame) -> DataFrame:
    return with_digests(rules).where("checksum <> expected_checksum").select("name", "checksum", "expected_checksum")


def languages(rules: DataFrame) -> DataFrame:
    return rules.select("language").distinct()


def for_artifacts(artifacts: DataFrame, rules: DataFrame) -> DataFrame:
    """artifacts (with language) x the names of the rules that run on their language; a rule of many thousands of artifacts is an
    equi-join's key like any other, and Spark sends the catalogue to all tasks where it finds it small."""
    wanted = rules.where("language is not null").select(F.col("name").alias("rule_name"), "language").distinct()
    return artifacts.join(wanted, "language")


def union_rules(*catalogues: DataFrame) -> DataFrame:
    """All rules of several catalogues; the same rule may come twice."""
    out = catalogues[0]
    for c in catalogues[1:]:
        out = out.unionByName(c)
    return out


def without(rulesets: DataFrame, excluded: DataFrame) -> DataFrame:
    return rulesets.join(excluded.select("ruleset"), "ruleset", "left_anti")


def descriptors(rules: DataFrame) -> DataFrame:
    """SARIF rule descriptors: decoded texts, tags for type, CWE and testing."""
    tags = F.filter(F.array(F.lit("RULE_TYPE:STATIC_ANALYSIS"), F.when(F.col("cwe").isNotNull(), F.concat(F.lit("CWE:"), "cwe")), F.when(F.col("is_testing"), F.lit("IS_TESTING"))), lambda t: t.isNotNull())
    return rules.select(F.col("name").alias("id"), decoded(F.col("description")).alias("full_description"), decoded(F.col("short_description")).alias("short_description"), "documentation_url", tags.alias("tags"))


def export(rules: DataFrame, path: str) -> None:
    """One JSON object for each ruleset, rules inside."""
    body = [c for c in rules.columns if c != "ruleset"]
    rules.groupBy(F.col("ruleset").alias("name")).agg(F.array_sort(F.collect_list(F.struct("name", *[c for c in body if c != "name"]))).alias("rules")).write.mode("errorifexists").json(path)


def self_test(rules: DataFrame, violations: DataFrame) -> DataFrame:
    """(name, filename, expected, found, passed) for each test of each rule; violations: rule_name, filename."""
    tests = rules.select("name", F.explode("tests").alias("t")).select("name", F.col("t.filename").alias("filename"), F.col("t.annotation_count").alias("expected"))
    found = violations.groupBy(F.col("rule_name").alias("name"), "filename").agg(F.count("*").cast("int").alias("found"))
    out = tests.join(found, ["name", "filename"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.withColumn("passed", F.col("found") == F.col("expected"))
