"""The queries over the fixed tables, and their SQL twins.

Artifacts come from documents: path is source/doc_id.extension with the extension dealt by doc_id, content is the text
behind a first line that the same number deals (a directive, a generated header, an import or nothing).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import paths, text
from siftwork.operators import config as cfg
from siftwork.operators import files, findings, flow, imports, nodes, rules, secrets, sinks, suppress
from siftwork.plans import scan
from siftwork.sources import repo

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EXTENSIONS = ["py", "JS", "go", "java", "rb", "ts", "tf", "sql", "md", "json", "docker", "txt"]
#: First lines by doc_id mod 8.
HEADS = ["# no-dd-sa", "// no-dd-sa: set/token, other", "Code generated by a tool", "#no-dd-secrets", "import unittest", "", "x = 1 # no-dd-sa set/email\n# more\n//  more", "\n# no-dd-sa:set/email\n# a\n\tb\nlast"]
DIRS = ["src", "src/test", "lib/node_modules/a", "Vendor", "spec/x y", "a/b/c"]
SECRET_RULES = [
    {"rule_id": "set/token", "pattern": 'token = "[0-9a-f]{40}"', "name": "hex token", "priority": "High", "is_supporting": False, "literals": ['token = "']},
    {"rule_id": "set/email", "pattern": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]+", "name": "address", "priority": "Medium", "is_supporting": False, "literals": ["@"]},
    {"rule_id": "set/license", "pattern": "(?:Licen[sc]ed|Copyright)", "name": "licence", "priority": "Info", "is_supporting": False, "literals": ["Licen", "Copyright"]},
    {"rule_id": "set/number", "pattern": "[0-9]{13,16}", "name": "digits", "priority": "Low", "is_supporting": True},
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(values: list[str], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    path = F.concat_ws("", dealt(DIRS, "doc_id"), F.lit("/"), F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), dealt(EXTENSIONS, "doc_id"))
    content = F.concat(dealt(HEADS, "doc_id"), F.lit("\n"), F.coalesce("text", F.lit("")))
    return d.select("doc_id", path.alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("size_bytes"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join("replace(" + _q(v.replace("\n", "~")) + ", '~', chr(10))" if "\n" in v else _q(v) for v in values) + "]"


ART = f"""
art AS (SELECT doc_id, ({_list(DIRS)})[(doc_id % {len(DIRS)} + 1)::INT] || '/' || source || '/f' || doc_id || '.' || ({_list(EXTENSIONS)})[(doc_id % {len(EXTENSIONS)} + 1)::INT] AS path,
       ({_list(HEADS)})[(doc_id % {len(HEADS)} + 1)::INT] || chr(10) || coalesce(text, '') AS content FROM documents)"""
_LANGS = "CASE lower(regexp_extract(path, '[.]([^.]*)$', 1)) " + " ".join(f"WHEN {_q(e)} THEN {_q(lang)}" for lang, exts in files.EXTENSIONS.items() for e in exts) + " END"
LANG = f"lang AS (SELECT *, {_LANGS} AS language FROM art)"
LINES = """
parts AS (SELECT path, string_split(content, chr(10)) AS p FROM art),
cut AS (SELECT path, CASE WHEN p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS p FROM parts),
raw AS (SELECT path, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS t FROM cut),
lines AS (SELECT path, line, regexp_replace(t, '\\r$', '') AS text FROM raw)"""
WS = "[\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
BARE = f"regexp_replace(text, '{WS}', '', 'g')"
HITS = "hits AS (" + " UNION ALL ".join(f"SELECT path, line, {i} AS ord, {_q(r['rule_id'])} AS rule_id, unnest(regexp_extract_all(text, {_q(r['pattern'])})) AS match, text FROM lines" for i, r in enumerate(SECRET_RULES)) + ")"
SUPP = f"supp AS (SELECT DISTINCT path, line + 1 AS line FROM lines WHERE starts_with({BARE}, '#no-dd-secrets') OR starts_with({BARE}, '//no-dd-secrets'))"
META = "meta AS (SELECT * FROM (VALUES " + ", ".join(f"({_q(r['rule_id'])}, {_q(r['name'])}, {_q(r['priority'])}, {str(r['is_supporting']).lower()})" for r in SECRET_RULES) + ") AS v(rule_id, rule_name, priority, is_supporting))"
SEVERITY = "CASE WHEN lower(priority) IN ('critical', 'high') THEN 'ERROR' WHEN lower(priority) = 'medium' THEN 'WARNING' ELSE 'NOTICE' END"
FOUND = f"""WITH {ART}, {LINES}, {HITS}, {SUPP}, {META},
found AS (SELECT h.path, h.line, h.ord, h.rule_id, h.match, h.text, m.rule_name, m.priority, {SEVERITY} AS severity, s.line IS NOT NULL AS is_suppressed
  FROM hits h JOIN meta m USING (rule_id) LEFT JOIN supp s ON h.path = s.path AND h.line = s.line WHERE NOT m.is_supporting)"""


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r["rule_id"], r["name"], r["priority"], r["is_supporting"], i) for i, r in enumerate(SECRET_RULES)], "rule_id string, name string, priority string, is_supporting boolean, ord int")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = artifacts(spark, sf_dir)
    hits = secrets.without_supporting(secrets.line_matches(a, SECRET_RULES, with_text=True), rule_table(spark))
    return secrets.with_secret_suppression(secrets.named(hits, rule_table(spark)), a, "line")


@query("secret_line_findings", FOUND + " SELECT path, CAST(line AS BIGINT) AS line, rule_id, rule_name, severity, match, is_suppressed FROM found")
def secret_line_findings(spark, sf_dir):
    return found(spark, sf_dir).select("path", F.col("line").cast("long").alias("line"), "rule_id", "rule_name", "severity", "match", "is_suppressed")


@query("secret_counts_by_rule", FOUND + " SELECT rule_id AS rule_name, count(*) AS total, count(*) FILTER (is_suppressed) AS suppressed, count(DISTINCT path) AS files FROM found GROUP BY 1")
def secret_counts_by_rule(spark, sf_dir):
    return findings.counts_by_rule(found(spark, sf_dir).select(F.col("rule_id").alias("rule_name"), F.col("path").alias("filename"), "is_suppressed"))


@query("findings_summary", FOUND + " SELECT count(*) FILTER (NOT is_suppressed) AS violations, count(*) AS all_violations, count(DISTINCT path) AS files, count(DISTINCT rule_id) AS rules FROM found")
def findings_summary(spark, sf_dir):
    return findings.summary(found(spark, sf_dir).select(F.col("rule_id").alias("rule_name"), F.col("path").alias("filename"), "is_suppressed"))


@query("fail_gate", FOUND + " SELECT count(*) AS n, count(*) > 0 AS failed FROM found WHERE severity IN ('ERROR', 'WARNING') AND NOT is_suppressed")
def fail_gate(spark, sf_dir):
    return findings.count_severities(found(spark, sf_dir), ["ERROR", "WARNING"])


@query("secret_totals", FOUND + " SELECT count(*) AS secrets, count(*) FILTER (line % 2 = 0) AS validated FROM found")
def secret_totals(spark, sf_dir):
    status = F.when(F.col("line") % 2 == 0, "VALID").otherwise("NOT_VALIDATED")
    return findings.secret_totals(found(spark, sf_dir).withColumn("validation_status", status))


@query("findings_fingerprint", FOUND + f" SELECT path, CAST(line AS BIGINT) AS line, rule_id, sha256(rule_id || '|' || path || '|' || strlen(path) || '|' || {BARE} || '|' || strlen({BARE})) AS fingerprint FROM found")
def findings_fingerprint(spark, sf_dir):
    f = found(spark, sf_dir).select("path", F.col("rule_id").alias("rule_name"), F.col("line").alias("start_line"), "line_text")
    return findings.fingerprinted(f, artifacts(spark, sf_dir)).select("path", F.col("start_line").cast("long").alias("line"), F.col("rule_name").alias("rule_id"), "fingerprint")


@query(
    "adjacent_rule_groups",
    FOUND + """, o AS (SELECT path, rule_id, line, ord, row_number() OVER (PARTITION BY path, line, ord) AS nth FROM found),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, ord, nth) - row_number() OVER (PARTITION BY path, rule_id ORDER BY line, ord, nth) AS isl FROM o)
SELECT path, rule_id, CAST(min(line) AS BIGINT) AS first_line, CAST(max(line) AS BIGINT) AS last_line, count(*) AS matches FROM r GROUP BY path, rule_id, isl""",
)
def adjacent_rule_groups(spark, sf_dir):
    g = secrets.grouped(found(spark, sf_dir).select("path", "rule_id", "line", "ord", "nth"), ("line", "ord", "nth"))
    lines = F.transform("matches", lambda m: m["line"])
    return g.select("path", "rule_id", F.array_min(lines).cast("long").alias("first_line"), F.array_max(lines).cast("long").alias("last_line"), F.size("matches").cast("long").alias("matches"))


@query("artifact_language", f"WITH {ART}, {LANG} SELECT path, language FROM lang")
def artifact_language(spark, sf_dir):
    return artifacts(spark, sf_dir).select("path", files.language_of(F.col("path")).alias("language"))


_NAMES = "nm AS (SELECT p_partkey AS k, (['Dockerfile', 'Dockerfile.py', 'Dockerfile.a.dockerignore', 'BUILD', 'BUILD.bazel', 'x.TSX', '.py', 'a.b.sh'])[(p_partkey % 8 + 1)::INT] AS name FROM part)"


@query(
    "artifact_languages_all",
    f"WITH {_NAMES} SELECT k, name, l.language FROM nm, (VALUES ('DOCKERFILE', '^Dockerfile', ''), ('PYTHON', '', 'py'), ('STARLARK', '^BUILD([.]bazel)?$', ''), ('TYPESCRIPT', '', 'tsx'), ('BASH', '', 'sh')) AS l(language, rx, ext) WHERE (l.rx <> '' AND regexp_matches(name, l.rx)) OR (l.ext <> '' AND lower(regexp_extract(name, '^.+[.]([^.]*)$', 1)) = l.ext)",
)
def artifact_languages_all(spark, sf_dir):
    names = ["Dockerfile", "Dockerfile.py", "Dockerfile.a.dockerignore", "BUILD", "BUILD.bazel", "x.TSX", ".py", "a.b.sh"]
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), dealt(names, "p_partkey").alias("path"))
    return files.by_language(p).select("k", F.col("path").alias("name"), "language")


@query("allowed_paths", f"WITH {ART} SELECT path FROM art WHERE NOT (regexp_matches(path, '(?i)^(.*/)?node_modules/.*$') OR path = 'spec' OR starts_with(path, 'spec/')) AND (path = 'src' OR starts_with(path, 'src/') OR regexp_matches(path, '(?i)^vendor/[^/]*/.*$') OR regexp_matches(path, '(?i)^a/.*[.](py|go|)$'))")
def allowed_paths(spark, sf_dir):
    keep = paths.allows_file(F.col("path"), ["**/node_modules/**", "spec/"], ["src", "vendor/*/**", "a/**.{py,go,}"])
    return artifacts(spark, sf_dir).where(keep).select("path")


CONFIG = """
rulesets:
  - set:
      ignore-paths: [Vendor]
      rules:
        token:
          only-paths: ["src/**"]
          severity: {"src/test": NOTICE, "/": WARNING}
          category: CODE_STYLE
          arguments:
            depth: {"/": 1, "src": 2, "src/test/src3": 3}
            wide: "no"
        email:
          ignore-paths: ["**/*.go"]
          severity: ERROR
"""


@query("rule_applies", FOUND + " SELECT DISTINCT path, rule_id FROM found WHERE NOT (path = 'Vendor' OR starts_with(path, 'Vendor/') OR regexp_matches(path, '(?i)^vendor$')) AND (rule_id <> 'set/token' OR regexp_matches(path, '(?i)^src/.*$')) AND (rule_id <> 'set/email' OR NOT regexp_matches(path, '(?i)^(.*/)?[^/]*[.]go$'))")
def rule_applies(spark, sf_dir):
    c = cfg.parse_config(CONFIG)
    return found(spark, sf_dir).where(cfg.rule_applies(F.col("path"), F.col("rule_id"), c)).select("path", "rule_id").distinct()


@query("rule_arguments", f"WITH {ART}, b AS (SELECT * FROM (VALUES ('', 'depth', '1'), ('src', 'depth', '2'), ('src/test/src3', 'depth', '3'), ('', 'wide', 'no')) AS v(prefix, name, value)) SELECT path, 'set/token' AS rule, name, arg_max(value, len(prefix)) AS value FROM art JOIN b ON prefix = '' OR path = prefix OR starts_with(path, prefix || '/') GROUP BY 1, 2, 3")
def rule_arguments(spark, sf_dir):
    return cfg.longest_prefix(artifacts(spark, sf_dir), cfg.arguments(spark, cfg.parse_config(CONFIG)))


@query("severity_override", FOUND + " SELECT path, CAST(line AS BIGINT) AS line, rule_id AS rule_name, CASE WHEN rule_id = 'set/token' THEN CASE WHEN starts_with(path, 'src/test/') THEN 'NOTICE' ELSE 'WARNING' END WHEN rule_id = 'set/email' THEN 'ERROR' ELSE severity END AS severity, CASE WHEN rule_id = 'set/token' THEN 'CODE_STYLE' ELSE 'SECURITY' END AS category FROM found")
def severity_override(spark, sf_dir):
    c = cfg.parse_config(CONFIG)
    f = found(spark, sf_dir).withColumn("rule_name", F.col("rule_id"))
    return cfg.overridden(f, cfg.severities(spark, c), cfg.categories(spark, c)).select("path", F.col("line").cast("long").alias("line"), "rule_name", "severity", "category")


_GEN = " OR ".join(f"(language = {_q(lang)} AND (" + " OR ".join(f"contains(head, {_q(p)})" for p in ps) + "))" for lang, ps in files.GENERATED.items())


@query(
    "size_generated_minified",
    f"""WITH {ART}, {LANG},
h AS (SELECT *, encode(content) AS b FROM lang),
g AS (SELECT *, CASE WHEN octet_length(b) > 400 AND regexp_matches(substr(hex(b), 801, 1), '[89AB]') THEN content ELSE content[:400] END AS head FROM h),
n AS (SELECT *, len(string_split(content, chr(10))) - CASE WHEN content = '' OR content[-1:] = chr(10) THEN 1 ELSE 0 END AS n FROM g)
SELECT path, octet_length(b) AS size_bytes, octet_length(b) <= 2 * 1024 AS small,
       coalesce({_GEN}, false) AS is_generated, coalesce(language = 'JAVASCRIPT' AND n > 0 AND octet_length(b) // n > 110, false) AS is_minified FROM n""",
)
def size_generated_minified(spark, sf_dir):
    a = files.classified(artifacts(spark, sf_dir))
    return a.select("path", "size_bytes", files.within_size(F.col("size_bytes"), 2).alias("small"), "is_generated", "is_minified")


def _rx(globs: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(path, {_q(paths.glob_regex(g, separated=False))})" for g in globs) + ")"


@query("test_like_paths", f"WITH {ART}, {LANG} SELECT path, CASE " + " ".join(f"WHEN language = {_q(k)} THEN {_rx(v)}" for k, v in files.TEST_GLOBS.items()) + f" ELSE {_rx([*files.TEST_PATHS, *files.TEST_NAMES])} END AS is_test_file FROM lang")
def test_like_paths(spark, sf_dir):
    a = artifacts(spark, sf_dir)
    return a.select("path", files.is_test_path(F.col("path"), files.language_of(F.col("path"))).alias("is_test_file"))


_COMMENT = "(" + " OR ".join(f"(language IN ({', '.join(map(_q, v))}) AND starts_with(replace(text, ' ', ''), {_q(k)}))" for k, v in suppress.COMMENTS.items()) + ")"
_DIRECTIVE = "(" + " OR ".join(f"(language IN ({', '.join(map(_q, v))}) AND contains({BARE}, {_q(k + 'no-dd-sa')}))" for k, v in suppress.COMMENTS.items()) + ")"


@query(
    "suppressions",
    f"""WITH {ART}, {LANG}, {LINES},
l AS (SELECT path, language, line, text, coalesce({_COMMENT}, false) AS com, coalesce({_DIRECTIVE}, false) AS dir FROM lines JOIN lang USING (path)),
w AS (SELECT *, coalesce(min(CASE WHEN NOT com THEN line END) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(line) OVER (PARTITION BY path) + 1) AS stop FROM l),
d AS (SELECT path, line, stop, list_filter(regexp_split_to_array(replace(replace(replace(replace(replace(replace(replace(text, '//', ''), '/*', ''), '*/', ''), '#', ''), 'no-dd-sa', ''), ':', ''), ',', ' '), '\\s+'), lambda x: contains(x, '/')) AS rules FROM w WHERE dir),
f AS (SELECT path, 0 AS line, CASE WHEN len(rules) = 0 THEN NULL ELSE unnest(CASE WHEN len(rules) = 0 THEN ['-'] ELSE rules END) END AS rule FROM d WHERE line = 1),
r AS (SELECT path, line, rules, unnest(range(line + 1, stop + 1)) AS covered FROM d WHERE line > 1),
n AS (SELECT path, covered, arg_max(rules, line) AS rules FROM r WHERE len(rules) > 0 GROUP BY 1, 2)
SELECT DISTINCT path, CAST(line AS BIGINT) AS line, rule FROM (SELECT * FROM f UNION ALL SELECT path, covered, NULL FROM r WHERE len(rules) = 0 UNION ALL SELECT path, covered, unnest(rules) FROM n)""",
)
def suppressions(spark, sf_dir):
    a = artifacts(spark, sf_dir).withColumn("language", files.language_of(F.col("path")))
    return suppress.suppressions(a).withColumn("line", F.col("line").cast("long"))


@query("default_minus_ignored", "SELECT n_name AS ruleset FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1)")
def default_minus_ignored(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.col("n_name").alias("ruleset"), "n_regionkey")
    return rules.without(n.select("ruleset"), n.where("n_regionkey = 1"))


@query("diff_aware_files", f"WITH {ART} SELECT path FROM art WHERE doc_id % 7 = 3")
def diff_aware_files(spark, sf_dir):
    a = artifacts(spark, sf_dir)
    return findings.in_files(a.select("path"), a.where("doc_id % 7 = 3").select("path"))


@query("changed_line_findings", FOUND + " SELECT path, CAST(line AS BIGINT) AS line, rule_id FROM found WHERE line % 3 = 1")
def changed_line_findings(spark, sf_dir):
    f = found(spark, sf_dir).withColumn("start_line", F.col("line"))
    changed = suppress.numbered_lines(artifacts(spark, sf_dir)).where("line % 3 = 1").select("path", "line")
    return findings.on_changed_lines(f, changed).select("path", F.col("start_line").cast("long").alias("line"), "rule_id")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    ms = F.floor(F.col("value") * 10).cast("long")
    return e.select(F.col("event_type").alias("rule_name"), F.col("user_id").cast("string").alias("filename"), ms.alias("execution_ms"), (F.col("event_id") % 50).alias("query_ms"), (F.col("event_id") % 977).alias("parse_ms"), F.when(F.col("event_id") % 41 == 0, "rule-timeout").when(F.col("event_id") % 43 == 0, "error-execution").alias("error"))


STATS = "WITH stats AS (SELECT event_type AS rule_name, CAST(user_id AS VARCHAR) AS filename, CAST(floor(value * 10) AS BIGINT) AS execution_ms, event_id % 50 AS query_ms, event_id % 977 AS parse_ms, CASE WHEN event_id % 41 = 0 THEN 'rule-timeout' WHEN event_id % 43 = 0 THEN 'error-execution' END AS error FROM events)"
_TIMES = "SELECT rule_name, CAST(sum(execution_ms) AS BIGINT) AS execution_ms, CAST(sum(query_ms) AS BIGINT) AS query_ms, count(*) AS files FROM stats GROUP BY 1"


@query("rule_time_stats", f"{STATS} {_TIMES}")
def rule_time_stats(spark, sf_dir):
    return findings.rule_times(stats(spark, sf_dir))


@query("top_slowest", f"{STATS} {_TIMES} ORDER BY execution_ms DESC, rule_name LIMIT 3")
def top_slowest(spark, sf_dir):
    return findings.slowest_rules(stats(spark, sf_dir), 3)


@query("bounded_top100", f"{STATS} SELECT DISTINCT parse_ms, filename FROM stats ORDER BY parse_ms DESC, filename DESC LIMIT 100")
def bounded_top100(spark, sf_dir):
    return findings.slowest_parses(stats(spark, sf_dir))


@query("failed_files", f"{STATS} SELECT rule_name, error, array_to_string(list_sort(list(filename)), ',') AS files FROM stats WHERE error IS NOT NULL GROUP BY 1, 2")
def failed_files(spark, sf_dir):
    return findings.failed_files(stats(spark, sf_dir)).withColumn("files", F.array_join("files", ","))


@query("metadata_union", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NOT NULL THEN a.q ELSE b.q END AS quality FROM (SELECT doc_id, quality AS q FROM labels) a FULL JOIN (SELECT doc_id, 1 - quality AS q FROM labels) b ON a.doc_id = b.doc_id")
def metadata_union(spark, sf_dir):
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return findings.first_writer(lab, lab.withColumn("quality", 1 - F.col("quality")), "doc_id", "quality")


@query("metadata_union_all", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NOT NULL THEN a.q ELSE b.q END AS quality FROM (SELECT doc_id, CAST(quality AS BIGINT) AS q FROM labels) a FULL JOIN (SELECT doc_id, CAST(n_chars AS BIGINT) AS q FROM documents) b ON a.doc_id = b.doc_id")
def metadata_union_all(spark, sf_dir):
    """metadata_union of whole tables: labels first, then a value of documents."""
    lab = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return findings.first_writer(lab, load(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("quality")), "doc_id", "quality")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select(F.col("path").alias("filename"), F.col("rule_id").alias("rule_name"), "category", "severity", "message", F.col("line").cast("long").alias("start_line"), (F.col("nth") + 1).cast("long").alias("start_col"), F.col("line").cast("long").alias("end_line"), (F.col("nth") + 2).cast("long").alias("end_col"), "is_suppressed", "validation_status")


# of equal rows the numbers are dealt in any order, so both sides deal the same ones
PLACED = FOUND + ", placed AS (SELECT path AS filename, rule_id AS rule_name, severity, rule_name AS message, line AS start_line, row_number() OVER (PARTITION BY path, line, rule_id) AS start_col, is_suppressed FROM found)"


@query("csv_rows", PLACED + " SELECT 1 AS ord, filename, rule_name AS rule, 'security' AS category, 'error' AS severity, message, CAST(start_line AS BIGINT) AS start_line, CAST(start_col AS BIGINT) AS start_col, CAST(start_line AS BIGINT) AS end_line, CAST(start_col + 1 AS BIGINT) AS end_col FROM placed WHERE NOT is_suppressed AND rule_name <> 'set/email' UNION ALL SELECT 0, filename, rule_name, 'security', lower(severity), message, start_line, start_col, start_line, start_col + 1 FROM placed WHERE NOT is_suppressed AND rule_name = 'set/email'")
def csv_rows(spark, sf_dir):
    p = placed(spark, sf_dir)
    return sinks.csv_rows(p.where("rule_name = 'set/email'"), p.where("rule_name <> 'set/email'"))


_ENC = "replace(replace(filename, '%', '%25'), ' ', '%20')"


@query("sarif_artifacts", f"{PLACED}, f AS (SELECT DISTINCT filename FROM placed) SELECT filename, {_ENC} AS uri, {_rx(files.TEST_PATHS).replace('path', 'filename')} AS is_test_file FROM f")
def sarif_artifacts(spark, sf_dir):
    p = placed(spark, sf_dir).withColumn("ord", F.col("start_line"))
    meta = artifacts(spark, sf_dir).select(F.col("path").alias("filename"), paths.any_glob(F.col("path"), files.TEST_PATHS).alias("is_test_file"))
    return sinks.sarif_artifacts(p, meta).drop("ord")


@query(
    "sarif_results",
    PLACED + f""", r AS (SELECT * FROM (VALUES ('set/token', 0, 'error', 'SECURITY'), ('set/email', 1, 'note', 'CODE_STYLE')) AS v(rule_name, rule_index, level, cat))
SELECT p.rule_name AS rule_id, r.rule_index, coalesce(level, 'none') AS level, message, {_ENC} AS uri, CAST(start_line AS BIGINT) AS start_line, CAST(start_col AS BIGINT) AS start_col,
  concat_ws(',', 'CATEGORY:' || cat, 'SECRET_VALIDATION_STATUS:NOT_VALIDATED') AS tags, CASE WHEN is_suppressed THEN 'inSource' ELSE '' END AS suppressions
FROM placed p LEFT JOIN r USING (rule_name)""",
)
def sarif_results(spark, sf_dir):
    p = placed(spark, sf_dir)
    r = spark.createDataFrame([("set/token", 0, "ERROR", "SECURITY"), ("set/email", 1, "NOTICE", "CODE_STYLE"), ("set/token", 2, "NONE", "SECURITY")], "rule_name string, ord int, severity string, category string")
    a = p.select("filename").distinct().withColumn("artifact_index", F.xxhash64("filename"))
    out = sinks.sarif_results(p, r, a)
    return out.select("rule_id", "rule_index", "level", "message", "uri", "start_line", "start_col", F.array_join("tags", ",").alias("tags"), F.array_join("suppressions", ",").alias("suppressions"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    b64 = lambda c: F.base64(F.encode(c, "UTF-8"))
    return n.select(
        F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise("set").alias("ruleset"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("set/"), "n_name")).otherwise(F.col("n_name")).alias("name"),
        b64(F.col("n_name")).alias("description"), b64(F.lower("n_name")).alias("short_description"), F.concat(F.lit("code"), F.col("n_nationkey").cast("string")).alias("code"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string")).otherwise("").alias("cwe"), F.when(F.col("n_nationkey") % 4 == 0, "p").alias("pattern"), (F.col("n_nationkey") % 6 == 0).alias("is_testing"),
        F.when(F.col("n_nationkey") % 7 == 0, "http://x").alias("documentation_url"),
    )


CAT = """WITH c AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE 'set' END AS ruleset, CASE WHEN n_nationkey % 3 = 0 THEN 'set/' || n_name ELSE n_name END AS name0, n_name, 'code' || n_nationkey AS code,
  CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS VARCHAR) END AS cwe, CASE WHEN n_nationkey % 4 = 0 THEN 'p' END AS pattern, n_nationkey % 6 = 0 AS is_testing, CASE WHEN n_nationkey % 7 = 0 THEN 'http://x' END AS documentation_url FROM nation),
n AS (SELECT *, CASE WHEN trim(ruleset) = '' OR starts_with(name0, ruleset || '/') THEN name0 ELSE ruleset || '/' || name0 END AS name FROM c)"""


@query("sarif_rules", CAT + " SELECT name AS id, n_name AS full_description, lower(n_name) AS short_description, documentation_url, concat_ws(',', 'RULE_TYPE:STATIC_ANALYSIS', 'CWE:' || cwe, CASE WHEN is_testing THEN 'IS_TESTING' END) AS tags FROM n")
def sarif_rules(spark, sf_dir):
    return rules.descriptors(rules.named(catalogue(spark, sf_dir))).withColumn("tags", F.array_join("tags", ","))


@query("rule_checksum", CAT + " SELECT name, sha256(code) AS expected_checksum, name || ':' || coalesce(pattern, 'no pattern') || ':' || code AS digest FROM n")
def rule_checksum(spark, sf_dir):
    return rules.with_digests(rules.named(catalogue(spark, sf_dir))).select("name", "expected_checksum", "digest")


@query("rule_docs", CAT + " SELECT name, coalesce(documentation_url, 'https://docs.example.org/rules/' || name) AS url FROM n")
def rule_docs(spark, sf_dir):
    return rules.named(catalogue(spark, sf_dir)).select("name", text.doc_url(F.col("documentation_url"), "https://docs.example.org/rules/", F.col("name")).alias("url"))


@query("config_digest", CAT + " SELECT sha256('a,b:c:false:' || array_to_string(list_sort(list(name || ':' || coalesce(pattern, 'no pattern') || ':' || code)), ',') || ':200::s::x,y') AS config_digest FROM n")
def config_digest(spark, sf_dir):
    r = rules.with_digests(rules.named(catalogue(spark, sf_dir)))
    return cfg.config_digest(r, ["a", "b"], ["c"], True, 200, ["s"], "", ["y", "x"])


@query("rule_self_test", "SELECT o_orderpriority AS name, o_orderstatus AS filename, CAST(count(*) FILTER (o_custkey % 2 = 0) AS INT) AS expected, CAST(count(*) FILTER (o_custkey % 3 = 0) AS INT) AS found, count(*) FILTER (o_custkey % 2 = 0) = count(*) FILTER (o_custkey % 3 = 0) AS passed FROM orders GROUP BY 1, 2")
def rule_self_test(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("filename"), "o_custkey")
    tests = o.groupBy("name", "filename").agg(F.count_if(F.col("o_custkey") % 2 == 0).cast("int").alias("n"))
    r = tests.groupBy("name").agg(F.collect_list(F.struct(F.col("n").alias("annotation_count"), "filename", F.lit("").alias("code"))).alias("tests"))
    return rules.self_test(r, o.where("o_custkey % 3 = 0").withColumnRenamed("name", "rule_name"))


# a tree: one root, regions, nations, suppliers in pre-order
def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier")
    size = 1 << 20
    col = lambda i, p, o, f, t, last, d, text_: F.struct(F.lit("g").alias("file_id"), i.cast("int").alias("node_id"), p.cast("int").alias("parent_id"), o.cast("int").alias("ordinal"), F.lit(f).alias("field_name"), F.lit(t).alias("cst_type"), F.lit(True).alias("is_named"), last.cast("int").alias("last_desc"), F.lit(d).alias("depth"), text_.alias("text"))
    rk, nk = F.col("r_regionkey") * size + 1, F.col("n_regionkey") * size + 2 + F.col("n_nationkey") * 20000
    root = spark.range(1).select(col(F.lit(0), F.lit(None), F.lit(0), None, "world", F.lit(2000000000), 0, F.lit("w")).alias("x"))
    a = r.select(col(rk, F.lit(0), F.col("r_regionkey"), "region", "region", rk + size - 1, 1, F.col("r_name")).alias("x"))
    b = n.select(col(nk, F.col("n_regionkey") * size + 1, F.col("n_nationkey"), "nation", "nation", nk + 19999, 2, F.col("n_name")).alias("x"))
    c = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(col(nk + 1 + F.col("s_suppkey"), nk, F.col("s_suppkey"), "supplier", "supplier", nk + 1 + F.col("s_suppkey"), 3, F.col("s_name")).alias("x"))
    return root.unionByName(a).unionByName(b).unionByName(c).select("x.*")


_SZ = 1 << 20
GEO = f"""WITH nn AS (SELECT *, n_regionkey * {_SZ} + 2 + n_nationkey * 20000 AS nk, n_regionkey * {_SZ} + 1 AS rk FROM nation),
geo AS (SELECT 0 AS node_id, NULL AS parent_id, 'world' AS t, 0 AS depth, 'w' AS text UNION ALL SELECT r_regionkey * {_SZ} + 1, 0, 'region', 1, r_name FROM region
UNION ALL SELECT nk, rk, 'nation', 2, n_name FROM nn UNION ALL SELECT nk + 1 + s_suppkey, nk, 'supplier', 3, s_name FROM supplier JOIN nn ON s_nationkey = n_nationkey)"""


@query("node_children", GEO + " SELECT CAST(parent_id AS BIGINT) AS node_id, CAST(node_id AS BIGINT) AS child_id, t AS cst_type FROM geo WHERE parent_id IS NOT NULL")
def node_children(spark, sf_dir):
    return nodes.children(geography(spark, sf_dir)).select(F.col("node_id").cast("long").alias("node_id"), F.col("child_id").cast("long").alias("child_id"), "cst_type")


@query("node_parents", GEO + " SELECT CAST(c.node_id AS BIGINT) AS node_id, c.t AS cst_type, p.t AS parent_type FROM geo c JOIN geo p ON c.parent_id = p.node_id")
def node_parents(spark, sf_dir):
    return nodes.parents(geography(spark, sf_dir)).select(F.col("node_id").cast("long").alias("node_id"), "cst_type", "parent_type")


@query("node_ancestors", GEO + " SELECT CAST(s.node_id AS BIGINT) AS node_id, CAST(n.parent_id AS BIGINT) AS ancestor_id FROM geo s JOIN geo n ON s.parent_id = n.node_id WHERE s.t = 'supplier'")
def node_ancestors(spark, sf_dir):
    t = F.col("cst_type")
    return nodes.find_ancestor(geography(spark, sf_dir), t == "supplier", t.isin("region", "world")).select(F.col("node_id").cast("long").alias("node_id"), F.col("ancestor_id").cast("long").alias("ancestor_id"))


@query("node_descendants", GEO + " SELECT CAST(n.parent_id AS BIGINT) AS node_id, CAST(min(s.node_id) AS BIGINT) AS descendant_id FROM geo s JOIN geo n ON s.parent_id = n.node_id WHERE s.t = 'supplier' GROUP BY 1")
def node_descendants(spark, sf_dir):
    t = F.col("cst_type")
    return nodes.find_descendant(geography(spark, sf_dir), t == "region", t == "supplier").select(F.col("node_id").cast("long").alias("node_id"), F.col("descendant_id").cast("long").alias("descendant_id"))


@query("tree_match", GEO + " SELECT CAST(r.node_id AS BIGINT) AS region, CAST(n.node_id AS BIGINT) AS nation, CAST(s.node_id AS BIGINT) AS supplier FROM geo r JOIN geo n ON n.parent_id = r.node_id JOIN geo s ON s.parent_id = n.node_id WHERE r.t = 'region' AND n.t = 'nation' AND s.t = 'supplier' AND regexp_matches(n.text, '[1-5]$')")
def tree_match(spark, sf_dir):
    p = nodes.Pattern("region", capture="region", children=[nodes.Pattern("nation", matches="[1-5]$", capture="nation", children=[nodes.Pattern(None, field_name="supplier", capture="supplier")])])
    return nodes.tree_matches(geography(spark, sf_dir), p).select(*[F.col(c).cast("long").alias(c) for c in ("region", "nation", "supplier")])


@query("tree_match_alternation", GEO + " SELECT CAST(node_id AS BIGINT) AS a, NULL::BIGINT AS b FROM geo WHERE t = 'region' UNION ALL SELECT NULL, node_id FROM geo WHERE t = 'nation' AND parent_id % 2 = 1")
def tree_match_alternation(spark, sf_dir):
    out = nodes.any_tree_matches(geography(spark, sf_dir), [nodes.Pattern("region", capture="a"), nodes.Pattern("nation", capture="b")])
    return out.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query("capture_groups", "SELECT o_custkey AS match_id, o_orderstatus AS capture, array_to_string(list_sort(list(o_orderkey)), ',') AS node_ids, max(o_orderkey) AS node_id FROM orders GROUP BY 1, 2")
def capture_groups(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("match_id"), F.col("o_orderstatus").alias("capture"), F.col("o_orderkey").alias("node_id"))
    return nodes.captures(o).withColumn("node_ids", F.array_join(F.col("node_ids").cast("array<string>"), ","))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of nations: to twice and to twice plus one their key, with one cycle and loops."""
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    e = n.select(F.lit("g").alias("graph_id"), F.col("k").alias("src"), F.explode(F.array(F.col("k") * 2, F.col("k") * 2 + 1)).alias("dst")).where("dst < 25")
    return e.unionByName(spark.createDataFrame([("g", 6, 3), ("g", 20, 5)], e.schema)).withColumn("kind", F.lit("assignment"))


_EDGES = "edges AS (SELECT DISTINCT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM (SELECT n_nationkey AS src, n_nationkey * 2 AS dst FROM nation UNION ALL SELECT n_nationkey, n_nationkey * 2 + 1 FROM nation UNION ALL SELECT 6, 3 UNION ALL SELECT 20, 5) WHERE dst < 25 AND src <> dst)"


def _walk(edges: str, start: int) -> str:
    return f"WITH RECURSIVE {_EDGES}, e AS ({edges}), walk AS (SELECT CAST({start} AS BIGINT) AS v, [CAST({start} AS BIGINT)] AS path UNION ALL SELECT e.dst, list_append(path, e.dst) FROM walk JOIN e ON v = e.src WHERE NOT list_contains(path, e.dst)) SELECT array_to_string(path, '>') AS path FROM walk WHERE len(path) > 1 AND v NOT IN (SELECT src FROM e)"


@query("simple_paths", _walk("SELECT * FROM edges", 1))
def simple_paths(spark, sf_dir):
    starts = spark.createDataFrame([("g", 1)], "graph_id string, vertex long")
    return flow.taint_sources(graph(spark, sf_dir), starts).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("transpose_paths", _walk("SELECT dst AS src, src AS dst FROM edges", 23))
def transpose_paths(spark, sf_dir):
    starts = spark.createDataFrame([("g", 23)], "graph_id string, vertex long")
    return flow.taint_sinks(graph(spark, sf_dir), starts).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("import_prefix", "SELECT l_orderkey AS k, l_linenumber AS line, package FROM (SELECT l_orderkey, l_linenumber, (['java.util.List', 'org.junit.Test', 'org.junit', 'org', 'org.junitx.A'])[(l_partkey % 5 + 1)::INT] AS package FROM lineitem) WHERE package = 'org.junit' OR starts_with(package, 'org.junit.') GROUP BY ALL")
def import_prefix(spark, sf_dir):
    names = ["java.util.List", "org.junit.Test", "org.junit", "org", "org.junitx.A"]
    i = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), dealt(names, "l_partkey").alias("package"))
    return imports.with_prefix(i, spark.createDataFrame([("org.junit",)], "package string"))



@query("import_prefix_all", "SELECT DISTINCT l_orderkey AS k, l_linenumber AS line, package FROM (SELECT l_orderkey, l_linenumber, (['java.util.List', 'org.junit.Test', 'org.junit', 'org', 'org.junitx.A'])[(l_partkey % 5 + 1)::INT] AS package FROM lineitem) WHERE package = 'org.junit' OR starts_with(package, 'org.junit.')")
def import_prefix_all(spark, sf_dir):
    """import_prefix over all rows."""
    names = ["java.util.List", "org.junit.Test", "org.junit", "org", "org.junitx.A"]
    i = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), dealt(names, "l_partkey").alias("package"))
    return imports.with_prefix(i, spark.createDataFrame([("org.junit",)], "package string"))


_RULE_LANGS = ["PYTHON", "GO", "JAVA", "SQL", "TERRAFORM"]


@query("rules_for_artifacts", f"WITH {ART}, {LANG}, r AS (SELECT n_name AS rule_name, ({_list(_RULE_LANGS)})[n_nationkey % 5 + 1] AS language FROM nation) SELECT path, language, rule_name FROM lang JOIN r USING (language)")
def rules_for_artifacts(spark, sf_dir):
    r = load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), dealt(_RULE_LANGS, "n_nationkey").alias("language"))
    a = artifacts(spark, sf_dir).select("path", files.language_of(F.col("path")).alias("language"))
    return rules.for_artifacts(a, r).select("path", "language", "rule_name")


_IMP = "regexp_extract(text, '^\\s*import\\s+([.\\w]+)', 1)"


@query("python_test_imports", f"WITH {ART}, {LINES} SELECT DISTINCT path FROM lines WHERE {_IMP} IN ('unittest', 'pytest', 'nose', 'nose2', 'doctest', 'hypothesis', 'behave', 'mock') AND ends_with(path, '.py')")
def python_test_imports(spark, sf_dir):
    a = artifacts(spark, sf_dir).where(files.language_of(F.col("path")) == "PYTHON")
    return imports.test_by_imports(a, "PYTHON")


@query(
    "card_like_luhn",
    f"""WITH {ART}, {LINES}, m AS (SELECT path, CAST(line AS BIGINT) AS line, unnest(regexp_extract_all(text, '[0-9]{{13,16}}')) AS match FROM lines),
d AS (SELECT *, list_transform(range(1, len(match) + 1), lambda i: CASE WHEN (len(match) - i) % 2 = 0 THEN match[i]::INT WHEN match[i]::INT * 2 > 9 THEN match[i]::INT * 2 - 9 ELSE match[i]::INT * 2 END) AS ds FROM m)
SELECT path, line, match, list_sum(ds) % 10 = 0 AS luhn FROM d""",
)
def card_like_luhn(spark, sf_dir):
    m = secrets.line_matches(artifacts(spark, sf_dir), [SECRET_RULES[3]])
    return m.select("path", F.col("line").cast("long").alias("line"), "match", secrets.luhn_ok(F.col("match")).alias("luhn"))


@query("supporting_pairs", f"WITH {ART}, {LINES}, {HITS} SELECT a.path, a.match AS primary_match, b.match AS supporting_match FROM hits a JOIN hits b ON a.path = b.path WHERE a.rule_id = 'set/email' AND b.rule_id = 'set/number'")
def supporting_pairs(spark, sf_dir):
    r = spark.createDataFrame([("set/email", "k", False), ("set/number", "k", True)], "rule_id string, kind string, is_supporting boolean")
    return secrets.paired(secrets.line_matches(artifacts(spark, sf_dir), [SECRET_RULES[1], SECRET_RULES[3]]), r).select("path", "primary_match", "supporting_match")


@query("line_of_offset", f"WITH {ART} SELECT path, CASE WHEN doc_id % 300 < octet_length(encode(content)) THEN CAST(len(regexp_replace(hex(encode(content))[:(doc_id % 300) * 2], '(0A)|..', '\\1', 'g')) // 2 + 1 AS BIGINT) END AS line FROM art")
def line_of_offset(spark, sf_dir):
    return artifacts(spark, sf_dir).select("path", text.line_of_offset(F.col("content"), (F.col("doc_id") % 300).cast("int")).cast("long").alias("line"))


@query("percent_encoded", f"WITH {ART} SELECT path, replace(replace(path || '#[%]', '%', '%25'), ' ', '%20').replace('#', '%23').replace('[', '%5B').replace(']', '%5D') AS uri FROM art")
def percent_encoded(spark, sf_dir):
    return artifacts(spark, sf_dir).select("path", text.percent_encode(F.concat("path", F.lit("#[%]"))).alias("uri"))


@query("used_rulesets", "SELECT ruleset FROM (SELECT n_name AS ruleset FROM nation WHERE n_regionkey < 2 UNION SELECT unnest(['x', 'y'])) WHERE ruleset NOT IN ('y', (SELECT min(n_name) FROM nation))")
def used_rulesets(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    first = n.agg(F.min("n_name").alias("m")).first()["m"]  # one row
    return cfg.used_rulesets(n.where("n_regionkey < 2").select(F.col("n_name").alias("ruleset")), {"use_default": True, "use": ["x", "y"], "ignore_rulesets": ["y", first]})


_PLACES = "found_ AS (" + " UNION ALL ".join(f"SELECT path, content, {_q(r['rule_id'])} AS rule_id, regexp_extract_all(content, {_q(r['pattern'])}) AS m, regexp_split_to_array(content, {_q(r['pattern'])}) AS p FROM art" for r in SECRET_RULES) + """),
each AS (SELECT path, content, rule_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM found_),
spans AS (SELECT path, content, rule_id, CAST(list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos, length(m[i]) AS n FROM each),
heads AS (SELECT path, rule_id, pos, content[:pos] AS a, content[:pos + n] AS b FROM spans WHERE pos + n < length(content)),
places AS (SELECT path, rule_id, CAST(pos AS INT) AS "at", CAST(len(string_split(a, chr(10))) AS INT) AS start_line, CAST(length_grapheme(string_split(a, chr(10))[-1]) + 1 AS INT) AS start_col,
  CAST(len(string_split(b, chr(10))) AS INT) AS end_line, CAST(length_grapheme(string_split(b, chr(10))[-1]) + 1 AS INT) AS end_col FROM heads)"""


@query("secret_scan_positions", f"WITH {ART}, {LINES}, {SUPP}, {_PLACES} SELECT l.*, s.line IS NOT NULL AS is_suppressed FROM places l LEFT JOIN supp s ON l.path = s.path AND l.start_line = s.line")
def secret_scan_positions(spark, sf_dir):
    a = artifacts(spark, sf_dir)
    return secrets.with_secret_suppression(secrets.scan(a, SECRET_RULES), a).drop("ord")


@query("rule_body_findings", FOUND + " SELECT path, rule_id AS rule_name, CAST(line AS INT) AS start_line, CAST(1 AS INT) AS start_col, CAST(1 + length(match) AS INT) AS end_col, 'long match' AS message FROM found WHERE rule_id IN ('set/token', 'set/email') AND length(match) > 20")
def rule_body_findings(spark, sf_dir):
    """The places of rule_bodies."""
    return rule_bodies(spark, sf_dir).select("path", "rule_name", "start_line", "start_col", "end_col", "message")


# ---- without a SQL twin ----


@query("html_node_types")
def html_node_types(spark, sf_dir):
    n = nodes.parse(repo.artifacts_from_pages(load(spark, sf_dir, "pages")), "HTML")
    return n.groupBy("cst_type", "depth").agg(F.count("*").alias("n"))


@query("rule_bodies")
def rule_bodies(spark, sf_dir):
    m = found(spark, sf_dir).select("path", F.col("rule_id").alias("rule_name"), F.col("line").cast("int").alias("start_line"), "match")

    def long_match(match: dict, report: scan.Report) -> None:
        if len(match["match"]) > 20:
            report.violation(match["start_line"], 1, match["start_line"], 1 + len(match["match"]), "long match")

    return scan.run_bodies(m, {"set/token": long_match, "set/email": long_match})


@query("sarif_documents")
def sarif_documents(spark, sf_dir):
    p = placed(spark, sf_dir)
    r = spark.createDataFrame([("set/token", 0, "ERROR", "SECURITY"), ("set/email", 1, "NOTICE", "CODE_STYLE")], "rule_name string, ord int, severity string, category string")
    a = p.select("filename").distinct().withColumn("artifact_index", F.xxhash64("filename"))
    return sinks.sarif_runs(sinks.sarif_results(p, r, a), r, "siftwork", ["a:b"])


@query("dot_graph", f"WITH {_EDGES} SELECT 'g' AS graph_id, 'digraph {{' || chr(10) || array_to_string(list_sort(list(DISTINCT '  \"' || src || '\" -> \"' || dst || '\";')), chr(10)) || chr(10) || '}}' AS dot FROM (SELECT src, dst FROM edges UNION ALL SELECT 0, 0)")
def dot_graph(spark, sf_dir):
    return sinks.dot_graphs(graph(spark, sf_dir))
