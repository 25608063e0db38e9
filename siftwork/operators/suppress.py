"""Suppression directives: which lines of which artifacts which rules skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwork.functions.text import SPACE, lines, spaced, stripped

# Comment prefixes by language; JSON has none that a text contains.
COMMENTS = {
    "#": ["PYTHON", "STARLARK", "DOCKERFILE", "ELIXIR", "RUBY", "TERRAFORM", "YAML", "BASH", "R", "PHP"],
    "//": ["JAVASCRIPT", "TYPESCRIPT", "KOTLIN", "APEX", "GO", "RUST", "CSHARP", "DART", "JAVA", "SWIFT", "PHP"],
    "/*": ["JAVASCRIPT", "TYPESCRIPT", "KOTLIN", "APEX", "PHP", "SQL"],
    "<!-": ["MARKDOWN"],
    "--": ["SQL"],
}
#: Words that disable rules; a second, vendor-named one can be passed by those who need it.
KEYWORDS = ("no-dd-sa",)
SECRET_MARKS = ("#no-dd-secrets", "//no-dd-secrets")


def numbered_lines(artifacts: DataFrame) -> DataFrame:
    """path, language (if there), line (from 1), text: one row for each line."""
    keep = [c for c in ("path", "language") if c in artifacts.columns]
    return artifacts.select(*keep, F.posexplode(lines(F.col("content"))).alias("at", "text")).select(*keep, (F.col("at") + 1).alias("line"), "text")


def is_comment(text: Column, language: Column) -> Column:
    """Only spaces are skipped before the prefix, not tabs."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    out = F.lit(False)
    for prefix, langs in COMMENTS.items():
        out = out | (language.isin(langs) & bare.startswith(prefix))
    return F.coalesce(out, F.lit(False))


def is_directive(text: Column, language: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """Anywhere on the line, white space aside, so code before a trailing comment counts."""
    bare = stripped(text)
    out = F.lit(False)
    for prefix, langs in COMMENTS.items():
        for k in keywords:
            out = out | (language.isin(langs) & bare.contains(prefix + k))
    # lines are stripped only where a keyword may be
    return F.coalesce(F.when(text.rlike("|".join(map(spaced, keywords))), out), F.lit(False))


def named_rules(text: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """Words of a directive that contain '/', once comment signs, keywords, colons and commas are gone."""
    out = text
    for sign in ("//", "/*", "*/", "#", *keywords, ":"):
        out = F.replace(out, F.lit(sign), F.lit(""))
    return F.filter(F.split(F.replace(out, F.lit(","), F.lit(" ")), r"(?U)\s+"), lambda w: w.contains("/"))


def suppressions(artifacts: DataFrame, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """(path, line, rule): line 0 is the whole file, a null rule is all rules.

    A directive on line 1 covers the file. Any other covers the next line and, while lines are comments, those after it, up
    to and with the first other line. Of directives that name rules for one line, the last counts. An artifact's lines
    share a window, which is as large as the artifact; only artifacts with a directive get there.
    """
    marked = artifacts.where(F.col("content").rlike("|".join(map(spaced, keywords))))
    rows = numbered_lines(marked).withColumns({"comment": is_comment(F.col("text"), F.col("language")), "directive": is_directive(F.col("text"), F.col("language"), keywords)})
    # from the last line up, so that the frame grows with each row and is not computed anew
    after = Window.partitionBy("path").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max("line").over(Window.partitionBy("path"))
    stop = F.coalesce(F.min(F.when(~F.col("comment"), F.col("line"))).over(after), last + 1)
    found = rows.withColumn("stop", stop).where("directive").select("path", "line", "stop", named_rules(F.col("text"), keywords).alias("rules"))
    first = found.where("line = 1").select("path", F.lit(0).alias("line"), F.explode(F.when(F.size("rules") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("rules"))).alias("rule"))
    rest = found.where("line > 1").select("path", "line", "rules", F.explode(F.sequence(F.col("line") + 1, F.col("stop"))).alias("covered"))
    whole = rest.where(F.size("rules") == 0).select("path", F.col("covered").alias("line"), F.lit(None).cast("string").alias("rule"))
    named = rest.where(F.size("rules") > 0).groupBy("path", "covered").agg(F.max_by("rules", "line").alias("rules")).select("path", F.col("covered").alias("line"), F.explode("rules").alias("rule"))
    return first.unionByName(whole).unionByName(named).distinct()


def with_suppression(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """findings (path, rule_name, start_line, flow_lines or none) with is_suppressed: the start line or, with a flow, any
    line of it is covered for the rule or for all; rows stay."""
    lines_of = F.array_union(F.array("start_line"), F.coalesce("flow_lines", F.array().cast("array<int>"))) if "flow_lines" in findings.columns else F.array("start_line")
    # one row for each artifact with suppressions: as many entries as it has covered lines
    cover = rules.groupBy(F.col("path").alias("s_path")).agg(F.collect_set(F.struct("line", "rule")).alias("cover"))
    joined = findings.join(cover, findings["path"] == F.col("s_path"), "left")
    hit = F.exists("cover", lambda c: (c["rule"].isNull() | (c["rule"] == F.col("rule_name"))) & ((c["line"] == 0) | F.array_contains(lines_of, c["line"])))
    return joined.withColumn("is_suppressed", F.coalesce(hit, F.lit(False))).drop("s_path", "cover")


def secret_lines(artifacts: DataFrame) -> DataFrame:
    """(path, line) after each line that begins, white space aside, with a secret directive."""
    # only artifacts with a line that begins with a comment sign are cut into lines, and only such lines are stripped
    rows = numbered_lines(artifacts.where(F.col("content").rlike(f"(?:^|\n){SPACE}*[#/]")))
    bare = stripped(F.col("text"))
    hit = F.lit(False)
    for m in SECRET_MARKS:
        hit = hit | bare.startswith(m)
    rows = rows.where(F.col("text").rlike(f"^{SPACE}*[#/]"))
    return rows.where(hit).select("path", (F.col("line") + 1).alias("line")).distinct()
