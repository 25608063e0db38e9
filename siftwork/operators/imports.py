"""Imports of source files by patterns over lines, their prefixes, and contexts of files.

One row for each import: path, line, name (what it is known by; null for whole packages), package. The lines of an
import statement are joined first, and its row has the line that it begins on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import lines
from siftwork.operators.suppress import numbered_lines

#: Test packages by language, those of the reference (classifiers/tests.rs).
TEST_PACKAGES = {
    "PYTHON": [
        "behave", "doctest", "hypothesis", "nox", "pytest", "pytest_bdd", "testify", "unittest", "unittest2",
    ],
    "GO": [
        "github.com/go-check/check", "github.com/onsi/ginkgo", "github.com/h2non/gock", "github.com/smartystreets/goconvey",
        "github.com/onsi/gomega", "github.com/golang/mock", "go.uber.org/mock", "github.com/petergtz/pegomock", "testing",
        "github.com/stretchr/testify",
    ],
    "JAVA": [
        "org.apache.camel.test", "org.awaitility", "org.jboss.arquillian", "org.assertj", "io.cucumber", "org.dbunit",
        "org.easymock", "org.jbehave", "org.openjdk.jmh", "org.junit", "com.intuit.karate", "org.mockito", "au.com.dius.pact",
        "org.powermock", "io.restassured", "org.seleniumhq.selenium", "org.openqa.selenium", "org.spockframework",
        "org.testcontainers", "org.testfx", "org.testng", "com.github.tomakehurst.wiremock",
    ],
    "JAVASCRIPT": [
        "ava", "better-assert", "bun:test", "chai", "cucumber", "expect.js", "enzyme", "jest", "assert", "mocha", "node:assert",
        "puppeteer", "qunit", "selenium-webdriver", "should", "sinon", "tape", "testcafe", "testcontainers", "unexpected",
    ],
    "CSHARP": [
        "ApprovalTests", "AutoFixture", "Ploeh.AutoFixture", "BenchmarkDotNet", "FakeItEasy", "FluentAssertions", "FsCheck",
        "LightBDD", "MbUnit.Framework", "Moq", "Microsoft.VisualStudio.TestPlatform", "Microsoft.VisualStudio.TestTools",
        "NBench", "NFluent", "NUnit.Framework", "NSubstitute", "Microsoft.Playwright", "OpenQA.Selenium", "Shouldly",
        "TechTalk.SpecFlow", "Testcontainers", "VerifyMSTest", "VerifyNUnit", "VerifyTests", "VerifyXunit", "WireMock", "Xunit",
    ],
}
TEST_PACKAGES["TYPESCRIPT"] = TEST_PACKAGES["JAVASCRIPT"]


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


#: A line feed and the number of the line behind it, as joined_lines() has them.
_NEXT = r"\n\d+\x02"
_HEAD = r"(?m)((?:\G(?!\A)|^\d+\x02\s*"
_PYTHON = [
    (_HEAD + r"(?:[^#;\"'\n]*;\s*)*(?:from|import)\b)[^#\n]*)\\" + _NEXT, "$1 "),
    (_HEAD + r"(?:[^#;\"'\n]*;\s*)*from\s+[.\w]+\s+import\s*\()[^()#\n]*)(?:#[^\n]*)?" + _NEXT, "$1 "),
]
_JAVASCRIPT = [
    (_HEAD + r"""(?:import\b[^;\n]*;\s*)*import\b)(?:[^"'();/\n]|/(?!/))*)(?://[^\n]*)?(?!\n\d+\x02\s*(?:import|const|let|var|export|function|class)\b)""" + _NEXT, "$1 "),
    (_HEAD + r"""(?:const|let|var)\s*\{)(?:[^{}"';/\n]|/(?!/))*)(?://[^\n]*)?""" + _NEXT, "$1 "),
    (r"(=\s*)" + _NEXT + r"(\s*(?:await\s+)?(?:require|import)\()", "$1$2"),
    (r"(\b(?:require|import)\(\s*)" + _NEXT + r"""(\s*["'])""", "$1$2"),
]
_JAVA = [(_HEAD + r"(?:import\b[^;\n]*;\s*)*import\b)[^;/\n]*)(?://[^\n]*)?(?!\n\d+\x02\s*import\b)" + _NEXT, "$1 ")]
_CSHARP = [(_HEAD + r"(?:(?:global\s+)?using\b[^;\n]*;\s*)*(?:global\s+)?using\b)[^;/(\n]*)(?://[^\n]*)?(?!\n\d+\x02\s*(?:global\s+)?using\b)" + _NEXT, "$1 ")]


def joined_lines(artifacts: DataFrame, joins: list[tuple[str, str]], begin: str) -> DataFrame:
    """path, line, text as numbered_lines, but statements over several lines are one, and lines that match `begin` are cut at semicolons."""
    whole = F.array_join(F.transform(lines(F.col("content")), lambda x, i: F.concat((i + 1).cast("string"), F.lit("\x02"), x)), "\n")
    for pattern, to in joins:
        whole = F.regexp_replace(whole, pattern, to)
    rows = artifacts.select("path", F.explode(F.split(whole, "\n")).alias("row"))
    rows = rows.select("path", F.substring_index("row", "\x02", 1).try_cast("int").alias("line"), F.regexp_replace("row", r"^\d+\x02", "").alias("text")).where("line is not null")
    return rows.select("path", "line", F.explode(F.when(F.col("text").rlike(begin), F.split("text", r"(?<=;)")).otherwise(F.array("text"))).alias("text"))


def stem(module: Column) -> Column:
    """The file stem of a module name: ./foo/bar.js is bar; null for a path without one."""
    last = F.substring_index(module, "/", -1)
    return F.when(last.rlike(r"[^.]"), F.regexp_replace(last, r"(?<=.)\.[^.]*$", ""))


def python_imports(artifacts: DataFrame) -> DataFrame:
    rows = joined_lines(artifacts, _PYTHON, r"^\s*(?:from|import)\b[^#]*;")
    base = r"^\s*from\s+([.\w]+)\s+import\b\s*\(?([^#();]+)"
    a = rows.where(F.col("text").rlike(base)).select("path", "line", _part(F.col("text"), base, 1).alias("package"), F.explode(F.split(_part(F.col("text"), base, 2), ",")).alias("item"))
    a = a.select("path", "line", F.trim(F.regexp_extract("item", r"(?:.*\sas\s+)?\s*(\S+)\s*$", 1)).alias("name"), "package").where("name <> ''")
    plain = r"^\s*import\s+([^#;]+)"
    b = rows.where(F.col("text").rlike(plain)).select("path", "line", F.explode(F.split(_part(F.col("text"), plain, 1), ",")).alias("item"))
    b = b.select("path", "line", _part(F.col("item"), r"\sas\s+(\w+)", 1).alias("name"), F.trim(F.regexp_extract("item", r"^\s*([.\w]+)", 1)).alias("package"))
    return a.unionByName(b)


def javascript_imports(artifacts: DataFrame) -> DataFrame:
    rows = joined_lines(artifacts, _JAVASCRIPT, r"^\s*(?:import|const|let|var)\b.*;")
    module = r"""(?:from|import|require\(|import\()\s*["']([^"']+)["']"""
    lines = rows.where(F.col("text").rlike(r"""\b(?:import|require)\b""") & F.col("text").rlike(module)).withColumn("package", stem(_part(F.col("text"), module, 1))).where("package is not null")
    named = lines.withColumn("list", _part(F.col("text"), r"\{([^}]*)\}", 1))
    a = named.where("list is not null").select("path", "line", "package", F.explode(F.split("list", ",")).alias("item")).select("path", "line", F.trim(F.regexp_extract("item", r"^\s*(\w+)", 1)).alias("raw"), "package").where("raw <> ''")
    a = a.select("path", "line", F.when(F.col("raw") == "default", F.col("package")).otherwise(F.col("raw")).alias("name"), "package")
    one = F.coalesce(_part(F.col("text"), r"import\s+(\w+)\s+from", 1), _part(F.col("text"), r"\*\s+as\s+(\w+)", 1), _part(F.col("text"), r"(?:const|let|var)\s+(\w+)\s*=\s*(?:await\s+)?(?:require|import)\(", 1))
    return a.unionByName(named.where("list is null").select("path", "line", one.alias("name"), "package"))


def go_imports(artifacts: DataFrame) -> DataFrame:
    rows = joined_lines(artifacts, [], r"^\s*import\b[^/]*;")
    one = r"""^\s*(?:import\b\s*\(?\s*)?(?:([\w.]+)\s+)?["`]([\w./-]+)["`]\s*[;)]*\s*(?://.*)?$"""
    hit = rows.where(F.col("text").rlike(one)).select("path", "line", _part(F.col("text"), one, 1).alias("alias"), _part(F.col("text"), one, 2).alias("package"))
    return hit.select("path", "line", F.coalesce("alias", F.substring_index("package", "/", -1)).alias("name"), "package")


def java_imports(artifacts: DataFrame) -> DataFrame:
    rows = joined_lines(artifacts, _JAVA, r"^\s*import\b.*;").withColumn("text", F.regexp_replace("text", r"\s*\.\s*", "."))
    p = r"^\s*import\s+(?:static\s+)?([\w.]+?)\.(\w+|\*)\s*;"
    hit = rows.where(F.col("text").rlike(p))
    return hit.select("path", "line", F.nullif(_part(F.col("text"), p, 2), F.lit("*")).alias("name"), _part(F.col("text"), p, 1).alias("package"))


def csharp_usings(artifacts: DataFrame) -> DataFrame:
    """A file with an alias-qualified name (a::b) has none."""
    rows = joined_lines(artifacts.where(~F.col("content").rlike(r"(?m)^\s*using\s[^;]*::")), _CSHARP, r"^\s*(?:global\s+)?using\b.*;").withColumn("text", F.regexp_replace("text", r"\s*\.\s*", "."))
    p = r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;"
    hit = rows.where(F.col("text").rlike(p))
    return hit.select("path", "line", _part(F.col("text"), p, 1).alias("name"), _part(F.col("text"), p, 2).alias("package"))


IMPORTS = {"PYTHON": python_imports, "JAVASCRIPT": javascript_imports, "TYPESCRIPT": javascript_imports, "GO": go_imports, "JAVA": java_imports, "CSHARP": csharp_usings}


def with_prefix(imports: DataFrame, prefixes: DataFrame, separator: str = ".") -> DataFrame:
    """Imports that have a listed package (column package) as a prefix by components."""
    parts = F.split("package", f"\\Q{separator}\\E")
    heads = imports.withColumn("head", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))))
    listed = prefixes.select(F.col("package").alias("head")).distinct()
    return heads.join(listed, "head", "left_semi").select(*imports.columns).distinct()


def test_by_imports(artifacts: DataFrame, language: str, packages: dict[str, list[str]] | None = None) -> DataFrame:
    """Paths of a language that import test packages: by prefix, in JavaScript by equal names."""
    listed = (packages or TEST_PACKAGES).get(language, [])
    spark = artifacts.sparkSession
    names = spark.createDataFrame([(p,) for p in listed], "package string")
    found = IMPORTS[language](artifacts)
    if language in ("JAVASCRIPT", "TYPESCRIPT"):
        return found.join(names, "package", "left_semi").select("path").distinct()
    return with_prefix(found, names, "/" if language == "GO" else ".").select("path").distinct()


def terraform_resources(artifacts: DataFrame) -> DataFrame:
    """(path, line, type, name) of resource blocks."""
    p = r"""^\s*resource\s+"([^"]+)"\s+"([^"]+)"\s*\{?"""
    rows = numbered_lines(artifacts)
    return rows.where(F.col("text").rlike(p)).select("path", "line", _part(F.col("text"), p, 1).alias("type"), _part(F.col("text"), p, 2).alias("name"))


def package_aliases(artifacts: DataFrame) -> DataFrame:
    """Go: (path, map of name to package)."""
    return go_imports(artifacts).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "package")))).alias("packages"))
