"""Artifacts: language, size, generated and minified content, test-like paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.paths import any_glob, extension, file_name
from siftwork.functions.text import lines

# Extensions, exact names and name prefixes of each language.
EXTENSIONS = {
    "CSHARP": ["cs"],
    "DART": ["dart"],
    "DOCKERFILE": ["docker", "dockerfile"],
    "ELIXIR": ["ex", "exs"],
    "GO": ["go"],
    "JAVA": ["java"],
    "JAVASCRIPT": ["js", "jsx", "mjs", "cjs"],
    "JSON": ["json"],
    "KOTLIN": ["kt", "kts"],
    "PYTHON": ["py", "py3"],
    "RUBY": ["rb"],
    "RUST": ["rs"],
    "SWIFT": ["swift"],
    "TERRAFORM": ["tf"],
    "TYPESCRIPT": ["ts", "tsx", "mts", "cts"],
    "YAML": ["yml", "yaml"],
    "STARLARK": ["bzl"],
    "BASH": ["sh", "bash"],
    "PHP": ["php"],
    "MARKDOWN": ["md", "mdc"],
    "APEX": ["cls"],
    "R": ["r"],
    "SQL": ["sql"],
}
EXACT_NAMES = {"DOCKERFILE": ["Dockerfile"], "STARLARK": ["BUILD", "BUILD.bazel"]}
NAME_PREFIXES = {"DOCKERFILE": ["Dockerfile"]}

# What the first 400 bytes of a generated file contain, by language.
HEADER_BYTES = 400
PROTOBUF = "Generated by the protocol buffer compiler.  DO NOT EDIT!"
THRIFT = "Autogenerated by Thrift Compiler"
GENERATED = {
    "GO": ["Code generated by", PROTOBUF, THRIFT],
    "JAVA": ["generated by the protocol buffer compiler", "@javax.annotation.Generated", "This file is generated by", "This class was generated by", "by ANTLR", PROTOBUF, THRIFT],
    "JAVASCRIPT": ["Generated by PEG.js", "GENERATED CODE -- DO NOT EDIT!", "@generated by", "Auto-generated by", THRIFT],
    "PYTHON": ["Generated protocol buffer code", "Generated by the gRPC Python protocol compiler plugin", "Code generated by", "file was automatically generated by", "Automatically generated by Colab", PROTOBUF, THRIFT],
    "RUBY": ["# Code generated by", "This file is auto-generated from the current", PROTOBUF, THRIFT],
    "TYPESCRIPT": ["Generated by PEG.js", "GENERATED CODE -- DO NOT EDIT!", "@generated by", "auto-generated by", THRIFT],
    "CSHARP": ["<autogenerated", "<auto-generated"],
    "DART": ["GENERATED CODE - DO NOT MODIFY", "This is a generated file", "Generated code. Do not modify"],
    "RUST": ["@generated by", "automatically generated by rust-bindgen"],
    "SWIFT": ["Generated by the Swift generator plugin for the protocol buffer compiler", "This file was automatically generated"],
    "PHP": ["@generated by Composer", "@generated by a phing", "This file has been auto-generated by the Symfony"],
}
MINIFIED_LINE = 110

# Paths left out by default.
DEFAULT_IGNORED = [
    "**/node_modules/**/*", "**/jspm_packages/**/*", "**/.next/**/*", "**/.vuepress/**/*",
    "**/venv/**/*", "**/__pycache__/**/*",
    "**/_vendor/bundle/ruby/**/*", "**/.vendor/bundle/ruby/**/*", "**/.bundle/**/*",
    "**/.gradle/**/*",
    "**/TemporaryGeneratedFile_.*.cs", "**/*.designer.cs", "**/*.generated.cs", "**/*.g.cs", "**/*.g.i.cs",
]

# Globs of test files.
TEST_PATHS = ["**/test/**/*", "**/tests/**/*", "**/spec/**/*", "**/specs/**/*", "**/testcases/**/*", "**/testing/**/*", "**/__test__/**/*", "**/__tests__/**/*"]
TEST_NAMES = ["**/*[_.]{test,tests,spec,specs}.*"]
_JS_TESTS = [*TEST_PATHS, *TEST_NAMES, "**/*Spec.{[jt]s,m[jt]s,[jt]sx}", "**/cypress/e2e/**/*", "**/cypress/fixtures/**/*", "**/cypress/support/**/*"]
TEST_GLOBS = {
    "CSHARP": [*TEST_PATHS, "**/*Test.cs", "**/*Tests.cs"],
    "GO": ["**/*_test.go", "**/mock_*.go", "**/*_mock.go"],
    "JAVA": TEST_PATHS,
    "JAVASCRIPT": _JS_TESTS,
    "TYPESCRIPT": _JS_TESTS,
    "PYTHON": [*TEST_PATHS, *TEST_NAMES, "**/features/steps/*.py", "**/features/environment.py", "**/test*.py", "**/*test_*.py", "**/*_test.py"],
}


def language_of(path: Column) -> Column:
    """By extension in any case, exact name, then name prefix; a Dockerfile's ignore file has none."""
    name, ext = file_name(path), F.lower(extension(path))
    out = F.lit(None).cast("string")
    for lang, prefixes in NAME_PREFIXES.items():
        for p in prefixes:
            out = F.when(name.startswith(p) & ~F.coalesce(extension(path).endswith("dockerignore"), F.lit(False)), lang).otherwise(out)
    for lang, names in EXACT_NAMES.items():
        out = F.when(name.isin(names), lang).otherwise(out)
    known = F.create_map(*[F.lit(x) for lang, exts in EXTENSIONS.items() for e in exts for x in (e, lang)])
    return F.coalesce(F.try_element_at(known, F.coalesce(ext, F.lit(""))), out)


def languages_of(path: Column) -> Column:
    """All languages whose extension, name or prefix test a path meets: a file may belong to two."""
    name, ext = file_name(path), F.coalesce(F.lower(extension(path)), F.lit(""))
    tests = []
    for lang, exts in EXTENSIONS.items():
        hit = ext.isin(exts) | name.isin(EXACT_NAMES.get(lang, [])) if lang in EXACT_NAMES else ext.isin(exts)
        for p in NAME_PREFIXES.get(lang, []):
            hit = hit | name.startswith(p)
        tests.append(F.when(hit, F.lit(lang)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def within_size(content_bytes: Column, max_kb: int = 200) -> Column:
    return content_bytes <= max_kb * 1024


def is_generated(content: Column, language: Column) -> Column:
    """A listed phrase in the first bytes; the whole content counts if the cut splits a character."""
    raw = F.encode(content, "UTF-8")
    cut = F.substring(raw, 1, HEADER_BYTES)
    whole = (F.octet_length(content) > HEADER_BYTES) & F.hex(F.substring(raw, HEADER_BYTES + 1, 1)).rlike("^[89AB]")
    head = F.when(whole, content).otherwise(F.decode(cut, "UTF-8"))
    out = F.lit(False)
    for lang, phrases in GENERATED.items():
        any_of = F.lit(False)
        for p in phrases:
            any_of = any_of | head.contains(p)
        out = out | ((language == lang) & any_of)
    return F.coalesce(out, F.lit(False))


def is_minified(content: Column, language: Column) -> Column:
    """JavaScript whose bytes a line, divided without remainder, pass 110."""
    n = F.size(lines(content))
    return F.coalesce((language == "JAVASCRIPT") & (n > 0) & (F.floor(F.octet_length(content) / n) > MINIFIED_LINE), F.lit(False))


def is_test_path(path: Column, language: Column) -> Column:
    out = any_glob(path, [*TEST_PATHS, *TEST_NAMES])
    for lang, globs in TEST_GLOBS.items():
        out = F.when(language == lang, any_glob(path, globs)).otherwise(out)
    return out


def classified(artifacts: DataFrame) -> DataFrame:
    """artifacts with language, is_generated, is_minified and is_test_file."""
    a = artifacts.withColumn("language", language_of(F.col("path")))
    return a.withColumns({"is_generated": is_generated(F.col("content"), F.col("language")), "is_minified": is_minified(F.col("content"), F.col("language")), "is_test_file": is_test_path(F.col("path"), F.col("language"))})


def by_language(artifacts: DataFrame) -> DataFrame:
    """One row for each language an artifact belongs to."""
    return artifacts.withColumn("language", F.explode(languages_of(F.col("path"))))


def pruned(artifacts: DataFrame, languages: DataFrame | None = None, max_kb: int = 200, skip_generated: bool = True) -> DataFrame:
    """Artifacts worth parsing: small enough, of a language that has rules, neither generated nor minified. Size is
    tested first, on the column alone, so that content is read for what passes."""
    a = artifacts.where(within_size(F.col("size_bytes"), max_kb)).withColumn("language", language_of(F.col("path")))
    if languages is not None:
        a = a.join(languages, "language", "left_semi")
    if skip_generated:
        a = a.where(~is_generated(F.col("content"), F.col("language")) & ~is_minified(F.col("content"), F.col("language")))
    return a
