"""Repositories: file scans, ignore files, changes and blame by git, artifacts from tables."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.paths import allows_file
from siftwork.schemas import CHANGED_LINES


def scan_files(spark: SparkSession, root: str, ignore: list[str] | None = None, only: list[str] | None = None, max_kb: int | None = None) -> DataFrame:
    """path (below the root), content, size_bytes. Lengths and paths are filtered before contents are used; bytes that are not
    UTF-8 become the replacement character; .git is left out, links are not followed by the recursive listing's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = os.path.realpath(root).rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(top), "")
    f = files.select(path.alias("path"), "length", "content")
    if max_kb is not None:
        f = f.where(F.col("length") <= max_kb * 1024)
    f = f.where(~F.col("path").rlike(r"(?:^|/)\.git(?:/|$)")).where(allows_file(F.col("path"), ignore or [], only))
    return f.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("length").alias("size_bytes"))


def subdirectories_are_safe(root: str, subdirectories: list[str]) -> bool:
    """Each stays under the root after links and dots are resolved."""
    top = Path(root).resolve()
    return all((top / s).resolve().is_relative_to(top) for s in subdirectories)


def gitignore_patterns(root: str) -> list[str]:
    """Lines of the root's .gitignore that are neither comments, negations nor empty, each a path pattern."""
    path = Path(root, ".gitignore")
    if not path.exists():
        return []
    return [x for x in path.read_text(errors="replace").splitlines() if x and not x.startswith("#") and "!" not in x]


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], capture_output=True, text=True, check=True, timeout=600).stdout


def changed_lines(spark: SparkSession, root: str, base: str, head: str = "HEAD") -> DataFrame:
    """(path, line) of lines that head adds to or updates in base."""
    rows, path = [], None
    for line in _git(root, "diff", "-U0", "--no-color", "--no-renames", base, head).splitlines():
        if line.startswith("+++ "):
            path = line[6:].removesuffix("\t") if line.startswith("+++ b/") else None  # git ends names that hold spaces by a tab
        elif path and (m := re.match(r"@@ -\S+ \+([0-9]+)(?:,([0-9]+))? @@", line)):
            rows += [(path, int(m[1]) + i) for i in range(int(m[2] or 1))]
    return spark.createDataFrame(rows, CHANGED_LINES)


def current_branch(root: str) -> str | None:
    return os.environ.get("CI_COMMIT_BRANCH") or _git(root, "rev-parse", "--abbrev-ref", "HEAD").strip() or None


def default_branch(root: str) -> str | None:
    try:
        return _git(root, "symbolic-ref", "--short", "refs/remotes/origin/HEAD").strip().removeprefix("origin/")
    except subprocess.CalledProcessError:
        names = _git(root, "branch", "--format=%(refname:short)").split()
        return next((n for n in ("main", "master") if n in names), None)


def remote_url(root: str) -> str | None:
    try:
        return _git(root, "remote", "get-url", "origin").strip()
    except subprocess.CalledProcessError:
        return None


def blamed(findings: DataFrame, root: str) -> DataFrame:
    """findings (path, start_line) with sha, the last commit of the line; root must be readable by the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path in b["path"].unique():
                try:
                    shas = {int(m[2]): m[1] for m in re.finditer(r"(?m)^([0-9a-f]{40}) [0-9]+ ([0-9]+)", _git(root, "blame", "--porcelain", "--", path))}
                except subprocess.CalledProcessError:
                    shas = {}
                rows += [(path, n, shas.get(int(n))) for n in b.loc[b["path"] == path, "start_line"].unique()]
            yield pd.DataFrame(rows, columns=["path", "start_line", "sha"])

    lines = findings.select("path", "start_line").distinct().repartition("path")
    return findings.join(lines.mapInPandas(run, "path string, start_line int, sha string"), ["path", "start_line"], "left")


def artifacts_from_documents(docs: DataFrame) -> DataFrame:
    """Documents as artifacts: source/doc_id.lang."""
    return docs.select(F.concat_ws("", F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"))


def artifacts_from_pages(pages: DataFrame) -> DataFrame:
    """Pages as artifacts: host and path of the url."""
    return pages.select(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "").alias("path"), F.col("html").alias("content"), F.octet_length("html").cast("long").alias("size_bytes"))


def artifacts_from_turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("."), F.col("role")).alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"))
