"""Path patterns as regular expressions and column predicates.

Two glob dialects: `separated` (configuration: any case, * and ? stay inside a component, an alternative may be
empty) and `plain` (test heuristics: case counts, * and ? cross components). A configuration pattern also matches
as a prefix by components; a glob that does not parse matches as a prefix only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str, separated: bool = True) -> str | None:
    """The regular expression (Java, RE2 and Python) of a glob for a whole path; None if the glob is malformed."""
    out, i, n, depth = [], 0, len(pattern), 0
    one, many = ("[^/]", "[^/]*") if separated else (".", ".*")
    while i < n:
        c = pattern[i]
        if c == "*":
            j = i
            while j < n and pattern[j] == "*":
                j += 1
            alone = j - i == 2 and (i == 0 or pattern[i - 1] == "/") and (j == n or pattern[j] == "/")
            if alone and j < n:  # **/
                out.append("(?:.*/)?" if i == 0 else "(?:.*/)?")
                i = j + 1
                continue
            out.append(".*" if alone else many)
            i = j
        elif c == "?":
            out.append(one)
            i += 1
        elif c == "[":
            j = i + 1
            negate = j < n and pattern[j] in "!^"
            j += negate
            k = pattern.find("]", j + 1)
            if k < 0:
                return None
            body = re.sub(r"([\\\[\]^&~])", r"\\\1", pattern[j:k])
            out.append(f"[{'^' if negate else ''}{body}]")
            i = k + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
            i += 1
        elif c == "}":
            if not depth:
                return None
            depth -= 1
            out.append(")")
            i += 1
        elif c == "," and depth:
            out.append("|")
            i += 1
        elif c == "\\":
            if i + 1 == n:
                return None
            out.append(re.escape(pattern[i + 1]))
            i += 2
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "/_-" else c)
            i += 1
    return None if depth else ("(?is)" if separated else "(?s)") + "^" + "".join(out) + "$"


def has_prefix(path: Column, prefix: str) -> Column:
    """Component-wise prefix; the empty prefix is every path's."""
    p = prefix.rstrip("/")
    return F.lit(True) if not p else (path == p) | path.startswith(f"{p}/")


def path_matches(path: Column, pattern: str) -> Column:
    """Glob or component-wise prefix."""
    regex = glob_regex(pattern)
    return has_prefix(path, pattern) if regex is None else path.rlike(regex) | has_prefix(path, pattern)


def any_match(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path_matches(path, p)
    return out


def allows_file(path: Column, ignore: list[str], only: list[str] | None) -> Column:
    """No ignore pattern matches, and one of `only` does unless it is None; an empty `only` rejects every path."""
    allowed = ~any_match(path, ignore)
    return allowed if only is None else allowed & any_match(path, only)


def any_glob(path: Column, globs: list[str]) -> Column:
    """Any glob of the plain dialect."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g, separated=False))
    return out


def split_path(path: Column) -> Column:
    """Components without empty ones."""
    return F.filter(F.split(path, "/"), lambda c: c != "")


def join_path(parts: Column) -> Column:
    return F.array_join(parts, "/")


def ancestors(path: Column) -> Column:
    """All component prefixes of a path, from '' (the root) to the path itself."""
    parts = split_path(path)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ruleset_of(rule: Column) -> Column:
    """What stands before the first '/', null without one."""
    return F.when(F.instr(rule, "/") > 0, F.substring_index(rule, "/", 1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """After the last dot of the file name, null without one or if the name only begins with it."""
    return F.nullif(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1), F.lit(""))


def slashed(path: Column, windows: bool = False) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/")) if windows else path
