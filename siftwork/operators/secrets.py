"""Secret scan: regular expressions over artifacts, positions, suppression, grouping.

Rules are few and known when the plan is made, so each is a column expression over the content and no rule meets
an artifact in a join: an artifact is read once whatever the number of rules, and content without a rule's keyword or
match yields nothing. Character offsets come from the pieces around matches, in the JVM; only columns by graphemes
need Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwork.functions.text import lines, priority_severity
from siftwork.operators.suppress import secret_lines


_CONTEXT = re.compile(r"[\^$]|\\[bBAzZG]|\(\?[=!<]")


def line_matches(artifacts: DataFrame, rules: list[dict], with_text: bool = False) -> DataFrame:
    """path, line, rule_id, match: matches inside lines, all of them; rules: dicts with rule_id, pattern and, if wanted,
    included_keywords and excluded_keywords, which the artifact's content must and must not hold, and literals, of which every match
    holds one. with_text: also line_text, the line.

    An artifact is cut into lines only if a rule can match in it: by its keywords and literals and, for a pattern that does not look
    at what is around its match, by one search of the whole content. Lines without a literal are not searched.
    """
    may, found = [], []
    for r in rules:
        content = F.lower("content")
        ok = F.lit(True)
        if r.get("included_keywords"):
            ok = F.lit(False)
            for k in r["included_keywords"]:
                ok = ok | content.contains(k.lower())
        for k in r.get("excluded_keywords") or []:
            ok = ok & ~content.contains(k.lower())
        every = F.regexp_extract_all(F.col("text"), F.lit(r["pattern"]), F.lit(0))
        if r.get("literals"):
            ok = ok & _any(F.col("content"), r["literals"])
            every = F.when(_any(F.col("text"), r["literals"]), every).otherwise(F.array().cast("array<string>"))
        if not _CONTEXT.search(r["pattern"]):
            ok = F.when(ok, F.col("content").rlike(r["pattern"])).otherwise(False)
        may.append(F.coalesce(ok, F.lit(False)))
        found.append((r["rule_id"], every))
    rows = artifacts.withColumn("_ok", F.array(*may)).where(F.exists("_ok", lambda x: x))
    rows = rows.select("path", "_ok", F.posexplode(lines(F.col("content"))).alias("at", "text")).select("path", "_ok", (F.col("at") + 1).alias("line"), "text")
    none = F.array().cast("array<string>")
    per_rule = [F.struct(F.lit(i).alias("ord"), F.lit(rid).alias("rule_id"), F.when(F.col("_ok")[i], every).otherwise(none).alias("m")) for i, (rid, every) in enumerate(found)]
    text = ["text"] if with_text else []
    hits = rows.select("path", "line", *text, F.explode(F.array(*per_rule)).alias("h")).where(F.size("h.m") > 0)
    hits = hits.select("path", "line", *text, F.col("h.ord").alias("ord"), F.col("h.rule_id").alias("rule_id"), F.posexplode("h.m").alias("nth", "match"))
    return hits.withColumnRenamed("text", "line_text") if with_text else hits


def _any(text: Column, literals: list[str]) -> Column:
    out = F.lit(False)
    for x in literals:
        out = out | text.contains(x)
    return out


def scan(artifacts: DataFrame, rules: list[dict], drop_at_end: bool = True) -> DataFrame:
    """path, ord, rule_id, start and end line and grapheme column of each match over whole contents.

    A match that ends with the content is dropped unless drop_at_end is off. Rows come from a pandas function over batches
    of contents, since columns count grapheme clusters.
    """
    wanted = [(i, r["rule_id"], r["pattern"], [k.lower() for k in r.get("included_keywords") or []], [k.lower() for k in r.get("excluded_keywords") or []]) for i, r in enumerate(rules)]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import bisect

        import regex

        compiled = [(i, rid, regex.compile(p), inc, exc) for i, rid, p, inc, exc in wanted]
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["content"], strict=True):
                if not text:
                    continue
                low = text.lower() if any(inc or exc for *_, inc, exc in compiled) else ""
                starts = None
                for i, rid, rx, inc, exc in compiled:
                    if (inc and not any(k in low for k in inc)) or any(k in low for k in exc):
                        continue
                    for m in rx.finditer(text):
                        if drop_at_end and m.end() >= len(text):
                            continue
                        if starts is None:
                            starts = [0, *(k.end() for k in regex.finditer("\n", text))]
                        where = []
                        for at in m.span():
                            line = bisect.bisect_right(starts, at)
                            where += [line, len(regex.findall(r"\X", text[starts[line - 1] : at])) + 1]
                        rows.append((path, i, rid, m.start(), *where))
            yield pd.DataFrame(rows, columns=["path", "ord", "rule_id", "at", "start_line", "start_col", "end_line", "end_col"])

    return artifacts.select("path", "content").mapInPandas(find, "path string, ord int, rule_id string, at int, start_line int, start_col int, end_line int, end_col int")


def with_secret_suppression(matches: DataFrame, artifacts: DataFrame, line: str = "start_line") -> DataFrame:
    """is_suppressed: the start line follows a directive."""
    lines_ = secret_lines(artifacts).select(F.col("path").alias("s_path"), F.col("line").alias("s_line"), F.lit(True).alias("s_hit"))
    out = matches.join(lines_, (F.col("path") == F.col("s_path")) & (F.col(line) == F.col("s_line")), "left")
    return out.withColumn("is_suppressed", F.coalesce("s_hit", F.lit(False))).drop("s_path", "s_line", "s_hit")


def grouped(matches: DataFrame, order: tuple[str, ...] = ("start_line", "start_col", "ord")) -> DataFrame:
    """Runs of matches of one rule, in the order of their positions in an artifact: path, grp, rule_id, matches.

    The window is one artifact's matches; an artifact with any number of them is sorted, never gathered, before runs are.
    """
    w = Window.partitionBy("path").orderBy(*order)
    new = F.coalesce((F.lag("rule_id").over(w) != F.col("rule_id")).cast("int"), F.lit(1))
    marked = matches.withColumn("new", new).withColumn("grp", F.sum("new").over(w).cast("long"))
    fields = [c for c in matches.columns if c not in ("path", "rule_id")]
    return marked.groupBy("path", "grp", "rule_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in order if c in fields], *[c for c in fields if c not in order]))).alias("matches"))


def without_supporting(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches of rules that are not only there for others."""
    return matches.join(rules.where("is_supporting").select("rule_id"), "rule_id", "left_anti")


def paired(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches of primary rules with those of supporting rules of the same kind in the same artifact."""
    kinds = rules.select("rule_id", "kind", "is_supporting")
    m = matches.join(kinds, "rule_id")
    main = m.where(~F.col("is_supporting")).select("path", "kind", F.col("rule_id").alias("primary_rule"), F.col("match").alias("primary_match"))
    side = m.where("is_supporting").select("path", "kind", F.col("rule_id").alias("supporting_rule"), F.col("match").alias("supporting_match"))
    return main.join(side, ["path", "kind"])


def named(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """With rule name, priority and severity; the message is the rule's name, the status NOT_VALIDATED."""
    r = rules.select("rule_id", F.col("name").alias("rule_name"), "priority")
    return matches.join(r, "rule_id").withColumns({"message": F.col("rule_name"), "severity": priority_severity(F.col("priority")), "category": F.lit("SECURITY"), "validation_status": F.lit("NOT_VALIDATED")})


def luhn_ok(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    cells = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(F.filter(cells, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0
