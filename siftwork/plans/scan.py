"""From artifacts and rules to findings: rule bodies in Python, secrets, suppression, overrides, fingerprints."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.operators import config as cfg
from siftwork.operators import findings as fnd
from siftwork.operators import secrets as sec
from siftwork.operators import suppress
from siftwork.schemas import FIX, REGION

FOUND = f"path string, rule_name string, start_line int, start_col int, end_line int, end_col int, message string, fixes array<{FIX}>, taint_flow array<{REGION}>, error string, output string"
COLUMNS = ["path", "rule_name", "start_line", "start_col", "end_line", "end_col", "message", "fixes", "taint_flow", "error", "output"]
_POSITION = pa.struct([("line", pa.int32()), ("col", pa.int32())])
_REGION = pa.struct([("start", _POSITION), ("end", _POSITION)])
_FIX = pa.struct([("description", pa.string()), ("edits", pa.list_(pa.struct([*_REGION, ("edit_type", pa.string()), ("content", pa.string())])))])
#: FOUND as rule bodies' rows leave a task.
ARROW = pa.schema(list(zip(COLUMNS, [*[pa.string()] * 2, *[pa.int32()] * 4, pa.string(), pa.list_(_FIX), pa.list_(_REGION), *[pa.string()] * 2], strict=True)))
#: Rows of a batch that leaves a task.
ROWS = 1000


def _at(line: int, col: int) -> dict:
    return {"line": line, "col": col}


def edit_add(line: int, col: int, content: str) -> dict:
    """An insertion; it has no end."""
    return {"start": _at(line, col), "end": None, "edit_type": "ADD", "content": content}


def edit_remove(start_line: int, start_col: int, end_line: int, end_col: int) -> dict:
    return {"start": _at(start_line, start_col), "end": _at(end_line, end_col), "edit_type": "REMOVE", "content": None}


def edit_update(start_line: int, start_col: int, end_line: int, end_col: int, content: str) -> dict:
    return {"start": _at(start_line, start_col), "end": _at(end_line, end_col), "edit_type": "UPDATE", "content": content}


def fix(description: str, *edits: dict) -> dict:
    return {"description": description, "edits": list(edits)}


def _region(where: tuple) -> dict:
    """A region of four numbers, of two (line, col) pairs, or of one mapping with start_line, start_col, end_line and end_col (a
    node of the node table) or with start and end (a region)."""
    if len(where) == 1 and isinstance(where[0], dict):
        m = where[0]
        where = (m["start"]["line"], m["start"]["col"], m["end"]["line"], m["end"]["col"]) if "start" in m else (m["start_line"], m["start_col"], m["end_line"], m["end_col"])
    elif len(where) == 2 and all(isinstance(p, (tuple, list)) and len(p) == 2 for p in where):
        where = (*where[0], *where[1])
    if len(where) != 4 or not all(isinstance(x, (int, np.integer)) for x in where):
        raise ValueError("a place is four numbers, two positions, a node or a region")
    if tuple(where[:2]) > tuple(where[2:]):
        raise ValueError("start follows end")
    return {"start": _at(*map(int, where[:2])), "end": _at(*map(int, where[2:]))}


class Report:
    """What a rule body gets beside its match: where to put violations and output."""

    def __init__(self) -> None:
        self.violations: list[tuple] = []
        self.lines: list[str] = []

    def violation(self, *where_and_message: object, fixes: list[dict] | None = None, flow: list | None = None) -> None:
        """A place as `_region` takes it, then the message; or flow, a list of such places, whose first is the violation's. Its start
        must not follow its end."""
        *where, message = where_and_message
        regions = [_region(tuple(p) if isinstance(p, (tuple, list)) else (p,)) for p in flow] if flow else None
        at = regions[0] if regions else _region(tuple(where))
        self.violations.append((at["start"]["line"], at["start"]["col"], at["end"]["line"], at["end"]["col"], message, list(fixes or []), regions))

    def log(self, *words: object) -> None:
        self.lines.append(" ".join(map(str, words)))


def run_bodies(
    matches: DataFrame,
    bodies: dict[str, Callable[[dict, Report], None]],
    limit_s: float = 2.0,
    before_all: dict[str, Callable[[list[dict], Report], None]] | None = None,
    after_all: dict[str, Callable[[Report], None]] | None = None,
) -> DataFrame:
    """FOUND for matches (path, rule_name, captures: map of names to text, and start_line): each rule's body is called once for
    each match of a file, after its before_all (with all matches of the file) and before its after_all, where it has any. A body or
    hook that fails, or is past its time for a file, gives one row with `error` and none of its violations; the job goes on.
    Time is looked at between calls, so a call that never ends holds its task. Rules without matches are not run. A match is a dict of
    its row, numbers as they are and None for null; a task sorts its matches by file and rule and holds those of one at a time."""
    first, last = before_all or {}, after_all or {}

    def run(path: str, rule: str, records: list[dict]) -> list[dict]:
        report, end, error = Report(), time.monotonic() + limit_s, None
        try:
            if rule in first:
                first[rule](records, report)
            for m in records:
                if time.monotonic() > end:
                    error = "rule-timeout"
                    break
                bodies[rule](m, report)
            if error is None and rule in last:
                last[rule](report)
        except Exception:  # noqa: BLE001  a rule's fault is its result
            error = "error-execution: " + traceback.format_exc(limit=1).strip().splitlines()[-1]
        said = "\n".join(report.lines) or None
        rows = [(path, rule, None, None, None, None, None, None, None, error, said)] if error else [(path, rule, *v, None, said) for v in report.violations]
        return [dict(zip(COLUMNS, r, strict=True)) for r in rows]

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        records = (m for batch in batches for m in batch.to_pylist(maps_as_pydicts="strict"))
        for (path, rule), group in groupby(records, itemgetter("path", "rule_name")):
            out += run(path, rule, list(group))
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out, ARROW)
                out = []
        yield pa.RecordBatch.from_pylist(out, ARROW)

    # files are dealt over a fixed number of tasks: their matches are few bytes, which Spark would put into one, but bodies take time
    tasks = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = matches.where(F.col("rule_name").isin(list(bodies)))
    return known.repartition(tasks, "path", "rule_name").sortWithinPartitions("path", "rule_name").mapInArrow(run_all, FOUND)


def secret_findings(artifacts: DataFrame, rules: DataFrame, rule_list: list[dict]) -> DataFrame:
    """Line matches with rule, suppression and fingerprint."""
    hits = sec.line_matches(artifacts, rule_list, with_text=True).withColumn("start_line", F.col("line"))
    shown = sec.without_supporting(hits, rules)
    out = sec.with_secret_suppression(sec.named(shown, rules), artifacts)
    return fnd.fingerprinted(out, artifacts).drop("line_text")


def static_findings(found: DataFrame, artifacts: DataFrame, rules: DataFrame, config: dict | None = None) -> DataFrame:
    """FOUND without errors, with the rules' severity and category (or the overrides of config), suppression, fingerprint;
    artifacts needs language."""
    r = rules.select(F.col("name").alias("rule_name"), "severity", "category")
    out = found.where("error is null").join(r, "rule_name")
    if config:
        spark = artifacts.sparkSession
        out = out.where(cfg.rule_applies(F.col("path"), F.col("rule_name"), config))
        out = cfg.overridden(out, cfg.severities(spark, config), cfg.categories(spark, config))
    out = suppress.with_suppression(out, suppress.suppressions(artifacts))
    return fnd.fingerprinted(out, artifacts)


def analyze_one(spark, path: str, content: str, scan: Callable[[DataFrame], DataFrame]) -> list[dict]:
    """One file through a scan, as rows; suppressed findings are left out."""
    one = spark.createDataFrame([(path, content, len(content.encode()))], "path string, content string, size_bytes long")
    return [r.asDict(recursive=True) for r in scan(one).where("not is_suppressed").collect()]


