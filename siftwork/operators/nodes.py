"""Syntax nodes as rows, navigation and tree patterns as joins.

Node ids are pre-order numbers, so a subtree is the range (node_id, last_desc]; every join holds file_id as an equal key.
Parsers are small emitters for HTML, Python and JSON from the standard library; their node types are their own. Any other
parser can fill the same schema.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.schemas import NODES

COLUMNS = [c.split()[0] for c in NODES.split(", ")]


class _Rows:
    """Collects nodes in pre-order."""

    def __init__(self, file_id: str):
        self.file_id, self.rows, self.stack, self.seen = file_id, [], [], {}

    def open(self, cst_type: str, line: int, col: int, named: bool = True, field_name: str | None = None, text: str | None = None) -> int:
        node, parent = len(self.rows), self.stack[-1] if self.stack else None
        at = self.seen.get(parent, 0)
        self.seen[parent] = at + 1
        self.rows.append([self.file_id, node, parent, at, field_name, cst_type, named, line, col, line, col, node, len(self.stack), text])
        self.stack.append(node)
        return node

    def close(self, line: int, col: int) -> None:
        r = self.rows[self.stack.pop()]
        r[9], r[10], r[11] = line, col, len(self.rows) - 1


def html_nodes(file_id: str, text: str) -> list[list]:
    from html.parser import HTMLParser

    out, void = _Rows(file_id), frozenset("area base br col embed hr img input link meta source track wbr".split())

    class Emit(HTMLParser):
        tags: list[str] = []

        def place(self) -> tuple[int, int]:
            line, col = self.getpos()
            return line, col + 1

        def handle_starttag(self, tag, attrs):
            out.open("element", *self.place(), text=tag)
            for k, v in attrs:
                out.open("attribute", *self.place(), field_name=k, text=v)
                out.close(*self.place())
            self.tags.append(tag)
            if tag in void:
                self.handle_endtag(tag)

        def handle_endtag(self, tag):
            if tag in self.tags:
                while self.tags and self.tags.pop() != tag:
                    out.close(*self.place())
                out.close(*self.place())

        def handle_data(self, data):
            if data.strip():
                out.open("text", *self.place(), text=data)
                out.close(*self.place())

    p = Emit(convert_charrefs=True)
    p.tags = []
    out.open("document", 1, 1)
    p.feed(text)
    p.close()
    while out.stack:
        out.close(*p.place())
    return out.rows


def python_nodes(file_id: str, text: str) -> list[list]:
    import ast

    out = _Rows(file_id)

    def walk(node: ast.AST, name: str | None) -> None:
        line, col = getattr(node, "lineno", 1), getattr(node, "col_offset", 0) + 1
        said = next((str(getattr(node, a)) for a in ("id", "name", "attr", "arg", "value") if isinstance(getattr(node, a, None), (str, int, float))), None)
        out.open(type(node).__name__, line, col, field_name=name, text=said)
        for key, value in ast.iter_fields(node):
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST) and not isinstance(child, ast.expr_context):
                    walk(child, key)
        out.close(getattr(node, "end_lineno", None) or line, (getattr(node, "end_col_offset", None) or col - 1) + 1)

    walk(ast.parse(text), None)
    return out.rows


def json_nodes(file_id: str, text: str) -> list[list]:
    import json

    out = _Rows(file_id)

    def walk(value: object, name: str | None) -> None:
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}[type(value)]
        out.open(kind, 1, 1, field_name=name, text=None if kind in ("object", "array") else json.dumps(value))
        for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
            walk(v, str(k))
        out.close(1, 1)

    walk(json.loads(text), None)
    return out.rows


PARSERS = {"HTML": html_nodes, "PYTHON": python_nodes, "JSON": json_nodes}


def parse(artifacts: DataFrame, language: str) -> DataFrame:
    """Nodes of artifacts (path, content); what does not parse gives one row of type ERROR, whose text is the
    fault. Filter before this: Spark moves no filter below it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = PARSERS[language]
        for batch in batches:
            for path, text in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = read(path, text or "")
                except (SyntaxError, ValueError, RecursionError) as e:
                    out = _Rows(path)
                    out.open("ERROR", 1, 1, text=f"{type(e).__name__}: {e}")
                    out.close(1, 1)
                    rows = out.rows
                df = pd.DataFrame(rows, columns=COLUMNS)
                df["parent_id"] = df["parent_id"].astype("Int32")
                yield df

    return artifacts.select("path", "content").mapInPandas(run, NODES)


def exported(nodes: DataFrame) -> DataFrame:
    """The root and named nodes."""
    return nodes.where("is_named or parent_id is null")


def children(nodes: DataFrame) -> DataFrame:
    """(file_id, node_id, child_id, field_name, cst_type): named children."""
    return nodes.where("is_named and parent_id is not null").select("file_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id"), "field_name", "cst_type", "ordinal")


def parents(nodes: DataFrame) -> DataFrame:
    p = nodes.select("file_id", F.col("node_id").alias("parent_id"), F.col("cst_type").alias("parent_type"))
    return nodes.select("file_id", "node_id", "parent_id", "cst_type").join(p, ["file_id", "parent_id"])


def _down(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x.cast("long"), k)


def _blocks(low: Column, high: Column) -> Column:
    """The ids low to high as aligned blocks (k, at) of 2^k ids from at * 2^k on: each id in one of them, two of a size at most."""
    size = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    spans = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(k.alias("k"), _down(low.cast("long") + size(k) - 1, k).alias("lo"), _down(high.cast("long") + 1, k).alias("hi")))
    left = F.filter(spans, lambda p: (p["lo"] < p["hi"]) & (p["lo"] % 2 == 1))
    right = F.filter(spans, lambda p: (p["lo"] < p["hi"]) & (p["hi"] % 2 == 1))
    return F.concat(F.transform(left, lambda p: F.struct(p["k"].alias("k"), p["lo"].alias("at"))), F.transform(right, lambda p: F.struct(p["k"].alias("k"), (p["hi"] - 1).alias("at"))))


def within(nodes: DataFrame, own: Column | None = None, above: Column | None = None, self_too: bool = False) -> DataFrame:
    """(file_id, node_id, ancestor_id, distance, ancestor_type): pairs of a node and an ancestor; own and above narrow the
    two sides before the join, on columns of nodes.

    A subtree's ids are cut into aligned blocks and a node names the block of each size that holds it, so the join is on
    equal keys (file, size, block): no pair is made that is not in the result, and a large file is spread over tasks.
    """
    d = nodes if own is None else nodes.where(own)
    a = nodes if above is None else nodes.where(above)
    low = F.col("node_id") if self_too else F.col("node_id") + 1
    a = a.where(F.col("last_desc") >= low).select("file_id", F.col("node_id").alias("ancestor_id"), "last_desc", F.col("depth").alias("a_depth"), F.col("cst_type").alias("ancestor_type"))
    top = a.groupBy("file_id").agg((F.floor(F.log2(F.max(F.col("last_desc").cast("long") - F.col("ancestor_id") + 1))) + 1).cast("int").alias("top"))
    low = F.col("ancestor_id") if self_too else F.col("ancestor_id") + 1
    a = a.select("*", F.explode(_blocks(low, F.col("last_desc"))).alias("block")).select("file_id", F.col("block.k").alias("k"), F.col("block.at").alias("at"), "ancestor_id", "a_depth", "ancestor_type")
    d = d.select("file_id", "node_id", F.col("depth").alias("d_depth")).join(top, "file_id")
    d = d.select("file_id", "node_id", "d_depth", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("k")).withColumn("at", _down(F.col("node_id"), F.col("k")))
    return d.join(a, ["file_id", "k", "at"]).select("file_id", "node_id", "ancestor_id", (F.col("d_depth") - F.col("a_depth")).alias("distance"), "ancestor_type")


def find_ancestor(nodes: DataFrame, own: Column, above: Column, self_too: bool = False) -> DataFrame:
    """The nearest ancestor that meets `above`, for nodes that meet `own`."""
    return within(nodes, own, above, self_too).groupBy("file_id", "node_id").agg(F.min_by("ancestor_id", "distance").alias("ancestor_id"))


def find_descendant(nodes: DataFrame, own: Column, below: Column) -> DataFrame:
    """The first descendant in depth-first order that meets `below`, for nodes that meet `own`."""
    got = within(nodes, below, own)
    return got.select("file_id", F.col("ancestor_id").alias("top_id"), F.col("node_id").alias("low_id")).groupBy("file_id", F.col("top_id").alias("node_id")).agg(F.min("low_id").alias("descendant_id"))


@dataclass
class Pattern:
    """A node of a tree pattern: type (None: any named node), field of its parent, text it equals or matches, name under
    which it is captured, patterns of children."""

    cst_type: str | None = None
    field_name: str | None = None
    text: str | None = None
    matches: str | None = None
    capture: str | None = None
    children: list[Pattern] = field(default_factory=list)


def tree_matches(nodes: DataFrame, pattern: Pattern) -> DataFrame:
    """(file_id, one column of node ids for each capture): one row for each way that the pattern holds.

    A pattern node is a filtered scan of nodes, a child an equi-join on (file_id, parent). Children of one pattern node
    stand in the order given.
    """
    counter = iter(range(1 << 20))

    def scan(p: Pattern) -> tuple[DataFrame, str, str, list[str]]:
        i = next(counter)
        ok = F.col("is_named") if p.cst_type is None else F.col("cst_type") == p.cst_type
        if p.field_name is not None:
            ok = ok & (F.col("field_name") == p.field_name)
        if p.text is not None:
            ok = ok & (F.col("text") == p.text)
        if p.matches is not None:
            ok = ok & F.col("text").rlike(p.matches)
        me, up, at = f"n{i}", f"p{i}", f"o{i}"
        df = nodes.where(ok).select("file_id", F.col("node_id").alias(me), F.col("parent_id").alias(up), F.col("ordinal").alias(at))
        names = [p.capture] if p.capture else []
        if p.capture:
            df = df.withColumn(p.capture, F.col(me))
        last = None
        for c in p.children:
            sub, c_me, c_up, c_names = scan(c)
            c_at = f"o{c_me[1:]}"
            df = df.join(sub.withColumnRenamed("file_id", "c_file"), (F.col("file_id") == F.col("c_file")) & (F.col(me) == F.col(c_up))).drop("c_file")
            if last:
                df = df.where(F.col(c_at) > F.col(last))
            last = c_at
            names += c_names
        return df.select("file_id", me, up, at, *names), me, up, names

    df, _, _, names = scan(pattern)
    return df.select("file_id", *names)


def any_tree_matches(nodes: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Alternation: captures that a branch lacks are null."""
    out = None
    for p in patterns:
        got = tree_matches(nodes, p)
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    return out


def sibling_runs(nodes: DataFrame, cst_type: str) -> DataFrame:
    """Quantified siblings: each maximal run of adjacent named siblings of a type is one match (file_id, parent_id, run)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("file_id", "parent_id").orderBy("ordinal")
    named = nodes.where("is_named and parent_id is not null").withColumn("at", F.row_number().over(w))
    hit = named.where(F.col("cst_type") == cst_type).withColumn("island", F.col("at") - F.row_number().over(w))
    return hit.groupBy("file_id", "parent_id", "island").agg(F.array_sort(F.collect_list("node_id")).alias("run")).drop("island")


def captures(rows: DataFrame) -> DataFrame:
    """(match_id, capture, node_ids, node_id): nodes of one name in a match in order, and the last of them; rows: match_id,
    capture, node_id. Matches without captures have no rows and so start no rule."""
    got = rows.groupBy("match_id", "capture").agg(F.array_sort(F.collect_list("node_id")).alias("node_ids"))
    return got.withColumn("node_id", F.element_at("node_ids", -1))
