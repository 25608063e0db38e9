"""Data flow over edge tables: transposition, simple paths to leaves, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transposed(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def without_loops(edges: DataFrame) -> DataFrame:
    """Edges of a vertex to itself are never kept; parallel ones are."""
    return edges.where("src <> dst")


def simple_paths(edges: DataFrame, starts: DataFrame, steps: int = 2**31 - 1) -> DataFrame:
    """(graph_id, path): all simple paths of two vertices or more from each start (graph_id, vertex) to a leaf, a
    vertex without edges out. A path that could only go back into itself is dropped.

    Each step joins the open paths to the edges on (graph_id, vertex). Their number may grow exponentially, as the
    paths themselves do. A path meets no vertex twice, so the walk ends by itself; a
    lower `steps`, like Spark's own limit of rows (spark.sql.cteRecursionRowLimit), is an error rather than a cut when it is reached.
    """
    e = without_loops(edges).select("graph_id", "src", "dst").distinct()
    leaves = e.select("graph_id", F.col("dst").alias("vertex")).distinct().join(e.select("graph_id", F.col("src").alias("vertex")), ["graph_id", "vertex"], "left_anti")
    view = f"siftwork_flow_{uuid.uuid4().hex}"  # plans of one session share no names
    e.createOrReplaceTempView(f"{view}_edges")
    starts.select("graph_id", "vertex").distinct().createOrReplaceTempView(f"{view}_starts")
    leaves.createOrReplaceTempView(f"{view}_leaves")
    return edges.sparkSession.sql(f"""
        WITH RECURSIVE walk(graph_id, vertex, path) MAX RECURSION LEVEL {steps} AS (
          SELECT graph_id, vertex, array(vertex) FROM {view}_starts
          UNION ALL
          SELECT w.graph_id, e.dst, array_append(w.path, e.dst) FROM walk w JOIN {view}_edges e
          ON w.graph_id = e.graph_id AND w.vertex = e.src WHERE NOT array_contains(w.path, e.dst))
        SELECT w.graph_id, w.path FROM walk w LEFT SEMI JOIN {view}_leaves l ON w.graph_id = l.graph_id AND w.vertex = l.vertex WHERE size(w.path) > 1""")


def taint_sources(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Backward flow: edges lead from a use to what it depends on."""
    return simple_paths(edges, starts)


def taint_sinks(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Forward flow on the transposed graph."""
    return simple_paths(transposed(edges), starts)


def visible(paths: DataFrame, hidden: DataFrame) -> DataFrame:
    """Paths without the vertices of hidden (graph_id, vertex), as merge points; the order stays."""
    h = hidden.groupBy("graph_id").agg(F.collect_set("vertex").alias("gone"))
    out = paths.join(h, "graph_id", "left")
    return out.select("graph_id", F.filter("path", lambda v: ~F.array_contains(F.coalesce("gone", F.array().cast("array<bigint>")), v)).alias("path")).where("size(path) > 1")


def ends(paths: DataFrame) -> DataFrame:
    """First and last vertex of each path."""
    return paths.select("graph_id", F.element_at("path", 1).alias("sink"), F.element_at("path", -1).alias("source"), "path")
