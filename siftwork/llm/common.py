"""What the operators share: tables in the shared folder, connected components, byte-bounded slices."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as every contract of this package has it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset (tests), under a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='siftwork-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/siftwork-{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: df written once to the shared folder, which outlives executors, and read again."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives memory that nothing uses back to the system, which an executor's limit counts."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """make() once for the tasks of one operator (key[0]) that a Python worker serves one after the other.

    A worker outlives an operator: what another one left goes, so dictionaries of several never stand side by side.
    """
    store = sys.modules.setdefault("_siftwork_kept", types.ModuleType("_siftwork_kept")).__dict__
    if key not in store:
        others = [k for k in store if isinstance(k, tuple) and k[0] != key[0]]
        for k in others:
            del store[k]
        if others:
            gc.collect()
            release()
        store[key] = make()
    return store[key]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of long texts by fewer rows than Spark's default, for Python workers of a few hundred MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches whose column holds about `most` bytes (one row may hold more); memory goes back at the end."""
    for batch in batches:
        sizes = batch.column(column).cast(pa.large_binary()) if batch.num_rows else None
        begin = total = 0
        for i in range(batch.num_rows):
            n = len(sizes[i].as_buffer()) if sizes[i].is_valid else 0
            if total and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n + 16
        if begin < batch.num_rows:
            yield batch.slice(begin)
        del sizes, batch
    release()


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(id, component): the least id that links reach, for every id on an edge between different ids.

    Alternating large-star and small-star steps; every step is a grouped minimum with map-side combine and a
    join on the id, so no component is gathered anywhere. Ends when the edges are stars.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = materialize(small.where("u <> v").distinct())
        # stars: every u has one v, and no v is a u
        many = small.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        if many and small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            return small.select(F.col("u").alias("id"), F.col("v").alias("component"))
        e = small
