"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source, in an order shuffled by a digest of its id, gets a virtual finish time: the words its
source has offered up to its end, divided by the source's target. Documents sorted by that time interleave the sources
in proportion to their targets; the mix is the sorted sequence up to the total budget.

Scale: running sums never gather a source. Rows without their texts are range-sorted by source and digest; sums for each
(range, source), map-side combined, are summed over the ranges, and a window runs only inside one (range, source). The copies are
range-sorted by finish time in the same way: sums for each range find the range that the budget ends in, and only
that one is looked into. The number of ranges follows that of the rows, RANGE_ROWS in each at most.

Cases: null or empty text has size 0 and is never taken; a null source is one source, the last; documents that repeat
(equal ids and texts) are ordered by id, text digest and a running number, so each counts; without words nothing is
taken and targets are 0; clashing extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwork.llm.common import WORD, materialize

#: Weights of the sources in code-point order, repeating; null is last.
WEIGHTS = (3, 1, 2)
#: About the most rows of a range.
RANGE_ROWS = 1_000_000


def word_count(text: Column) -> Column:
    """Words of a text as the contracts have them; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """sizes (source, source_size): adds weight and target, by water-filling with one sort of the sources.

    A target is the lesser of most * source_size and level * weight; the level is fixed by the sources that stay below
    their cap, which are those with the largest most * size / weight.
    """
    # one row for each source, after aggregation
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")))
    total = ranked.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weights"))
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.crossJoin(F.broadcast(total)).withColumns({  # one row beside each source
        "before_size": F.coalesce(F.sum("source_size").over(full), F.lit(0)), "before_weight": F.coalesce(F.sum("weight").over(full), F.lit(0)),
    }).withColumn("level", (F.lit(share) * F.col("all_words") - F.lit(most) * F.col("before_size")) / (F.col("all_weights") - F.col("before_weight")))
    # the first source in this order that the level does not fill sets the level
    chosen = level.where(F.col("level") * F.col("weight") <= F.lit(most) * F.col("source_size")).agg(F.min_by("level", F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")).alias("level"))
    cap = (F.lit(most) * F.col("source_size")).cast("double")
    return ranked.crossJoin(F.broadcast(chosen)).select("source", "source_size", "weight", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target"))


def ranged(rows: DataFrame, *keys: str) -> DataFrame:
    """rows sorted into ranges of keys, with the number of its range in column part; equal keys are in one range."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    return materialize(rows.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id()))


def mix(docs: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, t, source, size, source_size, target, copies, taken) for every row of docs; t is a digest of its text.

    A source whose target passes its size offers its documents again, in the same order, up to `most` times.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("h"), F.md5(F.coalesce("text", F.lit(""))).alias("t"))
    rows = ranged(materialize(rows), "source", "h", "doc_id", "t")  # the texts are read once, before
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    plan = targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), share, most)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range that a source has rows in
    bases = sums.withColumn("base", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    bases = bases.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select("s.source", "part", "base", "p.source_size", "p.target")
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id", "t").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).alias("r").join(bases.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.part") == F.col("b.part")))
    placed = placed.select("doc_id", "r.source", "size", "source_size", "target", "h", "t", (F.col("base") + F.col("upto")).alias("upto"))
    # the finish of each copy, and the words that it adds when it is within the budget
    offers = placed.withColumn("finish", F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.when(F.col("target") > 0, (F.col("upto") + k * F.col("source_size")) / F.col("target"))))
    offers = materialize(offers)
    copies = ranged(offers.where("size > 0").select("size", F.explode("finish").alias("finish")), "finish")
    sums = copies.groupBy("part").agg(F.sum("size").alias("words"), F.max("finish").alias("top"))  # one row for each range
    run = sums.withColumn("upto", F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("budget", F.lit(share) * F.sum("words").over(Window.partitionBy()) / F.lit(most))
    full = run.where("upto <= budget").agg(F.max("top").alias("top"))
    cut = run.where("upto > budget").agg(F.min("part").alias("cut"), F.min_by(F.col("budget") - (F.col("upto") - F.col("words")), "part").alias("left"))
    edge = copies.join(F.broadcast(cut), copies["part"] == cut["cut"]).groupBy("finish", "left").agg(F.sum("size").alias("words"))
    edge = edge.withColumn("upto", F.sum("words").over(Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, 0))).where("upto <= left").agg(F.max("finish").alias("edge"))
    last = full.crossJoin(edge).select(F.coalesce("edge", "top").alias("last"))  # one row: times in the edge are later than any in full ranges
    mixed = offers.crossJoin(F.broadcast(last))
    within = lambda f: F.coalesce(f <= F.col("last"), F.lit(False))
    n = F.when((F.col("size") > 0) & (F.col("target") > 0), F.size(F.filter("finish", within))).otherwise(0)
    return mixed.select("doc_id", "t", "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of the mix, each as often as it is taken. Rows that repeat id and text are taken equally often."""
    plan = mix(docs, share, most).where("copies > 0").groupBy("doc_id", "t").agg(F.max("copies").alias("copies"))
    plan = plan.select(F.col("doc_id").alias("mix_id"), F.col("t").alias("mix_text"), F.sequence(F.lit(1), F.col("copies")).alias("mix_copies"))
    on = F.col("doc_id").eqNullSafe(F.col("mix_id")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("mix_text"))
    return docs.join(plan, on).withColumn("mix_copy", F.explode("mix_copies")).select(*docs.columns)
