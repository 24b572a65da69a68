"""Abstract heap cells as relations: who writes, who reads with what assertion, what a write reaches.

writes(cell, fn, type), reads(cell, fn, assert_type, class; '' reads without a sink) and
copies(src, dst), cells whose content flows into another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import Known, stable


def sinks_of_cells(reads: DataFrame, copies: DataFrame, rounds: int = 1000) -> DataFrame:
    """(cell, class, reader, assert_type): the sinks that data in the cell reaches; an assertion is about the
    reader's own cell and falls away when data came through another."""
    found = reads.where("class <> ''").select("cell", "class", F.col("fn").alias("reader"), "assert_type").distinct()
    known = Known(reads.sparkSession, found.schema)
    new = known.add(found)
    back = stable(copies.select(F.col("dst").alias("cell"), "src").distinct())
    for _ in range(rounds):
        more = new.join(back, "cell").select(F.col("src").alias("cell"), "class", "reader", F.lit("").alias("assert_type")).distinct()
        new = known.add(more.join(known.rows(), more.columns, "left_anti"))
        if new.isEmpty():
            return known.rows()
    raise RuntimeError("cells did not settle")


def admits(assert_type, written):
    return (assert_type == "") | (written == "") | (assert_type == written)


def heap_hits(writes: DataFrame, sinks: DataFrame) -> DataFrame:
    """(fn, class, n): per writer and class how many distinct (cell, reader) its writes reach."""
    hit = writes.join(sinks, "cell").where(admits(F.col("assert_type"), F.col("type")))
    return hit.select("fn", "class", "cell", "reader").distinct().groupBy("fn", "class").agg(F.count("*").alias("n"))


def census(writes: DataFrame, reads: DataFrame, sinks: DataFrame) -> DataFrame:
    """(cell, writes, writer_fns, reader_fns, sinks, classes) of every cell that is written."""
    w = writes.groupBy("cell").agg(F.count("*").alias("writes"), F.countDistinct("fn").alias("writer_fns"))
    r = reads.groupBy("cell").agg(F.countDistinct("fn").alias("reader_fns"))
    s = sinks.groupBy("cell").agg(F.count("*").alias("sinks"), F.array_join(F.sort_array(F.collect_set("class")), ",").alias("classes"))
    out = w.join(r, "cell", "left").join(s, "cell", "left")
    return out.select("cell", "writes", "writer_fns", F.coalesce("reader_fns", F.lit(0)).alias("reader_fns"), F.coalesce("sinks", F.lit(0)).alias("sinks"), F.coalesce("classes", F.lit("")).alias("classes"))


def drops(writes: DataFrame, sinks: DataFrame) -> DataFrame:
    """(cell, dropped): write and sink pairs that the reader's type assertion rules out."""
    return writes.join(sinks, "cell").where(~admits(F.col("assert_type"), F.col("type"))).groupBy("cell").agg(F.count("*").alias("dropped"))
