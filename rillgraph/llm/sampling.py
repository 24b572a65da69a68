"""Bounded, deterministic samples of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str = "doc_id") -> F.Column:
    """The fold 0-3 of a document; fold 2 is held out from all learning."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` documents of each label 0 and 1, none of fold 2.

    Chosen by the smallest hashes of the ids. Rows with null ids or labels, or labels
    other than 0 and 1, teach nothing; an id that is labelled both ways teaches nothing.
    """
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(fold() != 2)
    one = one.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).where("y = _y").drop("_y")
    some = [one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
