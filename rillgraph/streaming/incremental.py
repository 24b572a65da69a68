"""Incremental runs: packages that arrive in a folder, judged against the keys of the store."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash_parts
from ..operators import store
from ..sources.cgf import SCHEMAS, decode, rows_of


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (kind, body) rows of the packages that come into the folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pb").load(folder).select("path", "content")

    def decoded(batches):
        for batch in batches:
            rows = [r for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in rows_of(decode(content), path)]
            yield pa.record_batch([pa.array([k for k, _ in rows], pa.string()), pa.array([json.dumps(r) for _, r in rows], pa.string())], names=["kind", "body"])

    return files.mapInArrow(decoded, "kind string, body string")


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Starts a query that appends (iid, key, batch) of functions whose content the store at `out` lacks.

    Each micro-batch is one append keyed by content, so a batch that is run again adds nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        own = batch.where("kind = 'function'").select(F.from_json("body", SCHEMAS["function"]).alias("f")).select("f.iid", hash_parts(F.col("f.iid"), F.col("f.bid"), F.col("f.copy")).alias("key"))
        store.save(own.distinct(), out, "arrivals")

    return arrivals(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
