"""Least fixpoints on DataFrames: stable storage, closures, components, strongly connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder for what must outlive an executor: the cluster's spark.checkpoint.dir.

    Only a local session that names none (a test) gets one of its own.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "rillgraph-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def stable(df: DataFrame) -> DataFrame:
    """df, computed once and kept where a lost executor takes nothing along.

    Spark deletes the files with the frame, if spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df as a table in the shared folder, and what deletes it: for large intermediate rows
    that nothing reads any more once later ones are stable."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), lambda: _delete(spark, path)


class Known:
    """Rows that only grow: each round's new ones are files of their own, so that a round writes
    what is new and no more. Every `compact` rounds the earlier files become one set, since
    listing them would be the work by then."""

    def __init__(self, spark: SparkSession, schema: StructType, compact: int = 64):
        self.spark, self.schema, self.compact = spark, schema, compact
        self.paths: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        path = f"{shared_folder(self.spark)}/known-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def add(self, new: DataFrame) -> DataFrame:
        """Adds the rows and returns them, stable until `compact` more rounds have passed."""
        if len(self.paths) >= 2 * self.compact:
            old, kept = self.paths[: self.compact], self.paths[self.compact :]
            most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.paths = [self._write(self.spark.read.schema(self.schema).parquet(*old).coalesce(most)), *kept]
            for path in old:
                _delete(self.spark, path)
        self.paths.append(self._write(new.select(*self.schema.names)))
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def closure(start: DataFrame, step: DataFrame, key: list[str], src: str = "src", dst: str = "dst", rounds: int = 10_000) -> DataFrame:
    """All (key..., node) that `start` reaches along step(src, dst), start included.

    Semi-naive: a round joins only what the round before found, drops what is known and
    writes what is new. If step has the key columns too, edges belong to their key.
    """
    columns = [*key, "node"]
    on = [k for k in key if k in step.columns]
    first = start.select(*columns).distinct()
    known = Known(start.sparkSession, first.schema)
    new = known.add(first)
    edges, drop = written(step.select(*on, F.col(src).alias("node"), F.col(dst).alias("_next")).distinct())
    for _ in range(rounds):
        found = new.join(edges, [*on, "node"]).select(*key, F.col("_next").alias("node")).distinct()
        new = known.add(found.join(known.rows(), columns, "left_anti"))
        if new.isEmpty():
            drop()
            return known.rows()
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 1000) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node it reaches.

    Alternating large-star and small-star rounds, each a min-aggregate and an equi-join,
    so a hub's neighbours are never gathered. Self-edges count as a node without links.
    Every round is kept in the shared folder until the next one stands, and compared with it.
    The number of rounds follows the logarithm of the longest path.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, drop = written(pairs)
    loops = now.where("u = v").groupBy("u").agg(F.min("v").alias("v"))
    loops, _ = written(loops)
    rest, drop_rest = written(now.where("u <> v"))
    drop()
    now, drop = rest, drop_rest
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == tuple(mark):
            break
        seen = tuple(mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, drop_large = written(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, drop_after = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        drop()
        drop_large()
        now, drop = after, drop_after
    else:
        raise RuntimeError(f"no fixpoint after {rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(tops).unionByName(loops.select(F.col("u").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def _spread_least(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels(node, part, label) after every node has taken the smallest label of those that
    reach it inside its part; edges(src, dst, part). Only improved labels are written each round."""
    labels = labels.select("node", "part", "label")
    known = Known(labels.sparkSession, labels.schema)
    changed = known.add(labels)
    while True:
        now = known.rows().groupBy("node", "part").agg(F.min("label").alias("label"))
        told = changed.join(edges, (changed.node == edges.src) & (changed.part == edges.part)).select(F.col("dst").alias("node"), "label").groupBy("node").agg(F.min("label").alias("offer"))
        changed = known.add(now.join(told, "node").where("offer < label").select("node", "part", F.col("offer").alias("label")))
        if changed.isEmpty():
            return known.rows().groupBy("node", "part").agg(F.min("label").alias("label"))


def strongly_connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, scc): scc is the smallest node of the strongly connected component.

    Forward-backward colouring: each node takes the smallest node that reaches it; the nodes
    of a colour that reach its namesake back are its component. The rest of each colour is
    coloured again, all at once, until none is left. Nodes without an edge in or out inside their
    part are components of their own and leave before each colouring.
    """
    left, drop_left = written(nodes.select("node", F.lit(0).cast("long").alias("part")).distinct())
    step, drop_step = written(edges.where("src <> dst").select("src", "dst").distinct())
    schema = left.select("node", F.col("node").alias("scc")).schema
    done = Known(nodes.sparkSession, schema)
    done.add(left.where("false").select("node", F.col("node").alias("scc")))
    for _ in range(10_000):
        if left.isEmpty():
            break
        a = left.select(F.col("node").alias("src"), "part")
        b = left.select(F.col("node").alias("dst"), F.col("part").alias("_p"))
        inside, drop_inside = written(step.join(a, "src").join(b, "dst").where("part = _p").select("src", "dst", "part"))
        cyclic = inside.select(F.col("src").alias("node")).intersect(inside.select(F.col("dst").alias("node")))
        rest, drop_rest = written(left.join(cyclic, "node", "left_semi"))
        done.add(left.join(rest.select("node"), "node", "left_anti").select("node", F.col("node").alias("scc")))
        if rest.isEmpty():
            break
        inside = inside.join(rest.select(F.col("node").alias("src")), "src", "left_semi").join(rest.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "part")
        colour, drop_colour = written(_spread_least(rest.select("node", "part", F.col("node").alias("label")), inside))
        ca = colour.select(F.col("node").alias("src"), F.col("label").alias("c"))
        cb = colour.select(F.col("node").alias("dst"), F.col("label").alias("_c"))
        back = inside.join(ca, "src").join(cb, "dst").where("c = _c").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("c").alias("key"))
        start = colour.where("node = label").select(F.col("label").alias("key"), "node")
        found = done.add(closure(start, back, ["key"]).select("node", F.col("key").alias("scc")))
        after, drop_after = written(colour.join(found.select("node"), "node", "left_anti").select("node", F.xxhash64("part", "label").alias("part")))
        for drop in (drop_left, drop_inside, drop_rest, drop_colour):
            drop()
        left, drop_left = after, drop_after
    drop_left()
    drop_step()
    return done.rows()
