"""The call graph as tables that survive a run: nodes and edges by repository, contracts shared by all.

A run replaces what it says of its own repositories and leaves the others' rows alone;
a contract keeps its first owner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.taint import Program


def graph(program: Program) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a program; edges carry the repository of their first end."""
    fn = program.function
    span = F.col("span.file") if "span" in fn.columns else F.lit("")
    line = F.col("span.line").cast("long") if "span" in fn.columns else F.lit(0).cast("long")
    nodes = fn.select(F.col("iid").alias("node"), F.lit(0).alias("kind"), "fqn", "repo", F.coalesce(span, F.lit("")).alias("span_file"), F.coalesce(line, F.lit(0)).alias("line"))
    repo = fn.select(F.col("iid").alias("src"), "repo")
    known = fn.select(F.col("iid").alias("callee"))
    calls = program.target.join(known, "callee", "left_semi").select(F.col("fn").alias("src"), F.col("callee").alias("dst"), F.lit(0).alias("rel"))
    remote = program.callsite.where("kind = 2").select("fn", "cs").join(program.target, ["fn", "cs"]).select(F.col("fn").alias("src"), F.col("callee").alias("dst"), F.lit(3).alias("rel"))
    edges = calls.join(remote.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(remote).distinct().join(repo, "src")
    if program.contract is not None:
        c = program.contract
        name = F.col("full_name") if "full_name" in c.columns else F.col("iid")
        owner = F.col("repo") if "repo" in c.columns else F.lit("")
        nodes = nodes.unionByName(c.select(F.col("iid").alias("node"), F.lit(2).alias("kind"), name.alias("fqn"), owner.alias("repo"), F.lit("").alias("span_file"), F.lit(0).cast("long").alias("line")).dropDuplicates(["node"]))
        edges = edges.unionByName(c.select(F.col("iid").alias("src"), F.col("handler").alias("dst"), F.lit(2).alias("rel"), owner.alias("repo")).distinct())
    return nodes, edges.select("src", "dst", "rel", "repo")


def invokes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(iid, repo, fn, file, line): which functions invoke each contract remotely, once each."""
    caller = nodes.where("kind = 0").select(F.col("node").alias("fn"), F.col("span_file").alias("file"), "line")
    remote = edges.where("rel = 3").select(F.col("dst").alias("iid"), "repo", F.col("src").alias("fn"))
    contract = nodes.where("kind = 2").select(F.col("node").alias("iid"))
    return remote.join(contract, "iid", "left_semi").join(caller, "fn").select("iid", "repo", "fn", "file", "line").distinct()


def endpoints(endpoint: DataFrame, contract: DataFrame, function: DataFrame) -> DataFrame:
    """(repo, iid, name, handler, handler_fqn): each repository's endpoint once, with the function of the same
    repository that its contract binds, the smallest of several; empty where there is none."""
    own = endpoint.groupBy("repo", "iid").agg(F.min("name").alias("name"))
    body = function.select(F.col("iid").alias("handler"), "repo", F.col("fqn").alias("handler_fqn"))
    bound = contract.select("iid", "handler").distinct().join(body, "handler").groupBy("repo", "iid").agg(F.min(F.struct("handler", "handler_fqn")).alias("_h"))
    empty = F.lit("")
    return own.join(bound, ["repo", "iid"], "left").select("repo", "iid", "name", F.coalesce("_h.handler", empty).alias("handler"), F.coalesce("_h.handler_fqn", empty).alias("handler_fqn"))


def save(program: Program, folder: str) -> None:
    """Replaces the rows of the program's repositories in the tables `nodes`, `edges` and `invokes` of the folder."""
    nodes, edges = graph(program)
    for name, df in (("nodes", nodes), ("edges", edges), ("invokes", invokes(nodes, edges))):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    schema = {"nodes": "node string, kind int, fqn string, span_file string, line long, repo string", "edges": "src string, dst string, rel int, repo string"}
    return tuple(spark.read.schema(schema[n]).parquet(f"{folder}/{n}") for n in ("nodes", "edges"))
