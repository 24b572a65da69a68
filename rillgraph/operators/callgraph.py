"""The persisted call graph: reachability, blast radius, paths, indexes.

Nodes are (node, kind 0 function | 2 contract, fqn, repo, span_file, line); edges are
(src, dst, rel 0 calls | 2 binds to | 3 invokes remotely).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import Known, closure, stable

RELATIONS = (0, 2, 3)


def callees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(caller, callee, callee_fqn) of every call that has a loaded callee."""
    return edges.where("rel = 0").join(nodes.where("kind = 0").select(F.col("node").alias("dst"), F.col("fqn").alias("callee_fqn")), "dst").select(F.col("src").alias("caller"), F.col("dst").alias("callee"), "callee_fqn")


def callers(edges: DataFrame) -> DataFrame:
    """(callee, n_callers, n_remote): how many functions call or remotely invoke each."""
    return edges.where("rel in (0, 3)").groupBy(F.col("dst").alias("callee")).agg(F.count("*").alias("n_callers"), F.count_if(F.col("rel") == 3).alias("n_remote"))


def missing_contracts(edges: DataFrame) -> DataFrame:
    """Contracts that are invoked but bind to no handler."""
    bound = edges.where("rel = 2").select(F.col("src").alias("dst")).distinct()
    return edges.where("rel = 3").select("dst").distinct().join(bound, "dst", "left_anti").select(F.col("dst").alias("iid"))


def foreign_contracts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, iid, owner): contracts that a repository invokes and another one owns."""
    caller = nodes.select(F.col("node").alias("src"), "repo")
    owner = nodes.where("kind = 2").select(F.col("node").alias("dst"), F.col("repo").alias("owner"))
    return edges.where("rel = 3").join(caller, "src").join(owner, "dst").where("repo <> owner").select("repo", F.col("dst").alias("iid"), "owner").distinct()


def seeds_by_name(nodes: DataFrame, substring: str, repo: str | None = None) -> DataFrame:
    """Functions whose qualified name holds the substring, literally."""
    found = nodes.where((F.col("kind") == 0) & F.col("fqn").contains(substring))
    return found.where(F.col("repo") == repo) if repo is not None else found


def seeds_by_file(nodes: DataFrame, repo: str, files: list[str]) -> DataFrame:
    """Functions of a repository in any of the files; names are relative, spans may be absolute."""
    at = F.lit(False)
    for f in files:
        at = at | (F.col("span_file") == f) | F.col("span_file").endswith("/" + f)
    return nodes.where((F.col("kind") == 0) & (F.col("repo") == repo) & at)


def upstream(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node) of everything that reaches a seed, the seeds included."""
    back = edges.where(F.col("rel").isin(*RELATIONS)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(seeds.select("node"), back, [])


def repos_of(up: DataFrame, nodes: DataFrame) -> DataFrame:
    return up.join(nodes, "node").select("repo").distinct()


def endpoints_of(up: DataFrame, nodes: DataFrame) -> DataFrame:
    return up.join(nodes.where("kind = 2"), "node").select(F.col("fqn").alias("full_name")).distinct()


def paths(edges: DataFrame, nodes: DataFrame, source: str, target: str, limit: int = 5, max_depth: int = 30) -> DataFrame:
    """(path, length): the shortest simple forward paths between names that hold the substrings.

    A path stops at its first target. Equal lengths are ordered by the path itself. Raises
    LookupError if either substring matches no function or contract.
    """
    named = nodes.where("kind in (0, 2)")
    goal = named.where(F.col("fqn").contains(target)).select("node").distinct()
    start = named.where(F.col("fqn").contains(source)).select("node").distinct()
    for rows, flag in ((start, "from"), (goal, "to")):
        if rows.isEmpty():
            raise LookupError(f"{flag}: no function or contract has this in its name")
    step = stable(edges.where(F.col("rel").isin(*RELATIONS)).select(F.col("src").alias("node"), "dst").distinct())
    walk = stable(start.select("node", F.array("node").alias("path")))
    found = Known(edges.sparkSession, walk.select("path").schema)
    # Nodes from which a target is within reach; no walk goes on elsewhere.
    near = closure(goal, step.select(F.col("dst").alias("src"), F.col("node").alias("dst")), [])
    step = stable(step.join(near.select(F.col("node").alias("dst")), "dst", "left_semi").select("node", "dst"))
    for depth in range(1, max_depth + 1):
        hit = walk.join(goal, "node", "left_semi").select("path")
        found.add(hit)
        # A shorter path beats any longer one: enough of them end the search.
        if depth == max_depth or found.rows().limit(limit).count() >= limit:
            break
        on = walk.join(goal, "node", "left_anti").join(step, "node").where(~F.array_contains("path", F.col("dst")))
        walk = stable(on.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")))
        if walk.isEmpty():
            break
    return found.rows().select("path", F.size("path").cast("long").alias("length")).orderBy("length", "path").limit(limit)


def graph_dump(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): counts of functions, contracts, repositories and edges by relation."""
    a = nodes.groupBy(F.when(F.col("kind") == 0, "functions").otherwise("contracts").alias("what")).agg(F.count("*").alias("n"))
    b = nodes.agg(F.countDistinct("repo").alias("n")).select(F.lit("repos").alias("what"), "n")
    c = edges.groupBy(F.concat(F.lit("edges_"), F.col("rel").cast("string")).alias("what")).agg(F.count("*").alias("n"))
    return a.unionByName(b).unionByName(c)
