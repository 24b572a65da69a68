"""Call-graph queries over the adapter of customers, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import callgraph as cg
from ..plans.fixpoint import strongly_connected
from ..sources.adapters import relation, with_sql

FILES = ["economy/p1.go", "src/small/p5.go"]
REPO = "Brand#17"
SEED = ".P1"  # a part of every table


def _graph(spark, sf_dir):
    return relation(spark, sf_dir, "cg_nodes"), relation(spark, sf_dir, "cg_edges")


def cg_nodes(spark, sf_dir):
    return relation(spark, sf_dir, "cg_nodes")


def cg_edges(spark, sf_dir):
    return relation(spark, sf_dir, "cg_edges")


def cg_invokes(spark, sf_dir):
    return relation(spark, sf_dir, "cg_invokes")


def cg_endpoints(spark, sf_dir):
    """Contracts with their bound function, if any, and its name."""
    nodes, edges = _graph(spark, sf_dir)
    bound = edges.where("rel = 2").join(nodes.where("kind = 0").select(F.col("node").alias("dst"), F.col("fqn").alias("handler_fqn")), "dst")
    bound = bound.select(F.col("src").alias("node"), F.col("dst").alias("handler"), "handler_fqn")
    out = nodes.where("kind = 2").join(bound, "node", "left")
    return out.select(F.col("node").alias("iid"), "fqn", F.coalesce("handler", F.lit("")).alias("handler"), F.coalesce("handler_fqn", F.lit("")).alias("handler_fqn"))


def cg_callees(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return cg.callees(edges, nodes)


def cg_callers(spark, sf_dir):
    return cg.callers(_graph(spark, sf_dir)[1])


def cg_missing_contracts(spark, sf_dir):
    return cg.missing_contracts(_graph(spark, sf_dir)[1])


def cg_foreign_contracts(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return cg.foreign_contracts(edges, nodes)


def cg_reach(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return cg.upstream(edges, cg.seeds_by_name(nodes, SEED)).join(nodes, "node").select("node", "fqn", "repo")


def cg_blast_repos(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return cg.repos_of(cg.upstream(edges, cg.seeds_by_file(nodes, REPO, FILES)), nodes)


def cg_blast_endpoints(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return cg.endpoints_of(cg.upstream(edges, cg.seeds_by_file(nodes, REPO, FILES)), nodes)


def cg_paths(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    out = cg.paths(edges, nodes, "part.red.widget", "cust.BUILDING", limit=20)
    return out.select(F.array_join("path", ">").alias("path"), "length")


def cg_scc(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return strongly_connected(nodes.select("node"), edges.select("src", "dst"))


def graph_dump(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return cg.graph_dump(nodes, edges)


_UP = """WITH RECURSIVE up(node) AS (
  SELECT node FROM cg_nodes WHERE kind = 0 AND {seed}
  UNION SELECT e.src FROM cg_edges e JOIN up ON e.dst = up.node)"""
_FILES = f"repo = '{REPO}' AND (" + " OR ".join(f"span_file = '{f}' OR ends_with(span_file, '/{f}')" for f in FILES) + ")"
_G = ["cg_nodes", "cg_edges"]
_F = (cg_nodes, cg_edges, cg_invokes, cg_endpoints, cg_callees, cg_callers, cg_missing_contracts, cg_foreign_contracts, cg_reach, cg_blast_repos, cg_blast_endpoints, cg_paths, cg_scc, graph_dump)
QUERIES = {f.__name__: f for f in _F}
ORACLE_SQL = {
    "cg_nodes": with_sql(["cg_nodes"], "SELECT * FROM cg_nodes"),
    "cg_edges": with_sql(["cg_edges"], "SELECT * FROM cg_edges"),
    "cg_invokes": with_sql(["cg_invokes"], "SELECT * FROM cg_invokes"),
    "cg_endpoints": with_sql(_G, "SELECT c.node AS iid, c.fqn, coalesce(e.dst, '') AS handler, coalesce(h.fqn, '') AS handler_fqn FROM cg_nodes c LEFT JOIN cg_edges e ON e.src = c.node AND e.rel = 2 LEFT JOIN cg_nodes h ON h.node = e.dst WHERE c.kind = 2"),
    "cg_callees": with_sql(_G, "SELECT e.src AS caller, e.dst AS callee, n.fqn AS callee_fqn FROM cg_edges e JOIN cg_nodes n ON n.node = e.dst WHERE e.rel = 0 AND n.kind = 0"),
    "cg_callers": with_sql(_G, "SELECT dst AS callee, count(*) AS n_callers, count(*) FILTER (WHERE rel = 3) AS n_remote FROM cg_edges WHERE rel IN (0, 3) GROUP BY dst"),
    "cg_missing_contracts": with_sql(_G, "SELECT DISTINCT dst AS iid FROM cg_edges WHERE rel = 3 AND dst NOT IN (SELECT src FROM cg_edges WHERE rel = 2)"),
    "cg_foreign_contracts": with_sql(_G, "SELECT DISTINCT a.repo, e.dst AS iid, b.repo AS owner FROM cg_edges e JOIN cg_nodes a ON a.node = e.src JOIN cg_nodes b ON b.node = e.dst AND b.kind = 2 WHERE e.rel = 3 AND a.repo <> b.repo"),
    "cg_reach": with_sql(_G, _UP.format(seed=f"contains(fqn, '{SEED}')") + " SELECT n.node, n.fqn, n.repo FROM up JOIN cg_nodes n ON n.node = up.node"),
    "cg_blast_repos": with_sql(_G, _UP.format(seed=_FILES) + " SELECT DISTINCT n.repo FROM up JOIN cg_nodes n ON n.node = up.node"),
    "cg_blast_endpoints": with_sql(_G, _UP.format(seed=_FILES) + " SELECT DISTINCT n.fqn AS full_name FROM up JOIN cg_nodes n ON n.node = up.node WHERE n.kind = 2"),
    "cg_paths": with_sql(_G, """WITH RECURSIVE walk(node, path) AS (
  SELECT node, [node] FROM cg_nodes WHERE contains(fqn, 'part.red.widget')
  UNION ALL
  SELECT e.dst, list_append(w.path, e.dst) FROM walk w JOIN cg_edges e ON e.src = w.node
  WHERE NOT list_contains(w.path, e.dst) AND len(w.path) < 4 AND NOT EXISTS (SELECT 1 FROM cg_nodes s WHERE s.node = w.node AND contains(s.fqn, 'cust.BUILDING')))
SELECT array_to_string(path, '>') AS path, CAST(len(path) AS BIGINT) AS length FROM walk w JOIN cg_nodes t ON t.node = w.node WHERE contains(t.fqn, 'cust.BUILDING') ORDER BY len(path), w.path LIMIT 20"""),
    "graph_dump": with_sql(_G, """SELECT CASE WHEN kind = 0 THEN 'functions' ELSE 'contracts' END AS what, count(*) AS n FROM cg_nodes GROUP BY 1
UNION ALL SELECT 'repos', count(DISTINCT repo) FROM cg_nodes UNION ALL SELECT 'edges_' || rel, count(*) FROM cg_edges GROUP BY rel"""),
}
