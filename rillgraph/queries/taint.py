"""Taint queries over the adapter of event flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import route_id, slot_text
from ..operators import persist, store
from ..operators import policy as po
from ..plans import backward
from ..plans import chains as ch
from ..plans.taint import Options, Program, analyse, dirty, static_facts, viewed_flows
from ..sources.adapters import relation, with_sql
from .heap import _hash

RULES = [("sources", 0, "signup", "src.Signup", None, "return"), ("sinks", 0, "purchase", "db.Purchase", None, "any"), ("sanitizers", 0, "clean", "san.Clean", None, "any")]


def program(spark, sf_dir, remote: bool = False) -> Program:
    """The event flows; remote: every other click goes through a gRPC contract of the user called."""
    none = F.array().cast("array<int>")
    function = relation(spark, sf_dir, "flow_functions").select("iid", "fqn", "repo", F.lit(True).alias("has_flow"), none.alias("source_params"))
    v = relation(spark, sf_dir, "flow_vertices")
    empty = F.lit("")
    vertex = v.select("fn", "vid", "kind", F.lit(0).alias("idx"), none.alias("path"), "cs", empty.alias("sym"), empty.alias("sym_name"), empty.alias("iface_type"), empty.alias("type"), F.array().cast("array<string>").alias("field_names"))
    calls = relation(spark, sf_dir, "flow_calls")
    one = F.lit(1).cast("bigint")
    callsite = calls.select("fn", "cs", F.lit(0).alias("kind"), "callee_fqn", one.alias("argc"), one.alias("resultc"), F.lit(False).alias("recv"), "dispatch_confidence", F.lit(0).alias("stream_op"), F.lit(False).alias("stream_client"), F.lit(0).cast("bigint").alias("error_results"))
    t = relation(spark, sf_dir, "flow_targets")
    target = t.select(F.concat(F.lit("U"), "user_id").alias("fn"), F.col("cs").cast("int").alias("cs"), F.concat(F.lit("U"), "target").alias("callee"))
    edge = relation(spark, sf_dir, "flow_edges")
    if not remote:
        return Program(function, vertex, edge, callsite, target)
    t = relation(spark, sf_dir, "flow_remote").select(F.concat(F.lit("U"), "user_id").alias("fn"), F.col("cs").cast("int").alias("cs"), F.concat(F.when(F.col("remote"), "K").otherwise("U"), "target").alias("callee"), "remote")
    callsite = callsite.drop("kind").join(t.select("fn", "cs", "remote"), ["fn", "cs"], "left").withColumn("kind", F.when(F.col("remote"), 2).otherwise(0)).drop("remote")
    shape = F.lit(False)
    contract = relation(spark, sf_dir, "flow_contracts").select("iid", "handler", F.lit(0).alias("kind"), shape.alias("client_streaming"), shape.alias("server_streaming"), none.alias("gql_param_idx"), none.alias("request_params"), "full_name", "repo")
    return Program(function, vertex, edge, callsite, t.drop("remote"), contract)


def _rules(spark):
    return spark.createDataFrame(RULES, po.SCHEMA)


def _result(spark, sf_dir, **options):
    p = program(spark, sf_dir)
    return p, analyse(p, _rules(spark), Options(**options))


def leaf_sites(spark, sf_dir):
    return static_facts(program(spark, sf_dir), _rules(spark), Options(), False).leaf_sites.select("fn", F.col("cs").cast("long").alias("cs"))


def static_edges(spark, sf_dir):
    e = static_facts(program(spark, sf_dir), _rules(spark), Options(), False).edges
    return e.select("fn", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "call")


def facts_ports(spark, sf_dir):
    i = static_facts(program(spark, sf_dir), _rules(spark), Options(), False).inputs
    return i.select("fn", F.col("vid").cast("long").alias("vid"), F.col("cs").cast("long").alias("cs"), "callee", "slot")


def facts_seeds(spark, sf_dir):
    s = static_facts(program(spark, sf_dir), _rules(spark), Options(), False).seeds
    return s.select("fn", "seed", F.col("vid").cast("long").alias("vid"))


def summary_flows(spark, sf_dir):
    f = _result(spark, sf_dir)[1].flows
    return f.select("fn", slot_text(F.col("in_slot"), F.col("in_path")).alias("in_slot"), slot_text(F.col("out_slot"), F.col("out_path")).alias("out_slot"))


def summary_sinks(spark, sf_dir):
    h = _result(spark, sf_dir)[1].hits
    return h.select("fn", "in_slot", "class", F.col("cs").cast("long").alias("cs"), "term_fn", F.col("term_cs").cast("long").alias("term_cs"))


def chains(spark, sf_dir):
    p, r = _result(spark, sf_dir)
    return ch.chains(r, p).select("repo", "fn", "class", F.col("cs").cast("long").alias("cs"), "term_fn", F.col("term_cs").cast("long").alias("term_cs"))


def chain_by_class(spark, sf_dir):
    p, r = _result(spark, sf_dir)
    return ch.by_class(ch.chains(r, p))


def routes(spark, sf_dir):
    p, r = _result(spark, sf_dir)
    return ch.routes(r, p).withColumn("hops", F.array_join("hops", ">"))


def views_merged(spark, sf_dir):
    """Flows of two contracts, each bound by all functions of a repository, seen through the contract's shape."""
    p, r = _result(spark, sf_dir)
    shape = p.function.where("repo in ('r1', 'r2')").select(F.concat(F.lit("K"), "repo").alias("iid"), F.col("iid").alias("handler"), F.when(F.col("repo") == "r1", 1).otherwise(2).alias("kind"), F.lit(False).alias("client_streaming"), F.lit(False).alias("server_streaming"), F.array(F.lit(3), F.lit(0)).alias("gql_param_idx"), F.array(F.lit(0)).alias("request_params"))
    return viewed_flows(r.flows, shape).select("fn", "in_slot", "out_slot")


def _remote(spark, sf_dir):
    p = program(spark, sf_dir, remote=True)
    return p, analyse(p, _rules(spark), Options())


def chains_remote(spark, sf_dir):
    """The chains of the program whose calls go through contracts: those of the direct one."""
    p, r = _remote(spark, sf_dir)
    return ch.chains(r, p).select("repo", "fn", "class", F.col("cs").cast("long").alias("cs"), "term_fn", F.col("term_cs").cast("long").alias("term_cs"))


def flows_remote(spark, sf_dir):
    f = _remote(spark, sf_dir)[1].flows
    return f.select("fn", slot_text(F.col("in_slot"), F.col("in_path")).alias("in_slot"), slot_text(F.col("out_slot"), F.col("out_path")).alias("out_slot"))


def persist_nodes(spark, sf_dir):
    return persist.graph(program(spark, sf_dir, remote=True))[0].select("node", F.col("kind").cast("long").alias("kind"), "fqn", "repo")


def persist_edges(spark, sf_dir):
    return persist.graph(program(spark, sf_dir, remote=True))[1].select("src", "dst", F.col("rel").cast("long").alias("rel"), "repo")


def persist_invokes(spark, sf_dir):
    return persist.invokes(*persist.graph(program(spark, sf_dir, remote=True))).select("iid", "repo", "fn")


def persist_endpoints(spark, sf_dir):
    p = program(spark, sf_dir, remote=True)
    return persist.endpoints(relation(spark, sf_dir, "flow_endpoints"), p.contract, p.function)


def summary_keys(spark, sf_dir):
    """The key of each function's summary: its own body and parameters and what its callees do."""
    p, r = _result(spark, sf_dir)
    functions = p.function.select("iid", F.col("fqn").alias("bid"), "source_params")
    return store.keys(functions, p.target.select(F.col("fn").alias("iid"), "callee"), store.behaviour(store.lines_of(r.flows, r.hits)))


def dirty_functions(spark, sf_dir):
    """The changed functions and all that reach one of them by calls and contracts."""
    changed = relation(spark, sf_dir, "flow_changed").select("iid")
    return dirty(program(spark, sf_dir, remote=True), changed).select("iid")


def impact_chains(spark, sf_dir):
    """Chains that start or end in a changed function."""
    found = chains(spark, sf_dir)
    return store.impact(found, relation(spark, sf_dir, "flow_changed")).select(*found.columns, "via_change")


def backward_verdicts(spark, sf_dir):
    p, r = _result(spark, sf_dir)
    out = backward.confirm(ch.chains(r, p), r, p)
    return out.select("fn", F.col("cs").cast("long").alias("cs"), "term_fn", F.col("term_cs").cast("long").alias("term_cs"), "verdict")


def backward_stats(spark, sf_dir):
    p, r = _result(spark, sf_dir)
    return backward.stats(backward.confirm(ch.chains(r, p), r, p)).select("verdict", "n")


def route_ids(spark, sf_dir):
    """The name and the fingerprint of each user's whole route."""
    hops = relation(spark, sf_dir, "flow_hops").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("cs", "repo", "func", "callee", "line", "kind"))).alias("hops"))
    return hops.select("user_id", route_id(F.col("hops"), F.lit("purchase")).alias("route"), route_id(F.col("hops"), F.lit("purchase"), with_line=False).alias("fingerprint"))


_T = ["flow_sites", "flow_targets", "flow_functions"]
# A call goes to the user before. x: a user's parameter is cut off by an error, or by a click whose target's is; so it is along a run
# of users that click, from the first error on.
_B = """WITH RECURSIVE t AS (SELECT s.*, g.target FROM flow_sites s LEFT JOIN flow_targets g ON g.user_id = s.user_id AND g.cs = s.cs),
u AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS e, max(CASE WHEN target IS NOT NULL THEN 1 ELSE 0 END) AS c FROM t GROUP BY user_id),
g AS (SELECT *, sum(1 - c) OVER (ORDER BY user_id) AS run FROM u),
x AS (SELECT user_id, max(e) OVER (PARTITION BY run ORDER BY user_id) = 1 AS cut FROM g),
b AS (SELECT t.user_id, min(n_sites) AS n, coalesce(min(CASE WHEN event_type = 'error' OR x.cut THEN cs END), min(n_sites)) AS b FROM t LEFT JOIN x ON x.user_id = t.target GROUP BY t.user_id),
k AS (SELECT t.*, event_type = 'error' OR coalesce(x.cut, false) AS blocked FROM t LEFT JOIN x ON x.user_id = t.target),
w AS (SELECT *, coalesce(max(CASE WHEN blocked THEN cs END) OVER p, -1) AS last_block, coalesce(max(CASE WHEN event_type = 'signup' THEN cs END) OVER p, -2) AS last_seed
  FROM k WINDOW p AS (PARTITION BY user_id ORDER BY cs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT w.*, w.cs <= b.b AS by_param, last_seed > last_block AS by_source FROM w JOIN b ON b.user_id = w.user_id)"""
_H = _B + """,
h AS (SELECT user_id, cs, user_id AS term, cs AS term_cs FROM a WHERE by_param AND event_type = 'purchase'
  UNION SELECT a.user_id, a.cs, h.term, h.term_cs FROM a JOIN h ON h.user_id = a.target WHERE a.by_param),
s AS (SELECT user_id, cs, user_id AS term, cs AS term_cs FROM a WHERE by_source AND event_type = 'purchase'
  UNION SELECT a.user_id, a.cs, h.term, h.term_cs FROM a JOIN h ON h.user_id = a.target WHERE a.by_source)"""
_FLOWS = _B + """,
f AS (SELECT 'U' || user_id AS fn, 'param_0' AS in_slot, 'return_0' AS out_slot FROM b WHERE b = n
  UNION ALL SELECT 'U' || user_id, 'source', 'return_0' FROM k GROUP BY user_id HAVING max(CASE WHEN event_type = 'signup' THEN cs ELSE -2 END) > max(CASE WHEN blocked THEN cs ELSE -1 END))"""
_STATIC = ["flow_sites", "flow_targets", "flow_vertices", "flow_edges", "flow_calls"]


def _route_sql() -> str:
    little = lambda n, w: f"array_to_string(list_reverse(regexp_extract_all(lpad(to_hex({n}), {2 * w}, '0'), '..')), '')"
    sized = lambda x: f"{little(f'strlen({x})', 8)} || hex(CAST({x} AS BLOB))"
    named = f"{sized('repo')} || {sized('func')} || {sized('callee')}"
    line = f"{little('4', 8)} || {little('line', 4)}"
    digest = lambda parts: f"substr(sha256(unhex({sized(chr(39) + 'purchase' + chr(39))} || string_agg({parts}, '' ORDER BY cs))), 1, 12)"
    return f"SELECT user_id, {digest(f'{named} || {line} || ' + sized('kind'))} AS route, {digest(f'{named} || ' + sized('kind'))} AS fingerprint FROM flow_hops GROUP BY user_id"


_F = (leaf_sites, static_edges, facts_ports, facts_seeds, summary_flows, summary_sinks, chains, chain_by_class, routes, views_merged, chains_remote, flows_remote, persist_nodes, persist_edges, persist_invokes, persist_endpoints, summary_keys, dirty_functions, impact_chains, backward_verdicts, backward_stats, route_ids)
QUERIES = {f.__name__: f for f in _F}
_R = ["flow_remote", "flow_contracts", "flow_functions"]
ORACLE_SQL = {
    "flows_remote": with_sql(_T, _FLOWS + " SELECT * FROM f UNION ALL SELECT 'K' || substr(fn, 2), in_slot, out_slot FROM f"),
    "persist_nodes": with_sql(_R, "SELECT iid AS node, CAST(0 AS BIGINT) AS kind, fqn, repo FROM flow_functions UNION ALL SELECT iid, CAST(2 AS BIGINT), full_name, repo FROM flow_contracts"),
    "persist_edges": with_sql(_R, "SELECT DISTINCT 'U' || user_id AS src, CASE WHEN remote THEN 'K' ELSE 'U' END || target AS dst, CAST(CASE WHEN remote THEN 3 ELSE 0 END AS BIGINT) AS rel, 'r' || (user_id % 5) AS repo FROM flow_remote UNION ALL SELECT iid, handler, CAST(2 AS BIGINT), repo FROM flow_contracts"),
    "persist_invokes": with_sql(_R, "SELECT DISTINCT 'K' || target AS iid, 'r' || (user_id % 5) AS repo, 'U' || user_id AS fn FROM flow_remote WHERE remote"),
    "persist_endpoints": with_sql(["flow_endpoints", "flow_contracts", "flow_functions"], "SELECT e.repo, e.iid, min(name) AS name, coalesce(min(f.iid), '') AS handler, coalesce(min(f.fqn), '') AS handler_fqn FROM flow_endpoints e LEFT JOIN flow_contracts c ON c.iid = e.iid LEFT JOIN flow_functions f ON f.iid = c.handler AND f.repo = e.repo GROUP BY e.repo, e.iid"),
    "dirty_functions": with_sql(["flow_remote", "flow_changed", "flow_contracts"], "WITH RECURSIVE d(iid) AS (SELECT iid FROM flow_changed UNION SELECT 'U' || r.user_id FROM d JOIN flow_remote r ON d.iid = 'U' || r.target) SELECT iid FROM d UNION SELECT 'K' || substr(iid, 2) FROM d"),
    "summary_keys": with_sql(_T, _H + _FLOWS[len(_B):] + f""",
l AS (SELECT fn, 'F:' || in_slot || '->' || out_slot AS line FROM f UNION SELECT 'U' || user_id, 'S:param_0:purchase:U' || term || ':' || term_cs FROM h UNION SELECT 'U' || user_id, 'S:source:purchase:U' || term || ':' || term_cs FROM s),
y AS (SELECT fn, {_hash("p")} AS y FROM (SELECT fn, string_agg(line, chr(10) ORDER BY line) AS p FROM l GROUP BY fn)),
z AS (SELECT user_id, string_agg('64:' || y, '' ORDER BY y) AS z FROM (SELECT DISTINCT t.user_id, y.y FROM flow_targets t JOIN y ON y.fn = 'U' || t.target) GROUP BY user_id)
SELECT iid, {_hash("iid", "fqn", "''", "coalesce(z, '')")} AS key FROM flow_functions LEFT JOIN z ON iid = 'U' || user_id"""),
    "leaf_sites": with_sql(_STATIC, "SELECT 'U' || s.user_id AS fn, CAST(s.cs AS BIGINT) AS cs FROM flow_sites s LEFT JOIN flow_targets t ON t.user_id = s.user_id AND t.cs = s.cs WHERE t.target IS NULL"),
    "static_edges": with_sql(_STATIC, "SELECT fn, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, false AS call FROM flow_edges UNION ALL SELECT 'U' || s.user_id, CAST(2 + 2 * s.cs AS BIGINT), CAST(3 + 2 * s.cs AS BIGINT), true FROM flow_sites s LEFT JOIN flow_targets t ON t.user_id = s.user_id AND t.cs = s.cs WHERE t.target IS NULL AND event_type <> 'error'"),
    "facts_ports": with_sql(_STATIC, "SELECT 'U' || user_id AS fn, CAST(2 + 2 * cs AS BIGINT) AS vid, CAST(cs AS BIGINT) AS cs, 'U' || target AS callee, 'param_0' AS slot FROM flow_targets"),
    "facts_seeds": with_sql(_STATIC, "SELECT DISTINCT 'U' || user_id AS fn, 'param_0' AS seed, CAST(0 AS BIGINT) AS vid FROM events UNION ALL SELECT 'U' || user_id, 'source', CAST(3 + 2 * cs AS BIGINT) FROM flow_sites WHERE event_type = 'signup'"),
    "summary_flows": with_sql(_T, _FLOWS + " SELECT * FROM f"),
    "summary_sinks": with_sql(_T, _H + " SELECT 'U' || user_id AS fn, 'param_0' AS in_slot, 'purchase' AS class, CAST(cs AS BIGINT) AS cs, 'U' || term AS term_fn, CAST(term_cs AS BIGINT) AS term_cs FROM h UNION ALL SELECT 'U' || user_id, 'source', 'purchase', CAST(cs AS BIGINT), 'U' || term, CAST(term_cs AS BIGINT) FROM s"),
    "chains": with_sql(_T, _H + " SELECT repo, iid AS fn, 'purchase' AS class, CAST(cs AS BIGINT) AS cs, 'U' || term AS term_fn, CAST(term_cs AS BIGINT) AS term_cs FROM s JOIN flow_functions ON iid = 'U' || user_id"),
    "impact_chains": with_sql([*_T, "flow_changed"], _H + ", c AS (SELECT repo, f.iid AS fn, 'purchase' AS class, CAST(cs AS BIGINT) AS cs, 'U' || term AS term_fn, CAST(term_cs AS BIGINT) AS term_cs FROM s JOIN flow_functions f ON f.iid = 'U' || user_id), d AS (SELECT c.*, fn IN (SELECT iid FROM flow_changed) AS x, term_fn IN (SELECT iid FROM flow_changed) AS y FROM c) SELECT repo, fn, class, cs, term_fn, term_cs, CASE WHEN x AND y THEN 'both' WHEN x THEN 'source' ELSE 'sink' END AS via_change FROM d WHERE x OR y"),
    # No function of this adapter tells fields apart, so the walk back confirms every chain.
    "backward_verdicts": with_sql(_T, _H + " SELECT 'U' || user_id AS fn, CAST(cs AS BIGINT) AS cs, 'U' || term AS term_fn, CAST(term_cs AS BIGINT) AS term_cs, 'confirmed' AS verdict FROM s"),
    "backward_stats": with_sql(_T, _H + " SELECT 'confirmed' AS verdict, count(*) AS n FROM s"),
    "route_ids": with_sql(["flow_hops"], _route_sql()),
    "chain_by_class": with_sql(_T, _H + " SELECT 'purchase' AS class, count(*) AS n FROM s"),
    "views_merged": with_sql(_T, _FLOWS + " SELECT DISTINCT 'Kr1' AS fn, CASE in_slot WHEN 'param_0' THEN 'param_1' ELSE in_slot END AS in_slot, out_slot FROM f JOIN flow_functions ON iid = fn WHERE repo = 'r1'"),
}
ORACLE_SQL["chains_remote"] = ORACLE_SQL["chains"]  # contracts change the way, not the findings
