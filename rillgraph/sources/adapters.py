"""Code-graph relations made of business tables, in SQL that Spark and DuckDB both read.

They stand in for extracted programs, so every operator can be run and checked on any
set of the tables region ... conversations, whole tables each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "conversations")

SQL: dict[str, str] = {
    # Call graph: customers call the parts they order, parts call suppliers' contracts, contracts of solvent suppliers bind customers.
    "cg_nodes": """
        SELECT 'C' || c_custkey AS node, 0 AS kind, 'cust.' || c_mktsegment || '.C' || c_custkey AS fqn, n_name AS repo,
               'src/' || lower(c_mktsegment) || '/c' || (c_custkey % 10) || '.go' AS span_file, CAST(c_custkey AS BIGINT) AS line
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'P' || p_partkey, 0, 'part.' || replace(p_name, ' ', '.') || '.P' || p_partkey, p_brand,
               'src/' || lower(p_type) || '/p' || (p_size % 10) || '.go', CAST(p_partkey AS BIGINT) FROM part
        UNION ALL SELECT 'S' || s_suppkey, 2, 'supply.S' || s_suppkey, n_name, '', CAST(0 AS BIGINT)
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "cg_edges": """
        SELECT DISTINCT 'C' || o_custkey AS src, 'P' || l_partkey AS dst, 0 AS rel FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        UNION ALL SELECT DISTINCT 'P' || l_partkey, 'S' || l_suppkey, 3 FROM lineitem
        UNION ALL SELECT 'S' || s_suppkey, 'C' || c_custkey, 2 FROM supplier JOIN customer ON c_custkey = s_suppkey WHERE s_acctbal >= 0""",
    "cg_invokes": """
        SELECT DISTINCT 'S' || l_suppkey AS iid, p_brand AS repo, 'P' || l_partkey AS fn, 'src/' || lower(p_type) || '.go' AS file, CAST(p_size AS BIGINT) AS line
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # Callees: one call site per lineitem of a part with a made-up qualified name.
    "callee_sites": """
        SELECT 'O' || l_orderkey AS fn, CAST(l_linenumber AS BIGINT) AS cs,
               lower(p_type) || '.example/' || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '.') AS callee_fqn,
               CAST(p_size % 4 AS BIGINT) AS argc, p_partkey % 2 = 1 AS recv, CAST(p_size % 3 AS BIGINT) AS resultc,
               CAST(p_size % 8 AS BIGINT) AS error_results, CAST(l_linenumber % 6 AS BIGINT) AS kind, p_size % 5 = 0 AS bodied
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # Events as functions: a user's events in order are the call sites, each result feeds the next call.
    "flow_sites": """
        SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS cs,
               count(*) OVER (PARTITION BY user_id) AS n_sites FROM events""",
    "flow_targets": """
        SELECT s.user_id, s.cs, s.user_id - 1 AS target FROM flow_sites s
        WHERE s.event_type = 'click' AND s.user_id - 1 IN (SELECT user_id FROM events)""",
    "flow_functions": """
        SELECT DISTINCT 'U' || user_id AS iid, 'app.U' || user_id AS fqn, 'r' || (user_id % 5) AS repo FROM events""",
    "flow_vertices": """
        SELECT DISTINCT 'U' || user_id AS fn, CAST(0 AS INT) AS vid, CAST(0 AS INT) AS kind, CAST(-1 AS INT) AS cs FROM events
        UNION ALL SELECT DISTINCT 'U' || user_id, 1, 3, -1 FROM events
        UNION ALL SELECT 'U' || user_id, CAST(2 + 2 * cs AS INT), 6, CAST(cs AS INT) FROM flow_sites
        UNION ALL SELECT 'U' || user_id, CAST(3 + 2 * cs AS INT), 7, CAST(cs AS INT) FROM flow_sites""",
    "flow_edges": """
        SELECT DISTINCT 'U' || user_id AS fn, CAST(0 AS INT) AS src, CAST(2 AS INT) AS dst FROM events
        UNION ALL SELECT 'U' || user_id, CAST(3 + 2 * cs AS INT), CASE WHEN cs = n_sites - 1 THEN 1 ELSE CAST(4 + 2 * cs AS INT) END FROM flow_sites""",
    "flow_calls": """
        SELECT 'U' || user_id AS fn, CAST(cs AS INT) AS cs,
               CASE event_type WHEN 'signup' THEN 'src.Signup' WHEN 'purchase' THEN 'db.Purchase' WHEN 'error' THEN 'san.Clean' WHEN 'view' THEN 'lib.View' ELSE 'app.Click' END AS callee_fqn,
               CASE WHEN event_id % 3 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS dispatch_confidence FROM flow_sites""",
    # The same program with every other click sent through a contract of the user called.
    "flow_remote": """
        SELECT t.user_id, t.cs, t.target, s.event_id % 2 = 1 AS remote FROM flow_targets t JOIN flow_sites s ON s.user_id = t.user_id AND s.cs = t.cs""",
    "flow_contracts": """
        SELECT DISTINCT 'K' || user_id AS iid, 'U' || user_id AS handler, 'grpc.K' || user_id AS full_name, 'r' || (user_id % 5) AS repo FROM events""",
    # Endpoints: what a repository says it serves; a fifth belongs to another repository than its handler.
    "flow_endpoints": """
        SELECT 'r' || (CASE WHEN event_type = 'error' THEN user_id + 1 ELSE user_id END % 5) AS repo, 'K' || user_id AS iid, event_type || user_id AS name FROM events""",
    "flow_changed": """
        SELECT 'U' || user_id AS iid FROM flow_sites WHERE cs = n_sites - 1 AND event_type = 'error'""",
    "flow_hops": """
        SELECT user_id, cs, 'r' || (user_id % 5) AS repo, 'app.U' || user_id AS func, event_type AS callee, event_id % 100000 AS line,
               CASE WHEN event_type = 'signup' THEN 'Source' WHEN event_type = 'purchase' THEN 'Sink' ELSE 'Call' END AS kind FROM flow_sites""",
    # Copies of functions: a customer's orders are copies of one function in several repositories.
    "function_copies": """
        SELECT 'F' || o_custkey AS iid, o_orderpriority AS repo, o_orderstatus <> 'P' AS has_flow, o_orderstatus AS content FROM orders""",
    # Contracts by route template, as several handlers and methods give them.
    "route_copies": """
        SELECT path AS iid, substr(handler, 1, 1) AS repo, handler, method FROM http_routes""",
    # Arguments by name: a conversation's turns are ports named by role, checked against a contract's names.
    "named_ports": """
        SELECT conv_id AS site, conv_id % 7 AS contract, turn AS idx, CASE WHEN turn % 5 = 4 THEN '' ELSE role || '_' || (turn % 6) END AS name FROM conversations""",
    "named_args": """
        SELECT contract, name, row_number() OVER (PARTITION BY contract ORDER BY name) - 1 AS pos
        FROM (SELECT DISTINCT conv_id % 7 AS contract, role || '_' || (turn % 4) AS name FROM conversations) a""",
    # Store: customers as functions, what their orders do as behaviour, in two versions.
    "store_lines": """
        SELECT 'C' || c_custkey AS iid, c_mktsegment AS bid, 'F:' || o_orderpriority || '->' || o_orderstatus AS line, o_orderdate AS day
        FROM customer JOIN orders ON c_custkey = o_custkey""",
    # HTTP: routes and clients from the URLs of pages.
    "http_parts": """
        SELECT page_id, url, regexp_extract(url, '://([^/.]+)', 1) AS host, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM pages""",
    "http_routes": """
        SELECT DISTINCT 'H' || host AS handler, CASE WHEN length(host) % 3 = 0 THEN 'GET' WHEN length(host) % 3 = 1 THEN '*' ELSE 'POST' END AS method,
               '/' || host || '/' || regexp_extract(path, '^/([^/]*)', 1) || '/{}' AS path FROM http_parts
        UNION SELECT DISTINCT 'V' || host || v, 'GET', '/v' || v || '/' || host || '/' || regexp_extract(path, '^/([^/]*)', 1) || '/{}'
              FROM http_parts, (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) m WHERE length(host) % 5 >= v
        UNION SELECT DISTINCT 'T' || host, '*', '/' || host || '/{*}' FROM http_parts WHERE length(host) % 2 = 0
        UNION SELECT DISTINCT 'B' || host, 'GET', '/' || regexp_extract(path, '^/([^/]*)', 1) || '/{}' FROM http_parts""",
    "http_clients": """
        SELECT page_id AS site, CASE WHEN page_id % 3 = 0 THEN 'GET' WHEN page_id % 3 = 1 THEN 'post' ELSE '' END AS method,
               CASE WHEN page_id % 5 = 0 THEN '/{}' WHEN page_id % 5 = 1 THEN '/gw' ELSE '' END || '/' || host || path AS path FROM http_parts""",
    # Cells: suppliers write what orders read, of line status types; cells feed one another.
    "cell_writes": """
        SELECT DISTINCT l_partkey AS cell, 'W' || l_suppkey AS fn, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linestatus END AS type FROM lineitem WHERE l_returnflag = 'A'""",
    "cell_reads": """
        SELECT DISTINCT l_partkey AS cell, 'R' || l_orderkey AS fn, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_linestatus END AS assert_type,
               CASE WHEN l_quantity > 40 THEN 'sqli' WHEN l_quantity > 30 THEN 'exec' ELSE '' END AS class FROM lineitem WHERE l_returnflag = 'R'""",
    "cell_edges": """
        SELECT p_partkey AS src, (p_partkey * 7 + 1) % (SELECT count(*) FROM part) AS dst FROM part WHERE p_size < 20""",
}
#: What each relation is made of, other relations first.
NEEDS = {
    **{n: ["flow_sites"] for n in ("flow_targets", "flow_vertices", "flow_edges", "flow_calls", "flow_changed", "flow_hops")},
    "flow_remote": ["flow_sites", "flow_targets"],
    "http_routes": ["http_parts"],
    "http_clients": ["http_parts"],
    "route_copies": ["http_parts", "http_routes"],
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation as a DataFrame over the tables of sf_dir."""
    for t in TABLES:
        if t in _words(name):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for need in NEEDS.get(name, []):
        relation(spark, sf_dir, need).createOrReplaceTempView(need)
    return spark.sql(SQL[name])


def _words(name: str) -> set[str]:
    out = set(SQL[name].replace("(", " ").replace(")", " ").replace(",", " ").split())
    for need in NEEDS.get(name, []):
        out |= _words(need)
    return out


def with_sql(names: list[str], body: str, recursive: bool = False) -> str:
    """SQL for DuckDB: the relations as common table expressions, then the body."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, []), n) if x not in order]
    parts = [f"{n} AS ({SQL[n]})" for n in order]
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = body[5:].lstrip()
        if body.upper().startswith("RECURSIVE "):
            recursive, body = True, body[10:]
        return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)}, {body}"
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} {body}"
