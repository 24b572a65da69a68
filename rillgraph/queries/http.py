"""HTTP queries over the adapter of page URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import canonical_path
from ..operators import httplink as hl
from ..sources.adapters import relation, with_sql


def http_canonical(spark, sf_dir):
    urls = relation(spark, sf_dir, "http_parts").select("url")
    routes = relation(spark, sf_dir, "http_routes").select(F.col("path").alias("url"))
    return urls.unionByName(routes).distinct().select("url", canonical_path(F.col("url")).alias("canonical"))


def _linked(spark, sf_dir):
    clients, routes = relation(spark, sf_dir, "http_clients"), relation(spark, sf_dir, "http_routes")
    return clients, routes, hl.link(clients, routes)


def http_link(spark, sf_dir):
    return _linked(spark, sf_dir)[2]


def http_census(spark, sf_dir):
    _, routes, linked = _linked(spark, sf_dir)
    return hl.census(linked, routes)


def http_top_unlinked(spark, sf_dir):
    clients, _, linked = _linked(spark, sf_dir)
    return hl.top_unlinked(clients, linked)


def http_contracts(spark, sf_dir):
    return hl.contracts(relation(spark, sf_dir, "http_routes"))


def _canonical(x: str) -> str:
    parts = f"list_filter(string_split(regexp_replace(regexp_replace({x}, '^((?i:https?:)?//)[^/]*', ''), '[?#].*$', ''), '/'), lambda s: s <> '' AND s <> '{{$}}')"
    one = r"CASE WHEN s = '{*}' OR starts_with(s, '*') OR regexp_matches(s, '^(\{.*\.\.\.\}|\[\.\.\..*\]|\[\[\.\.\..*\]\])$') THEN '{*}' WHEN regexp_matches(s, '[{\[]') OR starts_with(s, ':') THEN '{}' ELSE s END"
    return f"list_transform({parts}, lambda s: {one})"


def _cut(a: str) -> str:
    return f"CASE WHEN coalesce(list_position({a}, '{{*}}'), 0) > 0 THEN {a}[1:list_position({a}, '{{*}}')] ELSE {a} END"


def _hash(*parts: str) -> str:
    sized = " || ".join(f"unhex(array_to_string(list_reverse(regexp_extract_all(lpad(to_hex(strlen({p})), 16, '0'), '..')), '')) || CAST({p} AS BLOB)" for p in parts)
    return f"sha256({sized})"


_SEG = f"""WITH c0 AS (SELECT DISTINCT upper(method) AS method, path, {_canonical("path")} AS l FROM http_clients),
c1 AS (SELECT method, path, {_cut("l")} AS cs FROM c0),
c2 AS (SELECT *, coalesce(list_min(list_filter(range(1, len(cs) + 1), lambda i: cs[i] <> '{{}}')), len(cs) + 1) - 1 AS base FROM c1),
c AS (SELECT method, path, base, cs[CAST(base AS INT) + 1:] AS b FROM c2),
r0 AS (SELECT handler, upper(method) AS r_method, path AS route_path, {_canonical("path")} AS l FROM http_routes),
r AS (SELECT handler, r_method, route_path, {_cut("l")} AS a FROM r0),
p AS (SELECT c.method, c.path, base, handler, route_path, a, b, NOT (r_method IN ('', '*') OR c.method IN ('', '*')) AS exact_method
      FROM c JOIN r ON r_method IN ('', '*') OR c.method IN ('', '*') OR r_method = c.method),
o AS (SELECT *, x AS ro, 0 AS co FROM p, LATERAL (SELECT unnest(range(0, len(a) + 1)) AS x) UNION ALL SELECT *, 0, x FROM p, LATERAL (SELECT unnest(range(1, greatest(len(b), 1))) AS x)),
q AS (SELECT *, a[CAST(ro AS INT) + 1:] AS ra, b[CAST(co AS INT) + 1:] AS cb FROM o),
n AS (SELECT *, CASE WHEN coalesce(list_position(ra, '{{*}}'), 0) > 0 THEN list_position(ra, '{{*}}') - 1 ELSE len(ra) END AS na, CASE WHEN coalesce(list_position(cb, '{{*}}'), 0) > 0 THEN list_position(cb, '{{*}}') - 1 ELSE len(cb) END AS nb FROM q),
t AS (SELECT *, least(na, nb) AS k, (coalesce(list_position(ra, '{{*}}'), 0) > 0 AND na = least(na, nb)) OR (coalesce(list_position(cb, '{{*}}'), 0) > 0 AND nb = least(na, nb)) AS tail FROM n),
f AS (SELECT *, len(list_filter(range(1, k + 1), lambda i: ra[i] <> '{{}}' AND ra[i] = cb[i])) AS lits FROM t
      WHERE (tail OR len(ra) = len(cb)) AND len(list_filter(range(1, k + 1), lambda i: NOT (ra[i] = '{{}}' OR (cb[i] <> '{{}}' AND ra[i] = cb[i])))) = 0),
e AS (SELECT method, path, handler, route_path, CASE WHEN base = 0 AND ro = 0 AND co = 0 THEN 2 ELSE 1 END AS kind, lits, NOT tail AS specific, exact_method FROM f),
s AS (SELECT *, kind * 1000000 + lits * 1000 + CAST(specific AS INT) * 10 + CAST(exact_method AS INT) AS score FROM e WHERE (kind = 2 AND lits >= 1) OR (kind = 1 AND lits >= 2)),
w AS (SELECT DISTINCT method, path, handler, route_path, kind FROM s QUALIFY score = max(score) OVER (PARTITION BY method, path)),
z AS (SELECT *, count(*) OVER (PARTITION BY method, path) AS n_routes FROM w),
linked AS (SELECT DISTINCT site, CASE WHEN n_routes <= 4 THEN handler ELSE '' END AS handler, CASE WHEN n_routes <= 4 THEN route_path ELSE '' END AS route_path,
  CASE WHEN n_routes IS NULL THEN 'unlinked' WHEN n_routes > 4 THEN 'ambiguous' WHEN kind = 2 THEN 'exact' ELSE 'suffix' END AS kind, coalesce(n_routes, 0) AS n_routes,
  CASE WHEN n_routes <= 4 THEN CAST(1 AS DOUBLE) / n_routes ELSE CAST(0 AS DOUBLE) END AS confidence
  FROM http_clients h LEFT JOIN z ON z.method = upper(h.method) AND z.path = h.path),
l AS (SELECT site, coalesce(handler, '') AS handler, coalesce(route_path, '') AS route_path, kind, n_routes, confidence FROM linked)"""
_R = ["http_clients", "http_routes"]
_F = (http_canonical, http_link, http_census, http_top_unlinked, http_contracts)
QUERIES = {f.__name__: f for f in _F}
ORACLE_SQL = {
    "http_canonical": with_sql(["http_routes"], f"WITH u AS (SELECT url FROM http_parts UNION SELECT path FROM http_routes), l AS (SELECT url, {_canonical('url')} AS l FROM u) SELECT url, '/' || array_to_string({_cut('l')}, '/') AS canonical FROM l"),
    "http_link": with_sql(_R, _SEG + " SELECT * FROM l"),
    "http_census": with_sql(_R, _SEG + ", g AS (SELECT DISTINCT site, kind, n_routes FROM l) SELECT count(*) AS sites, count(*) FILTER (WHERE kind IN ('exact', 'suffix')) AS linked, count(*) FILTER (WHERE kind = 'exact') AS exact, count(*) FILTER (WHERE kind = 'suffix') AS suffix, count(*) FILTER (WHERE kind IN ('exact', 'suffix') AND n_routes > 1) AS fanout, count(*) FILTER (WHERE kind = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE kind = 'unlinked') AS unlinked, (SELECT count(*) FROM http_routes) AS routes FROM g"),
    "http_top_unlinked": with_sql(_R, _SEG + ", g AS (SELECT DISTINCT site, kind, n_routes FROM l WHERE kind IN ('unlinked', 'ambiguous')) SELECT CASE WHEN upper(method) = '' THEN '*' ELSE upper(method) END || ' ' || path || CASE WHEN kind = 'ambiguous' THEN ' (ambiguous: ' || n_routes || ')' ELSE '' END AS template, count(*) AS n FROM http_clients JOIN g USING (site) GROUP BY 1 ORDER BY n DESC, template LIMIT 8"),
    "http_contracts": with_sql(["http_routes"], f"""WITH l AS (SELECT handler, method, {_canonical('path')} AS l FROM http_routes), c AS (SELECT handler, 'http ' || upper(method) || ' ' || '/' || array_to_string({_cut('l')}, '/') AS name FROM l),
i AS (SELECT DISTINCT handler, name, {_hash("''", "''", "name", "'grpc'")} AS iid FROM c), m AS (SELECT iid, count(DISTINCT handler) > 1 AS shared FROM i GROUP BY iid)
SELECT iid, CASE WHEN shared THEN {_hash("'http-route'", "iid", "handler")} ELSE iid END AS key, handler, name FROM i JOIN m USING (iid)"""),
}
