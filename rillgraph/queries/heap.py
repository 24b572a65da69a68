"""Heap-cell, argument-name and store queries over their adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hash_parts
from ..operators import heap, normalize, store
from ..sources.adapters import relation, with_sql
from ..sources.cgf import contract_copies, examples, resolve_duplicates

CUT = "1997-01-01"


def _cells(spark, sf_dir):
    writes, reads = relation(spark, sf_dir, "cell_writes"), relation(spark, sf_dir, "cell_reads")
    return writes, reads, heap.sinks_of_cells(reads, relation(spark, sf_dir, "cell_edges"))


def heap_cells(spark, sf_dir):
    return _cells(spark, sf_dir)[2]


def heap_hits(spark, sf_dir):
    writes, _, sinks = _cells(spark, sf_dir)
    return heap.heap_hits(writes, sinks)


def heap_census(spark, sf_dir):
    return heap.census(*_cells(spark, sf_dir))


def heap_drops(spark, sf_dir):
    writes, _, sinks = _cells(spark, sf_dir)
    return heap.drops(writes, sinks)


def _normalised(spark, sf_dir):
    return normalize.normalise(relation(spark, sf_dir, "named_ports"), relation(spark, sf_dir, "named_args"))


def args_normalized(spark, sf_dir):
    return _normalised(spark, sf_dir)


def args_census(spark, sf_dir):
    return normalize.census(_normalised(spark, sf_dir))


def _keys(spark, sf_dir, before: str | None = None):
    lines = relation(spark, sf_dir, "store_lines")
    own = lines if before is None else lines.where(F.col("day") < F.lit(before).cast("timestamp"))
    done = store.behaviour(own.select("iid", "line"))
    return own.select("iid", "bid").distinct().join(done, "iid").select("iid", hash_parts(F.col("iid"), F.col("bid"), F.col("behaviour")).alias("key"))


def store_keys(spark, sf_dir):
    return _keys(spark, sf_dir)


def store_reuse(spark, sf_dir):
    return store.reuse(_keys(spark, sf_dir, CUT), _keys(spark, sf_dir))


def store_changed(spark, sf_dir):
    return store.changed(_keys(spark, sf_dir, CUT), _keys(spark, sf_dir))


def blast_provenance(spark, sf_dir):
    """Functions that changed between two versions, and those that some order reaches late, with who says so."""
    lines = relation(spark, sf_dir, "store_lines")
    late = lines.where(F.col("day") >= F.lit(CUT).cast("timestamp")).select("iid")
    return store.provenance(store_changed(spark, sf_dir), late, "iid")


def dup_functions(spark, sf_dir):
    return resolve_duplicates(relation(spark, sf_dir, "function_copies"))[0]


def dup_census(spark, sf_dir):
    return resolve_duplicates(relation(spark, sf_dir, "function_copies"))[1]


def dup_contracts(spark, sf_dir):
    return contract_copies(relation(spark, sf_dir, "route_copies"), ["method"])


def dup_contract_examples(spark, sf_dir):
    return examples(dup_contracts(spark, sf_dir), ["repos", "handlers", "shapes"])


def _hash(*parts: str) -> str:
    sized = " || ".join(f"unhex(array_to_string(list_reverse(regexp_extract_all(lpad(to_hex(strlen({p})), 16, '0'), '..')), '')) || CAST({p} AS BLOB)" for p in parts)
    return f"sha256({sized})"


_SINKS = """WITH RECURSIVE f(cell, class, reader, assert_type) AS (
  SELECT cell, class, fn, assert_type FROM cell_reads WHERE class <> ''
  UNION SELECT e.src, f.class, f.reader, '' FROM f JOIN cell_edges e ON e.dst = f.cell)"""
_C = ["cell_writes", "cell_reads", "cell_edges"]
_OK = "(assert_type = '' OR type = '' OR assert_type = type)"
_N = """WITH n AS (SELECT contract, count(*) AS n_args FROM named_args GROUP BY contract),
p AS (SELECT p.*, n_args, pos, CASE WHEN n_args IS NULL THEN 'unknown' WHEN p.name = '' THEN 'unnamed' WHEN pos IS NULL THEN 'dangling' ELSE 'named' END AS state
  FROM named_ports p LEFT JOIN n ON n.contract = p.contract LEFT JOIN named_args a ON a.contract = p.contract AND a.name = p.name),
r AS (SELECT site, idx, name, state, CAST(CASE state WHEN 'named' THEN pos WHEN 'dangling' THEN n_args + row_number() OVER (PARTITION BY site, state ORDER BY idx) - 1 ELSE idx END AS BIGINT) AS new_idx FROM p)"""


def _version(where: str) -> str:
    return f"SELECT iid, {_hash('iid', 'bid', 'h')} AS key FROM (SELECT iid, bid, {_hash('l')} AS h FROM (SELECT iid, min(bid) AS bid, array_to_string(list_sort(list_distinct(list(line))), chr(10)) AS l FROM store_lines {where} GROUP BY iid))"


_S = f"WITH o AS ({_version(f'''WHERE day < TIMESTAMP '{CUT}' ''')}), n AS ({_version('')})"
_D = "SELECT iid, count(*) AS copies, count(DISTINCT repo) AS repos, count(DISTINCT handler) AS handlers, count(DISTINCT method) AS shapes FROM route_copies GROUP BY iid HAVING repos > 1 OR handlers > 1 OR shapes > 1"
_CHANGED = "SELECT coalesce(o.iid, n.iid) AS iid, CASE WHEN o.iid IS NULL THEN 'added' WHEN n.iid IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.iid = n.iid WHERE o.key IS DISTINCT FROM n.key"
_F = (heap_cells, heap_hits, heap_census, heap_drops, args_normalized, args_census, store_keys, store_reuse, store_changed, blast_provenance, dup_functions, dup_census, dup_contracts, dup_contract_examples)
QUERIES = {f.__name__: f for f in _F}
ORACLE_SQL = {
    "dup_functions": with_sql(["function_copies"], "SELECT iid, repo, has_flow, content FROM function_copies QUALIFY row_number() OVER (PARTITION BY iid ORDER BY has_flow DESC, content DESC, repo) = 1"),
    "dup_census": with_sql(["function_copies"], "SELECT iid, count(*) AS copies, count(DISTINCT content) > 1 AS differ FROM function_copies GROUP BY iid HAVING count(*) > 1"),
    "dup_contracts": with_sql(["route_copies"], _D),
    "dup_contract_examples": with_sql(["route_copies"], f"WITH d AS ({_D}), k AS (SELECT 'repos' AS kind, iid FROM d WHERE repos > 1 UNION ALL SELECT 'handlers', iid FROM d WHERE handlers > 1 UNION ALL SELECT 'shapes', iid FROM d WHERE shapes > 1) SELECT kind, iid FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY iid) <= 5"),
    "heap_cells": with_sql(_C, _SINKS + " SELECT * FROM f"),
    "heap_hits": with_sql(_C, _SINKS + f" SELECT fn, class, count(*) AS n FROM (SELECT DISTINCT fn, class, w.cell, reader FROM cell_writes w JOIN f ON f.cell = w.cell WHERE {_OK}) GROUP BY fn, class"),
    "heap_census": with_sql(_C, _SINKS + " SELECT w.cell, writes, writer_fns, coalesce(reader_fns, 0) AS reader_fns, coalesce(sinks, 0) AS sinks, coalesce(classes, '') AS classes FROM (SELECT cell, count(*) AS writes, count(DISTINCT fn) AS writer_fns FROM cell_writes GROUP BY cell) w LEFT JOIN (SELECT cell, count(DISTINCT fn) AS reader_fns FROM cell_reads GROUP BY cell) r ON r.cell = w.cell LEFT JOIN (SELECT cell, count(*) AS sinks, array_to_string(list_sort(list_distinct(list(class))), ',') AS classes FROM f GROUP BY cell) s ON s.cell = w.cell"),
    "heap_drops": with_sql(_C, _SINKS + f" SELECT w.cell, count(*) AS dropped FROM cell_writes w JOIN f ON f.cell = w.cell WHERE NOT {_OK} GROUP BY w.cell"),
    "args_normalized": with_sql(["named_ports", "named_args"], _N + " SELECT site, idx, name, new_idx, state FROM r"),
    "args_census": with_sql(["named_ports", "named_args"], _N + " SELECT count(DISTINCT CASE WHEN idx <> new_idx THEN site END) AS sites, count(*) FILTER (WHERE idx <> new_idx) AS ports, count(*) FILTER (WHERE state = 'dangling') AS dangling FROM r"),
    "store_keys": with_sql(["store_lines"], _version("")),
    "store_reuse": with_sql(["store_lines"], _S + ", m AS (SELECT n.iid, o.key IS NOT NULL AS hit FROM n LEFT JOIN o ON o.iid = n.iid AND o.key = n.key) SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, 100.0::DOUBLE * count(*) FILTER (WHERE hit) / count(*) AS reuse_pct FROM m"),
    "store_changed": with_sql(["store_lines"], _S + " " + _CHANGED),
    "blast_provenance": with_sql(["store_lines"], _S + f", c AS ({_CHANGED}), l AS (SELECT DISTINCT iid FROM store_lines WHERE day >= TIMESTAMP '{CUT}') SELECT coalesce(c.iid, l.iid) AS iid, CASE WHEN l.iid IS NULL THEN 'chains' WHEN c.iid IS NULL THEN 'upstream' ELSE 'both' END AS found_by FROM c FULL JOIN l ON c.iid = l.iid"),
}
