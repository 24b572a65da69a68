"""Policy queries over the adapter of made-up callee names."""

from __future__ import annotations

from ..operators import policy as po
from ..sources.adapters import relation, with_sql

RULES = [
    ("sources", 0, "request", "small.ring", None, "return"),
    ("sources", 1, "env", None, "^promo.*bolt$", "1"),
    ("sources", 2, "ghost", "no.such.name", None, "return"),
    ("sources", 3, "wide", "gear", None, "7"),
    ("sinks", 0, "sqli", "widget", None, "any"),
    ("sinks", 1, "exec", None, "brand1[0-5]/", "0"),
    ("sinks", 2, "file", "gear", None, "args"),
    ("sinks", 3, "log", "bolt", None, "3"),
    ("sinks", 4, "note", "__annotation__", None, "any"),
    ("sinks", 5, "xss", "nothing.here", None, "receiver"),
    ("sanitizers", 0, "escape", None, "blue[.]", "any"),
    ("error_wrappers", 0, "wrap", "hot.gear", None, "any"),
    ("propagators", 0, "copy", "red.widget", None, "0"),
    ("propagators", 1, "fill", None, "^standard[.]example/brand[0-9]/", "receiver"),
    ("propagators", 2, "never", "never.called", None, "any"),
]


def _rules(spark):
    return spark.createDataFrame(RULES, po.SCHEMA)


def _matched(spark, sf_dir):
    return po.matches(relation(spark, sf_dir, "callee_sites"), _rules(spark))


def policy_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("callee_fqn", "section", "rule_ord", "tag")


def policy_first_match(spark, sf_dir):
    return po.first_matches(_matched(spark, sf_dir).where("section in ('sources', 'sinks', 'sanitizers')")).select("callee_fqn", "section", "rule_ord", "tag")


def policy_inert(spark, sf_dir):
    return po.inert(_rules(spark), _matched(spark, sf_dir))


def policy_arg_range(spark, sf_dir):
    return po.argument_range(relation(spark, sf_dir, "callee_sites"), _rules(spark), "sinks")


def policy_to_range(spark, sf_dir):
    return po.argument_range(relation(spark, sf_dir, "callee_sites"), _rules(spark), "sources")


def propagator_fit(spark, sf_dir):
    return po.propagator_fit(_rules(spark), _matched(spark, sf_dir))


def opaque_modules(spark, sf_dir):
    return po.opaque_modules(relation(spark, sf_dir, "callee_sites"))


def error_leaf_census(spark, sf_dir):
    sites = relation(spark, sf_dir, "callee_sites")
    return po.error_leaf_census(sites, _matched(spark, sf_dir).where("section = 'error_wrappers'"))


def _quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"


_VALUES = ", ".join("(" + ", ".join(_quoted(x) for x in r) + ")" for r in RULES)
_M = f"""WITH rules(section, rule_ord, tag, selector, regex, arg) AS (VALUES {_VALUES}),
names AS (SELECT DISTINCT callee_fqn FROM callee_sites),
m AS (SELECT callee_fqn, section, CAST(rule_ord AS BIGINT) AS rule_ord, tag, selector, regex, arg FROM names JOIN rules ON ends_with(callee_fqn, selector) OR regexp_matches(callee_fqn, regex))"""
_S = ["callee_sites"]
_F = (policy_match, policy_first_match, policy_inert, policy_arg_range, policy_to_range, propagator_fit, opaque_modules, error_leaf_census)
QUERIES = {f.__name__: f for f in _F}
ORACLE_SQL = {
    "policy_match": with_sql(_S, _M + " SELECT callee_fqn, section, rule_ord, tag FROM m"),
    "policy_first_match": with_sql(_S, _M + " SELECT callee_fqn, section, min(rule_ord) AS rule_ord, arg_min(tag, rule_ord) AS tag FROM m WHERE section IN ('sources', 'sinks', 'sanitizers') GROUP BY callee_fqn, section"),
    "policy_inert": with_sql(_S, _M + " SELECT section, tag, coalesce(selector, regex) AS selector FROM rules r WHERE section <> 'propagators' AND NOT starts_with(coalesce(selector, regex), '__') AND NOT EXISTS (SELECT 1 FROM m WHERE m.section = r.section AND m.rule_ord = r.rule_ord)"),
    "policy_arg_range": with_sql(_S, _M + " SELECT tag, selector, arg, max(argc) AS widest FROM m JOIN callee_sites s USING (callee_fqn) WHERE section = 'sinks' AND regexp_matches(arg, '^[0-9]+$') GROUP BY rule_ord, tag, selector, arg HAVING NOT bool_or(CAST(arg AS INT) < argc)"),
    "policy_to_range": with_sql(_S, _M + " SELECT tag, selector, arg, max(argc) AS widest FROM m JOIN callee_sites s USING (callee_fqn) WHERE section = 'sources' AND arg NOT IN ('any', 'return') GROUP BY rule_ord, tag, selector, arg HAVING NOT bool_or(CAST(arg AS INT) < argc)"),
    "propagator_fit": with_sql(_S, _M + " SELECT (SELECT count(DISTINCT rule_ord) FROM m WHERE section = 'propagators') AS hit, (SELECT count(*) FROM rules WHERE section = 'propagators') AS total"),
    "opaque_modules": with_sql(_S, "SELECT split_part(callee_fqn, '/', 1) || '/' || split_part(callee_fqn, '/', 2) || '/' || split_part(split_part(callee_fqn, '/', 3), '.', 1) AS module, count(*) AS n FROM callee_sites WHERE kind NOT IN (2, 5) AND NOT bodied GROUP BY 1 ORDER BY n DESC, module LIMIT 8"),
    "error_leaf_census": with_sql(_S, _M + ", w AS (SELECT DISTINCT callee_fqn FROM m WHERE section = 'error_wrappers'), s AS (SELECT c.*, callee_fqn IN (SELECT callee_fqn FROM w) AS wrapper FROM callee_sites c WHERE error_results <> 0) SELECT count(*) AS sites, count(*) FILTER (WHERE wrapper) AS wrappers, CAST(coalesce(sum(CASE WHEN wrapper THEN 0 ELSE bit_count(error_results & ((CAST(1 AS BIGINT) << CAST(least(resultc, 63) AS INT)) - 1)) END), 0) AS BIGINT) AS ports, count(DISTINCT fn) AS fns FROM s"),
}
