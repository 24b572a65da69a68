"""Policy as data: rules are rows, matching them is a join on distinct callee names.

Rules are (section, rule_ord, tag, selector, regex, arg): a rule matches a name that ends
with its selector or in which its regex is found. Sources, sinks and sanitizers take their
first match in order, propagators every one, error wrappers any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "section string, rule_ord long, tag string, selector string, regex string, arg string"


def matches(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(callee_fqn, section, rule_ord, tag, selector, arg) of every match; rules are few and bounded by the policy file."""
    hit = F.expr("(selector is not null and endswith(callee_fqn, selector)) or (regex is not null and callee_fqn rlike regex)")
    return names.select("callee_fqn").distinct().join(F.broadcast(rules), hit).select("callee_fqn", "section", "rule_ord", "tag", "selector", "arg")


def first_matches(matched: DataFrame) -> DataFrame:
    """The first rule of a section for each name."""
    return matched.groupBy("callee_fqn", "section").agg(F.min(F.struct("rule_ord", "tag", "selector", "arg")).alias("r")).select("callee_fqn", "section", "r.*")


def inert(rules: DataFrame, matched: DataFrame) -> DataFrame:
    """(section, tag, selector) of rules that match nothing; propagators and annotations aside."""
    label = F.coalesce("selector", "regex")
    own = rules.where(F.col("section") != "propagators").where(~label.startswith("__"))
    return own.join(matched.select("section", "rule_ord").distinct(), ["section", "rule_ord"], "left_anti").select("section", "tag", label.alias("selector"))


def ports(spec, argc, recv):
    """The argument ports that a port specification names, as an array."""
    none = F.array().cast("array<bigint>")
    span = lambda lo: F.when(argc > lo, F.sequence(lo, argc - 1)).otherwise(none)
    low = F.when(recv, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    index = F.try_to_number(spec, F.lit("999")).cast("bigint")
    return (
        F.when(spec == "return", none)
        .when(spec == "any", span(F.lit(0).cast("bigint")))
        .when(spec == "args", span(low))
        .when(spec == "receiver", F.when(recv & (argc > 0), F.array(F.lit(0).cast("bigint"))).otherwise(none))
        .when(index < argc, F.array(index))
        .otherwise(none)
    )


def argument_range(calls: DataFrame, rules: DataFrame, section: str) -> DataFrame:
    """(tag, selector, arg, widest) of rules whose names match calls, none of which has the port they name."""
    own = rules.where((F.col("section") == section) & ~F.coalesce("selector", "regex").startswith("__") & (F.col("arg") != "any") & (F.col("arg") != "return"))
    if section == "sinks":
        own = own.where(F.col("arg").rlike("^[0-9]+$"))
    wide = calls.select("callee_fqn", "argc", "recv").distinct()
    hit = matches(wide, own).join(wide, "callee_fqn")
    some = F.size(ports(F.col("arg"), F.col("argc"), F.col("recv"))) > 0
    return hit.groupBy("rule_ord", "tag", "selector", "arg").agg(F.max("argc").alias("widest"), F.max(some).alias("ever")).where("not ever").select("tag", "selector", "arg", "widest")


def propagator_fit(rules: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: hit, total."""
    total = rules.where("section = 'propagators'").agg(F.count("*").alias("total"))
    hit = matched.where("section = 'propagators'").agg(F.countDistinct("rule_ord").alias("hit"))
    return hit.crossJoin(total)


def opaque_modules(calls: DataFrame, top: int = 8) -> DataFrame:
    """(module, n): the modules with most call sites of no loaded body; a top-k report."""
    from ..functions.scalars import module_of

    own = calls.where("kind not in (2, 5) and not bodied").select(module_of(F.col("callee_fqn")).alias("module")).where("module is not null")
    return own.groupBy("module").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module").limit(top)


def error_leaf_census(calls: DataFrame, wrappers: DataFrame) -> DataFrame:
    """One row: sites with an error result, of those wrappers, error result ports of the others, functions."""
    own = calls.where("error_results <> 0").join(wrappers.select("callee_fqn").distinct().withColumn("wrapper", F.lit(True)), "callee_fqn", "left")
    mask = F.expr("shiftleft(cast(1 as bigint), cast(least(resultc, 63) as int)) - 1")
    ported = F.when(F.col("wrapper").isNull(), F.bit_count(F.col("error_results").bitwiseAND(mask))).otherwise(0)
    return own.agg(F.count("*").alias("sites"), F.count_if("wrapper").alias("wrappers"), F.coalesce(F.sum(ported), F.lit(0)).cast("long").alias("ports"), F.countDistinct("fn").alias("fns"))
