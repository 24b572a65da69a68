"""Content-addressed summaries: a function's key holds its callees' behaviour, not their bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_parts, slot_text
from ..plans.taint import Program


def behaviour(lines: DataFrame) -> DataFrame:
    """(iid, behaviour): the hash of a function's distinct lines, in order."""
    return lines.groupBy("iid").agg(hash_parts(F.array_join(F.array_sort(F.collect_set("line")), "\n")).alias("behaviour"))


def lines_of(flows: DataFrame, hits: DataFrame) -> DataFrame:
    """(iid, line) of summaries: a line per flow and per sink hit with its terminal."""
    i, o = slot_text(F.col("in_slot"), F.col("in_path")), slot_text(F.col("out_slot"), F.col("out_path"))
    a = flows.select(F.col("fn").alias("iid"), F.concat(F.lit("F:"), i, F.lit("->"), o).alias("line"))
    b = hits.select(F.col("fn").alias("iid"), F.concat_ws(":", F.lit("S"), i, "class", "term_fn", F.col("term_cs").cast("string")).alias("line"))
    return a.unionByName(b)


def _parts(items: Column) -> Column:
    """A list as one text that no other list gives: each item after its length."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), "")


def keys(functions: DataFrame, calls: DataFrame, behaviours: DataFrame) -> DataFrame:
    """(iid, key) from functions(iid, bid, source_params), calls(iid, callee) and the callees' behaviour."""
    used = calls.distinct().join(behaviours.select(F.col("iid").alias("callee"), "behaviour"), "callee").groupBy("iid").agg(_parts(F.array_sort(F.collect_set("behaviour"))).alias("of_callees"))
    params = _parts(F.array_sort(F.array_distinct("source_params")).cast("array<string>"))
    return functions.join(used, "iid", "left").select("iid", hash_parts(F.col("iid"), F.col("bid"), params, F.coalesce("of_callees", F.lit(""))).alias("key"))


def reuse(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: hits, misses, reuse percent of the new keys that the store holds."""
    known = old.select("iid", "key").withColumn("hit", F.lit(True))
    out = new.join(known, ["iid", "key"], "left").agg(F.count_if("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
    return out.select("hits", "misses", (100.0 * F.col("hits") / (F.col("hits") + F.col("misses"))).alias("reuse_pct"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(iid, change): functions whose key is new, gone or different."""
    both = old.select("iid", F.col("key").alias("a")).join(new.select("iid", F.col("key").alias("b")), "iid", "full_outer")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("iid", kind.alias("change"))


def save(summaries: DataFrame, path: str, namespace: str) -> None:
    """Adds the keys the store lacks; it is only ever appended to."""
    spark = summaries.sparkSession
    own = summaries.withColumn("namespace", F.lit(namespace))
    try:
        known = spark.read.parquet(path).where(F.col("namespace") == namespace).select("key").distinct()
        own = own.join(known, "key", "left_anti")
    except Exception as e:  # no store yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    own.write.mode("append").partitionBy("namespace").parquet(path)


def changes(before: Program, after: Program) -> DataFrame:
    """(iid, change) between two programs: functions by body, parameters that are sources and targets of their
    calls; contracts by handlers and shapes."""

    def known(p: Program) -> DataFrame:
        calls = p.target.groupBy(F.col("fn").alias("iid")).agg(F.array_sort(F.collect_set(F.struct("cs", "callee"))).alias("calls"))
        out = p.function.join(calls, "iid", "left").select("iid", F.sha2(F.to_json(F.struct("bid", "has_flow", F.array_sort("source_params").alias("source_params"), "calls")), 256).alias("key"))
        if p.contract is None:
            return out
        shape = F.struct("handler", "kind", "client_streaming", "server_streaming", "gql_param_idx", "request_params")
        return out.unionByName(p.contract.groupBy("iid").agg(F.sha2(F.to_json(F.array_sort(F.collect_set(shape))), 256).alias("key")))

    return changed(known(before), known(after))


def impact(chains: DataFrame, changes: DataFrame, up: DataFrame | None = None, routes: DataFrame | None = None) -> DataFrame:
    """Chains (with fn, term_fn) that start or end in a changed function, whose route (hops) passes one, or that start upstream of one; via_change: how."""
    ids = changes.select("iid", F.lit(True).alias("hit"))
    out = chains.join(ids.select(F.col("iid").alias("fn"), F.col("hit").alias("at_source")), "fn", "left").join(ids.select(F.col("iid").alias("term_fn"), F.col("hit").alias("at_sink")), "term_fn", "left")
    if up is not None:
        out = out.join(up.select(F.col("node").alias("fn"), F.lit(True).alias("above")), "fn", "left")
    else:
        out = out.withColumn("above", F.lit(None).cast("boolean"))
    if routes is not None:
        key = ["fn", "class", "cs", "term_fn", "term_cs"]
        passed = routes.select(*key, F.explode("hops").alias("hop")).withColumn("iid", F.split_part("hop", F.lit("#"), F.lit(1)))
        out = out.join(passed.join(ids, "iid").select(*key, F.lit(True).alias("passes")).distinct(), key, "left")
    else:
        out = out.withColumn("passes", F.lit(None).cast("boolean"))
    how = F.when(F.col("at_source") & F.col("at_sink"), "both").when(F.col("at_source"), "source").when(F.col("at_sink"), "sink").when(F.col("passes"), "route").when(F.col("above"), "upstream")
    return out.withColumn("via_change", how).where("via_change is not null").drop("at_source", "at_sink", "above", "passes")


def provenance(a: DataFrame, b: DataFrame, column: str, names: tuple[str, str] = ("chains", "upstream")) -> DataFrame:
    """(column, found_by): the union of two lists, each value with who found it, or both."""
    left, right = a.select(column, F.lit(True).alias("_a")).distinct(), b.select(column, F.lit(True).alias("_b")).distinct()
    both = left.join(right, column, "full_outer")
    return both.select(column, F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), names[0]).otherwise(names[1]).alias("found_by"))
