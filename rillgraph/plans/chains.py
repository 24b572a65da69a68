"""Findings: from sources to terminals, with a route through the functions between."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import confidence, slot_text
from .fixpoint import Known, stable
from .taint import UNMODELED, Program, Result

MAX_DEPTH = 32


def chains(result: Result, program: Program) -> DataFrame:
    """(repo, fn, class, cs, term_fn, term_cs, via): one per source function, class, call site and terminal."""
    own = result.hits.where("in_slot = 'source'").where(F.col("class") != UNMODELED)
    repo = program.function.select(F.col("iid").alias("fn"), "repo")
    return own.join(repo, "fn").select("repo", "fn", "class", "cs", "term_fn", "term_cs", "via").distinct()


def by_class(found: DataFrame) -> DataFrame:
    return found.groupBy("class").agg(F.count("*").alias("n"))


def unmodeled(result: Result, program: Program) -> DataFrame:
    """(callee_fqn, chains, sites, sources, examples) of library calls that may write what no rule models; examples are the first three."""
    own = result.hits.where(F.col("class") == UNMODELED).where("in_slot = 'source'")
    name = program.callsite.select(F.col("fn").alias("term_fn"), F.col("cs").alias("term_cs"), "callee_fqn")
    own = own.join(name, ["term_fn", "term_cs"])
    first = Window.partitionBy("callee_fqn").orderBy("fn", "term_fn", "term_cs", "cs")
    some = own.withColumn("_r", F.row_number().over(first)).where("_r <= 3").withColumn("_e", F.struct("_r", F.concat_ws(" -> ", "fn", F.concat_ws("#", "term_fn", "term_cs")).alias("e")))
    some = some.groupBy("callee_fqn").agg(F.transform(F.array_sort(F.collect_list("_e")), lambda x: x["e"]).alias("examples"))
    counted = own.groupBy("callee_fqn").agg(F.count("*").alias("chains"), F.countDistinct("term_fn", "term_cs").alias("sites"), F.countDistinct("fn").alias("sources"))
    return counted.join(some, "callee_fqn")


def routes(result: Result, program: Program, depth: int = MAX_DEPTH) -> DataFrame:
    """(fn, class, cs, term_fn, term_cs, hops, confidence): for each source hit the functions and call sites on its way.

    At each level the smallest call site, vertex, callee and slot that leads to the terminal
    without entering a function twice through one slot is taken; the confidence is the least of the
    hops'. A hit without a complete route of at most `depth` functions has no hops and a null confidence.
    """
    steps = result.steps.where("via = ''").withColumn("seed", slot_text(F.col("in_slot"), F.col("in_path")))
    if program.contract is not None:
        bound = program.contract.select(F.col("iid").alias("callee"), F.col("handler").alias("body")).distinct()
        steps = steps.join(bound, "callee", "left").withColumn("body", F.coalesce("body", "callee"))
    else:
        steps = steps.withColumn("body", F.col("callee"))
    site = program.callsite.select("fn", "cs", "callee_fqn", confidence(F.col("dispatch_confidence")).alias("conf"))
    steps = stable(steps.join(site, ["fn", "cs"]).select("fn", "seed", "class", "cs", "term_fn", "term_cs", "vid", "callee", "through", "body", "callee_fqn", "conf").distinct())
    key = ["src", "class", "cs0", "term_fn", "term_cs"]
    first = steps.where("seed = 'source'").select(F.col("fn").alias("src"), "class", F.col("cs").alias("cs0"), "term_fn", "term_cs").distinct()
    front = first.select(*key, F.col("src").alias("fn"), F.lit("source").alias("seed"), F.col("cs0").alias("at"), F.array().cast("array<string>").alias("hops"), F.array(F.concat_ws("|", "src", F.lit("source"))).alias("seen"), F.lit(1.0).alias("conf"))
    done: Known | None = None
    for _ in range(depth):
        s = steps.select("fn", "seed", "class", "term_fn", "term_cs", "cs", "callee", "through", "body", "callee_fqn", F.col("conf").alias("c"))
        on = front.join(s, ["fn", "seed", "class", "term_fn", "term_cs"]).where(F.col("at").isNull() | (F.col("at") == F.col("cs")))
        on = on.where((F.col("callee") == "") | ~F.array_contains("seen", F.concat_ws("|", "body", "through")))
        hop = F.concat_ws("#", "fn", F.col("cs").cast("string"), "callee_fqn")
        on = on.select(*key, "body", "callee", "through", F.concat("hops", F.array(hop)).alias("hops"), F.concat("seen", F.array(F.concat_ws("|", "body", "through"))).alias("seen"), F.least("conf", "c").alias("conf"))
        ended = on.where("callee = ''").select(*key, "hops", "conf")
        done = done or Known(ended.sparkSession, ended.schema)
        done.add(ended)
        # The smallest ways on; a shorter complete route ends the search of its hit.
        rest = on.where("callee <> ''").join(done.rows().select(*key).distinct(), key, "left_anti")
        pick = Window.partitionBy(*key, "body", "through").orderBy(F.array_join("hops", "|"))
        front = rest.withColumn("_r", F.row_number().over(pick)).where("_r = 1").select(*key, F.col("body").alias("fn"), F.col("through").alias("seed"), F.lit(None).cast("int").alias("at"), "hops", "seen", "conf")
        front = stable(front)
        if front.isEmpty():
            break
    best = Window.partitionBy(*key).orderBy(F.size("hops"), F.array_join("hops", "|"))
    out = done.rows().withColumn("_r", F.row_number().over(best)).where("_r = 1")
    out = first.join(out, key, "left").withColumn("hops", F.coalesce("hops", F.array().cast("array<string>")))
    return out.select(F.col("src").alias("fn"), "class", F.col("cs0").alias("cs"), "term_fn", "term_cs", "hops", F.col("conf").alias("confidence"))
