"""Linking HTTP client sites to the routes that serve them.

A client template is compared with every route on distinct templates only. The score of a
pair is (kind, literals, specific, exact method): exact alignment beats a suffix one, more
agreeing literals beat fewer, one-for-one segments beat a catch-all, a named method beats a
wildcard. All routes that tie for the best are linked; more than MAX_FANOUT are ambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import canonical_path

MIN_EXACT, MIN_SUFFIX, MAX_FANOUT = 1, 2, 4


def segments(path: Column) -> Column:
    return F.filter(F.split(canonical_path(path), "/"), lambda x: x != "")


def align(route: Column, client: Column) -> Column:
    """struct(lits, specific) if the segment arrays match place by place, else null."""
    cut = lambda a: F.array_position(a, "{*}")
    n_route = F.when(cut(route) > 0, cut(route) - 1).otherwise(F.size(route))
    n_client = F.when(cut(client) > 0, cut(client) - 1).otherwise(F.size(client))
    n = F.least(n_route, n_client)
    # The first end: whichever of a catch-all or the array's end comes first, on either side.
    tail = ((cut(route) > 0) & (n_route == n)) | ((cut(client) > 0) & (n_client == n))
    whole = tail | (F.size(route) == F.size(client))
    pairs = F.arrays_zip(F.slice(route, F.lit(1), F.greatest(n, F.lit(0)).cast("int")).alias("r"), F.slice(client, F.lit(1), F.greatest(n, F.lit(0)).cast("int")).alias("c"))
    fits = F.forall(pairs, lambda p: (p["r"] == "{}") | ((p["c"] != "{}") & (p["r"] == p["c"])))
    lits = F.size(F.filter(pairs, lambda p: (p["r"] != "{}") & (p["r"] == p["c"])))
    return F.when(whole & fits, F.struct(lits.alias("lits"), (~tail).alias("specific")))


def scores(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """(method, path, handler, route_path, kind, lits, specific, exact_method) of every pair that matches at all."""
    c = clients.select(F.upper("method").alias("method"), "path").distinct().withColumn("cs", segments(F.col("path")))
    # Leading holes are an unknown base.
    known = F.filter(F.transform("cs", lambda x, i: F.when(x != "{}", i)), lambda i: i.isNotNull())
    c = c.withColumn("base", F.when(F.size(known) > 0, F.element_at(known, 1)).otherwise(F.size("cs")).cast("int"))
    c = c.withColumn("rest", F.slice("cs", F.col("base") + 1, F.greatest(F.size("cs"), F.lit(1))))
    r = routes.select("handler", F.upper("method").alias("r_method"), F.col("path").alias("route_path"), segments(F.col("path")).alias("rs"))
    # A score needs an agreeing literal, so pairs meet on a literal instead of all with all.
    lit = lambda a: F.array_distinct(F.filter(a, lambda x: (x != "{}") & (x != "{*}")))
    pairs = c.select("*", F.explode(lit("rest")).alias("word")).join(r.select("*", F.explode(lit("rs")).alias("word")), "word").drop("word").distinct()
    wild = lambda m: m.isin("", "*")
    any_side = wild(F.col("method")) | wild(F.col("r_method"))
    pairs = pairs.where(any_side | (F.col("method") == F.col("r_method"))).withColumn("exact_method", ~any_side)
    exact = F.when(F.col("base") == 0, align(F.col("rs"), F.col("rest")))
    exact = F.when(exact["lits"] >= MIN_EXACT, exact)
    first = F.when(F.col("base") == 0, 1).otherwise(0)
    of_route = F.transform(F.sequence(first, F.size("rs")), lambda o: align(F.slice("rs", o + 1, F.greatest(F.size("rs"), F.lit(1))), F.col("rest")))
    none = F.array().cast("array<struct<lits:int,specific:boolean>>")
    of_client = F.when(F.size("rest") > 1, F.transform(F.sequence(F.lit(1), F.size("rest") - 1), lambda o: align(F.col("rs"), F.slice("rest", o + 1, F.greatest(F.size("rest"), F.lit(1)))))).otherwise(none)
    suffix = F.array_max(F.filter(F.concat(F.when(first <= F.size("rs"), of_route).otherwise(none), of_client), lambda x: x.isNotNull()))
    suffix = F.when(suffix["lits"] >= MIN_SUFFIX, suffix)
    out = pairs.withColumn("_e", exact).withColumn("_s", suffix).where("_e is not null or _s is not null")
    best = F.coalesce("_e", "_s")
    kind = F.when(F.col("_e").isNotNull(), 2).otherwise(1).cast("long")
    return out.select("method", "path", "handler", "route_path", kind.alias("kind"), best["lits"].cast("long").alias("lits"), best["specific"].alias("specific"), "exact_method")


def link(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """(site, handler, route_path, kind, n_routes, confidence): every client site with its best routes.

    kind is exact, suffix, ambiguous or unlinked; the last two have no handler and confidence 0.
    """
    scored = scores(clients, routes).withColumn("score", F.struct("kind", "lits", "specific", "exact_method"))
    top = scored.groupBy("method", "path").agg(F.max("score").alias("top"))
    tied = scored.join(top, ["method", "path"]).where("score = top").select("method", "path", "handler", "route_path", "kind").distinct()
    size = tied.groupBy("method", "path").agg(F.count("*").alias("n_routes"))
    tied = tied.join(size, ["method", "path"])
    own = clients.select("site", F.upper("method").alias("method"), "path")
    fine = tied.where(F.col("n_routes") <= MAX_FANOUT).select("method", "path", "handler", "route_path", F.when(F.col("kind") == 2, "exact").otherwise("suffix").alias("kind"), "n_routes", (1 / F.col("n_routes")).alias("confidence"))
    many = size.where(F.col("n_routes") > MAX_FANOUT).select("method", "path", F.lit("").alias("handler"), F.lit("").alias("route_path"), F.lit("ambiguous").alias("kind"), "n_routes", F.lit(0.0).alias("confidence"))
    joined = own.join(fine.unionByName(many), ["method", "path"], "left")
    return joined.select("site", F.coalesce("handler", F.lit("")).alias("handler"), F.coalesce("route_path", F.lit("")).alias("route_path"), F.coalesce("kind", F.lit("unlinked")).alias("kind"), F.coalesce("n_routes", F.lit(0)).alias("n_routes"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def census(linked: DataFrame, routes: DataFrame) -> DataFrame:
    """One row: sites, linked, exact, suffix, fanout, ambiguous, unlinked, routes."""
    sites = linked.groupBy("site").agg(F.first("kind").alias("kind"), F.max("n_routes").alias("n"))
    is_linked = F.col("kind").isin("exact", "suffix")
    out = sites.agg(F.count("*").alias("sites"), F.count_if(is_linked).alias("linked"), F.count_if(F.col("kind") == "exact").alias("exact"), F.count_if(F.col("kind") == "suffix").alias("suffix"), F.count_if(is_linked & (F.col("n") > 1)).alias("fanout"), F.count_if(F.col("kind") == "ambiguous").alias("ambiguous"), F.count_if(F.col("kind") == "unlinked").alias("unlinked"))
    return out.crossJoin(routes.agg(F.count("*").alias("routes")))


def top_unlinked(clients: DataFrame, linked: DataFrame, top: int = 8) -> DataFrame:
    """(template, n): the commonest templates that were not linked; a top-k report."""
    bad = linked.where("kind in ('unlinked', 'ambiguous')").select("site", "kind", "n_routes").distinct()
    verb = F.when(F.upper("method") == "", "*").otherwise(F.upper("method"))
    name = F.concat_ws(" ", verb, "path")
    text = F.when(F.col("kind") == "ambiguous", F.concat(name, F.lit(" (ambiguous: "), F.col("n_routes").cast("string"), F.lit(")"))).otherwise(name)
    return clients.join(bad, "site").groupBy(text.alias("template")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "template").limit(top)


def contracts(routes: DataFrame) -> DataFrame:
    """(iid, key, handler, name): HTTP contracts; an id that several handlers share is keyed by handler too."""
    from ..functions.scalars import hash_parts

    name = F.concat_ws(" ", F.lit("http"), F.upper("method"), canonical_path(F.col("path")))
    own = routes.select("handler", name.alias("name"), hash_parts(F.lit(""), F.lit(""), name, F.lit("grpc")).alias("iid"))
    many = own.groupBy("iid").agg((F.countDistinct("handler") > 1).alias("shared"))
    key = F.when(F.col("shared"), hash_parts(F.lit("http-route"), F.col("iid"), F.col("handler"))).otherwise(F.col("iid"))
    return own.join(many, "iid").select("iid", key.alias("key"), "handler", "name").distinct()
