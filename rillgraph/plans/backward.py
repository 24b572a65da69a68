"""Confirmation of findings by a walk back from their sinks.

The forward pass sees a function through the field paths that its own body names, so a
function that passes an object on whole lets one field's taint reach a sink of another.
The walk back carries the demanded part of the object along as a residual path, through
frames that do not spell it out. Frames are

  S|class|terminal     how a function's inputs reach that terminal,
  F|slot|path          how a function's inputs reach that part of its output,
  T|finding            the source function of a finding, from its call site alone,

and all frames grow together to one least fixpoint over (function, frame, vertex, residual),
so recursion needs no cut. Where a frame meets a source seed the finding is confirmed; a
finding without any is refuted, unless it goes through a cell or the program has stream
ports, which the walk does not model: then it is undecided.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import paths_comparable, residual_after
from .fixpoint import Known, stable
from .taint import Program, Result

MAX_DEMAND = 8
STATE = ["fn", "frame", "vid", "rest", "exact"]


def _walk(rows: pa.Table) -> pa.Table:
    """All (frame, vertex, residual) that a function's starts reach against its edges."""
    tag, a, b, call, frame, rest, exact = (rows[c].to_pylist() for c in ("tag", "a", "b", "call", "frame", "rest", "exact"))
    back: dict[int, list[tuple[int, bool]]] = defaultdict(list)
    work: deque = deque()
    for t, x, y, c, f, r, e in zip(tag, a, b, call, frame, rest, exact, strict=True):
        if t:
            work.append((f, x, tuple(r), e))
        else:
            back[y].append((x, c))
    seen: dict[tuple, bool] = {}
    while work:
        f, v, r, e = work.popleft()
        if seen.get((f, v, r)) or (not e and (f, v, r) in seen):
            continue
        seen[f, v, r] = e
        for u, by_call in back[v]:
            # A call of unknown body may use any part of its argument for any part of its result.
            work.append((f, u, (), False) if by_call else (f, u, r, e))
    fn = rows["fn"][0].as_py()
    keys = list(seen)
    return pa.table({"fn": pa.array([fn] * len(keys), pa.string()), "frame": pa.array([k[0] for k in keys], pa.string()), "vid": pa.array([k[1] for k in keys], pa.int32()), "rest": pa.array([list(k[2]) for k in keys], pa.list_(pa.int32())), "exact": pa.array(list(seen.values()), pa.bool_())})


def _walked(edges: DataFrame, starts: DataFrame) -> DataFrame:
    none = F.array().cast("array<int>")
    e = edges.join(starts.select("fn").distinct(), "fn", "left_semi").select("fn", F.lit(0).alias("tag"), F.col("src").cast("int").alias("a"), F.col("dst").cast("int").alias("b"), "call", F.lit("").alias("frame"), none.alias("rest"), F.lit(True).alias("exact"))
    s = starts.select("fn", F.lit(1).alias("tag"), F.col("vid").cast("int").alias("a"), F.lit(0).alias("b"), F.lit(False).alias("call"), "frame", "rest", "exact")
    return e.unionByName(s).groupBy("fn").applyInArrow(_walk, "fn string, frame string, vid int, rest array<int>, exact boolean")


def _text(path):
    return F.array_join(path.cast("array<string>"), ",")


def confirm(found: DataFrame, result: Result, program: Program, rounds: int = 200) -> DataFrame:
    """found(fn, class, cs, term_fn, term_cs, via) with verdict, exact and source_fields.

    source_fields: the distinct field paths of the seeds that were met, as "3.1" joined by commas.
    """
    facts = result.facts
    path_of = stable(program.vertex.select("fn", "vid", F.col("path").alias("declared")))
    inner = stable(facts.seeds.where("seed not in ('source', 'stream_in')").select("fn", "vid", F.regexp_extract("seed", r"^([^\[]*)", 1).alias("slot")).join(path_of, ["fn", "vid"]))
    own = facts.inputs
    bodies = program.function.select(F.col("iid").alias("callee"), F.col("iid").alias("body"))
    plain = F.lit(False)
    if program.contract is not None:
        plain = (F.col("kind") == 0) & ~F.col("client_streaming") & ~F.col("server_streaming")
        bodies = bodies.unionByName(program.contract.where(plain).select(F.col("iid").alias("callee"), F.col("handler").alias("body"))).distinct()
    bodies = stable(bodies)
    inputs = own.join(bodies, "callee").select("fn", "vid", "cs", "body", "slot", F.col("path").alias("declared"))
    sites = inputs.select("fn", "cs", "body").withColumn("only", F.lit(""))
    if program.contract is not None:
        # Contracts that show their handlers' parameters under other numbers, and at most one result.
        named = lambda c: F.concat(F.lit("param_"), c.cast("string"))
        c = program.contract.where(~plain)
        shown = c.where("kind = 1").select("iid", "handler", F.posexplode("gql_param_idx").alias("j", "p")).select("iid", "handler", named(F.col("j")).alias("slot"), named(F.col("p")).alias("inner_slot"))
        shown = shown.unionByName(c.where("kind = 2").select("iid", "handler", F.explode("request_params").alias("p")).select("iid", "handler", F.lit("param_0").alias("slot"), named(F.col("p")).alias("inner_slot")))
        shown = shown.unionByName(c.where("kind = 0 and server_streaming and not client_streaming").select("iid", "handler", F.lit("param_1").alias("slot"), F.lit("param_0").alias("inner_slot")))
        used = own.withColumnRenamed("callee", "iid").join(shown, ["iid", "slot"])
        inputs = inputs.unionByName(used.select("fn", "vid", "cs", F.col("handler").alias("body"), F.col("inner_slot").alias("slot"), F.col("path").alias("declared")))
        answers_back = own.withColumnRenamed("callee", "iid").join(c.where("kind = 1").select("iid", "handler"), "iid")
        sites = sites.unionByName(answers_back.select("fn", "cs", F.col("handler").alias("body"), F.lit("return_0").alias("only")))
    inputs = stable(inputs.distinct())
    landing = facts.landing.join(sites.distinct(), ["fn", "cs"]).where("only = '' or only = out_slot")
    landing = stable(landing.select("fn", "vid", "cs", "body", "out_slot", "land_path").distinct())
    outs = stable(facts.out_fact.select(F.col("fn").alias("body"), "out_slot", "out_path", F.col("vid").alias("out_vid")))
    edges = facts.edges

    found = stable(found.select("fn", "class", "cs", "term_fn", "term_cs", "via").distinct())
    finding = F.concat_ws("|", F.lit("T"), "fn", "class", F.col("cs").cast("string"), "term_fn", F.col("term_cs").cast("string"))
    sink_frame = F.concat_ws("|", F.lit("S"), "class", "term_fn", F.col("term_cs").cast("string"))
    none = F.array().cast("array<int>")
    ends = found.where("via = ''").select("class", "term_fn", "term_cs").distinct().join(facts.sinks.select(F.col("fn").alias("term_fn"), F.col("cs").alias("term_cs"), "class", "vid"), ["term_fn", "term_cs", "class"])
    base = ends.select(F.col("term_fn").alias("fn"), sink_frame.alias("frame"), "vid", none.alias("rest"), F.lit(True).alias("exact"))
    tops = stable(found.where("via = ''").select("fn", "cs", finding.alias("top"), sink_frame.alias("frame"), "term_fn", "term_cs", "class"))
    direct = tops.where("fn = term_fn and cs = term_cs").join(facts.sinks, ["fn", "cs", "class"]).select("fn", F.col("top").alias("frame"), "vid", none.alias("rest"), F.lit(True).alias("exact"))

    base = base.unionByName(direct).distinct()
    started = Known(base.sparkSession, base.schema)
    new, states = started.add(base), None
    for _ in range(rounds):
        reached = stable(_walked(edges, new))
        states = stable((reached if states is None else states.unionByName(reached)).groupBy("fn", "frame", "vid", "rest").agg(F.max("exact").alias("exact")))
        at = states.join(path_of, ["fn", "vid"], "left").withColumn("full", F.concat(F.coalesce("declared", none), "rest"))
        at = at.withColumn("exact", F.col("exact") & (F.size("full") <= MAX_DEMAND)).withColumn("full", F.when(F.size("full") <= MAX_DEMAND, F.col("full")).otherwise(F.col("declared"))).drop("declared")
        # What a port that takes a callee's output asks of the callee.
        asked = at.join(landing, ["fn", "vid"]).where(paths_comparable(F.col("full"), F.col("land_path")))
        asked = stable(asked.select("fn", "frame", "cs", "body", "exact", "out_slot", "full", F.concat_ws("|", F.lit("F"), "out_slot", _text(F.col("full"))).alias("inner")).distinct())
        opened = asked.join(outs, ["body", "out_slot"]).where(paths_comparable(F.col("full"), F.col("out_path"))).select(F.col("body").alias("fn"), F.col("inner").alias("frame"), F.col("out_vid").alias("vid"), residual_after(F.col("out_path"), F.col("full")).alias("rest"), F.lit(True).alias("exact"))
        # What frames answer: the parts of their function's inputs that matter.
        answers = stable(at.join(inner.select("fn", "vid", "slot"), ["fn", "vid"]).select(F.col("fn").alias("body"), F.col("frame").alias("inner"), "slot", F.col("full").alias("need"), F.col("exact").alias("sure")).distinct())
        fits = paths_comparable(F.col("need"), F.col("declared"))
        left = residual_after(F.col("declared"), F.col("need"))
        back = asked.select("fn", "frame", "cs", "body", "inner", "exact").join(answers, ["body", "inner"]).join(inputs, ["fn", "cs", "body", "slot"]).where(fits).select("fn", "frame", "vid", left.alias("rest"), (F.col("exact") & F.col("sure")).alias("exact"))
        of_sinks = answers.where(F.col("inner").startswith("S|"))
        up = of_sinks.join(inputs, ["body", "slot"]).where(fits)
        callers = up.select("fn", F.col("inner").alias("frame"), "vid", left.alias("rest"), F.col("sure").alias("exact"))
        top = up.join(tops.select("fn", "cs", "top", F.col("frame").alias("inner")), ["fn", "cs", "inner"]).select("fn", F.col("top").alias("frame"), "vid", left.alias("rest"), F.col("sure").alias("exact"))
        more = opened.unionByName(back).unionByName(callers).unionByName(top).distinct()
        new = started.add(more.join(started.rows(), STATE, "left_anti"))
        if new.isEmpty():
            break
    else:
        raise RuntimeError("the walk back did not settle")

    seeds = facts.seeds.where("seed = 'source'").select("fn", "vid")
    met = states.where(F.col("frame").startswith("T|")).join(seeds, ["fn", "vid"]).join(path_of, ["fn", "vid"], "left")
    field = F.array_join(F.concat(F.coalesce("declared", none), "rest").cast("array<string>"), ".")
    met = met.groupBy(F.col("frame").alias("top")).agg(F.max("exact").alias("sure"), F.array_join(F.array_sort(F.collect_set(field)), ",").alias("source_fields"))
    unmodelled = not program.callsite.where("stream_op > 0").isEmpty()
    out = found.withColumn("top", finding).join(met, "top", "left")
    verdict = F.when(F.col("via") != "", "undecided").when(F.col("sure").isNotNull(), "confirmed").otherwise("undecided" if unmodelled else "refuted")
    return out.select("fn", "class", "cs", "term_fn", "term_cs", "via", verdict.alias("verdict"), F.coalesce("sure", F.lit(False)).alias("exact"), F.coalesce("source_fields", F.lit("")).alias("source_fields"))


def stats(confirmed: DataFrame) -> DataFrame:
    """(verdict, n, exact)."""
    return confirmed.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"))


def prune(chains: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The findings that are not refuted."""
    key = ["fn", "class", "cs", "term_fn", "term_cs", "via"]
    return chains.join(confirmed.where("verdict = 'refuted'").select(*key), key, "left_anti")
