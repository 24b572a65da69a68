"""Taint analysis as a stratified fixpoint over relations.

What a call does without knowing its callee (default leaf, propagators, sanitizers,
sinks) is static, so it compiles to edges and marks once. Only the application of callee
summaries is recursive: each round closes every changed function over its edges in one
kernel call, reads its summary off the closure, and turns new summary rows into new edges
of the callers. Sinks never feed taint back, so hits are a second, plain fixpoint.

Facts are (slot, path): a slot is param_0, receiver, return_0, byref_0, byref_recv,
global_<cell>[@<type>], field_0, source, stream_in or stream_out; a path is up to two field numbers.
The result is the least fixpoint: within groups of mutually recursive functions it has no
flow that only sustains itself.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import getter_field, paths_comparable, slot_base, slot_path, slot_text
from ..operators import policy as po
from .fixpoint import Known, closure, stable

OUT, IN = -1, -2  # pseudo vertices: data that leaves by a stream, data that a helper received
UNMODELED = "unmodeled-write"


@dataclass
class Program:
    """function(iid, fqn, repo, has_flow, source_params), vertex(fn, vid, kind, idx, path, cs, sym,
    iface_type, type, field_names), edge(fn, src, dst), callsite(fn, cs, kind, callee_fqn, argc,
    resultc, recv, dispatch_confidence, stream_op, stream_client, error_results), target(fn, cs,
    callee), contract(iid, handler, kind, client_streaming, server_streaming, gql_param_idx,
    request_params)."""

    function: DataFrame
    vertex: DataFrame
    edge: DataFrame
    callsite: DataFrame
    target: DataFrame
    contract: DataFrame | None = None


@dataclass
class Options:
    no_error_leaf: bool = False
    pb_getters: bool = False
    unmodeled: bool = False
    ignore_types: tuple[str, ...] = ()


@dataclass
class Facts:
    seeds: DataFrame  # fn, seed, vid, wb
    out_fact: DataFrame  # fn, vid, out_slot, out_path
    edges: DataFrame  # fn, src, dst, call
    inputs: DataFrame  # fn, vid, cs, callee, slot, path, remote
    landing: DataFrame  # fn, cs, out_slot, land_path, vid
    sinks: DataFrame  # fn, vid, cs, class
    writes: DataFrame  # fn, vid, cell, type
    receives: DataFrame  # fn, callee, vid
    leaf_sites: DataFrame  # fn, cs


@dataclass
class Result:
    flows: DataFrame  # fn, in_slot, in_path, out_slot, out_path
    hits: DataFrame  # fn, in_slot, in_path, class, cs, term_fn, term_cs, via
    steps: DataFrame  # hits with the callee and its seed they came through
    reach: DataFrame
    facts: Facts
    stats: dict = field(default_factory=dict)


def _sites(program: Program, rules: DataFrame) -> DataFrame:
    """Call sites with what the policy says of their callee."""
    matched = po.matches(program.callsite, rules)
    first = po.first_matches(matched)
    one = lambda section, **columns: first.where(F.col("section") == section).select("callee_fqn", *[F.col(c).alias(a) for a, c in columns.items()])
    any_of = lambda section, name: matched.where(F.col("section") == section).select("callee_fqn").distinct().withColumn(name, F.lit(True))
    out = program.callsite
    for part in (one("sources", src_to="arg"), one("sinks", sink_class="tag", sink_arg="arg"), any_of("sanitizers", "sanitizer"), any_of("error_wrappers", "wrapper"), any_of("propagators", "modeled")):
        out = out.join(part, "callee_fqn", "left")
    return out.withColumns({
        "sanitizer": F.coalesce("sanitizer", F.lit(False)), "wrapper": F.coalesce("wrapper", F.lit(False)), "modeled": F.coalesce("modeled", F.lit(False)),
        "server_stream": (F.col("stream_op") > 0) & ~F.col("stream_client"), "src_specs": F.split(F.coalesce("src_to", F.lit("")), ","),
    })


def _names_port(specs: Column, idx: Column, argc: Column, recv: Column) -> Column:
    return F.exists(specs, lambda s: F.array_contains(po.ports(s, argc, recv), idx.cast("bigint")))


def static_facts(program: Program, rules: DataFrame, options: Options, contracts: bool) -> Facts:
    """Everything that does not depend on summaries; `contracts`: whether contracts with a handler are known."""
    site = stable(_sites(program, rules))
    v = program.vertex
    port = v.where("kind in (6, 7)").select("fn", "vid", "kind", "idx", "path", "cs", "type", "field_names").join(site.withColumnRenamed("kind", "call_kind"), ["fn", "cs"])
    port = stable(port)
    args, results = port.where("kind = 6"), port.where("kind = 7")

    # In- and out-slots and seeds.
    name = F.when(F.col("kind") == 0, F.concat(F.lit("param_"), F.col("idx").cast("string"))).when(F.col("kind") == 1, "receiver").when(F.col("iface_type") != "", F.concat(F.lit("global_"), "sym", F.lit("@"), "iface_type")).otherwise(F.concat(F.lit("global_"), F.col("sym")))
    inner = v.where("kind in (0, 1, 2)").select("fn", slot_text(name, F.col("path")).alias("seed"), "vid", F.lit(False).alias("wb"))
    params = v.where("kind = 0").join(program.function.select(F.col("iid").alias("fn"), "source_params"), "fn").where(F.array_contains("source_params", F.col("idx"))).select("fn", F.lit("source").alias("seed"), "vid", F.lit(False).alias("wb"))
    byref = args.where(_names_port(F.col("src_specs"), F.col("idx"), F.col("argc"), F.col("recv"))).select("fn", F.lit("source").alias("seed"), "vid", F.lit(True).alias("wb"))
    returned = results.where(F.array_contains("src_specs", "return")).select("fn", F.lit("source").alias("seed"), "vid", F.lit(False).alias("wb"))
    received = results.where("stream_op = 2 and not stream_client and idx = 0").select("fn", F.explode(F.array(F.lit("source"), F.lit("stream_in"))).alias("seed"), "vid", F.lit(False).alias("wb"))
    helpers = site.where("stream_op = 0 and kind <> 2").join(program.target, ["fn", "cs"], "left_semi").select("fn").distinct()
    streams = site.where("stream_op > 0").limit(1).select(F.lit(True).alias("_any"))
    lifted = helpers.crossJoin(F.broadcast(streams)).select("fn", F.lit("stream_in").alias("seed"), F.lit(IN).alias("vid"), F.lit(False).alias("wb"))  # one row at most
    seeds = inner.unionByName(params).unionByName(byref).unionByName(returned).unionByName(received).unionByName(lifted).distinct()

    out_name = F.when(F.col("kind") == 3, F.concat(F.lit("return_"), F.col("idx").cast("string"))).when(F.col("kind") == 4, F.concat(F.lit("byref_"), F.col("idx").cast("string"))).when(F.col("kind") == 8, "byref_recv").when(F.col("sym") != "", F.concat(F.lit("global_"), F.col("sym"))).otherwise(F.concat(F.lit("field_"), F.col("idx").cast("string")))
    none = F.array().cast("array<int>")
    outs = v.where("kind in (3, 4, 5, 8)").select("fn", "vid", out_name.alias("out_slot"), F.col("path").alias("out_path"))
    sends = args.where("stream_op = 1 and not stream_client and idx >= 1").select("fn", "vid", F.lit("stream_out").alias("out_slot"), none.alias("out_path"))
    leaving = program.function.select(F.col("iid").alias("fn"), F.lit(OUT).alias("vid"), F.lit("stream_out").alias("out_slot"), none.alias("out_path"))
    out_fact = outs.unionByName(sends).unionByName(leaving)

    # Sites with a target that nothing is known of.
    known = program.function.select(F.col("iid").alias("callee"))
    if contracts and program.contract is not None:
        known = known.unionByName(program.contract.join(program.function.select(F.col("iid").alias("handler")), "handler", "left_semi").select(F.col("iid").alias("callee"))).distinct()
    unknown = program.target.join(known, "callee", "left_anti").select("fn", "cs")
    bare = program.callsite.select("fn", "cs").join(program.target.select("fn", "cs"), ["fn", "cs"], "left_anti")
    leaf_sites = stable(unknown.unionByName(bare).distinct())

    live = args.where("not sanitizer and not server_stream")
    at_leaf = live.join(leaf_sites, ["fn", "cs"])
    to = results.select("fn", "cs", F.col("idx").alias("j"), F.col("vid").alias("dst"))
    field = getter_field(F.col("callee_fqn"), F.col("argc"), F.col("recv"), F.col("resultc")) if options.pb_getters else F.lit(None).cast("string")
    named = F.size("field_names") == F.size("path")
    passes = field.isNull() | ((F.col("idx") == 0) & ((F.size("path") == 0) | ~named | (F.get("field_names", F.lit(0)) == field)))
    is_error = F.expr("j < 63 and (shiftright(error_results, cast(j as int)) & 1) = 1")
    keeps = F.lit(True) if not options.no_error_leaf else ~(is_error & ~F.col("wrapper"))
    leaf = at_leaf.where(passes).join(to, ["fn", "cs"]).where((F.col("j") < F.col("resultc")) & keeps).select("fn", F.col("vid").alias("src"), "dst", F.lit(True).alias("call"))
    rule = po.matches(program.callsite, rules.where("section = 'propagators'")).select("callee_fqn", F.split_part("arg", F.lit(">"), F.lit(1)).alias("frm"), F.explode(F.split(F.split_part("arg", F.lit(">"), F.lit(2)), ",")).alias("spec"))
    fires = at_leaf.join(rule, "callee_fqn").where(F.array_contains(po.ports(F.col("frm"), F.col("argc"), F.col("recv")), F.col("idx").cast("bigint")))
    ends = port.select("fn", "cs", F.col("kind").alias("end_kind"), F.col("idx").alias("end_idx"), F.col("vid").alias("dst"))
    moved = fires.join(ends, ["fn", "cs"]).where(F.when(F.col("spec") == "return", F.col("end_kind") == 7).otherwise((F.col("end_kind") == 6) & F.array_contains(po.ports(F.col("spec"), F.col("argc"), F.col("recv")), F.col("end_idx").cast("bigint")))).select("fn", F.col("vid").alias("src"), "dst", F.lit(True).alias("call"))
    edges = program.edge.select("fn", "src", "dst", F.lit(False).alias("call")).unionByName(leaf).unionByName(moved).distinct()

    # Catalog sinks, and writes of library calls that no rule models.
    admits = F.when(F.col("sink_arg") == "any", True).when(F.col("sink_arg") == "args", ~(F.col("recv") & (F.col("idx") == 0))).when(F.col("sink_arg") == "receiver", F.col("recv") & (F.col("idx") == 0)).otherwise(F.col("sink_arg") == F.col("idx").cast("string"))
    heeded = ~F.col("type").isin(*options.ignore_types) | (F.col("type") == "") if options.ignore_types else F.lit(True)
    sinks = args.where("not sanitizer and sink_class is not null").where(admits & heeded).select("fn", "vid", "cs", F.col("sink_class").alias("class"))
    if options.unmodeled:
        can_write = args.join(program.edge.select("fn", F.col("src").alias("vid")).distinct(), ["fn", "vid"], "left_semi").select("fn", "cs", F.col("idx").alias("w")).distinct()
        writes_args = F.exists("src_specs", lambda s: (s != "return") & (s != ""))
        blind = at_leaf.where("stream_op = 0 and call_kind <> 2 and not modeled").where(~writes_args)
        sinks = sinks.unionByName(blind.join(can_write, ["fn", "cs"]).where("w <> idx").select("fn", "vid", "cs", F.lit(UNMODELED).alias("class")).distinct())

    number = F.col("idx") - F.when(F.col("recv"), 1).otherwise(0)
    is_send = F.col("stream_client") & (F.col("stream_op") == 1) & (F.col("idx") >= 1)
    slot = F.when(is_send, "stream_in").when(F.col("recv") & (F.col("idx") == 0), "receiver").otherwise(F.concat(F.lit("param_"), number.cast("string")))
    calls = program.target.select("fn", "cs", "callee").distinct()
    inputs = live.join(calls, ["fn", "cs"]).select("fn", "vid", "cs", "callee", slot.alias("slot"), F.when(is_send, none).otherwise(F.col("path")).alias("path"), (F.col("call_kind") == 2).alias("remote"))
    lifts = site.where("stream_op = 0 and kind <> 2").join(calls, ["fn", "cs"]).select("fn", F.lit(IN).alias("vid"), "cs", "callee", F.lit("stream_in").alias("slot"), none.alias("path"), F.lit(False).alias("remote"))
    inputs = inputs.unionByName(lifts.crossJoin(F.broadcast(streams)).drop("_any"))  # one row at most

    ret = results.select("fn", "cs", F.concat(F.lit("return_"), F.col("idx").cast("string")).alias("out_slot"), F.col("path").alias("land_path"), "vid")
    back = args.where(~(F.col("recv") & (F.col("idx") == 0))).select("fn", "cs", F.concat(F.lit("byref_"), number.cast("string")).alias("out_slot"), F.col("path").alias("land_path"), "vid")
    me = args.where("recv and idx = 0").select("fn", "cs", F.lit("byref_recv").alias("out_slot"), F.col("path").alias("land_path"), "vid")
    receives = results.where("stream_op = 2 and stream_client and idx = 0").join(calls, ["fn", "cs"]).select("fn", "callee", "vid")
    writes = v.where("kind = 5 and sym <> ''").select("fn", "vid", F.col("sym").alias("cell"), F.col("iface_type").alias("type"), F.col("path").alias("cell_path"))
    return Facts(stable(seeds), stable(out_fact), stable(edges), stable(inputs), stable(ret.unionByName(back).unionByName(me)), stable(sinks.distinct()), stable(writes), stable(receives), leaf_sites)


def _close(rows: pa.Table) -> pa.Table:
    """All that each seed of one function reaches. live: the call rules apply to the port there;
    a port that the run itself was seeded with as written through is no input of its call."""
    tag, a, b, call, seed = (rows[c].to_pylist() for c in ("tag", "a", "b", "call", "seed"))
    local, called = defaultdict(list), defaultdict(list)
    starts: dict[str, list[int]] = defaultdict(list)
    written: dict[str, set[int]] = defaultdict(set)
    for t, x, y, c, s in zip(tag, a, b, call, seed, strict=True):
        if t:
            starts[s].append(x)
            if c:
                written[s].add(x)
        else:
            (called if c else local)[x].append(y)
    out_seed, out_vid, out_live = [], [], []
    for s, vids in starts.items():
        seen, work = set(vids), deque(vids)
        dead = written[s]
        while work:
            x = work.popleft()
            for y in local[x] if x in dead else [*local[x], *called[x]]:
                if y not in seen:
                    seen.add(y)
                    work.append(y)
        out_seed += [s] * len(seen)
        out_vid += seen
        out_live += [x not in dead for x in seen]
    fn = rows["fn"][0].as_py()
    return pa.table({"fn": pa.array([fn] * len(out_vid), pa.string()), "seed": pa.array(out_seed, pa.string()), "vid": pa.array(out_vid, pa.int32()), "live": pa.array(out_live, pa.bool_())})


def close(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """reach(fn, seed, vid, live), each function's body closed in one task."""
    e = edges.select("fn", F.lit(0).alias("tag"), F.col("src").cast("int").alias("a"), F.col("dst").cast("int").alias("b"), "call", F.lit("").alias("seed"))
    s = seeds.select("fn", F.lit(1).alias("tag"), F.col("vid").cast("int").alias("a"), F.lit(0).alias("b"), F.col("wb").alias("call"), "seed")
    return e.join(seeds.select("fn").distinct(), "fn", "left_semi").unionByName(s).groupBy("fn").applyInArrow(_close, "fn string, seed string, vid int, live boolean")


def view_slot(slot: Column, side: str) -> Column:
    """A handler's slot as its contract shows it (null: not at all), by the contract's columns."""
    number = F.regexp_extract(slot, "^param_([0-9]+)$", 1)
    is_param, p = number != "", F.when(number != "", number.cast("int"))
    byref, ret = slot.startswith("byref_"), slot.startswith("return_")
    streamed = F.col("client_streaming") | F.col("server_streaming")
    if side == "in":
        grpc = F.when(~streamed, slot).when(is_param, F.when((p == 0) & F.col("server_streaming") & ~F.col("client_streaming"), "param_1")).when(slot != "receiver", slot)
        place = F.array_position("gql_param_idx", p)
        gql = F.when(is_param, F.when(place > 0, F.concat(F.lit("param_"), (place - 1).cast("string")))).when((slot != "receiver") & ~byref, slot)
        http = F.when(is_param, F.when(F.array_contains("request_params", p), "param_0")).when((slot != "receiver") & ~byref, slot)
    else:
        grpc = F.when(~streamed | ~ret, slot)
        gql = F.when(ret, F.when(slot == "return_0", slot)).when(~byref, slot)
        http = F.when(~ret & ~byref & ~slot.startswith("field_"), slot)
    return F.when(F.col("kind") == 0, grpc).when(F.col("kind") == 1, gql).otherwise(http)


def viewed_flows(flows: DataFrame, contract: DataFrame) -> DataFrame:
    """The flows of handlers as flows of their contracts; several handlers' views are united."""
    own = flows.join(contract.withColumnRenamed("iid", "_iid"), F.col("fn") == F.col("handler"))
    own = own.withColumn("_i", view_slot(F.col("in_slot"), "in")).withColumn("_o", view_slot(F.col("out_slot"), "out")).where("_i is not null and _o is not null")
    return own.select(F.col("_iid").alias("fn"), F.col("_i").alias("in_slot"), "in_path", F.col("_o").alias("out_slot"), "out_path").distinct()


def viewed_hits(hits: DataFrame, contract: DataFrame) -> DataFrame:
    own = hits.join(contract.withColumnRenamed("iid", "_iid"), F.col("fn") == F.col("handler")).withColumn("_i", view_slot(F.col("in_slot"), "in")).where("_i is not null")
    rest = [c for c in hits.columns if c not in ("fn", "in_slot")]
    return own.select(F.col("_iid").alias("fn"), F.col("_i").alias("in_slot"), *rest).distinct()


def _flows(reach: DataFrame, facts: Facts) -> DataFrame:
    return reach.join(facts.out_fact, ["fn", "vid"]).select("fn", slot_base(F.col("seed")).alias("in_slot"), slot_path(F.col("seed")).alias("in_path"), "out_slot", "out_path").distinct()


def _edges_of(flows: DataFrame, facts: Facts) -> DataFrame:
    """What summary rows add to their callers' edges."""
    f = flows.withColumnRenamed("fn", "callee").withColumnRenamed("in_slot", "slot")
    used = facts.inputs.join(f, ["callee", "slot"]).where(paths_comparable(F.col("path"), F.col("in_path"))).select("fn", F.col("vid").alias("src"), "cs", "callee", "remote", "out_slot", "out_path")
    landed = used.join(facts.landing, ["fn", "cs", "out_slot"]).where(paths_comparable(F.col("out_path"), F.col("land_path"))).select("fn", "src", F.col("vid").alias("dst"))
    streamed = used.where("out_slot = 'stream_out'")
    heard = streamed.where("remote").join(facts.receives, ["fn", "callee"]).select("fn", "src", F.col("vid").alias("dst"))
    sent = streamed.where("not remote").select("fn", "src", F.lit(OUT).alias("dst"))
    return landed.unionByName(heard).unionByName(sent).select("fn", "src", "dst", F.lit(True).alias("call")).distinct()


def summarise(facts: Facts, contract: DataFrame | None, given: DataFrame | None = None, rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(reach, flows) of the facts' functions at the least fixpoint; given: flows of others that are settled."""
    known = Known(facts.edges.sparkSession, facts.edges.schema)
    known.add(facts.edges)
    if given is not None:
        known.add(_edges_of(given, facts).join(known.rows(), ["fn", "src", "dst", "call"], "left_anti"))
    reach = stable(close(known.rows(), facts.seeds))
    for _ in range(rounds):
        flows = _flows(reach, facts)
        if contract is not None:
            flows = flows.unionByName(viewed_flows(flows, contract))
        flows = stable(flows.distinct())
        new = known.add(_edges_of(flows, facts).join(known.rows(), ["fn", "src", "dst", "call"], "left_anti"))
        if new.isEmpty():
            return reach, flows
        changed = new.select("fn").distinct()
        again = close(known.rows().join(changed, "fn", "left_semi"), facts.seeds.join(changed, "fn", "left_semi"))
        reach = stable(reach.join(changed, "fn", "left_anti").unionByName(again))
    raise RuntimeError("summaries did not settle")


def dirty(program: Program, changed: DataFrame) -> DataFrame:
    """(iid) of the changed functions and all, contracts included, whose summary may rest on one of them."""
    back = program.target.select(F.col("callee").alias("src"), F.col("fn").alias("dst"))
    if program.contract is not None:
        back = back.unionByName(program.contract.select(F.col("handler").alias("src"), F.col("iid").alias("dst")))
    return closure(changed.select(F.col("iid").alias("node")).distinct(), back.distinct(), []).select(F.col("node").alias("iid"))


def resummarise(facts: Facts, program: Program, changed: DataFrame, reach: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reach, flows) of a program after a change, from those before it.

    facts are the changed program's, changed(iid) names functions that are new, gone or
    different, or whose contracts are. A summary rests on its callees alone, so only functions
    above a changed one are closed again; the others keep their rows.
    """
    # Stream ports of helpers come and go with the program's first stream call, wherever that is.
    was = reach.select("fn", "seed").distinct()
    moved = facts.seeds.join(reach, ["fn", "seed", "vid"], "left_anti").select("fn").unionByName(was.join(facts.seeds, ["fn", "seed"], "left_anti").select("fn"))
    stale = stable(dirty(program, changed.select("iid").unionByName(moved.select(F.col("fn").alias("iid")))).select(F.col("iid").alias("fn")))
    clean = stable(flows.join(stale, "fn", "left_anti"))
    if program.contract is not None:  # a contract of several handlers keeps what the clean ones show
        clean = stable(clean.unionByName(viewed_flows(clean, program.contract)).distinct())
    own = {n: getattr(facts, n) for n in Facts.__dataclass_fields__}
    mine = Facts(**{n: stable(df.join(stale, "fn", "left_semi")) for n, df in own.items()})
    new_reach, new_flows = summarise(mine, program.contract, clean)
    kept = reach.join(stale, "fn", "left_anti")
    return stable(kept.unionByName(new_reach)), stable(clean.unionByName(new_flows).distinct())


HIT = ["fn", "in_slot", "in_path", "class", "cs", "term_fn", "term_cs", "via"]


def find_hits(reach: DataFrame, facts: Facts, contract: DataFrame | None, heap: DataFrame | None, rounds: int = 1000) -> DataFrame:
    """steps: hits with the vertex, callee and callee slot that they came by; base hits have callee ''."""
    seed = [slot_base(F.col("seed")).alias("in_slot"), slot_path(F.col("seed")).alias("in_path")]
    live = stable(reach.where("live"))
    base = live.join(facts.sinks, ["fn", "vid"]).select("fn", *seed, "class", "cs", F.col("fn").alias("term_fn"), F.col("cs").alias("term_cs"), F.lit("").alias("via"), "vid", F.lit("").alias("callee"), F.lit("").alias("through"))
    if heap is not None:
        written = reach.join(facts.writes, ["fn", "vid"]).join(heap, "cell").where("assert_type = '' or type = '' or assert_type = type")
        base = base.unionByName(written.select("fn", *seed, "class", F.lit(-1).cast("int").alias("cs"), "term_fn", "term_cs", F.concat_ws("|", "cell", "reader").alias("via"), "vid", F.lit("").alias("callee"), F.lit("").alias("through")))
    use = live.join(facts.inputs, ["fn", "vid"]).select("fn", *seed, "cs", "vid", "callee", "slot", "path")
    use = stable(use)
    base = base.distinct()
    known = Known(base.sparkSession, base.schema)
    new = known.add(base)
    for _ in range(rounds):
        hit = new.select(*HIT).distinct()
        if contract is not None:
            hit = hit.unionByName(viewed_hits(hit, contract))
        h = hit.select(F.col("fn").alias("callee"), F.col("in_slot").alias("slot"), F.col("in_path").alias("_path"), "class", "term_fn", "term_cs", "via")
        more = use.join(h, ["callee", "slot"]).where(paths_comparable(F.col("path"), F.col("_path")))
        more = more.select("fn", "in_slot", "in_path", "class", "cs", "term_fn", "term_cs", "via", "vid", "callee", slot_text(F.col("slot"), F.col("_path")).alias("through")).distinct()
        new = known.add(more.join(known.rows(), more.columns, "left_anti"))
        if new.isEmpty():
            return known.rows()
    raise RuntimeError("hits did not settle")


def cell_hits(flows: DataFrame, hits: DataFrame, rounds: int = 1000) -> DataFrame:
    """heap(cell, class, reader, reader_slot, assert_type, term_fn, term_cs): sinks that a write to the cell reaches.

    Readers are keyed by global slots; a cell that is copied to another reaches its sinks too,
    the reader's type assertion being about the other cell. A sink counts for a cell only if
    some write of the cell overlaps the path that its reader reads.
    """
    split = lambda c, i: F.coalesce(F.get(F.split(F.regexp_replace(c, "^global_", ""), "@"), F.lit(i)), F.lit(""))
    is_cell = lambda c: F.col(c).startswith("global_")
    direct = hits.where("via = ''").where(is_cell("in_slot")).select(split(F.col("in_slot"), 0).alias("cell"), "class", F.col("fn").alias("reader"), slot_text(F.col("in_slot"), F.col("in_path")).alias("reader_slot"), split(F.col("in_slot"), 1).alias("assert_type"), "term_fn", "term_cs")
    copies = flows.where(is_cell("in_slot") & is_cell("out_slot")).select(split(F.col("in_slot"), 0).alias("src"), split(F.col("out_slot"), 0).alias("cell")).distinct()
    written = flows.where(is_cell("out_slot")).select(split(F.col("out_slot"), 0).alias("cell"), "out_path").distinct()
    direct = direct.distinct()
    known = Known(direct.sparkSession, direct.schema)
    new = known.add(direct)
    copies = stable(copies)
    for _ in range(rounds):
        more = new.join(copies, "cell").select(F.col("src").alias("cell"), "class", "reader", "reader_slot", F.lit("").alias("assert_type"), "term_fn", "term_cs").distinct()
        new = known.add(more.join(known.rows(), more.columns, "left_anti"))
        if new.isEmpty():
            break
    else:
        raise RuntimeError("cells did not settle")
    found = known.rows()
    fits = paths_comparable(F.col("out_path"), slot_path(F.col("reader_slot")))
    return found.join(written, "cell").where(fits).select(*found.columns).distinct()


def analyse(program: Program, rules: DataFrame, options: Options | None = None, before: Result | None = None, changed: DataFrame | None = None) -> Result:
    """Summaries and hits, in three strata: without contracts; cells from their result; all together.

    before and changed(iid): the result of the program before a change under the same rules and options, and
    what the change touched; summaries of functions that rest on none of it are taken over.
    """
    options = options or Options()

    def final(facts: Facts) -> tuple[DataFrame, DataFrame]:
        return summarise(facts, program.contract) if before is None else resummarise(facts, program, changed, before.reach, before.flows)

    facts = static_facts(program, rules, options, contracts=False)
    heap = reach = flows = None
    if not facts.writes.isEmpty():
        reach, flows = summarise(facts, None) if program.contract is not None else final(facts)
        heap = stable(cell_hits(flows, find_hits(reach, facts, None, None).select(*HIT).distinct()))
    if program.contract is not None:
        facts = static_facts(program, rules, options, contracts=True)
        reach, flows = final(facts)
    elif reach is None:
        reach, flows = final(facts)
    steps = find_hits(reach, facts, program.contract, heap)
    hits = steps.select(*HIT).distinct()
    if program.contract is not None:
        hits = hits.unionByName(viewed_hits(hits, program.contract))
    return Result(flows, hits, steps, reach, facts)
