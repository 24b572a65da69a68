"""Command line: taint, summary, impact and graph-dump over folders of packages, query over persisted graphs."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rillgraph")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("taint", help="findings from sources to sinks")
    t.add_argument("folder", nargs="+")
    t.add_argument("--policy", required=True)
    t.add_argument("--format", choices=("json", "text", "sarif"), default="json")
    t.add_argument("--fail-on", default="")
    t.add_argument("--no-error-leaf", action="store_true")
    t.add_argument("--pb-getters", action="store_true")
    t.add_argument("--no-http-link", action="store_true")
    t.add_argument("--store", help="folder that keeps summaries between runs")
    t.add_argument("--graph", help="folder whose call-graph tables this run's repositories are written to")
    t.add_argument("--backward", action="store_true", help="add each finding's verdict")
    t.add_argument("--prune", action="store_true", help="leave refuted findings out")
    t.add_argument("--unmodeled", action="store_true", help="report library calls that no rule models, on stderr")
    t.add_argument("--unmodeled-report", help="folder that the same report is written to as JSON, whole")
    t.add_argument("--endpoint", help="keep findings whose source function has this in its name")
    t.add_argument("--phases", action="store_true", help="a line per phase on stderr")
    s = sub.add_parser("summary", help="flows and sinks of functions")
    s.add_argument("folder", nargs="+")
    s.add_argument("--policy", required=True)
    s.add_argument("--fn", required=True, help="part of a qualified name")
    i = sub.add_parser("impact", help="what a change of packages does to the findings")
    i.add_argument("before")
    i.add_argument("after")
    i.add_argument("--policy", required=True)
    q = sub.add_parser("query", help="the persisted call graph")
    q.add_argument("what", choices=("blast", "reach", "path"))
    q.add_argument("--graph", required=True)
    q.add_argument("--repo")
    q.add_argument("--file", action="append", default=[])
    q.add_argument("--fn")
    q.add_argument("--from", dest="source")
    q.add_argument("--to")
    q.add_argument("--limit", type=int, default=5)
    q.add_argument("--max-depth", type=int, default=30)
    d = sub.add_parser("graph-dump", help="counts of what was loaded")
    d.add_argument("folder", nargs="+")
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .functions.hashes import namespace
    from .functions.scalars import slot_text
    from .operators import callgraph, persist, render, store
    from .plans import backward, chains
    from .plans.fixpoint import stable
    from .plans.phases import Phases
    from .plans.taint import Options, analyse, dirty
    from .sources import cgf, policy

    spark = SparkSession.builder.appName("rillgraph").getOrCreate()
    if a.command == "graph-dump":
        for r in cgf.dump(cgf.load(spark, a.folder)).orderBy("what").collect():
            print(f"{r.what}: {r.n}")
        return 0
    if a.command == "query":
        nodes, edges = persist.load(spark, a.graph)
        if a.what == "path":
            found = [r.asDict() for r in callgraph.paths(edges, nodes, a.source, a.to, a.limit, a.max_depth).collect()]
        else:
            seeds = callgraph.seeds_by_file(nodes, a.repo, a.file) if a.what == "blast" else callgraph.seeds_by_name(nodes, a.fn, a.repo)
            if a.what == "reach" and seeds.isEmpty():
                print("no function has this in its name", file=sys.stderr)
                return 1
            up = callgraph.upstream(edges, seeds)
            found = {"repos": sorted(r.repo for r in callgraph.repos_of(up, nodes).collect()), "endpoints": sorted(r.full_name for r in callgraph.endpoints_of(up, nodes).collect())}
        sys.stdout.write(json.dumps(found, indent=2) + "\n")
        return 0
    rules = policy.load(a.policy)
    if a.command == "summary":
        program = cgf.program(spark, a.folder)
        result = analyse(program, rules.rules(spark), Options(ignore_types=rules.ignore_types))
        names = program.function.where(F.col("fqn").contains(a.fn)).select(F.col("iid").alias("fn"), "fqn")
        i = slot_text(F.col("in_slot"), F.col("in_path"))
        flows = result.flows.join(names, "fn").select("fqn", F.concat_ws(" -> ", i, slot_text(F.col("out_slot"), F.col("out_path"))).alias("line"))
        sinks = result.hits.join(names, "fn").select("fqn", F.concat_ws(" ", i, F.lit("->"), "class", F.concat_ws(":", "term_fn", F.col("term_cs").cast("string"))).alias("line"))
        for r in flows.unionByName(sinks).distinct().orderBy("fqn", "line").collect():
            print(f"{r.fqn}: {r.line}")
        return 0
    if a.command == "impact":
        old, new = cgf.program(spark, [a.before]), cgf.program(spark, [a.after])
        changes = stable(store.changes(old, new))
        options = Options(ignore_types=rules.ignore_types)
        first = analyse(old, rules.rules(spark), options)
        result = analyse(new, rules.rules(spark), options, before=first, changed=changes)
        nodes, edges = persist.graph(new)
        up = callgraph.upstream(edges, changes.select(F.col("iid").alias("node")))
        hit = store.impact(chains.chains(result, new), changes, up, chains.routes(result, new))
        again = new.function.join(dirty(new, changes), "iid", "left_semi").count()
        report = {
            "changed": [r.asDict() for r in changes.orderBy("iid").collect()],
            "chains": render.rows(hit),
            "repos": sorted(r.repo for r in callgraph.repos_of(up, nodes).collect()),
            "endpoints": sorted(r.full_name for r in callgraph.endpoints_of(up, nodes).collect()),
            "summaries": {"made again": again, "kept": new.function.count() - again},
        }
        sys.stdout.write(json.dumps(report, indent=2, sort_keys=True) + "\n")
        return 0
    wanted = [c for c in a.fail_on.split(",") if c]
    if set(wanted) - rules.sink_classes():
        print("--fail-on names a class that the policy has not", file=sys.stderr)
        return 2
    phases = Phases(a.phases)
    with phases.phase("load", functions=lambda: program.function):
        program = cgf.program(spark, a.folder, link_http=not a.no_http_link)
    if a.graph:
        with phases.phase("persist"):
            persist.save(program, a.graph)
    flags = {"no_error_leaf": a.no_error_leaf, "pb_getters": a.pb_getters, "unmodeled": a.unmodeled or bool(a.unmodeled_report)}
    with phases.phase("analyse", flows=lambda: result.flows, hits=lambda: result.hits):
        result = analyse(program, rules.rules(spark), Options(**flags, ignore_types=rules.ignore_types))
    key = ["fn", "class", "cs", "term_fn", "term_cs"]
    found = chains.chains(result, program)
    if a.endpoint:
        found = found.join(program.function.where(F.col("fqn").contains(a.endpoint)).select(F.col("iid").alias("fn")), "fn", "left_semi")
    if a.backward or a.prune:
        with phases.phase("backward", checked=lambda: checked):
            checked = backward.confirm(found, result, program)
        if a.prune:
            found = backward.prune(found, checked)
        found = found.join(checked, [*key, "via"], "left")
    found = found.join(chains.routes(result, program).select(*key, "hops", "confidence"), key, "left")
    if a.unmodeled:
        for r in chains.unmodeled(result, program).orderBy(F.desc("chains"), "callee_fqn").limit(15).collect():
            print(f"unmodeled: {r.callee_fqn} chains={r.chains} sites={r.sites} sources={r.sources}", file=sys.stderr)
    if a.unmodeled_report:
        chains.unmodeled(result, program).write.mode("overwrite").json(a.unmodeled_report)
    if a.store:
        lines = store.behaviour(store.lines_of(result.flows, result.hits))
        store.save(lines.select("iid", F.col("behaviour").alias("key")), a.store, namespace(rules.digest, flags))
    rows = render.rows(found)
    text = {"json": render.as_json, "text": render.as_text}.get(a.format)
    sys.stdout.write(text(rows) if text else render.as_sarif(rows, rules.severity_of))
    return render.gate(rows, wanted, rules.sink_classes())


if __name__ == "__main__":
    sys.exit(main())
