"""Literal programs with the results their semantics ask for."""

import pytest
from pyspark.sql import functions as F

from rillgraph.functions.scalars import slot_text
from rillgraph.operators import policy as po
from rillgraph.operators import store
from rillgraph.plans import chains
from rillgraph.plans.taint import Options, analyse, dirty
from tests.program import Builder

SQLI = [("sinks", 0, "sqli", "db.Exec", None, "any")]
EXEC = {"callee": "db.Exec", "argc": 1}


@pytest.fixture(scope="module", autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark, builder, rules=SQLI, **options):
    program = builder.build(spark)
    return program, analyse(program, spark.createDataFrame(rules, po.SCHEMA), Options(**options))


def hits(result, fn):
    rows = result.hits.where(F.col("fn") == fn).select(slot_text(F.col("in_slot"), F.col("in_path")).alias("s"), "class", "cs", "term_fn", "term_cs").distinct().collect()
    return {(r.s, r["class"], r.cs, r.term_fn, r.term_cs) for r in rows}


def flows(result, fn):
    rows = result.flows.where(F.col("fn") == fn).select(slot_text(F.col("in_slot"), F.col("in_path")).alias("i"), slot_text(F.col("out_slot"), F.col("out_path")).alias("o")).collect()
    return {(r.i, r.o) for r in rows}


def test_callee_sink_and_flow(spark):
    b = Builder().function("B", ["P0->A0@0"], [EXEC]).function("A", ["P0->A0@0", "R0@0->ret0"], [{"targets": ["B"], "resultc": 1}])
    _, r = run(spark, b)
    assert hits(r, "A") == {("param_0", "sqli", 0, "B", 0)} and flows(r, "A") == set()


@pytest.mark.parametrize("path,hit", [("[3]", True), ("", True), ("[3,1]", True), ("[7]", False)])
def test_field_paths_must_be_comparable(spark, path, hit):
    b = Builder().function("B", ["P0[3]->A0@0"], [EXEC], only=["P0"]).function("A", [f"P0->A0@0{path}"], [{"targets": ["B"]}])
    assert bool(hits(run(spark, b)[1], "A")) == hit


def test_returned_field_lands_on_its_variants(spark):
    b = Builder().function("B", ["P0->ret0[3]"])
    b.function("A", ["P0->A0@0", "R0@0[3]->A0@1", "R0@0[7]->A0@2"], [{"targets": ["B"], "resultc": 1}, EXEC, EXEC], only=["R0@0"])
    assert {h[2] for h in hits(run(spark, b)[1], "A")} == {1}


@pytest.mark.parametrize("targets,leaf", [(["A1", "B1"], True), (["A1", "A2"], False), (["A1"], False), ([], True)])
def test_leaf_is_per_unknown_target(spark, targets, leaf):
    b = Builder().function("A1", has_flow=False).function("A2", has_flow=False)
    b.function("C", ["P0->A0@0", "R0@0->A0@1"], [{"targets": targets, "resultc": 1}, EXEC])
    assert bool(hits(run(spark, b)[1], "C")) == leaf


def test_error_results(spark):
    def sites(callee, **options):
        b = Builder().function("A", ["P0->A0@0", "R0@0->A0@1", "R1@0->A0@2"], [{"callee": callee, "resultc": 2, "errors": 2}, EXEC, EXEC])
        return {h[2] for h in hits(run(spark, b, [*SQLI, ("error_wrappers", 0, "w", "fmt.Errorf", None, "any")], **options)[1], "A")}

    assert sites("x.Do") == {1, 2} and sites("x.Do", no_error_leaf=True) == {1} and sites("fmt.Errorf", no_error_leaf=True) == {1, 2}


def test_recursion(spark):
    me = {"targets": ["F"], "argc": 2, "resultc": 1}
    b = Builder().function("F", ["P0->A1@0", "R0@0->ret0", "P1->ret0"], [me])
    assert flows(run(spark, b)[1], "F") == {("param_0", "return_0"), ("param_1", "return_0")}
    b = Builder().function("F", ["P1->A0@0", "P1->A0@1", "P0->A1@1"], [EXEC, me])
    assert {h[0] for h in hits(run(spark, b)[1], "F")} == {"param_0", "param_1"}
    b = Builder().function("F", ["P0->A0@0", "P0->A0@1"], [EXEC, {"targets": ["F"]}])
    assert hits(run(spark, b)[1], "F") == {("param_0", "sqli", 0, "F", 0), ("param_0", "sqli", 1, "F", 0)}


def test_propagators_and_unmodeled_writes(spark):
    def builder():
        write = {"callee": "(*strings.Builder).WriteString", "argc": 2, "resultc": 2, "recv": True}
        text = {"callee": "(*strings.Builder).String", "argc": 1, "resultc": 1, "recv": True}
        return Builder().function("A", ["P0->A1@0", "A0@0->A0@1", "R0@1->A0@2"], [write, text, EXEC])

    rule = lambda to: [*SQLI, ("propagators", 0, "w", "WriteString", None, f"1>{to}")]
    assert hits(run(spark, builder())[1], "A") == set()
    assert {h[:2] for h in hits(run(spark, builder(), rule("receiver"))[1], "A")} == {("param_0", "sqli")}
    assert {h[:2] for h in hits(run(spark, builder(), unmodeled=True)[1], "A")} == {("param_0", "unmodeled-write")}
    assert hits(run(spark, builder(), rule("none"), unmodeled=True)[1], "A") == set()


def test_by_reference_sources(spark):
    bind = {"callee": "(*g.Context).ShouldBindJSON", "argc": 2, "resultc": 1, "recv": True}
    flow = ["P0->A0@0", "A1@0->A0@1"]
    src = lambda to: [*SQLI, ("sources", 0, "http", "ShouldBindJSON", None, to)]
    b = Builder().function("A", flow, [bind, EXEC], only=["R0@0"])
    assert not any(h[0] == "source" for h in hits(run(spark, b, src("return"))[1], "A"))
    assert {h[:3] for h in hits(run(spark, b, src("1"))[1], "A") if h[0] == "source"} == {("source", "sqli", 1)}
    b = Builder().function("A", ["P0->A0@0", "R0@0->A0@1"], [bind, EXEC], only=["A1@0"])
    assert {h[0] for h in hits(run(spark, b, src("1"))[1], "A")} == {"param_0"}


def test_sanitizers_sink_arguments_and_source_parameters(spark):
    b = Builder().function("A", ["P0->A0@0", "R0@0->A0@1"], [{"callee": "html.Escape", "resultc": 1}, EXEC])
    assert hits(run(spark, b, [*SQLI, ("sanitizers", 0, "e", "Escape", None, "any")])[1], "A") == set()
    one = [("sinks", 0, "sqli", "db.Exec", None, "1")]
    wide = {"callee": "db.Exec", "argc": 2}
    assert len(hits(run(spark, Builder().function("A", ["P0->A1@0"], [wide]), one)[1], "A")) == 1
    assert hits(run(spark, Builder().function("A", ["P0->A0@0"], [wide]), one)[1], "A") == set()
    b = Builder().function("A", ["P1->A0@0"], [EXEC], sources=[1], only=["P0"])
    assert "source" in {h[0] for h in hits(run(spark, b)[1], "A")}
    b = Builder().function("A", ["P0->A0@0"], [EXEC], sources=[1], only=["P1"])
    assert "source" not in {h[0] for h in hits(run(spark, b)[1], "A")}
    b = Builder().function("A", ["P0->A0@0"], [EXEC], types={"A0@0": "context.Context"})
    assert hits(run(spark, b, ignore_types=("context.Context",))[1], "A") == set()


def test_server_and_client_streams(spark):
    recv = {"kind": 2, "stream": 2, "argc": 1, "resultc": 2, "recv": True, "targets": ["K"]}
    send = {"kind": 2, "stream": 1, "argc": 2, "resultc": 1, "recv": True, "targets": ["K"]}
    b = Builder().function("H", ["R0@0->A0@1"], [recv, EXEC])
    assert {h[0] for h in hits(run(spark, b)[1], "H")} == {"source", "stream_in"}
    b = Builder().function("H", ["P0->A1@0"], [send])
    assert ("param_0", "stream_out") in flows(run(spark, b)[1], "H")
    helper = Builder().function("S", ["P1->A1@0"], [send]).function("H", ["P0->A1@0", "P1->A0@0"], [{"targets": ["S"], "argc": 2}])
    assert ("param_0", "stream_out") in flows(run(spark, helper)[1], "H")
    lifted = Builder().function("S", ["R0@0->ret0", "R0@0->A0@1"], [recv, EXEC]).function("H", ["R0@0->A0@1"], [{"targets": ["S"], "argc": 0, "resultc": 1}, EXEC])
    assert len([h for h in hits(run(spark, lifted)[1], "H") if h[0] == "stream_in"]) >= 2


def test_contract_views(spark):
    remote = {"kind": 2, "targets": ["K"], "argc": 2, "resultc": 1}
    b = Builder().function("H", ["P1->A0@0"], [EXEC]).contract("K", "H").function("R", ["P0->A1@0", "R0@0->ret0"], [remote])
    _, r = run(spark, b)
    assert hits(r, "R") == {("param_0", "sqli", 0, "H", 0)} and flows(r, "R") == set()
    b = Builder().function("H", ["P0[3,1]->A0@0"], [EXEC]).contract("K", "H", server=True)
    assert {h[0] for h in hits(run(spark, b)[1], "K")} == {"param_1[3,1]"}
    b = Builder().function("H", ["P2->ret0", "P3->ret1", "P1->ret0", "P0->ret0", "P3->A0@0", "P0->A0@0"], [EXEC]).contract("K", "H", kind=1, gql=[2, 3])
    _, r = run(spark, b)
    assert flows(r, "K") == {("param_0", "return_0")} and {h[0] for h in hits(r, "K")} == {"param_1"}
    b = Builder().function("H", ["P0->A0@0", "P1->A0@0", "P2->A0@0", "P0->F0{ab}"], [EXEC], sources=[0]).contract("K", "H", kind=2, params=[0, 1])
    _, r = run(spark, b)
    assert {h[0] for h in hits(r, "K")} == {"param_0", "source"} and ("param_0", "global_ab") in flows(r, "K")


def test_contracts_chain_and_cycle(spark):
    call = lambda k: {"kind": 2, "targets": [k], "argc": 2}
    b = Builder().function("R", ["P0->A1@0"], [call("C1")]).function("H1", ["P1->A1@0"], [call("C2")]).function("H2", ["P1->A0@0"], [EXEC])
    b.contract("C1", "H1").contract("C2", "H2")
    _, r = run(spark, b)
    assert {h[0] for h in hits(r, "H1")} == {"param_1"} and {h[0] for h in hits(r, "R")} == {"param_0"}
    b = Builder().function("R", ["P0->A1@0"], [call("CA")]).function("HA", ["P1->A1@0"], [call("CB")])
    b.function("HB", ["P1->A1@0", "P1->A0@1"], [call("CA"), EXEC]).contract("CA", "HA").contract("CB", "HB")
    _, r = run(spark, b)
    assert {h[3:] for f in ("R", "HA", "HB") for h in hits(r, f)} == {("HB", 1)}


def test_cells(spark):
    b = Builder().function("W", ["P1->F0{c}"]).function("R", ["G0{c}->A0@0"], [EXEC])
    _, r = run(spark, b)
    assert {h[0] for h in hits(r, "W")} == {"param_1"} and {h[3] for h in hits(r, "W")} == {"R"}
    b = Builder().function("W", ["P1->F0{c1}"]).function("M", ["G0{c1}->F0{c2}"]).function("R", ["G0{c2}->A0@0"], [EXEC])
    assert {h[0] for h in hits(run(spark, b)[1], "W")} == {"param_1"}
    b = Builder().function("W", ["P1->F0{c}[0]"]).function("R", ["G0{c}[1]->A0@0"], [EXEC])
    assert hits(run(spark, b)[1], "W") == set()
    for written, read, found in (("T", "T", True), ("U", "T", False), ("", "T", True), ("T", "", True)):
        b = Builder().function("W", [f"P1->F0{{c:{written}}}"]).function("R", [f"G0{{c:{read}}}->A0@0"], [EXEC])
        assert bool(hits(run(spark, b)[1], "W")) == found, (written, read)


def test_getter_projects_one_field(spark):
    rules = [*SQLI]
    get = {"callee": "(*example.com/api/pb.Request).GetId", "argc": 1, "resultc": 1, "recv": True}
    for field, found in (("Id", True), ("Amount", False)):
        b = Builder().function("A", ["P0->A0@0[2]", "R0@0->A0@1"], [get, EXEC], names={"A0@0[2]": [field]})
        assert bool(hits(run(spark, b, rules, pb_getters=True)[1], "A")) == found


def test_chains_and_routes(spark):
    b = Builder().function("S", ["R0@0->A0@1"], [{"callee": "http.Form", "argc": 0, "resultc": 1}, {"callee": "M", "targets": ["M"], "conf": 0.5}])
    b.function("M", ["P0->A0@0"], [{"callee": "L", "targets": ["L"]}]).function("L", ["P0->A0@0"], [EXEC])
    program, r = run(spark, b, [*SQLI, ("sources", 0, "http", "http.Form", None, "return")])
    found = chains.chains(r, program).collect()
    assert [(c.fn, c["class"], c.cs, c.term_fn, c.term_cs) for c in found] == [("S", "sqli", 1, "L", 0)]
    route = chains.routes(r, program).collect()
    assert [(x.hops, x.confidence) for x in route] == [(["S#1#M", "M#0#L", "L#0#db.Exec"], 0.5)]


def test_route_that_enters_a_function_twice_through_different_slots(spark):
    # B hands its first parameter on to its own second one, which is sunk.
    b = Builder().function("A", ["R0@0->A0@1"], [{"callee": "http.Form", "argc": 0, "resultc": 1}, {"callee": "B", "targets": ["B"], "argc": 2}])
    b.function("B", ["P0->A1@0", "P1->A0@1"], [{"callee": "B", "targets": ["B"], "argc": 2}, EXEC])
    program, r = run(spark, b, [*SQLI, ("sources", 0, "http", "http.Form", None, "return")])
    assert [(c.fn, c.term_fn, c.term_cs) for c in chains.chains(r, program).collect()] == [("A", "B", 1)]
    assert [x.hops for x in chains.routes(r, program).collect()] == [["A#1#B", "B#0#B", "B#1#db.Exec"]]


def test_queries_follow_calls_of_any_depth(spark, tmp_path):
    import random

    from rillgraph.queries import taint as queries

    rng = random.Random(3)
    sites = {u: rng.choices(["signup", "click", "view", "purchase", "error"], [2, 5, 2, 3, 0.3], k=5) for u in range(1, 9)}
    sites |= {u: ["signup", "click", "purchase"] for u in range(2, 8)}
    rows = [(100 * u + i, u, e, i) for u, own in sites.items() for i, e in enumerate(own)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts long").write.parquet(str(tmp_path / "events.parquet"))
    passes, flows, sinks = {}, set(), set()
    reached = {0: set()}  # the sinks that each user's parameter reaches: (site, user, site there)
    for u, own in sorted(sites.items()):
        calls = [e == "click" and u - 1 in sites for e in own]
        stops = [e == "error" or (c and not passes[u - 1]) for e, c in zip(own, calls, strict=True)]
        passes[u] = not any(stops)
        reached[u] = set()
        for slot, tainted in (("param_0", True), ("source", False)):
            for i, e in enumerate(own):
                found = {(i, u, i)} if e == "purchase" else {(i, *x[1:]) for x in reached[u - 1]} if calls[i] else set()
                if tainted:
                    sinks |= {(f"U{u}", slot, a, f"U{b}", c) for a, b, c in found}
                    if slot == "param_0":
                        reached[u] |= found
                tainted = (tainted and not stops[i]) or (slot == "source" and e == "signup")
            if tainted:
                flows.add((f"U{u}", slot, "return_0"))
    want = {(f, a, b, c) for f, slot, a, b, c in sinks if slot == "source"}
    assert max(int(f[1:]) - int(b[1:]) for f, _, b, _ in want) > 4
    p, r = queries._result(spark, str(tmp_path))
    assert {tuple(x) for x in r.flows.select("fn", slot_text(F.col("in_slot"), F.col("in_path")), slot_text(F.col("out_slot"), F.col("out_path"))).collect()} == flows
    assert {tuple(x) for x in r.hits.select("fn", "in_slot", "cs", "term_fn", "term_cs").collect()} == sinks
    assert {tuple(x) for x in chains.chains(r, p).select("fn", "cs", "term_fn", "term_cs").collect()} == want


def _random_program(rng, names, bodies=None):
    """Functions that pass one of two parameters on to others, some through contracts or a cell."""
    bodies = dict(bodies or {})
    for n in names:
        if n not in bodies:
            callees = rng.choices([*names, *(f"K{x}" for x in names)], k=2)
            flows = rng.sample(["P0->A0@0", "P1->A0@1", "R0@0->ret0", "R0@1->ret0", "R0@0->A0@1", "P0->ret0", "P1->A0@2", "R0@1->A0@2", "R0@3->A0@0", "R0@1->F0{cell}", "G0{cell}->A0@2"], 5)
            bodies[n] = (flows, [{"callee": c, "targets": [c], "resultc": 1, "kind": 2 if c[0] == "K" else 0} for c in callees] + [EXEC, {"callee": "http.Form", "argc": 0, "resultc": 1}])
    b = Builder()
    for n in names:
        b.function(n, *bodies[n])
        b.contract(f"K{n}", n)
    return bodies, b


def test_summaries_after_a_change_equal_those_made_anew(spark):
    """Of six functions one gets another body and one goes; the rest keep what does not rest on them."""
    import random

    rng = random.Random(1)
    names = [f"f{k}" for k in range(6)]
    rules = spark.createDataFrame([*SQLI, ("sources", 0, "http", "http.Form", None, "return")], po.SCHEMA)
    bodies, b = _random_program(rng, names)
    before = analyse(b.build(spark), rules)
    _, b = _random_program(rng, names[:-1], {n: x for n, x in bodies.items() if n != "f3"})
    program = b.build(spark)
    touched = spark.createDataFrame([("f3",), ("f5",), ("Kf5",)], "iid string")
    whole, part = analyse(program, rules), analyse(program, rules, before=before, changed=touched)
    for name in ("flows", "hits", "reach"):
        a, z = (sorted(map(str, getattr(r, name).collect())) for r in (whole, part))
        assert a == z, name


def test_impact_tells_how_a_chain_meets_the_change(spark):
    b = Builder().function("S", ["R0@0->A0@1"], [{"callee": "http.Form", "argc": 0, "resultc": 1}, {"callee": "M", "targets": ["M"]}])
    b.function("M", ["P0->A0@0"], [{"callee": "L", "targets": ["L"]}]).function("L", ["P0->A0@0"], [EXEC])
    program, r = run(spark, b, [*SQLI, ("sources", 0, "http", "http.Form", None, "return")])
    found, way = chains.chains(r, program), chains.routes(r, program)
    how = lambda *ids, **k: [x.via_change for x in store.impact(found, spark.createDataFrame([(i,) for i in ids], "iid string"), **k).collect()]
    assert how("S") == ["source"] and how("L") == ["sink"] and how("S", "L") == ["both"]
    assert how("M") == [] and how("M", routes=way) == ["route"] and how("elsewhere", routes=way) == []
    assert how("elsewhere", up=spark.createDataFrame([("S",)], "node string")) == ["upstream"]
