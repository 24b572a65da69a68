"""Fixpoints, call graph, policy, HTTP linking, cells and names on literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from rillgraph.functions.scalars import canonical_path, compose_path, getter_field, module_of, paths_comparable, residual_after, slot_base, slot_path, slot_text
from rillgraph.operators import callgraph as cg
from rillgraph.operators import heap, httplink, normalize, policy, store
from rillgraph.plans.fixpoint import closure, strongly_connected

VECTORS = {
    "/api/users/{id}": "/api/users/{}", "/api/users/:id": "/api/users/{}", "/api/users/{id:[0-9]+}": "/api/users/{}", "/users/[id]/posts": "/users/{}/posts",
    "/files/{path...}": "/files/{*}", "/static/*filepath": "/static/{*}", "/static/*": "/static/{*}", "/blog/[...slug]": "/blog/{*}", "/docs/[[...slug]]": "/docs/{*}",
    "/a/{*}/b": "/a/{*}", "/users/{$}": "/users", "/v{}.json": "/{}", "https://api.example.com/v1/users?x=1#frag": "/v1/users", "HTTP://localhost:8080": "/",
    "//cdn.example.com/a": "/a", "{}/api/users/{}": "/{}/api/users/{}", "{}": "/{}", "/api//users/": "/api/users", "api/users": "/api/users", "/search?q={}": "/search", "": "/", "/": "/",
}


def test_canonical_paths(spark):
    rows = spark.createDataFrame([(k,) for k in VECTORS], "p string").select("p", canonical_path(F.col("p")).alias("c"), canonical_path(canonical_path(F.col("p"))).alias("cc")).collect()
    assert {r.p: r.c for r in rows} == VECTORS and all(r.c == r.cc for r in rows)


def reachable(edges, start):
    seen, work = set(start), list(start)
    while work:
        x = work.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                work.append(b)
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_closure_and_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(rng.randrange(10, 50))}
    nodes = sorted({x for e in edges for x in e})
    frame = spark.createDataFrame(sorted(edges), "src string, dst string")
    start = spark.createDataFrame([(nodes[0],)], "node string")
    assert {r.node for r in closure(start, frame, []).collect()} == reachable(edges, nodes[:1])
    to = {n: reachable(edges, [n]) for n in nodes}
    want = {n: min(m for m in nodes if m in to[n] and n in to[m]) for n in nodes}
    got = strongly_connected(spark.createDataFrame([(n,) for n in nodes], "node string"), frame)
    assert {r.node: r.scc for r in got.collect()} == want


def graph(spark):
    nodes = [("A", 0, "svc.A", "r1", "x/a.go", 1), ("B", 0, "svc.B", "r1", "/abs/x/b.go", 2), ("K", 2, "api.K", "r2", "", 0), ("H", 0, "srv.H", "r2", "h.go", 3), ("Z", 0, "svc_Z%", "r3", "z.go", 4)]
    edges = [("A", "B", 0), ("B", "K", 3), ("K", "H", 2), ("Z", "A", 0), ("H", "A", 0), ("A", "H", 0), ("A", "M", 3)]
    return spark.createDataFrame(nodes, "node string, kind int, fqn string, repo string, span_file string, line long"), spark.createDataFrame(edges, "src string, dst string, rel int")


def test_call_graph(spark):
    nodes, edges = graph(spark)
    up = cg.upstream(edges, cg.seeds_by_name(nodes, "srv.H"))
    assert {r.node for r in up.collect()} == {"H", "K", "B", "A", "Z"}
    assert {r.repo for r in cg.repos_of(up, nodes).collect()} == {"r1", "r2", "r3"} and [r.full_name for r in cg.endpoints_of(up, nodes).collect()] == ["api.K"]
    assert [r.node for r in cg.seeds_by_file(nodes, "r1", ["x/b.go"]).collect()] == ["B"]
    assert [r.node for r in cg.seeds_by_name(nodes, "_Z%").collect()] == ["Z"] and cg.seeds_by_name(nodes, "srv", "r1").count() == 0
    assert [r.path for r in cg.paths(edges, nodes, "svc.A", "srv.H").collect()] == [["A", "H"], ["A", "B", "K", "H"]]
    assert [r.path for r in cg.paths(edges, nodes, "svc.A", "srv.H", max_depth=2).collect()] == [["A", "H"]]
    assert [r.path for r in cg.paths(edges, nodes, "svc.A", "svc").collect()] == [["A"]]
    assert cg.paths(edges, nodes, "api.K", "svc_Z").count() == 0
    with pytest.raises(LookupError):
        cg.paths(edges, nodes, "nobody", "svc")
    assert [r.iid for r in cg.missing_contracts(edges).collect()] == ["M"]
    assert {(r.repo, r.iid) for r in cg.foreign_contracts(edges, nodes).collect()} == {("r1", "K")}


ROUTES = [("01", "GET", "/api/users/{}"), ("02", "GET", "/api/users/me"), ("03", "POST", "/api/users"), ("04", "*", "/api/users")]
LINKS = [
    ("GET", "/api/users/me", ROUTES, ["02"]), ("POST", "/api/users", ROUTES, ["03"]), ("", "/api/users/{}", ROUTES, ["01"]),
    ("DELETE", "/api/users", [("03", "POST", "/api/users")], []), ("GET", "/api/{}", [("03", "POST", "/api/users")], []),
    ("GET", "/{}/api/users/{}", [("01", "GET", "/api/users/{}"), ("05", "GET", "/v2/api/users/{}")], ["01", "05"]),
    ("GET", "/{}/users", [("01", "GET", "/api/users")], []), ("GET", "/gw/api/users", [("01", "GET", "/api/users")], ["01"]),
    ("GET", "/api/users", [("01", "GET", "/{owner}/{repo}"), ("02", "GET", "/v1/api/users"), ("03", "GET", "/"), ("04", "*", "/")], ["02"]),
    ("GET", "/", [("03", "GET", "/"), ("04", "*", "/")], []),
    ("GET", "/api/users/me", [("01", "GET", "/api/users/{*}"), ("02", "GET", "/api/users/{}")], ["02"]),
    ("GET", "/api/users/me/avatar", [("01", "GET", "/api/users/{*}"), ("02", "GET", "/api/users/{}")], ["01"]),
    ("GET", "/static/js/app.js", [("06", "GET", "/static/{*}"), ("07", "GET", "/{*}")], ["06"]), ("GET", "/api/orders", [("06", "GET", "/static/{*}"), ("07", "GET", "/{*}")], []),
    ("GET", "/{}/api/users/{}", [(f"1{i}", "GET", f"/p{i}/api/users/{{}}") for i in range(5)], []),
    ("GET", "/health/live", [("B1", "GET", "/health/live"), ("B2", "GET", "/health/live")], ["B1", "B2"]),
]


def test_http_links(spark):
    for method, path, routes, want in LINKS:
        linked = httplink.link(spark.createDataFrame([(1, method, path)], "site long, method string, path string"), spark.createDataFrame(routes, "handler string, method string, path string")).collect()
        assert sorted(r.handler for r in linked if r.handler) == want, (method, path)
        assert all(r.confidence == 1 / len(want) for r in linked if r.handler)
        if len(routes) == 5:
            assert [r.kind for r in linked] == ["ambiguous"]


def test_policy_matching(spark):
    rules = spark.createDataFrame([("sinks", 0, "a", "Exec", None, "any"), ("sinks", 1, "b", None, "^db[.]", "9"), ("sinks", 2, "c", "", None, "any"), ("sources", 0, "s", "nope", None, "return"), ("propagators", 0, "p", "Exec", None, "any")], policy.SCHEMA)
    names = spark.createDataFrame([("db.Exec", 2, False), ("db.Query", 1, True), ("x", 0, False)], "callee_fqn string, argc long, recv boolean")
    m = policy.matches(names, rules)
    assert {(r.callee_fqn, r.tag) for r in m.where("section = 'sinks'").collect()} == {("db.Exec", "a"), ("db.Exec", "b"), ("db.Query", "b"), ("db.Exec", "c"), ("db.Query", "c"), ("x", "c")}
    assert {(r.callee_fqn, r.tag) for r in policy.first_matches(m.where("section = 'sinks'")).collect()} == {("db.Exec", "a"), ("db.Query", "b"), ("x", "c")}
    assert [r.tag for r in policy.inert(rules, m).collect()] == ["s"]
    assert [(r.tag, r.widest) for r in policy.argument_range(names, rules, "sinks").collect()] == [("b", 2)]
    assert policy.propagator_fit(rules, m).first()[:] == (1, 1)
    spec = names.select(*[policy.ports(F.lit(s), F.col("argc"), F.col("recv")).alias(s) for s in ("any", "args", "receiver", "return", "0", "1")]).collect()
    assert spec[0][:] == ([0, 1], [0, 1], [], [], [0], [1]) and spec[1][:] == ([0], [], [0], [], [0], []) and spec[2][:] == ([], [], [], [], [], [])


def test_names_of_slots_modules_and_getters(spark):
    one = spark.range(1)
    array = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<int>")
    get = lambda c: one.select(c).first()[0]
    assert get(slot_text(F.lit("param_1"), array(3, 7))) == "param_1[3,7]" and get(slot_base(F.lit("param_1[3,7]"))) == "param_1" and get(slot_path(F.lit("param_1[3,7]"))) == [3, 7] and get(slot_path(F.lit("source"))) == []
    assert get(paths_comparable(array(3), array(3, 1))) and get(paths_comparable(array(), array(7))) and not get(paths_comparable(array(3), array(7)))
    assert get(residual_after(array(3), array(3, 1))) == [1] and get(residual_after(array(3, 1), array(3))) == [] and get(residual_after(array(2), array(3, 1))) == []
    assert get(compose_path(array(1), array(2))) == [1, 2] and get(compose_path(array(1, 2), array(3))) == [1, 2]
    module = lambda s: get(module_of(F.lit(s)))
    assert module("(*github.com/x/y.T).M") == "github.com/x/y" and module("gitlab.example.com/acme/svc/pkg.F") == "gitlab.example.com/acme/svc" and module("fmt.Sprintf") is None and module("func(int) error") == "<dynamic func value>"
    field = lambda s, argc=1: get(getter_field(F.lit(s), F.lit(argc), F.lit(True), F.lit(1)))
    assert field("(*example.com/api/pb.Request).GetId") == "Id" and field("(*example.com/x.Request).GetId") is None and field("(*a/pb.R).Getid") is None and field("(*a/pb.R).GetId", 2) is None


def test_argument_names(spark):
    ports = spark.createDataFrame([("s1", "k", 0, "password"), ("s1", "k", 1, "pincode"), ("s2", "k2", 0, "nope"), ("s2", "k2", 1, "pincode"), ("s3", "none", 0, "a"), ("s1", "k", 2, "")], "site string, contract string, idx int, name string")
    args = spark.createDataFrame([("k", "pincode", 0), ("k", "password", 1), ("k2", "pincode", 0)], "contract string, name string, pos int")
    got = normalize.normalise(ports, args)
    assert {(r.site, r.idx): (r.new_idx, r.state) for r in got.collect()} == {("s1", 0): (1, "named"), ("s1", 1): (0, "named"), ("s1", 2): (2, "unnamed"), ("s2", 0): (1, "dangling"), ("s2", 1): (0, "named"), ("s3", 0): (0, "unknown")}
    assert normalize.census(got).first()[:] == (2, 4, 1)


def test_cells(spark):
    writes = spark.createDataFrame([("c1", "W", "T"), ("c1", "V", ""), ("c2", "X", "U")], "cell string, fn string, type string")
    reads = spark.createDataFrame([("c2", "R", "T", "sqli"), ("c1", "Q", "U", "exec"), ("c1", "P", "", "")], "cell string, fn string, assert_type string, class string")
    sinks = heap.sinks_of_cells(reads, spark.createDataFrame([("c1", "c2"), ("c2", "c1")], "src string, dst string"))
    assert {(r.cell, r.reader, r.assert_type) for r in sinks.collect()} == {("c2", "R", "T"), ("c1", "Q", "U"), ("c1", "R", ""), ("c2", "Q", ""), ("c2", "R", ""), ("c1", "Q", "")}
    assert {(r.fn, r["class"]) for r in heap.heap_hits(writes, sinks).collect()} == {("W", "sqli"), ("W", "exec"), ("V", "sqli"), ("V", "exec"), ("X", "sqli"), ("X", "exec")}
    assert {r.cell: r.dropped for r in heap.drops(writes, sinks).collect()} == {"c1": 1, "c2": 1}
    assert {r.cell: r.reader_fns for r in heap.census(writes, reads, sinks).collect()} == {"c1": 2, "c2": 1}


def test_store_reuse_depends_on_behaviour(spark, tmp_path):
    functions = spark.createDataFrame([("A", "a", []), ("B", "b", [1])], "iid string, bid string, source_params array<int>")
    calls = spark.createDataFrame([("A", "B")], "iid string, callee string")
    seen = lambda *lines: store.behaviour(spark.createDataFrame([("B", x) for x in lines], "iid string, line string"))
    old = store.keys(functions, calls, seen("F:param_0->return_0"))
    assert store.reuse(old, store.keys(functions, calls, seen("F:param_0->return_0", "F:param_0->return_0"))).first()[:] == (2, 0, 100.0)
    body = functions.withColumn("bid", F.when(F.col("iid") == "B", "b2").otherwise(F.col("bid")))
    assert [r.iid for r in store.changed(old, store.keys(body, calls, seen("F:param_0->return_0"))).collect()] == ["B"]
    assert [r.iid for r in store.changed(old, store.keys(functions, calls, seen("F:param_0->return_1"))).collect()] == ["A"]
    for _ in range(2):
        store.save(old, str(tmp_path / "store"), "ns")
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    chains = spark.createDataFrame([("A", "B"), ("C", "D"), ("B", "D")], "fn string, term_fn string")
    hit = store.impact(chains, spark.createDataFrame([("B",)], "iid string"), spark.createDataFrame([("C",)], "node string"))
    assert {(r.fn, r.via_change) for r in hit.collect()} == {("A", "sink"), ("B", "source"), ("C", "upstream")}


def test_registered_paths_go_as_deep_as_their_limit_asks(spark, tmp_path):
    from rillgraph.queries import callgraph as queries

    # P1 -> S1 -> C1 -> P2 -> S2 -> C2: the only customer of the target segment is five calls away.
    tables = {
        "region": ([(0, "r")], "r_regionkey long, r_name string"),
        "nation": ([(0, "n")], "n_nationkey long, n_name string"),
        "customer": ([(1, "HOUSEHOLD", 0), (2, "BUILDING", 0)], "c_custkey long, c_mktsegment string, c_nationkey long"),
        "supplier": ([(1, 0, 1.0), (2, 0, 1.0)], "s_suppkey long, s_nationkey long, s_acctbal double"),
        "part": ([(1, "red widget", "b", "T", 1), (2, "blue bolt", "b", "T", 1)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "orders": ([(1, 1)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(1, 2, 2), (2, 1, 1)], "l_orderkey long, l_partkey long, l_suppkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert [tuple(r) for r in queries.cg_paths(spark, str(tmp_path)).collect()] == [("P1>S1>C1>P2>S2>C2", 6)]
