"""Package files, policies, duplicates, reports and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from rillgraph.__main__ import main
from rillgraph.functions.hashes import hash_bytes
from rillgraph.functions.scalars import hash_parts
from rillgraph.operators import persist, render
from rillgraph.sources import cgf, policy

POLICY = """
sink_ignore_arg_types = ["context.Context"]
[severity]
sqli = "error"
[[sources]]
kind = "http"
selector = "http.Form"
[[sinks]]
class = "sqli"
selector = "db.Exec"
"""


def iid(n):
    return f"{n:02x}" * 32


def function(n, fqn, edges=(), vertices=(), calls=(), **more):
    flow = {"vertices": [dict(v) for v in vertices], "edges": [{"from": a, "to": b} for a, b in edges], "callsites": [{"id": k, **c} for k, c in enumerate(calls)]}
    return {"id": {"iid": iid(n), "bid": iid(n)}, "fqn": fqn, "flow": flow, **more}


def packages():
    v = lambda i, kind, cs=0, index=0: {"id": i, "kind": kind, "callsite_id": cs, "index": index}
    server = function(1, "srv.Get", [(0, 1)], [v(0, 0), v(1, 6)], [{"callee_fqn": "db.Exec", "argc": 1}])
    client = function(2, "app.Call", [(0, 1)], [v(0, 7, 0), v(1, 6, 1)], [{"callee_fqn": "http.Form", "resultc": 1}, {"callee_fqn": "fetch", "argc": 1, "http_call": {"method": "GET", "path": "/api/users/{}"}}])
    route = {"iid": iid(9), "method": "GET", "path": "/api/users/{}", "display": "/api/users/{id}", "handler": iid(1), "request_params": [0], "framework": "chi"}
    return {"repo": "srv", "functions": [server], "http": [route], "endpoints": [{"iid": iid(9), "kind": 2, "name": "users"}]}, {"repo": "app", "language": "ts", "functions": [client]}


@pytest.fixture()
def folder(tmp_path):
    for k, p in enumerate(packages()):
        (tmp_path / f"{k}.pb").write_bytes(cgf.encode(p))
    (tmp_path / "policy.toml").write_text(POLICY)
    return tmp_path


def test_round_trip_of_messages():
    for p in packages():
        once = cgf.decode(cgf.encode(p))
        assert cgf.decode(cgf.encode(once)) == once and once["repo"] == p["repo"]
    with pytest.raises(ValueError):
        cgf.decode(cgf.encode(packages()[0])[:-3])
    assert cgf.decode(b"\xa2\x06\x03abc" + cgf.encode({"repo": "r"}))["repo"] == "r"  # a field it does not know


def test_http_linked_finding_from_files(spark, folder, capsys):
    assert main(["taint", str(folder), "--policy", str(folder / "policy.toml"), "--fail-on", "sqli"]) == 3
    found = json.loads(capsys.readouterr().out)
    assert [(f["fn"], f["term_fn"], f["class"], len(f["hops"])) for f in found] == [(iid(2), iid(1), "sqli", 2)]
    assert main(["taint", str(folder), "--policy", str(folder / "policy.toml"), "--no-http-link", "--format", "text"]) == 0
    assert "no findings" in capsys.readouterr().out
    assert main(["taint", str(folder), "--policy", str(folder / "policy.toml"), "--fail-on", "nope"]) == 2
    assert main(["graph-dump", str(folder)]) == 0
    assert "contracts http: 1" in capsys.readouterr().out


def test_persisted_graph_and_verdicts(spark, folder, capsys):
    graph = str(folder / "graph")
    run = lambda *more: main(["taint", str(folder), "--policy", str(folder / "policy.toml"), *more])
    for _ in range(2):
        assert run("--graph", graph, "--backward", "--phases") == 0
    out, err = capsys.readouterr()
    assert '"verdict": "confirmed"' in out and '"phase": "analyse"' in err
    assert main(["query", "reach", "--graph", graph, "--fn", "srv.Get"]) == 0
    assert json.loads(capsys.readouterr().out) == {"repos": ["app", "srv"], "endpoints": ["http GET /api/users/{id} (chi)"]}
    assert main(["query", "path", "--graph", graph, "--from", "app.Call", "--to", "srv.Get"]) == 0
    assert [p["path"] for p in json.loads(capsys.readouterr().out)] == [[iid(2), iid(9), iid(1)]]
    assert main(["query", "reach", "--graph", graph, "--fn", "nobody"]) == 1
    capsys.readouterr()
    assert main(["summary", str(folder), "--policy", str(folder / "policy.toml"), "--fn", "srv"]) == 0
    assert capsys.readouterr().out == f"srv.Get: param_0 -> sqli {iid(1)}:0\n"


def test_empty_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        cgf.load(spark, [str(tmp_path)])


def test_duplicate_functions(spark):
    rows = [("f", "b", True, "02"), ("f", "a", True, "02"), ("g", "z", False, "09"), ("g", "y", True, "01"), ("h", "r", True, "01"), ("h", "q", True, "05")]
    frame = spark.createDataFrame(rows, "iid string, repo string, has_flow boolean, content string")
    one, copies = cgf.resolve_duplicates(frame)
    assert {(r.iid, r.repo) for r in one.collect()} == {("f", "a"), ("g", "y"), ("h", "q")}
    assert {(r.iid, r.differ) for r in copies.collect()} == {("f", False), ("g", True), ("h", True)}


def test_shared_route_ids_are_keyed_by_handler(spark):
    rows = [(iid(8), 2, iid(1)), (iid(8), 2, iid(2)), (iid(7), 0, iid(1)), ("", 0, iid(1)), (iid(6), 2, iid(3))]
    got = cgf.keyed_contracts(spark.createDataFrame(rows, "iid string, kind int, handler string")).collect()
    assert len(got) == 4 and len({r.iid for r in got}) == 4
    want = hash_bytes(b"http-route", bytes.fromhex(iid(8)), bytes.fromhex(iid(1)))
    assert want in {r.iid for r in got}


def test_hash_parts_of_both_sides(spark):
    row = spark.createDataFrame([("", "é", "abc" * 100)], "a string, b string, c string").select(hash_parts(F.col("a"), F.col("b"), F.col("c"))).first()
    assert row[0] == hash_bytes(b"", "é".encode(), b"abc" * 100)


def test_policies_are_checked():
    p = policy.parse(POLICY)
    assert p.sink_classes() == {"sqli"} and p.severity_of("sqli") == "error" and p.severity_of("x") == "warning" and p.ignore_types == ("context.Context",)
    for bad in ('[[sinks]]\nclass = "a"', '[[sinks]]\nselector = "a"\narg = "x"', '[[sinks]]\nselector = "a"\nto = "1"', '[[sources]]\nselector = "a"\nto = "left"', '[[sources]]\nselector_regex = "("', '[severity]\na = "bad"'):
        with pytest.raises(policy.PolicyError):
            policy.parse(bad)


def test_sarif_and_gate():
    found = [{"repo": "r", "fn": "f", "class": "sqli", "cs": 1, "term_fn": "g", "term_cs": 0, "hops": ["f#1#g", "g#0#db.Exec"]}]
    log = json.loads(render.as_sarif(found, lambda c: "error", files={"f": ("a dir/ü.go", 3)}))
    result = log["runs"][0]["results"][0]
    assert log["version"] == "2.1.0" and result["level"] == "error" and len(result["codeFlows"][0]["threadFlows"][0]["locations"]) == 2
    assert result["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a%20dir/%C3%BC.go"
    assert render.gate(found, ["exec"], {"sqli", "exec"}) == 0 and render.gate(found, ["sqli"], {"sqli"}) == 3 and render.gate(found, ["x"], {"sqli"}) == 2


def test_impact_of_a_change_between_two_folders(spark, folder, tmp_path, capsys):
    after = tmp_path / "after"
    after.mkdir()
    server, client = packages()
    server["functions"][0]["id"]["bid"] = iid(77)
    for k, p in enumerate((server, client)):
        (after / f"{k}.pb").write_bytes(cgf.encode(p))
    assert main(["impact", str(folder), str(after), "--policy", str(folder / "policy.toml")]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["changed"] == [{"iid": iid(1), "change": "changed"}] and report["repos"] == ["app", "srv"]
    assert [(c["fn"], c["term_fn"], c["via_change"]) for c in report["chains"]] == [(iid(2), iid(1), "sink")]
    assert report["summaries"] == {"made again": 2, "kept": 0} and len(report["endpoints"]) == 1
    assert main(["impact", str(folder), str(folder), "--policy", str(folder / "policy.toml")]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["changed"] == report["chains"] == [] and report["summaries"] == {"made again": 0, "kept": 2}
    assert main(["taint", str(folder), "--policy", str(folder / "policy.toml"), "--endpoint", "nobody"]) == 0
    assert json.loads(capsys.readouterr().out) == []


def test_contracts_that_several_give(spark):
    rows = [("a", "r1", "f", 0), ("a", "r2", "f", 0), ("b", "r1", "f", 0), ("b", "r1", "f", 0), ("c", "r1", "f", 0), ("c", "r1", "g", 1)]
    got = cgf.contract_copies(spark.createDataFrame(rows, "iid string, repo string, handler string, kind int"), ["kind"])
    assert {tuple(r) for r in got.collect()} == {("a", 2, 2, 1, 1), ("c", 2, 1, 2, 2)}
    assert {tuple(r) for r in cgf.examples(got, ["repos", "handlers", "shapes"]).collect()} == {("repos", "a"), ("handlers", "c"), ("shapes", "c")}


def test_endpoints_bind_functions_of_their_own_repository(spark):
    endpoint = spark.createDataFrame([("r", "k", "n"), ("r", "k", "m"), ("q", "k", "n"), ("r", "z", "n")], "repo string, iid string, name string")
    contract = spark.createDataFrame([("k", "f"), ("k", "g"), ("z", "gone")], "iid string, handler string")
    function = spark.createDataFrame([("f", "r", "F"), ("g", "r", "G")], "iid string, repo string, fqn string")
    got = {tuple(r) for r in persist.endpoints(endpoint, contract, function).collect()}
    assert got == {("r", "k", "m", "f", "F"), ("q", "k", "n", "", ""), ("r", "z", "n", "", "")}
