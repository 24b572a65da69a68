"""Findings that the walk back confirms, refutes or leaves open."""

import pytest

from rillgraph.operators import policy as po
from rillgraph.plans import backward, chains
from rillgraph.plans.taint import Options, analyse
from tests.program import Builder

RULES = [("sources", 0, "http", "http.Form", None, "return"), ("sinks", 0, "sqli", "db.Exec", None, "any")]
FORM, EXEC = {"callee": "http.Form", "argc": 0, "resultc": 1}, {"callee": "db.Exec"}


@pytest.fixture(scope="module", autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def verdicts(spark, b):
    program = b.build(spark)
    result = analyse(program, spark.createDataFrame(RULES, po.SCHEMA), Options())
    found = chains.chains(result, program)
    checked = backward.confirm(found, result, program)
    assert backward.prune(found, checked).count() == checked.where("verdict <> 'refuted'").count()
    return {(r.fn, r.cs, r.term_fn): (r.verdict, r.exact, r.source_fields) for r in checked.collect()}


@pytest.mark.parametrize("field,want", [(2, ("refuted", False, "")), (1, ("confirmed", True, "1"))])
def test_field_mapper(spark, field, want):
    b = Builder().function("S", ["R0@0->A0@1"], [FORM, {"targets": ["M"]}])
    b.function("M", ["P0[1]->A0@1[1]", "R0@0->A0@1[2]"], [{"callee": "session.Get", "argc": 0, "resultc": 1}, {"targets": ["P"]}])
    b.function("P", ["P0->A0@0"], [{"targets": ["L"]}]).function("L", [f"P0[{field}]->A0@0"], [EXEC])
    assert verdicts(spark, b) == {("S", 1, "L"): want}


def test_through_results_and_recursion(spark):
    b = Builder().function("S", ["R0@0->A0@1", "R0@1->A0@2"], [FORM, {"targets": ["I"], "resultc": 1}, EXEC])
    b.function("I", ["P0->ret0", "P0->A0@0", "R0@0->ret0"], [{"targets": ["I"], "resultc": 1}])
    assert verdicts(spark, b) == {("S", 2, "S"): ("confirmed", True, "")}
    b = Builder().function("S", ["R0@0->A0@1", "R0@1->A0@2"], [FORM, {"callee": "lib.F", "resultc": 1}, EXEC])
    assert verdicts(spark, b) == {("S", 2, "S"): ("confirmed", False, "")}


def test_cells_are_left_open(spark):
    b = Builder().function("S", ["R0@0->F0{c}"], [FORM]).function("R", ["G0{c}->A0@0"], [EXEC])
    assert verdicts(spark, b) == {("S", -1, "R"): ("undecided", False, "")}
