"""Faults of programs by hand, and nesting against a walk of the tree."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import checks, labels, scope, trees as tr
from codeloom.sources.stores import Options
from tests.test_programs import attempt, branch, frame, invoke, loop

CONTROL = {"DBranch": ("_cond", "_then", "_else"), "DLoop": ("_cond", "_body"), "DExcept": ("_try", "_catch")}


def peaks(nodes, tag):
    """(along siblings and children, by nesting alone)"""
    path = nested = 0
    for node in reversed(nodes):
        inner = [peaks(node.get(slot, []), tag) for slot in CONTROL.get(node["node"], ())]
        own = int(node["node"] == tag)
        path = own + max([path, *[p for p, _ in inner]])
        nested = max([nested, own + max([0, *[n for _, n in inner]])])
    return path, nested


def tree(rnd, depth):
    def several():
        return [tree(rnd, depth - 1) for _ in range(rnd.randint(0, 3))] if depth else []

    return rnd.choice([lambda: branch(several(), several(), several()), lambda: loop(several(), several()), lambda: attempt(several(), several()), lambda: invoke("java.x.A.f()")])()


@pytest.mark.parametrize("bin_size", [3, 8192])
def test_nesting_is_that_of_a_walk(spark, monkeypatch, bin_size):
    monkeypatch.setattr(tr, "EVENT_BIN", bin_size)
    rnd = random.Random(5)
    bodies = [[tree(rnd, 4) for _ in range(rnd.randint(1, 5))] for _ in range(25)]
    got = {r.pid: r for r in tr.nesting(tr.flatten(frame(spark, *bodies))).collect()}
    for pid, body in enumerate(bodies):
        for tag in CONTROL:
            assert (got[pid][f"path_{tag}"], got[pid][f"nested_{tag}"]) == peaks(body, tag), (pid, tag)


def declare(name, kind="DVarDecl", returns="int"):
    return {"node": kind, "_id": name, "_returns": returns}


def ret(name, returns="int"):
    return {"node": "DReturnVar", "_id": name, "_returns": returns}


def test_every_reason(spark):
    call, chain = invoke("java.x.A.f()"), invoke("java.x.A.f()")
    chain["_calls"] = chain["_calls"] * 5
    end = [declare("a"), ret("a")]
    bodies = {
        "assignment": [{"node": "DAssign", "_from": "a", "_to": "b", "_type": "int"}, call, chain, *end],
        "nested_api": [chain, *end],
        "unknown_variable": [invoke("java.x.A.f()", expr="nowhere"), *end],
        "too_many_variables": [call, declare("var_12"), ret("var_12")],
        "too_large": [call] * 30 + end,
        "branch": [branch([call])] * 3 + end,
        "loop": [call, loop([], [loop([], [loop()])]), *end],
        "try": [call, attempt(), attempt([attempt()]), *end],
        "void": end,
        "type": [call, declare("a"), ret("a", "long")],
        "no_return": [call],
        None: [call, branch([branch()]), loop([loop()]), *end],
    }
    nodes = tr.flatten(frame(spark, *bodies.values()))
    many = len(bodies)
    programs = spark.createDataFrame([(i, "int", 2) for i in range(many)] + [(many, "void", 0), (many + 1, None, 99)], "pid long, return_type string, params int")
    used = scope.resolve_uses(nodes)
    got = {r.pid: r for r in labels.label(nodes, programs, used, used.limit(0), Options(max_nodes=31)).collect()}
    assert [got[i].reason for i in range(many)] == list(bodies)
    assert got[0].nested_api and got[0].assignment and not got[0].void
    # without a node: void by itself; too many parameters come first
    assert (got[many].reason, got[many].statements, got[many].no_return) == ("void", 0, False)
    assert got[many + 1].reason == "too_many_variables" and got[many + 1].void and got[many + 1].no_return
    # ten declarations of a kind are too many, nine are not
    ten = tr.flatten(frame(spark, [call, ret("v0")] + [declare(f"v{i}") for i in range(9)], [call, ret("v0")] + [declare(f"v{i}") for i in range(10)]))
    flags = labels.label(ten, programs.where("pid < 2"), used.limit(0), used.limit(0)).orderBy("pid").collect()
    assert [r.too_many_variables for r in flags] == [False, True]
    wrong = labels.label(ten, programs.where("pid < 2"), used.limit(0), used.limit(1).withColumn("pid", F.lit(0).cast("long"))).orderBy("pid").collect()
    assert [r.type for r in wrong] == [True, False]


def test_counts_hold_every_reason(spark):
    nodes = tr.flatten(frame(spark, [invoke("java.x.A.f()"), declare("a"), ret("a")], [declare("a"), ret("a")]))
    programs = spark.createDataFrame([(0, "int", 0), (1, "int", 0)], "pid long, return_type string, params int")
    used = scope.resolve_uses(nodes)
    counts = {r.reason: (r.programs, r["first"]) for r in labels.label_counts(labels.label(nodes, programs, used, used.limit(0))).collect()}
    assert counts == {**{r: (0, 0) for r in labels.REASONS}, "void": (1, 1), "passed": (1, 1)}


def filled(nodes, at, out):
    """Numbers of the nodes that stay, by recursion; gives the next number and whether any stays."""
    some = False
    for node in nodes:
        me, inside, kept = at, False, []
        at += 1
        for slot in CONTROL.get(node["node"], ()):
            at, any_there = filled(node[slot], at, kept)
            inside |= any_there
        if inside or node["node"] not in CONTROL:
            out += [me, *kept]
            some = True
    return at, some


def test_empty_controls_go(spark):
    rnd = random.Random(9)
    bodies = [[tree(rnd, 4) for _ in range(rnd.randint(1, 4))] for _ in range(30)] + [[branch()], [loop([], [branch([attempt()])]), invoke("java.x.A.f()")]]
    rows = tr.drop_empty_controls(tr.flatten(frame(spark, *bodies))).collect()
    got = sorted((r.pid, r.node_id) for r in rows)
    want = []
    for pid, body in enumerate(bodies):
        numbers = []
        filled(body, 0, numbers)
        want += [(pid, n) for n in numbers]
    assert got == sorted(want) and not any(r.pid == 30 for r in rows)
