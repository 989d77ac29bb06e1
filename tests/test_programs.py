"""Trees by hand: flags, lowering, rendering, sequences, paths, checks."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from codeloom.operators import checks, labels, lowering, rendering, scope, trees as tr


def frame(spark, *bodies):
    rows = [(i, json.dumps({"node": "DSubTree", "_nodes": body})) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "pid bigint, ast string")


def ref(name):
    return {"node": "DVarCall", "_id": name}


def call(name, expr="system_package", ret=None, args=(), returns="int"):
    return {"node": "DAPICall", "_call": name, "expr_var_id": ref(expr), "fp_var_ids": list(args), "ret_var_id": ret, "_throws": [], "_returns": returns}


def invoke(name, expr="system_package", ret="no_return_var", args=(), returns="int"):
    return {"node": "DAPIInvoke", "_calls": [{"_call": name, "fp": list(args), "_returns": returns}], "expr_var_id": expr, "ret_var_id": ret, "_returns": returns}


def branch(cond=(), then=(), other=()):
    return {"node": "DBranch", "_cond": list(cond), "_then": list(then), "_else": list(other)}


def loop(cond=(), body=()):
    return {"node": "DLoop", "_cond": list(cond), "_body": list(body)}


def attempt(body=(), catch=()):
    return {"node": "DExcept", "_try": list(body), "_catch": list(catch)}


def lowered(spark, *bodies, apis=None):
    rows, bad = lowering.lower(tr.flatten(frame(spark, *bodies)), apis)
    return {k: [r for r in g] for k, g in itertools.groupby(rows.orderBy("pid", "node_id").collect(), lambda r: r.pid)}, [r.pid for r in bad.collect()]


IT = "java.util.Iterator<java.lang.String>."


def test_iterator_flags(spark):
    body = [
        call(IT + "hasNext()"), call("a.b()"), call(IT + "next()"), loop([call(IT + "remove()")], [call("a.in()")]), call("a.after()"),
        branch([], [], [call(IT + "remove()")]), call("a.end()"), call(IT + "nextElement()"),
    ]
    rows = tr.flatten(frame(spark, body)).where("tag = 'DAPICall'").orderBy("node_id").collect()
    assert [(r.calls[0].call.split(".")[-1], list(r.iattrib)) for r in rows] == [
        ("hasNext()", [0, 0, 0]), ("b()", [1, 0, 0]), ("next()", [1, 0, 0]), ("remove()", [1, 1, 0]), ("in()", [1, 1, 1]),
        ("after()", [1, 1, 0]), ("remove()", [1, 1, 0]), ("end()", [1, 1, 1]), ("nextElement()", [1, 1, 1]),
    ]


def test_chain_folds_and_bad_chain_is_rejected(spark):
    good = [call("java.x.A.one()", ret="v"), call("java.x.A.two()", expr="last_DAPICall"), call("java.x.A.three()", expr="last_DAPICall")]
    bad = [{"node": "DVarCall", "_id": "q", "_returns": "int"}, call("java.x.A.two()", expr="last_DAPICall")]
    rows, rejected = lowered(spark, good, bad)
    assert [r.tag for r in rows[0]] == ["DVarDecl", "DAPIInvoke", "DReturnVar"]
    assert [c.call for c in rows[0][1].calls] == ["java.x.A.one()", "java.x.A.two()", "java.x.A.three()"]
    assert rejected == [1] and 1 not in rows


def test_arguments_become_temporaries(spark):
    made = {"node": "DVarDeclExpr", "_stmt": [{"node": "DClsInit", "_call": "java.io.File.File(java.lang.String)", "fp_var_ids": [ref(None)], "_var": None, "_type": None, "_returns": "java.io.File"}]}
    body = [call("java.x.A.f(int,java.io.File,int)", expr="o", ret="r", args=[call("java.x.A.g()", expr="o"), made, ref(None)])]
    rows, _ = lowered(spark, body)
    got = [(r.tag, r.var_id or r.ret_id, [list(c.args) for c in r.calls]) for r in rows[0]]
    assert got == [
        ("DVarDecl", "my_decl_var_0", []), ("DAPIInvoke", "my_decl_var_0", [[]]),
        ("DVarDeclCls", "my_decl_var_1", []), ("DClsInit", "my_decl_var_1", [["LITERAL"]]),
        ("DVarDecl", "r", []), ("DAPIInvoke", "r", [["my_decl_var_0", "my_decl_var_1", "LITERAL"]]), ("DReturnVar", None, []),
    ]


def test_declarations_follow_scope_and_type(spark):
    decl = lambda t: {"node": "DVarCall", "_id": "v", "_returns": t}
    use = call("java.x.A.f()", ret="v")
    body = [branch([], [decl("int"), use], [use]), use, decl("long"), use, decl("int"), use]
    rows, _ = lowered(spark, body)
    # known in the branch (both blocks share a table), unknown after it, then of another type, then right
    assert [r.tag for r in rows[0]] == [
        "DBranch", "DVarDecl", "DAPIInvoke", "DAPIInvoke", "DVarDecl", "DAPIInvoke", "DVarDecl", "DVarDecl", "DAPIInvoke", "DVarDecl", "DAPIInvoke", "DReturnVar"]


def test_catch_return_and_constructor_repair(spark):
    exc = {"node": "DExceptionVar", "_id": "e", "_returns": "java.lang.Exception"}
    used = attempt([], [exc, call("java.lang.Throwable.getMessage()", expr="e")])
    plain = attempt([], [exc])
    obj = {"node": "DVarCall", "_id": "f", "_returns": "java.io.File"}
    ret = {"node": "DReturnStmt", "_stmt": [call("java.x.A.f()", returns="java.util.List<Tau_E>")]}
    apis = spark.createDataFrame([("java.io.File(java.lang.String,int)", 1), ("java.io.FileReader()", 2)], "api string, id long")
    rows, _ = lowered(spark, [used, plain, obj, call("java.x.A.g()"), ret], [branch([], [ret], [])], apis=apis)
    got = [(r.tag, r.var_id, r.returns) for r in rows[0]]
    assert got == [
        ("DExcept", None, None), ("DExceptionVar", "e", "java.lang.Exception"), ("DAPIInvoke", None, "int"),
        ("DExcept", None, None), ("DExceptionVar", "e", "java.lang.Exception"), ("DAPIInvoke", None, "void"),
        ("DVarDeclCls", "f", "java.io.File"), ("DClsInit", "f", "java.io.File"), ("DAPIInvoke", None, "int"),
        ("DVarDecl", "my_return_var", "java.util.List<java.lang.Object>"), ("DAPIInvoke", None, "java.util.List<java.lang.Object>"),
        ("DReturnVar", "my_return_var", "java.util.List<java.lang.Object>"),
    ]
    assert rows[0][5].calls[0].call == "java.lang.Throwable.printStackTrace()"
    assert list(rows[0][7].calls[0].args) == ["LITERAL", "LITERAL"]
    # a return inside a branch does not set the type of the body
    assert [r.tag for r in rows[1]] == ["DBranch", "DVarDecl", "DAPIInvoke", "DReturnVar", "DReturnVar"]


def test_later_construction_makes_a_class_declaration(spark):
    body = [
        {"node": "DVarCall", "_id": "f", "_returns": "java.io.File"},
        {"node": "DClsInit", "_call": "java.io.File()", "fp_var_ids": [], "_var": "f", "_type": None, "_returns": "java.io.File"},
    ]
    rows, _ = lowered(spark, body)
    assert [r.tag for r in rows[0]] == ["DVarDeclCls", "DClsInit", "DReturnVar"]


def test_render(spark):
    body = [
        {"node": "DVarDecl", "_id": "x", "_returns": "int"},
        branch([invoke("java.x.A.ok(int)", expr="o", args=["x"])], [invoke("java.x.A.a()", ret="x")], [{"node": "DReturnVar", "_id": "x", "_returns": "int"}]),
        attempt([invoke("java.x.A.b()")], [{"node": "DExceptionVar", "_id": "e", "_returns": "E"}]),
    ]
    code = rendering.render(tr.flatten(frame(spark, body))).first().code
    first, second = code.split(";")[0].split()[-1], code.split("E var_")[1].split(";")[0]
    assert code == (
        f"\tint {first};\n\tif (o.ok(int: x)){{\n\t\tx = A.a();\n\t}}else {{\n\t\treturn x;\n\t}}\n"
        f"\ttry {{\n\t\tA.b();\n\t}}\n\tcatch(\t\tE var_{second};\n\t)\n"
    )
    assert first != f"var_{second}"


def all_sequences(nodes):
    """Brute force: sets of call tuples."""
    ways = {()}
    for n in nodes:
        if n["node"] == "DBranch":
            start = {w + s for w in ways for s in all_sequences(n["_cond"])}
            ways = {w + s for w in start for part in ("_then", "_else") for s in all_sequences(n[part])}
        elif n["node"] == "DLoop":
            ways = {w + s for w in ways for s in all_sequences(n["_cond"] + n["_body"] + n["_cond"])}
        elif n["node"] == "DExcept":
            start = {w + s for w in ways for s in all_sequences(n["_try"])}
            ways = start | {w + s for w in start for s in all_sequences(n["_catch"])}
        else:
            ways = {w + tuple(c["_call"] for c in n.get("_calls", ())) for w in ways}
    return ways


def test_call_sequences(spark):
    a, b, c, d = (invoke(f"java.x.A.{n}()") for n in "abcd")
    one = [a, branch([b], [c], [d]), attempt([loop([a], [b])], [c]), branch([], [], [])]
    many = [branch([], [invoke(f"x.y{i}()")], []) for i in range(8)]
    rows = rendering.call_sequences(frame(spark, one, many), max_seqs=64, max_length=32).collect()
    assert {tuple(r.calls) for r in rows if r.pid == 0} == all_sequences(one)
    assert [r.rejected for r in rows if r.pid == 1] == ["too many sequences"]
    too_long = rendering.call_sequences(frame(spark, [a, b, c]), max_length=2).collect()
    assert [r.rejected for r in too_long] == ["too long a sequence"]


def test_malformed_trees_are_kept_aside(spark):
    rows = spark.createDataFrame([(1, '{"_nodes": []}'), (2, '{"_nodes": [')], "pid bigint, ast string")
    assert [r.pid for r in tr.malformed(rows).collect()] == [2]
    assert tr.flatten(rows).count() == 0


def test_texts_that_are_no_trees(spark):
    good = json.dumps({"node": "DSubTree", "_nodes": [{"node": "DVarDecl", "_id": "x", "_returns": "int"}]})
    deep = invoke("java.x.A.f()")
    for _ in range(450):
        deep = loop([], [deep])
    texts = [
        good, None, "{", "3", '"text"', "{}", '{"_nodes": {}}', '{"_nodes": [{"_id": "x"}]}', '{"_nodes": [{"node": "DVarDecl", "_id": 7}]}',
        '{"_nodes": [{"node": "DAPIInvoke", "_calls": [{"fp": []}]}]}', '{"_nodes": [{"node": "DAPIInvoke", "_calls": "f"}]}', '{"_nodes": [{"node": ["DLoop"]}]}',
        '{"_nodes": []}', json.dumps({"_nodes": [deep]}), "", good,
    ]
    programs = spark.createDataFrame(list(enumerate(texts)), "pid long, ast string").coalesce(1)
    sizes = {r.pid: r["count"] for r in tr.flatten(programs).groupBy("pid").count().collect()}
    reasons = {r.pid: r.reason for r in tr.rejected(programs).collect()}
    assert sizes == {0: 1, 13: 451, 15: 1}
    assert reasons == {1: "no text", 2: "not JSON", 14: "not JSON", **dict.fromkeys(range(3, 12), "not a tree")}


def test_round_trip_and_size_cap(spark):
    wide = [{"node": "DVarDecl", "_id": f"v{i}", "_returns": "int"} for i in range(64)]
    over = wide + [wide[0]]
    nodes = tr.flatten(frame(spark, wide, over))
    kept = tr.unflatten(nodes, 64).collect()
    assert [r.pid for r in kept] == [0]
    assert json.loads(kept[0].ast)["_nodes"] == wide


def test_nesting_counts_follow_siblings(spark):
    rows = tr.nesting(tr.flatten(frame(spark, [branch(), branch([], [branch()], []), branch([branch()])]))).first()
    assert (rows.path_DBranch, rows.nested_DBranch) == (4, 2)


def test_scope_of_uses(spark):
    decl = {"node": "DVarDecl", "_id": "v", "_returns": "int"}
    use = invoke("java.x.A.f()", expr="v")
    rows = scope.resolve_uses(tr.flatten(frame(spark, [branch([decl], [use], [use]), use, decl, loop([use], [use])])))
    found = [r.found for r in rows.where("role = 'expr'").orderBy("node_id").collect()]
    assert found == [False, False, False, True, True]


def test_short_programs_are_resolved_in_one_shuffle(spark, monkeypatch):
    """Short programs write no bins and shuffle their nodes once; long ones, and a mix of both, give the same rows."""
    decl, use = {"node": "DVarDecl", "_id": "v", "_returns": "int"}, invoke("java.x.A.f(int)", expr="v", ret="x", args=["v"])
    programs = [[branch([decl], [use], [use]), use, decl, loop([use], [use])], [use], [decl, use, decl, use] * 3]
    nodes = tr.flatten(frame(spark, *programs)).cache()
    written = []
    monkeypatch.setattr(scope, "persist_table", lambda df, name: written.append(name) or df)
    rows = scope.resolve_uses(nodes, {"x": "long"})
    plan = rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "bins" not in written and plan.count("Exchange") == 1
    want = sorted(map(str, rows.collect()))
    for short in (0, 7):
        monkeypatch.setattr(scope, "SHORT", short)
        assert sorted(map(str, scope.resolve_uses(nodes, {"x": "long"}).collect())) == want
    assert "bins" in written


def test_short_programs_are_rendered_in_one_shuffle(spark, monkeypatch):
    """Rendering short programs writes no bins and shuffles their nodes once; long ones, and a mix of both, give the same code."""
    decl, use = {"node": "DVarDecl", "_id": "v", "_returns": "int"}, invoke("java.x.A.f(int)", expr="v", ret="x", args=["v"])
    programs = [[branch([decl], [decl], [use, decl]), decl, loop([use], [decl])], [decl], [decl, attempt([decl, use], [decl]), decl] * 3]
    nodes = tr.flatten(frame(spark, *programs)).cache()
    written = []
    monkeypatch.setattr(scope, "persist_table", lambda df, name: written.append(name) or df)
    code = rendering.render(nodes)
    plan = code._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "bins" not in written and plan.count("Exchange") == 1
    want = {r.pid: r.code for r in code.collect()}
    assert len(want) == 3
    for short in (0, 7):
        monkeypatch.setattr(scope, "SHORT", short)
        assert {r.pid: r.code for r in rendering.render(nodes).collect()} == want
    assert "bins" in written


def test_labels_collect_no_lists(spark):
    """The types that a program returns come down to two texts, not to a list for each program."""
    back = lambda kind: {"node": "DReturnVar", "_id": "v", "_returns": kind}
    nodes = tr.flatten(frame(spark, [back("int")], [back("int"), back("void"), back("int")], [back(None)], [loop()])).cache()
    programs = spark.range(4).select(F.col("id").alias("pid"), F.lit("int").alias("return_type"), F.lit(0).alias("params"))
    used = scope.resolve_uses(nodes)
    rows = labels.label(nodes, programs, used, checks.seen_nowhere_else(used))
    assert "collect_set" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r.pid: r.type for r in rows.collect()} == {0: False, 1: True, 2: True, 3: False}


def test_short_programs_are_numbered_in_one_shuffle(spark, monkeypatch):
    """Lowered rows of short programs are numbered without a table of their own; long ones, and a mix of both, give the same rows."""
    body = [ref("a"), branch([call("java.x.A.f()", "a")], [call("java.x.A.g()", "a", "b"), call("java.x.A.h()", "last_DAPICall")]), loop([], [ref("c")])]
    nodes = tr.flatten(frame(spark, body, body * 3, [ref("z")])).cache()
    written, write = [], lowering.persist_table
    monkeypatch.setattr(lowering, "persist_table", lambda df, name: written.append(name) or write(df, name))
    want = sorted(map(str, lowering.lower(nodes)[0].collect()))
    assert want and "numbered" not in written
    for short in (0, 10):
        monkeypatch.setattr(scope, "SHORT", short)
        assert sorted(map(str, lowering.lower(nodes)[0].collect())) == want
    assert "numbered" in written
