"""Short programs, lowered one by one, against the same programs lowered by joins and scans."""

import json
import random

from pyspark.sql import functions as F

from codeloom.functions import javatypes, plaintypes
from codeloom.operators import lowering, scope, trees as tr
from codeloom.plans import projection as pj
from codeloom.queries import lowered as ql

TYPES = (None, "null", "int", "void", "java.util.List<Tau_E>", "java.util.Map<java.lang.String,int>", "org.acme.Foo", "java.x.A", "", "Integer")
APIS = ("java.x.A.f()", "$NOT$java.x.A<Tau_T,int>.g(int,java.util.List<Tau_E>)", "a.b(org.acme.Foo,Tau_T)", "no brackets", None)
NAMES = ("a", "b", "c", None)


def argument(r, depth):
    kind = r.random()
    if kind < 0.5 or depth > 2:
        return {"node": "DVarCall", "_id": r.choice(NAMES), "_returns": r.choice(TYPES)} if r.random() < 0.9 else "text"
    if kind < 0.8:
        return call(r, depth + 1)
    return {"node": "DVarDeclExpr", "_returns": r.choice(TYPES), "_stmt": [statement(r, 3) for _ in range(r.randrange(3))]}


def call(r, depth):
    return {
        "node": "DAPICall", "_call": r.choice(APIS), "_returns": r.choice(TYPES), "expr_var_id": r.choice([argument(r, depth), "system_package", "last_DAPICall" if r.random() < 0.3 else "a", None]),
        "fp_var_ids": [argument(r, depth) for _ in range(r.randrange(3))], "ret_var_id": r.choice(NAMES)}


def statement(r, depth):
    inside = lambda: [statement(r, depth + 1) for _ in range(r.randrange(4) if depth < 3 else 0)]
    kind = r.randrange(16)
    if kind < 5:
        return call(r, depth)
    if kind < 7:
        return {"node": "DVarCall", "_id": r.choice(NAMES), "_returns": r.choice(TYPES)}
    if kind < 9:
        return {"node": "DClsInit", "_call": r.choice(APIS), "_var": r.choice(NAMES), "_returns": r.choice(TYPES), "fp_var_ids": [argument(r, depth) for _ in range(r.randrange(2))]}
    return (
        {"node": "DBranch", "_cond": inside(), "_then": inside(), "_else": inside()}, {"node": "DLoop", "_cond": inside(), "_body": inside()},
        {"node": "DExcept", "_try": inside(), "_catch": [{"node": "DExceptionVar", "_id": r.choice(NAMES), "_returns": r.choice(TYPES)}, *inside()]},
        {"node": "DReturnStmt", "_stmt": [call(r, depth), *inside()][r.randrange(2):]}, {"node": "DReturnVar", "_id": r.choice(NAMES), "_returns": r.choice(TYPES)},
        {"node": "DInfix", "_op": ["<"], "_left": inside(), "_right": inside()}, {"node": "DInternalAPICall", "int_meth_name": "m", "_returns": r.choice(TYPES), "fp_var_ids": [argument(r, depth)]},
    )[kind - 9]


def test_one_by_one_as_by_joins(spark, monkeypatch):
    r = random.Random(7)
    bodies = [[statement(r, 0) if r.random() < 0.9 else {"node": r.choice(("DAssign", "DFieldCall")), "_id": "a", "_returns": "int"} for _ in range(r.randrange(1, 5))] for _ in range(300)]
    texts = [(i, json.dumps({"node": "DSubTree", "_nodes": body})) for i, body in enumerate(bodies)]
    nodes = tr.flatten(spark.createDataFrame(texts, "pid bigint, ast string")).cache()
    apis = spark.createDataFrame([(1, "java.x.A.<init>(int,int)"), (2, "java.x.A.make()"), (3, "java.lang.Object.<init>()"), (4, "org.acme.Foo()")], "id int, api string")
    found = {}
    for short in (1 << 20, 0):
        monkeypatch.setattr(scope, "SHORT", short)
        for known in (None, apis):
            rows, bad = lowering.lower(nodes, known)
            got = sorted(map(str, rows.collect())), sorted(x.pid for x in bad.collect())
            assert found.setdefault(known is None, got) == got
    rows, bad = found[False]
    assert len(rows) > 2000 and 20 < len(bad) < 280 and rows != found[True][0]


def test_types_are_simplified_as_by_columns(spark):
    r = random.Random(5)
    pieces = ("java.util.", "List", "<", ">", ",", "Tau_T", "int", "(", ")", ".", "org.acme.Foo", " ", "$NOT$", "void", "?", "[]")
    texts = [None, "", *TYPES, *APIS, *["".join(r.choice(pieces) for _ in range(r.randrange(1, 14))) for _ in range(3000)]]
    texts += [f"java.{t}" for t in texts if t]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", javatypes.simplify_type(F.col("t")).alias("type"), javatypes.simplify_api(F.col("t")).alias("api"), F.size(javatypes.formal_types(F.col("t"))).alias("n"))
    for row in rows.collect():
        assert plaintypes.simplify_type(row.t) == row.type, row.t
        if row.t is not None:
            assert (plaintypes.simplify_api(row.t), plaintypes.formal_count(row.t)) == (row.api, row.n), row.t


def test_short_programs_write_one_table(spark, monkeypatch):
    written, write = [], lowering.persist_table
    monkeypatch.setattr(lowering, "persist_table", lambda df, name: written.append(name) or write(df, name))
    nodes, n = pj.dealt_program_nodes(spark, "/root/testdata/sf0.001", ql.EXTRACTED, node=pj.raw_line_nodes)
    rows, _ = lowering.lower(nodes, buckets=n)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert written == [] and "Exchange" not in plan and rows.count() > 0
