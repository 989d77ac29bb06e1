"""Text, type and score functions on the cases that matter."""

import math

import pytest
from pyspark.sql import functions as F

from codeloom.functions import javatypes as jt, scores as sc, sets, text as tx


def one(spark, value, build, kind="string"):
    row = spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()
    return row["y"]


@pytest.mark.parametrize("given,want", [
    ("java.util.Map<java.lang.Long,java.lang.Byte>", "java.util.Map<java.lang.Long,java.lang.Byte>"),
    ("org.acme.Tree<java.lang.String>", "java.lang.Object"),
    ("int", "int"),
    ("java.util.Set<Tau_K>.stream()", "java.util.Set<java.lang.Object>.stream()"),
    ("java.util.Deque<java.util.Map<java.lang.Long,org.q.R>, long>.peek()", "java.util.Deque<java.lang.Object, long>.peek()"),
    ("java.util.Map<java.util.List<java.util.List<java.util.List<java.util.Set<java.util.Set<java.util.Set<int>>>>>>,int>", "java.util.Map<java.lang.Object,int>"),
    ("java.util.List", "java.util.List"),
    (None, "java.lang.Object"),
    ("void", "void"),
    ("Foo", "java.lang.Object"),
])
def test_simplify_type(spark, given, want):
    assert one(spark, given, jt.simplify_type) == want


def test_unbalanced_type_takes_the_walk(spark):
    # one bracket too many: content runs from the first < to the last matching >
    assert one(spark, "java.util.List<a.b<c", jt.simplify_type) == "java.util.List<java.lang.Object"


@pytest.mark.parametrize("given,want", [
    ("$NOT$java.util.Scanner.close()", "java.util.Scanner.close()"),
    ("$NOT$java.util.Scanner.close(org.acme.Flag)", "java.util.Scanner.close(java.lang.Object)"),
])
def test_simplify_api(spark, given, want):
    assert one(spark, given, jt.simplify_api) == want


CALLS = [
    ("java.util.Optional<java.util.Set<java.lang.Long>>.orElse(java.util.Set<java.lang.Long>)", "java.util.Optional<java.util.Set<java.lang.Long>>", ["java.util.Set<java.lang.Long>"]),
    ("java.lang.Math.abs(long)", "java.lang.Math", ["long"]),
    ("java.nio.file.Path.of(java.lang.String)", "java.nio.file.Path", ["java.lang.String"]),
    ("java.util.Timer.cancel()", "java.util.Timer", []),
    ("java.util.Map.Entry.getKey()", "java.util.Map.Entry", []),
    ("java.awt.Point.move(int,int)", "java.awt.Point", ["int", "int"]),
    ("java.awt.Point.pair(List<int>,List<int>)", "java.awt.Point", ["List<int>", "List<int>"]),
]


@pytest.mark.parametrize("call,receiver,formals", CALLS)
def test_call_parts(spark, call, receiver, formals):
    assert one(spark, call, jt.expr_type) == receiver
    assert one(spark, call, jt.formal_types) == formals


def test_names_types_keywords(spark):
    assert one(spark, "$NOT$java.util.List<java.lang.String>.isEmpty()", jt.api_name) == "isEmpty"
    assert one(spark, "java.io.File.File(java.lang.String)", jt.api_name) is None
    assert sorted(one(spark, "java.util.Map.Entry.get(int,java.lang.String)", jt.types_in)) == ["Entry", "Integer", "String"]
    words = one(spark, "java.io.FileReader.readLine()", lambda c: jt.keywords_of_call(c, jt.types_in(c)))
    assert sorted(words) == ["file", "io", "line", "read", "reader"]


def test_display(spark):
    call = "java.util.Map<java.lang.String,int>.get(java.lang.String,int)"
    assert one(spark, call, lambda c: jt.display_name(c, F.lit("system_package"))) == "Map<java.lang.String,int>.get"
    assert one(spark, call, lambda c: jt.display_name(c, F.lit("x"))) == "get"
    assert one(spark, call, lambda c: jt.typed_arguments(c, F.array(F.lit("a"), F.lit("b")))) == "(java.lang.String: a,int: b)"
    assert one(spark, "a.b()", lambda c: jt.typed_arguments(c, F.array().cast("array<string>"))) == "()"


def test_text(spark):
    assert one(spark, "getHTTPResponseCode2Go", tx.split_camel) == ["get", "HTTP", "Response", "Code2", "Go"]
    assert one(spark, "/** doc */ @Override public int f(int a) { return { 1 }; } // x", tx.header) == "public int f(int a)  // x"
    assert one(spark, "int f() { open", tx.header) == "int f() "
    assert one(spark, "no body", tx.header) == "no body"
    assert one(spark, "a.b == c && d<=e", tx.code_tokens) == ["a", ".", "b", "=", "=", "c", "&&", "d", "<=", "e"]
    assert one(spark, "// drop\n  keep // this\n//x\n", tx.prune_comments) == "keep // this"
    assert one(spark, "a\nb", tx.comment_block) == "// a\n// b\n"
    assert one(spark, "Reads the <b>XMLFile</b> now. And more", tx.doc_summary) == "reads the xml file now"
    assert one(spark, "TODO later. x", tx.doc_summary) is None
    assert one(spark, "éàaccentedNames of2 x", tx.name_words) == ["accented", "names"]
    assert one(spark, "run@12", tx.method_base) == "run"
    assert one(spark, ["get", "file", "NAME"], tx.reconstruct_camel, "array<string>") == "getFileName"
    assert one(spark, -1.239, tx.truncate_two_decimals, "double") == -1.23
    assert one(spark, [1, 2, 3], lambda a: tx.pad(a, 2), "array<int>") == [1, 2]
    assert one(spark, [1], lambda a: tx.pad(a, 3), "array<int>") == [1, 0, 0]


def test_jaccard_properties(spark):
    rows = [([], []), (["a"], []), (["a", "b"], ["b", "c"]), (["a"], ["a"])]
    out = spark.createDataFrame(rows, "a array<string>, b array<string>").select(
        sc.jaccard(F.col("a"), F.col("b")).alias("x"), sc.jaccard(F.col("b"), F.col("a")).alias("y")
    ).collect()
    assert [r.x for r in out] == [1.0, 0.0, 1 / 3, 1.0]
    assert all(r.x == r.y and 0 <= r.x <= 1 for r in out)


def test_scores(spark):
    values, idx = spark.createDataFrame([([1.0, 3.0, 2.0],)], "v array<double>").select(*sc.top_scores(F.col("v"), 5)).first()
    total = math.log(sum(math.exp(x) for x in (1, 2, 3)))
    assert idx == [1, 2, 0, 1, 1]
    assert values == pytest.approx([3 - total, 2 - total, 1 - total, -20000.0, -20000.0])
    passed = spark.range(1).select(*sc.rates_with_blanks(F.lit(3), F.lit(1), F.lit(1))).first()
    assert list(passed) == pytest.approx([3 / 4.001 * 100, 1 / 4.001 * 100, 2 / 3.001 * 100])


def test_sets(spark):
    assert one(spark, ["a", "b"], lambda c: sets.combinations([c, F.array(F.lit("x"), F.lit("y"))]), "array<string>") == [
        ["a", "x"], ["a", "y"], ["b", "x"], ["b", "y"]]
    assert one(spark, [5, 0, 7], lambda c: sets.pack_left(c, lambda x: x > 0), "array<int>") == [5, 7, 0]
    assert one(spark, [[1.0, 2.0], [0.0, 0.0]], sets.where_valid, "array<array<double>>") == [[1.0, 2.0], [0.0, 0.0]]
    assert one(spark, [["a"], []], sets.without_empty, "array<array<string>>") == [["a"]]
