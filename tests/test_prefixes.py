"""First API of a type by its text, against looking at all pairs."""

import random

import pytest

from codeloom.operators.checks import constructors_for


@pytest.mark.parametrize("seed", range(4))
def test_nested_types(spark, seed):
    rnd = random.Random(seed)
    word = lambda most: "".join(rnd.choice("ab.é") for _ in range(rnd.randint(0 if seed == 3 else 1, most)))
    types = [word(4) for _ in range(40)] + [None]
    apis = [(word(7), rnd.randint(0, 60)) for _ in range(200)] + [(None, 1), ("aa", 0), ("aa", 0)]
    want = {}
    for t in {t for t in types if t is not None}:
        fits = [(i, a) for a, i in apis if a is not None and a.startswith(t)]
        if fits:
            want[t] = min(fits, key=lambda x: (x[0], x[1].encode()))[1]
    frame = spark.createDataFrame([(t, 1) for t in types], "type string, id int")
    got = constructors_for(frame, spark.createDataFrame(apis, "api string, id long")).collect()
    assert {r.type: r.api for r in got} == want and len(got) == len(want)


def test_nothing_to_look_up(spark):
    none, apis = spark.createDataFrame([], "type string"), spark.createDataFrame([("a.B()", 1)], "api string, id long")
    assert constructors_for(none, apis).count() == 0
    assert constructors_for(spark.createDataFrame([("a",)], "type string"), apis.limit(0)).count() == 0
