import random

import pytest

from notemill.operators.claims import in_arrival_order

CLAIM = "folder string, name string, ordinal long"


def one_by_one(claims, reserved):
    taken = {(f or "", n.lower()) for f, n in reserved}
    out = {}
    for f, n, o in sorted(claims, key=lambda c: c[2]):
        k, given = 0, n
        while (f or "", given.lower()) in taken:
            k += 1
            given = f"{n} {k}"
        taken.add((f or "", given.lower()))
        out[o] = given
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equal_to_one_by_one(spark, seed):
    rng = random.Random(seed)
    names = ["a", "A", "a 1", "a 2", "a 1 1", "b", "a 10", "a 01", "é", " 1"]
    claims = [(rng.choice(["F", None]), rng.choice(names[: rng.choice([2, 4, 10])]), o) for o in rng.sample(range(1000), rng.choice([3, 25, 60]))]
    reserved = [(rng.choice(["F", ""]), rng.choice(["a", "a 1", "a 3", "A 2", "b 1"])) for _ in range(rng.choice([0, 3]))]
    df = spark.createDataFrame(claims, CLAIM).repartition(3)
    got = in_arrival_order(df, spark.createDataFrame(reserved, "folder string, name string"))
    assert got.columns == ["folder", "name", "ordinal", "given"]
    assert {r.ordinal: r.given for r in got.collect()} == one_by_one(claims, reserved)


def test_many_claims_to_one_name(spark):
    df = spark.range(3000).selectExpr("'' AS folder", "'note' AS name", "3000 - id AS ordinal")
    none = spark.createDataFrame([("", "note 1"), ("", "Note 7"), ("x", "note")], "folder string, name string")
    got = {r.ordinal: r.given for r in in_arrival_order(df, none).collect()}
    assert got == one_by_one([("", "note", o) for o in range(1, 3001)], [("", "note 1"), ("", "Note 7")])
    assert in_arrival_order(df.limit(0), none).collect() == []
