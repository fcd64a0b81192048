"""Densities against the plain sum over all values and points."""

import math
import random

import pytest

from weirspan.operators import validate as va


def plain(values):
    n, top = len(values), max(values)
    mean = sum(values) / n
    h = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1)) * n**-0.2
    return [sum(math.exp(-0.5 * ((top * i / 499 - v) / h) ** 2) for v in values) / (n * h * math.sqrt(2 * math.pi)) for i in range(500)]


rng = random.Random(3)
CASES = {
    "even": [rng.uniform(0.1, 60) for _ in range(400)], "heavy": [5.0] * 300 + [rng.uniform(4, 6) for _ in range(100)],
    "far": [1.0] * 200 + [rng.gauss(1, 1e-3) for _ in range(200)] + [1000.0], "below": [rng.gauss(-5, 2) for _ in range(200)], "two": [1.0, 2.0], "zero_top": [-1.0, -0.5, 0.0],
}


def test_against_plain_sums(spark):
    df = spark.createDataFrame([(k, v) for k, vs in CASES.items() for v in [*vs, None, float("nan")]], "k string, v double")
    got = {}
    for r in va.kernel_density(df, ["k"], "v").collect():
        got.setdefault(r.k, {})[r.i] = (r.x, r.density)
    for k, values in CASES.items():
        want = plain(values)
        assert sorted(got[k]) == list(range(500))
        for i in range(500):
            assert got[k][i][0] == pytest.approx(max(values) * i / 499)
            assert got[k][i][1] == pytest.approx(want[i], rel=1e-9, abs=1e-12 * max(want)), (k, i)


def test_no_bandwidth_and_no_rows(spark):
    df = spark.createDataFrame([("one", 1.0), ("equal", 2.0), ("equal", 2.0), ("none", None)], "k string, v double")
    rows = va.kernel_density(df, ["k"], "v").collect()
    assert len(rows) == 1000 and {r.k for r in rows} == {"one", "equal"} and all(r.density is None for r in rows)
    assert va.kernel_density(df.limit(0), ["k"], "v").collect() == []


def test_rows_follow_cells_and_points_not_values(spark):
    df = spark.range(200_000).selectExpr("'a' AS k", "60 * rand(1) AS v")
    out = va.kernel_density(df, ["k"], "v")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()

    def rows(node):
        name, found = node.getClass().getSimpleName(), node.metrics().get("numOutputRows")
        own = [(name, found.get().value())] if found.isDefined() else []
        kids = node.children()
        below = [node.plan()] if name.endswith("QueryStageExec") else [kids.apply(i) for i in range(kids.size())]
        return own + [x for k in below for x in rows(k)]

    counted = rows(plan.finalPhysicalPlan())
    spread = [n for name, n in counted if name == "GenerateExec"]
    assert 500 in spread and 500 < max(spread) < 40_000, counted
    assert [n for name, n in counted if name == "HashAggregateExec" and n > 40_000] == []
