"""Flow statistics on literal records, and the sliced form of ranks against the plain one."""

import random

import numpy as np
import pytest

from weirspan.operators import flow, ranking


def record(spark, rows):
    return spark.createDataFrame(rows, "reach_id long, date string, streamflow double").selectExpr("reach_id", "to_date(date) AS date", "streamflow")


def test_duration_curve_drops_missing_flows(spark):
    df = record(spark, [(1, f"2000-01-{i:02d}", float(i)) for i in range(1, 10)] + [(1, "2000-01-20", None), (1, "2000-01-21", float("nan"))])
    got = {r.streamflow: r.exceedance for r in flow.duration_curve_rows(df).collect()}
    assert got == {float(i): pytest.approx(100 * (10 - i) / 10) for i in range(1, 10)}


def test_lookup_between_two_flows_takes_the_lower_exceedance(spark):
    df = record(spark, [(1, "2000-01-01", 5.0), (1, "2000-01-02", 5.0), (1, "2000-01-03", 3.0)])
    asked = spark.createDataFrame([(1, 4.0), (1, 100.0), (1, -1.0), (2, 4.0)], "reach_id long, q double")
    got = {(r.reach_id, r.q): r.exceedance for r in flow.exceedance_of(asked, df, {"q": "exceedance"}).collect()}
    assert got == {(1, 4.0): 25.0, (1, 100.0): 25.0, (1, -1.0): 75.0, (2, 4.0): None}


def test_return_periods(spark):
    rows = [(1, "2000-05-01", 9.0)]
    rows += [(2, "2000-05-01", 9.0), (2, "2001-05-01", 3.0), (2, "2002-05-01", None)]
    rows += [(3, f"{2000 + i}-05-01", float(i + 1)) for i in range(10)]
    got = {r.reach_id: r for r in flow.return_period_flows(record(spark, rows)).collect()}
    assert set(got) == {2, 3}
    assert (got[2].rp2, got[2].rp100) == (pytest.approx(3 + 6 * 0.5 / 1.5), 9.0)
    periods = [11 / i for i in range(10, 0, -1)]
    for t in flow.RETURN_PERIODS:
        assert got[3][f"rp{t}"] == pytest.approx(np.interp(t, periods, range(1, 11)))


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(1, "2000-01-01", float(rng.randint(0, 400)) / 7) for _ in range(3000)] + [(k, "2000-01-01", rng.random()) for k in range(2, 40) for _ in range(k)]
    rows += [(1, "2000-01-01", 0.0)] * 1500
    return record(spark, rows).repartition(6).cache()


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_ranks_over_steps_equal_brute_force(skewed):
    rows = {}
    for r in skewed.collect():
        rows.setdefault(r.reach_id, []).append(r.streamflow)
    for r in ranking.cumulative_counts(skewed, ["reach_id"], "streamflow").collect():
        values = rows[r.reach_id]
        assert (r.cnt, r.before, r.total) == (values.count(r.v), sum(v < r.v for v in values), len(values))
    got = sorted((r.reach_id, r["rank"], r.v) for r in ranking.ranked_rows(skewed, ["reach_id"], "streamflow", descending=True).collect())
    assert got == sorted((k, i + 1, v) for k, values in rows.items() for i, v in enumerate(sorted(values, reverse=True)))


def test_steps_never_fall(spark):
    edge = [0.0, 5e-324, 1e-300, 1e-6, 1.0, 1.0 + 2**-52, 1e300, 1.7e308, float("inf")]
    rng = random.Random(4)
    values = sorted({s * v for v in edge for s in (1, -1)} | {rng.uniform(-9, 9) * 10 ** rng.randint(-9, 9) for _ in range(2000)})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    steps = [r.s for r in df.select("i", ranking.step_of(df.v).alias("s")).orderBy("i").collect()]
    assert steps == sorted(steps) and len(set(steps)) > 100


def test_quantiles_of_a_hot_key(skewed):
    values = [r.streamflow for r in skewed.where("reach_id = 1").collect()]
    names = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.93, "e": 1.0}
    got = ranking.quantiles(skewed, ["reach_id"], "streamflow", names).where("reach_id = 1").first()
    for n, p in names.items():
        assert got[n] == pytest.approx(np.quantile(values, p))


def test_lookups_over_steps_equal_brute_force(spark, skewed):
    rng = random.Random(5)
    asked = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 9, 50]), rng.uniform(-5, 70)) for _ in range(800)], "reach_id long, q double")
    curve = flow.duration_curve(skewed)
    points = {}
    for r in flow.duration_curve(skewed).collect():
        points.setdefault(r.reach_id, []).append((r.v, r.exceedance))
    got = ranking.nearest_value(asked, curve, ["reach_id"], {"q": "e"}, "exceedance").collect()
    assert len(got) == 800
    for r in got:
        want = min(((abs(v - r.q), e) for v, e in points.get(r.reach_id, [])), default=(None, None))[1]
        assert r.e == (want if want is None else pytest.approx(want))


def test_heavily_repeated_value_is_expanded_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "EXPAND_BLOCK", 7)
    df = record(spark, [(1, "2000-01-01", 2.0)] * 50 + [(1, "2000-01-01", 1.0)] * 3)
    got = sorted((r.rank, r.v) for r in ranking.ranked_rows(df, ["reach_id"], "streamflow").collect())
    assert got == [(i, 1.0) for i in (1, 2, 3)] + [(i, 2.0) for i in range(4, 54)]


def test_running_sum_over_blocks(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS seq", "CAST(id AS double) AS x")
    got = ranking.running_sum(df, ["k"], "seq", df.x, "total", block=10).collect()
    for r in got:
        assert r.total == sum(i for i in range(r.seq + 1) if i % 3 == r.k)


def test_result_does_not_depend_on_partitions(skewed):
    same(flow.median_and_max(skewed.coalesce(1)), flow.median_and_max(skewed.repartition(8)))
