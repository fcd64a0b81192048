"""Near joins and network walks on literal cases and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from weirspan.functions import geo
from weirspan.operators import near, network, validate
from weirspan.operators.keyed import reindex_large, replace_keys, upsert


def test_tolerance_join(spark):
    left = spark.createDataFrame([(1, 10, 10), (9, 10, 10), (3, 0, 0)], "comid long, row_ int, col_ int")
    right = spark.createDataFrame([(1, 12, 12, 1), (1, 8, 12, 2), (1, 13, 10, 3), (2, 10, 11, 4)], "comid long, row_ int, col_ int, ord int")
    got = {r.comid: r.ord for r in near.tolerance_join(left, right).collect()}
    assert got == {1: 1, 9: None, 3: None}
    assert {r.comid: r.ord for r in near.tolerance_join(left, right, compat=True).collect()} == {1: 3, 9: None, 3: None}


@pytest.mark.parametrize("cell, most", [(0.01, 512), (3.0, 512), (0.1, 4)])
def test_nearest_point_against_brute_force(spark, monkeypatch, cell, most):
    monkeypatch.setattr(near, "MOST_DIRECT", most)
    rng = random.Random(1)
    pts = [(i % 3, rng.gauss(0, 5), rng.gauss(0, 5), i) for i in range(150)] + [(0, 500.0, 500.0, 900)]
    asks = [(i, i % 4, rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(60)]
    left = spark.createDataFrame(asks, "i int, k int, x double, y double")
    right = spark.createDataFrame(pts, "k int, x2 double, y2 double, ord int")
    for r in near.nearest_point(left, right, ["k"], cell).collect():
        want = min((((x - r.x) ** 2 + (y - r.y) ** 2, o) for k, x, y, o in pts if k == r.k), default=(None, None))[1]
        assert r.ord == want


def test_lone_points_meet_few_of_a_dense_cluster(spark):
    # 40,000 positions within 0.01 of the origin, a few far out, and questions near, inside and very far.
    rng = random.Random(2)
    pts = [(rng.gauss(0, 0.002), rng.gauss(0, 0.002), i) for i in range(40_000)] + [(rng.uniform(-50, 50), rng.uniform(-50, 50), 50_000 + i) for i in range(20)]
    asks = [(rng.uniform(-100, 100), rng.uniform(-100, 100)) for _ in range(40)] + [(rng.gauss(0, 0.003), rng.gauss(0, 0.003)) for _ in range(40)] + [(0.5, 0.5), (1e6, -3e5)]
    targets = spark.createDataFrame([(x, y, (i,)) for x, y, i in pts], "x2 double, y2 double, pay struct<ord: int>")
    asked = spark.createDataFrame(asks, "x double, y double")
    pairs = near.nearest_pairs(asked, targets, [], 1.0, F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).collect()
    assert len(pairs) < 300 * len(asks) and max(sum((r.x, r.y) == a for r in pairs) for a in asks) < 2000
    for x, y in asks:
        want = min(((x - a) ** 2 + (y - b) ** 2, i) for a, b, i in pts)[1]
        assert min((r.dist, r.pay.ord) for r in pairs if (r.x, r.y) == (x, y))[1] == want


def test_nearest_point_without_any_target(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0)], "i int, x double, y double")
    right = spark.createDataFrame([], "x2 double, y2 double, ord int")
    assert near.nearest_point(left, right, [], 1.0).first().ord is None


def test_priority_prefers_stream_order_over_distance(spark):
    sites = spark.createDataFrame([(1, 40.0, -100.0), (2, 45.0, -90.0)], "site_id long, latitude double, longitude double")
    verts = spark.createDataFrame([(7, 0, -100.001, 40.001), (7, 1, -99.999, 40.001), (8, 0, -100.003, 40.003), (8, 1, -99.997, 40.003)], "linkno long, seq int, x double, y double")
    reaches = spark.createDataFrame([(7, 1), (8, 4)], "linkno long, strm_order int")
    got = {r.site_id: (r.linkno, r.dist) for r in near.priority_nearest(sites, reaches, verts).collect()}
    # 0.003 degrees of latitude are 333 m; the equal-area projection stretches north-south by up to 1.25 %
    assert got[1][0] == 8 and 333 <= got[1][1] <= 333 * 1.0125 and got[2] == (None, None)
    plain = reaches.withColumn("strm_order", F.lit(None).cast("int"))
    assert near.priority_nearest(sites, plain, verts).where("site_id = 1").first().linkno == 7


def test_nearest_lines_keep_ties(spark):
    a = spark.createDataFrame([(1, 5, 0.0, 0.0, 1.0, 0.0)], "k int, left_id int, x1 double, y1 double, x2 double, y2 double")
    b = spark.createDataFrame([(1, 1, 0.0, 9.0, 1.0, 9.0), (1, 2, 0.0, -9.0, 1.0, -9.0), (1, 3, 0.0, 30.0, 1.0, 31.0), (2, 4, 0.0, 0.0, 1.0, 0.0)], "k int, right_id int, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.right_id for r in near.nearest_lines(a, b, ["k"], 0.5).collect()) == [1, 2]


def test_ring(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0))])
    df = spark.createDataFrame([(1.0, 1.0, True), (2.0, 3.0, False), (3.5, 3.0, True), (5.0, 1.0, False), (-1.0, 0.5, False)], "x double, y double, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", geo.in_ring(F.col("x"), F.col("y"), ring)).collect())


def test_projections_against_known_points(spark):
    df = spark.createDataFrame([(23.0, -96.0), (40.0, -96.0)], "lat double, lon double")
    ax, ay = geo.albers(F.col("lat"), F.col("lon"))
    ux, uy = geo.utm(F.col("lat"), F.lit(-93.0))
    rows = df.select(ax.alias("ax"), ay.alias("ay"), ux.alias("ux"), uy.alias("uy")).collect()
    assert (rows[0].ax, rows[0].ay) == (pytest.approx(0, abs=1e-6), pytest.approx(0, abs=1e-3))
    # on a central meridian the easting is 500 km and the northing the meridian arc times the scale
    assert rows[1].ux == pytest.approx(500000) and rows[1].uy == pytest.approx(4427757.22, abs=0.05)


def test_walk_at_a_confluence(spark):
    reaches = spark.createDataFrame([(1, 3, 600.0, 1), (2, 3, 600.0, 2), (3, 4, 500.0, 2), (4, -1, 500.0, 2)], "linkno long, dslinkno long, length_m double, strm_order int")
    start = spark.createDataFrame([(3,), (3,)], "linkno long")
    got = {(r.direction, r.linkno): r.total for r in network.walk(start, reaches, 1000.0, 2000.0).collect()}
    assert got == {("up", 3): 500.0, ("up", 2): 1100.0, ("down", 3): 500.0, ("down", 4): 1000.0}
    # a threshold reached exactly stops the walk
    short = {(r.direction, r.linkno) for r in network.walk(start, reaches, 500.0, 501.0).collect()}
    assert short == {("up", 3), ("down", 3), ("down", 4)}
    loop = spark.createDataFrame([(1, 2, 1.0, 1), (2, 1, 1.0, 1)], "linkno long, dslinkno long, length_m double, strm_order int")
    ring = network.walk(spark.createDataFrame([(1,)], "linkno long"), loop, 10.0, 10.0).collect()
    assert len(ring) == 4


def stepwise(starts, reaches, up, down):
    """Walks one reach at a time."""
    known = {r[0]: r for r in reaches}
    stem = {}
    for link, ds, _, order in reaches:
        if ds != -1 and (ds not in stem or (order, -link) > (known[stem[ds]][3], -stem[ds])):
            stem[ds] = link
    out = {}
    for start in {s for s in starts if s in known}:
        for name, limit, after in (("up", up, stem.get), ("down", down, lambda k: known[k][1])):
            here, total, seen = start, 0.0, set()
            while here in known and here not in seen:
                seen.add(here)
                total += known[here][2]
                out[start, name, here] = total
                if total >= limit:
                    break
                here = after(here)
    return out


def test_walks_against_single_steps(spark):
    rng = random.Random(5)
    # Downstream links anywhere make long rivers, confluences and loops; some lead out of the table, some to themselves.
    reaches = [(i, rng.choice([i + 1, i + 1, i + 1, rng.randrange(300), -1 if i % 9 == 0 else i + 2]), float(rng.randrange(0, 64)), rng.randrange(4)) for i in range(300)]
    starts = [*range(0, 300, 7), 900]
    df = spark.createDataFrame(reaches, "linkno long, dslinkno long, length_m double, strm_order int")
    for up, down in ((50.0, 200.0), (3000.0, 1e9)):
        got = network.walk(spark.createDataFrame([(s,) for s in starts], "linkno long"), df, up, down).collect()
        assert {(r.start, r.direction, r.linkno): r.total for r in got} == stepwise(starts, reaches, up, down) and len(got) == len({tuple(r) for r in got})


def test_rounds_grow_with_the_logarithm_of_a_walk(spark, monkeypatch):
    n, stored = 10_000, []
    monkeypatch.setattr(network, "cut_lineage", lambda df, cut=network.cut_lineage: stored.append(1) or cut(df))
    chain = spark.range(n).selectExpr("id AS linkno", f"if(id = {n - 1}, -1, id + 1) AS dslinkno", "1.0D AS length_m", "1 AS strm_order")
    got = network.walk(spark.createDataFrame([(0,), (n - 1,)], "linkno long"), chain, 1e6, 1e6)
    assert got.count() == 2 * n + 2 and got.agg(F.max("total")).first()[0] == n
    assert len(stored) <= 2 * 15 + 2


def test_walks_without_starts_or_reaches(spark):
    none = spark.createDataFrame([], "linkno long, dslinkno long, length_m double, strm_order int")
    assert network.walk(spark.range(3).withColumnRenamed("id", "linkno"), none).isEmpty()
    assert network.walk(none.select("linkno"), none.union(none)).columns == ["start", "linkno", "direction", "total"]


def test_band_overlap(spark):
    rows = [(1.0, 1.0, 1.0, 1.0, 1.0), (0.0, 1.0, 2.0, 3.0, 0.0), (0.0, 10.0, 2.0, 4.0, 0.2), (0.0, 4.0, 0.0, 4.0, 1.0), (1.0, 1.0, 2.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, want double")
    got = df.withColumn("got", validate.jaccard(*[F.col(c) for c in "abcd"])).collect()
    assert all(r.got == pytest.approx(r.want) for r in got)


def test_reindex_only_above_the_limit(spark):
    df = spark.createDataFrame([("a", 10**9), ("b", 10**9 + 1), ("b", 10**9 + 5)], "f string, h long")
    got = sorted((r.f, r.h, r.state) for r in reindex_large(df, ["h"], "h", "f").collect())
    assert got == [("a", 10**9, "OK"), ("b", 1, "FIXED"), ("b", 5, "FIXED")]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "id int, s string, v double")
    new = spark.createDataFrame([(2, None, 9.0), (3, "z", None)], "id int, s string, v double")
    assert sorted(map(tuple, upsert(old, new, ["id"]).collect())) == [(1, "x", 1.0), (2, "y", 9.0), (3, "z", None)]
    empty = spark.createDataFrame([(1, None, None)], "id int, s string, v double")
    assert sorted(map(tuple, replace_keys(old, empty, ["id"]).collect())) == [(2, "y", 2.0)]
