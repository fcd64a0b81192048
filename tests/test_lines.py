"""The curve-ordered line layer: ranges against brute force, and row groups that the scan skips."""

import random

import pytest
from pyspark.sql import functions as F

from weirspan.functions import geo
from weirspan.sources import lines


def wandering(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x, y, step = rng.uniform(-125, -70), rng.uniform(25, 48), rng.choice([1e-4, 1e-3, 1e-2, 0.5])
        for i in range(rng.randint(1, 5)):
            rows.append((k, i, x, y))
            x, y = x + rng.uniform(-step, step), y + rng.uniform(-step, step)
    return rows


def touches(points, box):
    """A segment and a box, by clipping."""
    x0, y0, x1, y1 = box
    for (ax, ay), (bx, by) in zip(points, points[1:] or points):
        lo, hi = 0.0, 1.0
        for p, d, a, b in ((ax, bx - ax, x0, x1), (ay, by - ay, y0, y1)):
            if d == 0:
                if not a <= p <= b:
                    hi = -1.0
            else:
                s, t = sorted(((a - p) / d, (b - p) / d))
                lo, hi = max(lo, s), min(hi, t)
        if lo <= hi:
            return True
    return False


BOXES = [(-100.0, 35.0, -99.0, 36.0), (-120.0, 30.0, -75.0, 31.0), (-90.005, 40.0, -90.0, 40.005), (-180.0, -90.0, 180.0, 90.0), (-99.0, 36.0, -99.0, 36.0), (0.0, 0.0, 5.0, 5.0)]


@pytest.fixture(scope="module")
def layer(spark, tmp_path_factory):
    rows = wandering(4000) + [(9000, 0, -124.0, 26.0), (9000, 1, -71.0, 47.0), (9001, 0, None, 3.0), (9001, 1, -99.5, 35.5), (9002, 0, 180.0, 90.0), (9003, 0, float("nan"), 1.0)]
    path = f"{tmp_path_factory.mktemp('lines')}/layer"
    lines.write_lines(spark.createDataFrame(rows, "linkno long, seq int, x double, y double"), path, group_bytes=4096)
    found = {}
    for k, i, x, y in rows:
        if x is not None and x == x:
            found.setdefault(k, []).append((x, y))
    return path, found


@pytest.mark.parametrize("box", BOXES)
def test_box_against_brute_force(spark, layer, box):
    path, found = layer
    got = sorted(r.linkno for r in lines.read_box(spark, path, box).collect())
    assert got == sorted(k for k, points in found.items() if touches(points, box))


def test_key_ranges_are_few_and_ordered():
    for box in BOXES:
        ranges = lines.key_ranges(box)
        assert all(a <= b for a, b in ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
        assert len(ranges) <= lines.MOST_RANGES * (lines.DEEPEST + 1)


def test_most_row_groups_are_skipped(spark, tmp_path):
    n = 200_000
    k = F.col("id")
    start = spark.range(n).select(k.alias("linkno"), (-125 + (k * 7919 % 55000) / 1000.0).alias("x"), (25 + (k * 104729 % 23000) / 1000.0).alias("y"))
    vertices = start.select("linkno", F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), (F.col("x") + 0.001 * i).alias("x"), (F.col("y") + 0.0005 * i).alias("y")) for i in range(2)])).alias("v"))
    path = f"{tmp_path}/layer"
    lines.write_lines(vertices.select("linkno", "v.*"), path, group_bytes=64 << 10)
    box = (-100.2, 35.0, -100.0, 35.2)
    hit = lines.read_box(spark, path, box)
    rows = hit.collect()
    plan = hit._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [Or(" in plan.toString() or "PushedFilters: [" in plan.toString() and "curve" in plan.toString()
    scan = plan.collectLeaves().apply(0)
    read = scan.metrics().apply("numOutputRows").value()
    assert 0 < len(rows) <= read < n / 10
    want = start.where(F.col("x").between(box[0] - 0.001, box[2]) & F.col("y").between(box[1] - 0.0005, box[3]))
    assert len(rows) <= want.count()


@pytest.mark.parametrize("name", ["albers", "utm"])
def test_projections_there_and_back(spark, name):
    rng = random.Random(3)
    rows = [(rng.uniform(18, 60), rng.uniform(-130, -60)) for _ in range(2000)] + [(23.0, -96.0), (29.5, -96.0), (49.999, -124.999)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    x, y = getattr(geo, name)(F.col("lat"), F.col("lon"))
    df = df.select("lat", "lon", x.alias("x"), y.alias("y"), geo.utm_zone(F.col("lon")).alias("zone"))
    back = geo.albers_inverse(F.col("x"), F.col("y")) if name == "albers" else geo.utm_inverse(F.col("x"), F.col("y"), F.col("zone"))
    worst = df.select(F.max(F.abs(back[0] - F.col("lat"))), F.max(F.abs(back[1] - F.col("lon")))).first()
    assert max(worst) < 1e-8


def test_known_place(spark):
    """Central meridian and equator-like landmarks with exact answers."""
    df = spark.createDataFrame([(500000.0, 0.0, 15)], "x double, y double, zone int")
    lat, lon = geo.utm_inverse(F.col("x"), F.col("y"), F.col("zone"))
    assert tuple(df.select(lat, lon).first()) == (0.0, -93.0)
    lat, lon = geo.albers_inverse(F.lit(0.0), F.lit(0.0))
    got = df.select(lat, lon).first()
    assert abs(got[0] - 23) < 1e-9 and got[1] == -96.0
