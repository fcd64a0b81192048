"""Regions of several parts and with holes, and walks through loops."""

import random

from weirspan.operators import near, network

SQUARE = [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)]
HOLE = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]
ISLAND = [(2.8, 2.8), (3.2, 2.8), (3.0, 3.3)]
FAR = [(10.0, 1.0), (12.0, 2.0), (11.0, 5.0)]


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def test_parts_and_holes(spark):
    rng = random.Random(6)
    regions = {3: [SQUARE, HOLE, ISLAND, FAR], 1: [[(5.0, 5.0), (8.0, 5.0), (8.0, 8.0)]], 2: [[]]}
    df = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in r] for r in rings]) for k, rings in regions.items()], "vpu int, rings array<array<struct<x double, y double>>>")
    points = [(i, rng.uniform(-1, 9), rng.uniform(-1, 13)) for i in range(400)] + [(1000, 3.0, 3.0), (1001, 2.5, 2.5), (1002, 3.0, 11.0), (1003, None, 1.0), (1004, float("nan"), 1.0)]
    sites = spark.createDataFrame(points, "site_id int, latitude double, longitude double")
    got = {r.site_id: r.vpu for r in near.region_of(sites, df).collect()}
    want = {i: min((k for k, rings in regions.items() if lat is not None and inside(lon, lat, rings)), default=None) for i, lat, lon in points}
    assert got == want and got[1000] == 3 and got[1001] is None and got[1002] == 3


def test_walk_ends_at_a_loop(spark):
    """Downstream 1 -> 2 -> 3 -> 2, with reaches of no length."""
    reaches = spark.createDataFrame([(1, 2, 0.0, 1), (2, 3, 0.0, 1), (3, 2, 0.0, 1)], "linkno long, dslinkno long, length_m double, strm_order int")
    starts = spark.createDataFrame([(1,)], "linkno long")
    got = sorted((r.direction, r.linkno) for r in network.walk(starts, reaches).collect())
    assert got == [("down", 1), ("down", 2), ("down", 3), ("up", 1)]
