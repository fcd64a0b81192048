"""Nearest searches with missing coordinates, and reaches whose extent but not whose line meets the box."""

import math

import pytest
from pyspark.sql import functions as F

from weirspan.functions import text
from weirspan.operators import near

BAD = (None, float("nan"), float("inf"), float("-inf"))


def test_nearest_point_ends_on_missing_coordinates(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), *[(i + 2, b, 1.0) for i, b in enumerate(BAD)], (9, 1.0, None)], "k int, x double, y double")
    right = spark.createDataFrame([(7, 3.0, 4.0), *[(20 + i, b, b) for i, b in enumerate(BAD)]], "ord int, x2 double, y2 double")
    got = {r.k: (r.dist, r.ord) for r in near.nearest_point(left, right, [], 1.0).collect()}
    assert got == {1: (5.0, 7), **{k: (None, None) for k in (2, 3, 4, 5, 9)}}


def test_nearest_point_without_usable_targets(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "c int, x double, y double")
    right = spark.createDataFrame([(1, 7, None, 1.0), (2, 8, float("nan"), 1.0)], "c int, ord int, x2 double, y2 double")
    assert [r.ord for r in near.nearest_point(left, right, ["c"], 1.0).collect()] == [None, None]
    assert [r.ord for r in near.nearest_point(left, right.drop("c"), [], 1.0).collect()] == [None, None]


def test_nearest_lines_end_on_missing_coordinates(spark):
    left = spark.createDataFrame([(1, 10, 0.0, 0.0, 1.0, 0.0), (1, 11, None, 0.0, 1.0, 0.0), (2, 12, 0.0, 0.0, 1.0, 1.0)], "c int, left_id int, x1 double, y1 double, x2 double, y2 double")
    right = spark.createDataFrame([(1, 5, 0.0, 3.0, 1.0, 3.0), (2, 6, float("nan"), 0.0, 1.0, 1.0)], "c int, right_id int, x1 double, y1 double, x2 double, y2 double")
    got = [(r.left_id, r.right_id, r.dist) for r in near.nearest_lines(left, right, ["c"], 0.5).collect()]
    assert got == [(10, 5, 3.0)]


def test_a_reach_whose_extent_alone_meets_the_box_is_not_taken(spark):
    """A long bent reach of order 4 passes 8 km from the site; a small one runs by it."""
    site = spark.createDataFrame([(1, 40.0, -100.0)], "site_id int, latitude double, longitude double")
    bend = [(50, 1, -100.1, 39.9), (50, 2, -99.9, 39.9), (50, 3, -99.9, 40.1)]
    small = [(60, 1, -100.001, 40.001), (60, 2, -99.999, 40.001)]
    vertices = spark.createDataFrame(bend + small, "linkno int, seq int, x double, y double")
    reaches = spark.createDataFrame([(50, 4), (60, 1)], "linkno int, strm_order int")
    got = near.priority_nearest(site, reaches, vertices).first()
    assert got.linkno == 60 and got.dist < 200
    assert [r.linkno for r in near.reaches_in_box(site, vertices).collect()] == [60]


@pytest.mark.parametrize("x, inside", [(0.004, True), (0.02, False)])
def test_a_reach_crossing_the_box_without_a_vertex_in_it(spark, x, inside):
    site = spark.createDataFrame([(1, 40.0, -100.0)], "site_id int, latitude double, longitude double")
    vertices = spark.createDataFrame([(5, 1, -100.0 + x, 39.8), (5, 2, -100.0 + x, 40.2)], "linkno int, seq int, x double, y double")
    assert (near.reaches_in_box(site, vertices).count() == 1) is inside


def test_dates_in_free_text(spark):
    same = ["2010-01-05", "2010-1-5", "1/5/2010", "01/05/2010", "2010/01/05", "Jan 5, 2010", "January 5, 2010", "5 Jan 2010", "20100105", " 2010-01-05 13:45:10 ", "2010-01-05T13:45:10.250Z", "1/5/2010 9:30"]
    none = ["2010-01-05xyz", "unknown", "", "2010-13-05", "2/30/2010", "5", None, "tomorrow 2010-01-05"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(same + none)], "i int, v string")
    got = [r.d for r in df.select("i", F.date_format(text.parse_date(df.v), "yyyy-MM-dd").alias("d")).orderBy("i").collect()]
    assert got == ["2010-01-05"] * len(same) + [None] * len(none)


def test_file_names_keep_their_length(spark):
    df = spark.createDataFrame([('1/3 arc-second',), ('a<>:"/\\|?*b c',)], "v string")
    assert [r[0] for r in df.select(text.safe_filename(df.v)).collect()] == ["1-3 arc-second", "a---------b c"]


def test_distance_of_the_bend(spark):
    """The extent of the bend holds the site, its line is kilometres away."""
    pairs = spark.createDataFrame([(1, 40.0, -100.0, 50)], "site_id int, latitude double, longitude double, linkno int")
    vertices = spark.createDataFrame([(50, 1, -100.1, 39.9), (50, 2, -99.9, 39.9), (50, 3, -99.9, 40.1)], "linkno int, seq int, x double, y double")
    assert math.isclose(near.point_line_distance(pairs, vertices).first().dist, 8500, rel_tol=0.02)
