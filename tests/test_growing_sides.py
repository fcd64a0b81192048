"""Sides of joins that grow with the input are not broadcast, however small the planner takes them to be."""

import pytest
from pyspark.sql import functions as F

from weirspan.functions import steps
from weirspan.operators import flow, near, network
from weirspan.plans import site_geometry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def vertices(spark, tmp_path):
    """Lines of four vertices out of a small file: ``explode`` adds rows that the planner doesn't count."""
    spark.range(50).select(F.col("id").alias("site_id")).write.parquet(f"{tmp_path}/lines")
    rows = spark.read.parquet(f"{tmp_path}/lines").withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.select("site_id", "seq", (F.col("seq") * 1.0).alias("x"), (F.col("site_id") * 1.0).alias("y"))


def targets(vertices):
    points = vertices.where("seq = 1").select("site_id", (F.col("x") + 0.25).alias("px"), "y").withColumnRenamed("y", "py").withColumn("weir_length", F.lit(0.5))
    return network.target_points(points, network.measured_segments(vertices))


def test_segments_and_target_points(vertices):
    assert "BroadcastExchange" not in plan(near.line_segments(vertices, "site_id"))
    found = targets(vertices)
    assert "Broadcast" not in plan(found).replace("BroadcastNestedLoop", "")
    rows = {r.label: (r.x, r.y) for r in found.where("site_id = 7").collect()}
    assert rows == {"Upstream": (0.75, 7.0), "Downstream1": (1.75, 7.0), "Downstream2": (2.25, 7.0), "Downstream3": (2.75, 7.0), "Downstream4": (3.0, 7.0)}


def test_nearest_point(vertices, monkeypatch):
    plans, cut = [], near.cut_lineage
    monkeypatch.setattr(near, "cut_lineage", lambda df: plans.append(plan(df)) or cut(df))
    left = vertices.select("site_id", (F.col("x") + 0.2).alias("x"), "y")
    right = vertices.select("site_id", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("seq").alias("ord"), "seq")
    found = near.nearest_point(left, right, ["site_id"], 8.0)
    assert not any("Broadcast" in p for p in [*plans, plan(found)])
    assert found.where(F.col("seq") != F.floor("x")).isEmpty() and found.count() == 200


def test_nearest_label_and_repair(vertices):
    marks = targets(vertices)
    points = vertices.where("seq = 1").select("site_id", F.col("site_id").alias("point_id"), "x", "y")
    found = near.nearest_label(points, marks)
    assert "Broadcast" not in plan(found) and found.where("label = 'Upstream'").count() == 50
    sections = points.select("site_id", F.col("point_id").alias("xs_key"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.lit(None).cast("string").alias("label"))
    fixed = site_geometry.repair_labels(sections, marks)
    assert "Broadcast" not in plan(fixed) and fixed.where("label = 'Upstream'").count() == 50


def test_merged_line(vertices):
    steps = vertices.where("seq = 0").select("site_id", F.col("site_id").alias("linkno"), F.lit(0).alias("place"))
    line = network.merged_line(steps, vertices.withColumnRenamed("site_id", "linkno"))
    assert "Broadcast" not in plan(line)
    assert [(r.seq, r.x) for r in line.where("site_id = 3").orderBy("seq").collect()] == [(0, 3.0), (1, 2.0), (2, 1.0), (3, 0.0)]


def test_pairs_in_a_box_come_once_and_are_not_sorted(spark):
    # A long reach and a wide box share several bins; the pair is one row without being sought for among all pairs.
    sites = spark.createDataFrame([(1, 40.0, -100.0), (1, 40.0, -100.0), (2, 41.0, -100.0)], "site_id long, latitude double, longitude double")
    reach = spark.createDataFrame([(7, i, -100.05 + 0.02 * i, 40.001) for i in range(6)] + [(8, 0, -99.0, 40.0), (8, 1, -98.9, 40.0)], "linkno long, seq long, x double, y double")
    found = near.reaches_in_box(sites, reach)
    assert [(r.site_id, r.linkno) for r in found.collect()] == [(1, 7)]
    assert "HashAggregate(keys=[site_id" not in plan(found.select("site_id", "linkno")).split("Join")[0]


def test_only_asked_days_are_averaged(spark):
    # The record is not aggregated or sorted again for the look-up: it meets the questions first, and the questions are held in memory.
    record = spark.createDataFrame([(1, "2020-01-01", 2.0), (1, "2020-01-01", 4.0), (1, "2020-01-02", 9.0), (2, "2020-01-01", None), (None, "2020-01-01", 7.0)], "reach_id long, date string, streamflow double")
    asks = spark.createDataFrame([(1, "2020-01-01"), (1, "2020-01-01"), (1, None), (2, "2020-01-01"), (3, "2020-01-01"), (None, "2020-01-01")], "reach_id long, day string")
    found = flow.flow_on(asks, record, "day", "q")
    shown = plan(found)
    assert sorted((r.reach_id or 0, r.day or "", r.q or 0.0) for r in found.collect()) == [(0, "2020-01-01", 0.0), (1, "", 0.0), (1, "2020-01-01", 3.0), (1, "2020-01-01", 3.0), (2, "2020-01-01", 0.0), (3, "2020-01-01", 0.0)]
    assert "SortMergeJoin" not in shown and "keys=[reach_id" not in shown.split("ShuffledHashJoin")[1]


def test_line_is_laid_out_once(spark, vertices, monkeypatch):
    seen, nearest = [], near.nearest_point
    monkeypatch.setattr(near, "nearest_point", lambda left, *rest: seen.append(plan(left)) or nearest(left, *rest))
    sites = spark.createDataFrame([(3, 1.25, 3.0, 0.5)], "site_id long, px double, py double, weir_length double")
    cells = spark.createDataFrame([(3, 70, 0, 0, 1)], "site_id long, comid long, row_ int, col_ int, ord long")
    profiles = spark.createDataFrame([(70, 0, 0, "[1, 2]", "[3, 4]")], "comid long, row_ int, col_ int, xs1 string, xs2 string")
    found = site_geometry.extract_sections(sites, vertices, cells, profiles, (0.0, 3.0, 1.0, 1.0))
    assert sorted(r.label for r in found.collect()) == ["Downstream1", "Downstream2", "Downstream3", "Downstream4", "Upstream"]
    assert len(seen) == 1 and "FileScan" not in seen[0]


def test_a_search_names_the_middle_once(spark):
    # The condition names it four times; the sum of both ends stands in the tree for the halvings and for the end only.
    root = steps.bisect(F.lit(0.0), F.col("hi"), lambda y: y * y * y * y < 2, 50)
    found = spark.createDataFrame([(2.0,), (None,)], "hi double").select(root.alias("root"))
    assert plan(found).split("\n")[0].count(") / 2.0)") == 2
    assert [r.root and round(r.root, 9) for r in found.collect()] == [round(2**0.25, 9), None]
