"""Reach identification, crosswalks, cross-section extraction, stream profiles and label repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirspan.functions import geo
from weirspan.functions import text as tx
from weirspan.operators import keyed, near, network
from weirspan.session import cut_lineage, merged


def identify_reaches(sites: DataFrame, gauges: DataFrame, regions: DataFrame, reaches: DataFrame, vertices: DataFrame) -> DataFrame:
    """Basin code, region and reach of every site; places listed more than once are looked up once."""
    place = ["latitude", "longitude"]
    once = sites.groupBy(*place).agg(F.min("site_id").alias("site_id"))
    found = near.priority_nearest(near.region_of(near.nearest_gauge(once, gauges), regions), reaches, vertices)
    return sites.select("site_id", *place).join(found.select(*place, "huc4", "vpu", "linkno", "strm_order", "dist"), place, "left")


def crosswalks(pairs: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Crosswalk tables from nearest-line pairs: NHD to TDX distinct; TDX to NHD the lowest in network order."""
    nhd = pairs.select(F.col("left_id").alias("nhdplusid"), F.col("right_id").alias("linkno")).distinct()
    tdx = keyed.one_per_target(nhd.join(order, "nhdplusid"), "hydroseq")
    return nhd, tdx


def rekeyed_both_ways(stats_nhd: DataFrame, pairs: DataFrame, order: DataFrame) -> DataFrame:
    """Statistics of NHD reaches under their TDX ids, one NHD reach per TDX id."""
    _, tdx = crosswalks(pairs, order)
    return keyed.rekey(stats_nhd, tdx, "nhdplusid", "linkno", "comid")


def extract_sections(sites: DataFrame, line: DataFrame, stream_cells: DataFrame, profiles: DataFrame, grid: tuple[float, float, float, float]) -> DataFrame:
    """Cross-sections at the five target points of each site.

    ``line``: site_id, seq, x, y; ``stream_cells``: site_id, comid, row_, col_, ord; ``profiles``: comid, row_,
    col_, xs1, xs2 as list text; ``grid``: origin and cell size of the raster.
    """
    # The line is read many times below and its plan would be laid out as often: materialise it once.
    targets = network.target_points(sites, network.measured_segments(cut_lineage(line)))
    x0, y0, dx, dy = [F.lit(v) for v in grid]
    row, col = geo.grid_cell(F.col("x"), F.col("y"), x0, y0, dx, dy)
    asked = targets.select("site_id", "label", "label_ord", row.cast("double").alias("x"), col.cast("double").alias("y"))
    cells = stream_cells.select("site_id", F.col("row_").cast("double").alias("x2"), F.col("col_").cast("double").alias("y2"), "comid", "ord")
    hits = near.nearest_point(asked, cells, ["site_id"], 8.0).where(F.col("comid").isNotNull())
    hits = hits.select("site_id", "label", "comid", F.col("x2").cast("int").alias("row_"), F.col("y2").cast("int").alias("col_"))
    out = hits.join(merged(profiles), ["comid", "row_", "col_"])
    out = out.withColumns({"xs1": tx.parse_list(F.col("xs1")), "xs2": tx.parse_list(F.col("xs2"))})
    return out.where((F.size("xs1") >= 2) & (F.size("xs2") >= 2))


def merge_simulator_tables(curve: DataFrame, stage: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rating curves with the stage and the profile row of the nearest cell, numbered along the stream."""
    merged = near.tolerance_join(curve, stage)
    merged = near.tolerance_join(merged, profiles.withColumnRenamed("ord", "profile_ord").withColumn("ord", F.col("profile_ord")).drop("profile_ord"))
    return network.numbered_cells(merged)


def stream_profile(cells: DataFrame, stage: DataFrame) -> DataFrame:
    """Bed and stage along the stream of each site; cells without stage keep NULL."""
    level = stage.groupBy("comid", "row_", "col_").agg(F.max("wse").alias("wse"))
    rows = network.stream_distance(cells)
    return rows.join(level, ["comid", "row_", "col_"], "left")


def repair_labels(sections: DataFrame, targets: DataFrame) -> DataFrame:
    """Label of sections that lack one: the target point closest to the middle of the section line."""
    broken = sections.where(F.col("label").isNull())
    mid = broken.select("site_id", F.col("xs_key").alias("point_id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    fixed = near.nearest_label(mid, targets).select(F.col("point_id").alias("xs_key"), F.col("label").alias("fixed"))
    return sections.join(merged(fixed), "xs_key", "left").withColumn("label", F.coalesce("label", "fixed")).drop("fixed")
