"""Structure height, dangerous range and jump conditions of cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirspan.functions import hydraulics as hy
from weirspan.functions import sections as sx
from weirspan.operators import keyed
from weirspan.session import spread

RECTANGULAR, MOMENTUM = "rectangular", "momentum"
GRID = 100
# Parts into which the incidents of a site are dealt.
SITE_PARTS = 16
# First discharge of a grid whose lower bound is 0: no depth is defined without flow.
GRID_START = 0.01


def with_profiles(surveys: DataFrame) -> DataFrame:
    """Bed elevation, depth profiles and stage table of each section."""
    out = surveys.withColumn("bed", sx.bed_elevation(F.col("xs1"), F.col("xs2")))
    out = out.withColumns({"d1": sx.depth_profile(F.col("xs1"), F.col("bed")), "d2": sx.depth_profile(F.col("xs2"), F.col("bed"))})
    return out.withColumn("stage", sx.stage_table(F.col("d1"), F.col("d2"), F.col("dx")))


def with_height(sections: DataFrame) -> DataFrame:
    """Weir head and structure height at base flow, from the fall of the water level below the upstream section.

    Needs site_id, xs_index, wse, bed, baseflow, weir_length; the upstream section itself gets NULL.
    """
    rows = keyed.with_upstream(sections, ["wse"])
    rows = hy.with_weir_geometry(
        rows, F.col("baseflow"), F.col("weir_length"), F.col("wse") - F.col("bed"), F.col("wse_up") - F.col("wse")
    )
    below = F.col("xs_index") > 0
    return rows.withColumns({"head": F.when(below, F.col("head")), "p_height": F.when(below, F.col("p_height"))}).drop("wse_up")


def with_danger_range(sections: DataFrame, mode: str) -> DataFrame:
    """``qmin``, ``qmax`` within the search bounds ``q_lo``, ``q_hi``; NULL without a structure height."""
    args = [F.col("weir_length"), F.when(F.col("p_height") != 0, F.col("p_height")), F.col("depth_a"), F.col("depth_b")]
    bounds = [F.col("q_lo"), F.col("q_hi")]
    sections = spread(sections)
    if mode == MOMENTUM:
        lo, hi = sx.danger_range_momentum(*args, F.col("stage"), *bounds)
    else:
        lo, hi = hy.danger_range_rectangular(*args, *bounds)
    return sections.withColumns({"qmin": lo, "qmax": hi})


def with_jump(rows: DataFrame, flow: str, mode: str = RECTANGULAR) -> DataFrame:
    """Depths, Froude number and jump type at discharge ``flow``.

    Needs weir_length, p_height, depth_a, depth_b, and ``stage`` in momentum mode.
    """
    q = F.col(flow)
    rows = rows.withColumns({"y_t": hy.tailwater(q, F.col("depth_a"), F.col("depth_b")), "head": hy.weir_head(q, F.col("weir_length"))})
    rows = hy.with_y1(rows, F.col("head"), F.col("p_height"))
    rows = hy.with_froude(rows, F.col("head"), F.col("p_height"))
    rows = hy.with_flip_depth(rows, q, F.col("weir_length"), F.col("p_height"))
    if mode == MOMENTUM:
        rows = rows.withColumn("__m", sx.conjugate_by_momentum(q, F.col("y_1"), F.col("weir_length"), F.col("stage")))
        rows = rows.withColumns({"y_2": F.col("__m.y2"), "m1": F.col("__m.m1"), "m2": F.col("__m.m2")}).drop("__m")
    else:
        none = F.lit(None).cast("double")
        rows = rows.withColumns({"y_2": hy.conjugate_depth(F.col("y_1"), F.col("fr_1")), "m1": none, "m2": none})
    return rows.withColumn("jump_type", hy.jump_type(F.col("y_2"), F.col("y_t"), F.col("y_flip")))


def jumps_at_incidents(sections: DataFrame, incidents: DataFrame, mode: str = RECTANGULAR) -> DataFrame:
    """One row per downstream section and incident with a positive flow at its site."""
    below = sections.where((F.col("xs_index") > 0) & (F.col("p_height") != 0))
    # The thin sides are dealt out by site and part; their product is worked on where it arises. The incidents of a
    # busy site are then the work of several tasks, and the few sections of a site are repeated once a part: they are
    # the side that a task holds in memory, only those of its share of sites. A hash join also keeps the row work out of the merge.
    asked = incidents.where(F.col("flow") > 0)
    asked = asked.withColumn("__part", F.pmod(F.xxhash64(*asked.columns), F.lit(SITE_PARTS)))
    below = below.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SITE_PARTS - 1)).cast("array<bigint>")))
    rows = spread(asked, "site_id", "__part").join(spread(below, "site_id", "__part").hint("shuffle_hash"), ["site_id", "__part"]).drop("__part")
    return with_jump(rows, "flow", mode)


def with_grid(sections: DataFrame) -> DataFrame:
    """Each section on ``GRID`` discharges ``q``, numbered ``i``, from ``q_lo`` to ``q_hi``; 0 is replaced by ``GRID_START``."""
    start = F.when(F.col("q_lo") == 0, F.lit(GRID_START)).otherwise(F.col("q_lo"))
    step = (F.col("q_hi") - start) / F.lit(GRID - 1)
    grid = sections.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
    return grid.withColumn("q", start + F.col("i") * step)


def danger_curves(sections: DataFrame, mode: str = RECTANGULAR) -> DataFrame:
    """Tailwater, conjugate and flip depth on the grid of discharges."""
    return with_jump(with_grid(spread(sections)), "q", mode)
