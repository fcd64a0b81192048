"""Hydraulic analysis of every site: the ``xsections`` and ``results`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirspan.functions import text as tx
from weirspan.operators import flow, jumps, keyed
from weirspan.session import cut_lineage

SLOPE_DIGITS = 3


def section_heights(surveys: DataFrame, sites: DataFrame) -> DataFrame:
    """Sections with profiles and structure height; ``sites``: site_id, reach_id, weir_length, baseflow."""
    return jumps.with_height(jumps.with_profiles(surveys).join(sites, "site_id"))


def analyse_sections(surveys: DataFrame, sites: DataFrame, record: DataFrame, mode: str) -> DataFrame:
    """Structure height, dangerous range and its exceedance probabilities, one row per section."""
    rows = section_heights(surveys, sites).join(flow.reach_range(record), "reach_id", "left")
    rows = rows.withColumns({"q_lo": F.coalesce("q_lo", F.lit(0.0)), "q_hi": F.coalesce("q_hi", F.lit(100.0))})
    rows = jumps.with_danger_range(rows, mode).withColumn("slope", tx.significant(F.col("slope"), SLOPE_DIGITS))
    # The range search is the costly part and is read several times below: materialise it once.
    rows = cut_lineage(rows.drop("xs1", "xs2", "d1", "d2", "stage"))
    return flow.exceedance_of(rows, record, {"qmin": "prob_min", "qmax": "prob_max"})


def analyse_incidents(surveys: DataFrame, sites: DataFrame, incidents: DataFrame, mode: str) -> DataFrame:
    """Jump conditions of every downstream section at every incident of its site."""
    sections = section_heights(surveys, sites).drop("xs1", "xs2", "d1", "d2")
    return jumps.jumps_at_incidents(sections, incidents, mode)


def recompute_heads(stored: DataFrame, surveys: DataFrame, sites: DataFrame) -> DataFrame:
    """Weir head again from stored results: the stored height is kept, the head is solved anew."""
    fresh = section_heights(surveys, sites).select("site_id", "xs_index", "xs_key", F.col("head").alias("head_new"))
    return fresh.join(stored.select("site_id", "xs_index", "xs_key", "p_height"), ["site_id", "xs_index", "xs_key"])


def replace_site_rows(target: DataFrame, fresh: DataFrame) -> DataFrame:
    return keyed.replace_keys(target, fresh, ["site_id"])
