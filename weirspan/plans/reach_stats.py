"""Reach statistics: one row per reach with base flow, median, extremes and return-period flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirspan.operators import flow

# Fixed column order of the statistics table.
STAT_COLUMNS = (
    "comid", "known_baseflow", "qout_median", "qout_max", "rp2", "rp5", "rp10", "rp25", "rp50", "rp100", "qout_max_premium", "rp100_premium",
)


def reach_statistics(record: DataFrame, scan_dates: DataFrame, exceedance: bool = False) -> DataFrame:
    """Statistics of every reach with at least two years; base flow on the scan date, else the median.

    With ``exceedance`` the flows at 10, 20 .. 100 percent follow; they come from the same pass as the median.
    """
    more = flow.EXCEEDANCE_NAMES if exceedance else {}
    stats = flow.median_and_max(record, more).join(flow.return_period_flows(record), "reach_id")
    scans = flow.flow_on(scan_dates, record, "scan_date", "on_scan").select("reach_id", "on_scan")
    out = stats.join(scans, "reach_id", "left")
    return out.withColumns(
        {"known_baseflow": F.coalesce("on_scan", "qout_median"), "rp100_premium": F.col("rp100") * flow.PREMIUM,
         "comid": F.col("reach_id")}
    ).select(*STAT_COLUMNS, *more)


def reach_statistics_from_table(record: DataFrame, return_periods: DataFrame, scan_dates: DataFrame) -> DataFrame:
    """As ``reach_statistics`` with return-period flows from a supplied table, 0 where it has none."""
    scans = flow.flow_on(scan_dates, record, "scan_date", "on_scan").select(F.col("reach_id").alias("comid"), "on_scan")
    out = flow.median_and_max(record).withColumnRenamed("reach_id", "comid").join(scans, "comid", "left")
    out = out.join(flow.return_periods_from_table(return_periods), "comid", "left")
    return out.withColumns(
        {**{f"rp{t}": F.coalesce(f"rp{t}", F.lit(0.0)) for t in flow.RETURN_PERIODS},
         "known_baseflow": F.coalesce("on_scan", "qout_median"),
         "rp100_premium": F.coalesce("rp100", F.lit(0.0)) * flow.PREMIUM}
    ).select(*STAT_COLUMNS)


def replace_columns(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Drop the columns ``fresh`` brings and join its values in; rows without a match get NULL."""
    return table.drop(*[c for c in fresh.columns if c != key]).join(fresh, key, "left")


def with_exceedance(stats: DataFrame, record: DataFrame) -> DataFrame:
    return replace_columns(stats, flow.exceedance_flows(record).withColumnRenamed("reach_id", "comid"), "comid")


def update_baseflow(stats: DataFrame, scan_dates: DataFrame, record: DataFrame) -> DataFrame:
    """Base flow replaced by the flow on the scan date where that is known."""
    scans = flow.flow_on(scan_dates, record, "scan_date", "on_scan").select("reach_id", "on_scan")
    return stats.join(scans, "reach_id", "left").withColumn(
        "known_baseflow", F.coalesce("on_scan", "known_baseflow")
    ).drop("on_scan")


def exceedance_per_source(incidents: DataFrame, records: dict[str, DataFrame]) -> DataFrame:
    """Exceedance of ``flow_<source>`` in that source's record; NULL for sites without one."""
    return reduce(
        lambda df, s: flow.exceedance_of(df, records[s], {f"flow_{s}": f"exceedance_{s}"}), records, incidents
    )
