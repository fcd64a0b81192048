"""Flow histories: daily means, medians, return periods, flow-duration curves, lookups on a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirspan.operators import ranking

# Return periods in years, the factor of the "premium" flows, exceedance percentages.
RETURN_PERIODS = (2, 5, 10, 25, 50, 100)
PREMIUM = 1.5
EXCEEDANCES = (10, 20, 30, 40, 50, 60, 70, 80, 90, 100)


def known_flow() -> Column:
    """Flow with NaN as NULL: aggregates skip it instead of ranking it above every number."""
    return F.when(~F.isnan("streamflow"), F.col("streamflow"))


def daily_mean(obs: DataFrame) -> DataFrame:
    """Sub-daily observations to one mean per reach and observed day."""
    return obs.groupBy("reach_id", F.to_date("ts").alias("date")).agg(F.avg(known_flow()).alias("streamflow"))


def daily_mean_with_gaps(obs: DataFrame) -> DataFrame:
    """As ``daily_mean`` with NULL for days missing inside each reach's record."""
    daily = daily_mean(obs)
    span = daily.groupBy("reach_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("reach_id", F.explode(F.sequence("a", "b")).alias("date"))
    return days.join(daily, ["reach_id", "date"], "left")


def reach_range(flow: DataFrame) -> DataFrame:
    """Smallest and largest flow on record."""
    return flow.groupBy("reach_id").agg(F.min(known_flow()).alias("q_lo"), F.max(known_flow()).alias("q_hi"))


def search_bounds(ids: DataFrame, flow: DataFrame, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Search interval per reach with defaults where there is no record."""
    return ids.join(reach_range(flow), "reach_id", "left").withColumns(
        {"q_lo": F.coalesce("q_lo", F.lit(lo)), "q_hi": F.coalesce("q_hi", F.lit(hi))}
    )


EXCEEDANCE_NAMES = {f"q_ep_{p}": (100 - p) / 100 for p in EXCEEDANCES}


def median_and_max(flow: DataFrame, more: dict[str, float] | None = None) -> DataFrame:
    """Median and largest flow, and the quantiles named in ``more``, from one pass."""
    out = ranking.quantiles(flow, ["reach_id"], "streamflow", {"qout_median": 0.5, "qout_max": 1.0} | (more or {}))
    return out.withColumn("qout_max_premium", F.col("qout_max") * PREMIUM)


def annual_maxima(flow: DataFrame) -> DataFrame:
    top = flow.groupBy("reach_id", F.year("date").alias("year")).agg(F.max(known_flow()).alias("peak"))
    return top.where(F.col("peak").isNotNull())


def _peaks(flow: DataFrame) -> DataFrame:
    """Annual peaks of a reach as a descending array: at most one element per calendar year."""
    peaks = annual_maxima(flow).groupBy("reach_id").agg(F.sort_array(F.collect_list("peak"), asc=False).alias("peaks"))
    return peaks.where(F.size("peaks") >= 2)


def plotting_positions(flow: DataFrame) -> DataFrame:
    """Weibull exceedance probability and return period of every annual peak."""
    ranked = _peaks(flow).select("reach_id", F.size("peaks").alias("n"), F.posexplode("peaks").alias("i", "peak"))
    rank = F.col("i") + 1
    return ranked.select(
        "reach_id", "peak", rank.alias("rank"),
        (rank / (F.col("n") + 1)).alias("probability"), ((F.col("n") + 1) / rank).alias("period"),
    )


def _flow_at_period(peaks: Column, period: int) -> Column:
    """Linear in the return period between neighbouring peaks, constant beyond both ends."""
    n1 = (F.size(peaks) + 1).cast("double")
    above = F.floor(n1 / F.lit(float(period))).cast("int")
    p_above, p_below = n1 / above, n1 / (above + 1)
    v_above, v_below = F.get(peaks, above - 1), F.get(peaks, above)
    inside = v_below + (v_above - v_below) * (F.lit(float(period)) - p_below) / (p_above - p_below)
    return (
        F.when(F.lit(float(period)) > n1, F.get(peaks, F.lit(0)))
        .when(F.lit(float(period)) < n1 / F.size(peaks), F.get(peaks, F.size(peaks) - 1))
        .when(p_above == F.lit(float(period)), v_above)
        .otherwise(inside)
    )


def return_period_flows(flow: DataFrame) -> DataFrame:
    return _peaks(flow).select("reach_id", *[_flow_at_period(F.col("peaks"), t).alias(f"rp{t}") for t in RETURN_PERIODS])


def return_periods_from_table(table: DataFrame) -> DataFrame:
    """Supplied return-period flows as columns; a missing period is 0."""
    wide = table.groupBy("comid").pivot("return_period", list(RETURN_PERIODS)).agg(F.first("flow"))
    return wide.select("comid", *[F.coalesce(F.col(str(t)), F.lit(0.0)).alias(f"rp{t}") for t in RETURN_PERIODS])


def exceedance_flows(flow: DataFrame) -> DataFrame:
    """Flow exceeded 10, 20 .. 100 percent of the time."""
    return ranking.quantiles(flow, ["reach_id"], "streamflow", EXCEEDANCE_NAMES)


def duration_curve(flow: DataFrame) -> DataFrame:
    """One row per distinct flow: exceedance of its first occurrence in descending order."""
    cum = ranking.cumulative_counts(flow, ["reach_id"], "streamflow")
    first = F.col("total") - F.col("before") - F.col("cnt") + 1
    return cum.select("reach_id", "v", "cnt", (F.lit(100.0) * first / (F.col("total") + 1)).alias("exceedance"))


def duration_curve_rows(flow: DataFrame) -> DataFrame:
    """One row per observation, largest flow first: 100 * rank / (n + 1)."""
    rows = ranking.ranked_rows(flow, ["reach_id"], "streamflow", descending=True)
    return rows.select(
        "reach_id", F.col("v").alias("streamflow"), "rank",
        (F.lit(100.0) * F.col("rank") / (F.col("total") + 1)).alias("exceedance"),
    )


def exceedance_of(lookups: DataFrame, flow: DataFrame, outs: dict[str, str]) -> DataFrame:
    """Exceedance of the recorded flow closest to each value column; the smaller exceedance on a tie."""
    return ranking.nearest_value(lookups, duration_curve(flow), ["reach_id"], outs, "exceedance")


def flow_on(asks: DataFrame, flow: DataFrame, date: str, out: str) -> DataFrame:
    """Daily mean on the asked date, NULL when there is none.

    The record meets the questions first: a task holds those of its share in memory, and only days asked for are averaged.
    """
    key = ["reach_id", date]
    rest = [c for c in asks.columns if c not in key]
    asked = asks.withColumn("__ask", F.monotonically_increasing_id()).hint("shuffle_hash")
    days = flow.select("reach_id", F.col("date").alias(date), known_flow().alias("__flow"))
    hits = asked.join(days, key, "left").groupBy(*key, "__ask")
    found = hits.agg(F.first(F.struct("__ask", *rest)).alias("__row"), F.avg("__flow").alias(out))
    return found.select(*key, *[F.col(f"__row.`{c}`").alias(c) for c in rest], out)


def flow_on_or_median(asks: DataFrame, flow: DataFrame, date: str, out: str) -> DataFrame:
    mid = ranking.median(flow, ["reach_id"], "streamflow", "__median")
    hit = flow_on(asks, flow, date, "__hit").join(mid, "reach_id", "left")
    return hit.withColumn(out, F.coalesce("__hit", "__median")).drop("__hit", "__median")


def record_of(flow: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the asked reaches."""
    return flow.join(ids.select("reach_id").distinct(), "reach_id", "left_semi")


def missing_from_record(flow: DataFrame, ids: DataFrame) -> DataFrame:
    """Asked reaches without any row."""
    return ids.select("reach_id").distinct().join(flow.select("reach_id"), "reach_id", "left_anti")
