"""Flow-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirspan.operators import flow
from weirspan.operators import ranking
from weirspan.plans import reach_stats
from weirspan.plans.catalog import query
from weirspan.plans.common import day, r, rd, rounded

RP = flow.RETURN_PERIODS
EP = flow.EXCEEDANCES

FDC = """
fdc AS (SELECT reach_id, streamflow, 100.0e0 * row_number() OVER (PARTITION BY reach_id ORDER BY streamflow DESC)
               / (count(*) OVER (PARTITION BY reach_id) + 1) AS exceedance
        FROM {flow_daily} WHERE streamflow IS NOT NULL)"""

PEAKS = """
years AS (SELECT reach_id, extract(year FROM date) AS year, max(streamflow) AS peak FROM {flow_daily} GROUP BY 1, 2),
peaks AS (SELECT reach_id, peak, row_number() OVER (PARTITION BY reach_id ORDER BY peak DESC) AS rank,
                 count(*) OVER (PARTITION BY reach_id) AS n FROM years WHERE peak IS NOT NULL)"""


def rp_sql() -> str:
    """Interpolated return-period flows from ``peaks`` as CTE ``rp(reach_id, period, q)``."""
    targets = ", ".join(f"({t})" for t in RP)
    return f"""
pts AS (SELECT reach_id, peak, n, (n + 1) / CAST(rank AS double) AS period FROM peaks WHERE n >= 2),
ask AS (SELECT DISTINCT reach_id, n, t FROM pts, (VALUES {targets}) AS v(t)),
lo AS (SELECT a.reach_id, a.t, max(p.period) AS period, arg_max(p.peak, p.period) AS peak FROM ask a JOIN pts p ON a.reach_id = p.reach_id AND p.period <= a.t GROUP BY 1, 2),
hi AS (SELECT a.reach_id, a.t, min(p.period) AS period, arg_min(p.peak, p.period) AS peak FROM ask a JOIN pts p ON a.reach_id = p.reach_id AND p.period >= a.t GROUP BY 1, 2),
rp AS (SELECT a.reach_id, a.t, CASE WHEN hi.peak IS NULL THEN lo.peak WHEN lo.peak IS NULL THEN hi.peak
              WHEN hi.period = lo.period THEN hi.peak
              ELSE lo.peak + (hi.peak - lo.peak) * (a.t - lo.period) / (hi.period - lo.period) END AS q
       FROM ask a LEFT JOIN lo ON a.reach_id = lo.reach_id AND a.t = lo.t LEFT JOIN hi ON a.reach_id = hi.reach_id AND a.t = hi.t)"""


def rp_cols(alias: str = "q") -> str:
    return ", ".join(f"{rd(f'max(CASE WHEN t = {t} THEN {alias} END)')} AS rp{t}" for t in RP)


@query(
    "A1_median_and_max",
    f"""SELECT reach_id, {rd('quantile_cont(streamflow, 0.5)')} AS qout_median, {rd('max(streamflow)')} AS qout_max,
               {rd('1.5e0 * max(streamflow)')} AS qout_max_premium FROM {{flow_daily}} GROUP BY reach_id""",
)
def _(t):
    return rounded(flow.median_and_max(t.flow_daily), "qout_median", "qout_max", "qout_max_premium")


@query(
    "A2_annual_maxima",
    f"SELECT reach_id, CAST(extract(year FROM date) AS bigint) AS year, {rd('max(streamflow)')} AS peak FROM {{flow_daily}} GROUP BY 1, 2",
)
def _(t):
    return rounded(flow.annual_maxima(t.flow_daily), "peak").withColumn("year", F.col("year").cast("bigint"))


@query("A3_return_period_flows", f"WITH {PEAKS.strip()}, {rp_sql().strip()} SELECT reach_id, {rp_cols()} FROM rp GROUP BY reach_id")
def _(t):
    return rounded(flow.return_period_flows(t.flow_daily), *[f"rp{p}" for p in RP])


@query(
    "A4_return_periods_from_table",
    "SELECT comid, " + ", ".join(f"{rd(f'coalesce(max(CASE WHEN return_period = {p} THEN flow END), 0)')} AS rp{p}" for p in RP)
    + " FROM {return_periods} GROUP BY comid",
)
def _(t):
    return rounded(flow.return_periods_from_table(t.return_periods), *[f"rp{p}" for p in RP])


@query(
    "A5_exceedance_flows",
    "SELECT reach_id, " + ", ".join(f"{rd(f'quantile_cont(streamflow, {(100 - p) / 100})')} AS q_ep_{p}" for p in EP)
    + " FROM {flow_daily} GROUP BY reach_id",
)
def _(t):
    return rounded(flow.exceedance_flows(t.flow_daily), *[f"q_ep_{p}" for p in EP])


@query(
    "A6_search_bounds",
    f"""SELECT s.reach_id, {rd('coalesce(min(f.streamflow), 0)')} AS q_lo, {rd('coalesce(max(f.streamflow), 100)')} AS q_hi
        FROM (SELECT DISTINCT c_custkey AS reach_id FROM {{customer}}) s LEFT JOIN {{flow_daily}} f ON s.reach_id = f.reach_id GROUP BY s.reach_id""",
)
def _(t):
    ids = t.customer.select(F.col("c_custkey").alias("reach_id")).distinct()
    return rounded(flow.search_bounds(ids, t.flow_daily), "q_lo", "q_hi")


@query(
    "A13_daily_mean",
    f"SELECT reach_id, strftime(ts, '%Y-%m-%d') AS date, {rd('avg(streamflow)')} AS streamflow FROM {{flow_obs}} GROUP BY 1, 2",
)
def _(t):
    return rounded(flow.daily_mean(t.flow_obs), "streamflow").withColumn("date", day("date"))


@query(
    "A13_daily_mean_with_gaps",
    f"""WITH d AS (SELECT reach_id, CAST(ts AS date) AS date, avg(streamflow) AS q FROM {{flow_obs}} GROUP BY 1, 2),
        days AS (SELECT reach_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS date FROM d GROUP BY reach_id)
        SELECT days.reach_id, strftime(days.date, '%Y-%m-%d') AS date, {rd('d.q')} AS streamflow
        FROM days LEFT JOIN d ON days.reach_id = d.reach_id AND CAST(days.date AS date) = d.date""",
)
def _(t):
    return rounded(flow.daily_mean_with_gaps(t.flow_obs), "streamflow").withColumn("date", day("date"))


@query("A30_median_flow", f"SELECT reach_id, {rd('quantile_cont(streamflow, 0.5)')} AS median FROM {{flow_obs}} GROUP BY reach_id")
def _(t):
    return rounded(ranking.median(t.flow_obs, ["reach_id"], "streamflow"), "median")


@query("W1_flow_duration_curve", f"WITH {FDC.strip()} SELECT reach_id, {rd('streamflow')} AS streamflow, {rd('exceedance')} AS exceedance FROM fdc")
def _(t):
    return rounded(flow.duration_curve_rows(t.flow_daily).drop("rank"), "streamflow", "exceedance")


@query(
    "W1_flow_duration_curve_by_value",
    f"""WITH {FDC.strip()} SELECT reach_id, {rd('streamflow')} AS streamflow, count(*) AS days, {rd('min(exceedance)')} AS exceedance
        FROM fdc GROUP BY reach_id, streamflow""",
)
def _(t):
    out = flow.duration_curve(t.flow_daily)
    return out.select("reach_id", r("v").alias("streamflow"), F.col("cnt").alias("days"), r("exceedance").alias("exceedance"))


@query(
    "W2_plotting_positions",
    f"""WITH {PEAKS.strip()} SELECT reach_id, {rd('peak')} AS peak, rank, {rd('rank / CAST(n + 1 AS double)')} AS probability,
        {rd('(n + 1) / CAST(rank AS double)')} AS period FROM peaks WHERE n >= 2""",
)
def _(t):
    out = flow.plotting_positions(t.flow_daily)
    return rounded(out, "peak", "probability", "period").withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "W3_interpolated_return_periods",
    f"WITH {PEAKS.strip()}, {rp_sql().strip()} SELECT reach_id, CAST(t AS bigint) AS period, {rd('q')} AS flow FROM rp",
)
def _(t):
    out = flow.return_period_flows(t.flow_daily).unpivot("reach_id", [f"rp{p}" for p in RP], "period", "flow")
    return out.select("reach_id", F.substring("period", 3, 9).cast("bigint").alias("period"), r("flow").alias("flow"))


@query(
    "J21_exceedance_of_flow",
    f"""WITH {FDC.strip()}, curve AS (SELECT reach_id, streamflow AS v, min(exceedance) AS exceedance FROM fdc GROUP BY 1, 2),
        asked AS (SELECT DISTINCT site_id AS reach_id, flow / 10 AS q FROM {{incidents}}),
        best AS (SELECT a.reach_id, a.q, arg_min(c.exceedance, struct_pack(d := abs(c.v - a.q), e := c.exceedance)) AS exceedance
                 FROM asked a JOIN curve c ON a.reach_id = c.reach_id GROUP BY 1, 2)
        SELECT i.incident_id, i.site_id, {rd('i.flow')} AS flow, {rd('b.exceedance')} AS exceedance
        FROM {{incidents}} i LEFT JOIN best b ON i.site_id = b.reach_id AND i.flow / 10 = b.q""",
)
def _(t):
    asked = t.incidents.select("incident_id", "site_id", F.col("site_id").alias("reach_id"), "flow", (F.col("flow") / 10).alias("q"))
    out = flow.exceedance_of(asked, t.flow_daily, {"q": "exceedance"})
    return out.select("incident_id", "site_id", r("flow").alias("flow"), r("exceedance").alias("exceedance"))


@query(
    "J22_flow_on_date_or_median",
    f"""SELECT s.reach_id, strftime(s.scan_date, '%Y-%m-%d') AS scan_date, {rd('coalesce(f.streamflow, m.q)')} AS known_baseflow
        FROM {{scan_dates}} s LEFT JOIN {{flow_daily}} f ON s.reach_id = f.reach_id AND s.scan_date = f.date
        LEFT JOIN (SELECT reach_id, quantile_cont(streamflow, 0.5) AS q FROM {{flow_daily}} GROUP BY 1) m ON s.reach_id = m.reach_id""",
)
def _(t):
    out = flow.flow_on_or_median(t.scan_dates, t.flow_daily, "scan_date", "known_baseflow")
    return rounded(out, "known_baseflow").withColumn("scan_date", day("scan_date"))


@query(
    "J23_baseflow_update",
    f"""SELECT f.reach_id, {rd('coalesce(d.streamflow, f.med)')} AS known_baseflow
        FROM (SELECT reach_id, quantile_cont(streamflow, 0.5) AS med FROM {{flow_daily}} GROUP BY 1) f
        LEFT JOIN {{scan_dates}} s ON s.reach_id = f.reach_id LEFT JOIN {{flow_daily}} d ON d.reach_id = f.reach_id AND d.date = s.scan_date""",
)
def _(t):
    stats = ranking.median(t.flow_daily, ["reach_id"], "streamflow", "known_baseflow")
    return rounded(reach_stats.update_baseflow(stats, t.scan_dates, t.flow_daily), "known_baseflow")


@query(
    "J24_incident_flows",
    f"""SELECT i.incident_id, i.site_id, strftime(i.date, '%Y-%m-%d') AS date, {rd('n.streamflow')} AS flow_nwm, {rd('g.q', 9)} AS flow_geo
        FROM {{incidents}} i LEFT JOIN {{flow_daily}} n ON i.site_id = n.reach_id AND i.date = n.date
        LEFT JOIN (SELECT l_suppkey AS reach_id, CAST(l_shipdate AS date) AS date, avg(l_extendedprice) / 1000 AS q FROM {{lineitem}} GROUP BY 1, 2) g
        ON i.site_id = g.reach_id AND i.date = g.date""",
)
def _(t):
    other = t.lineitem.select(
        F.col("l_suppkey").alias("reach_id"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / 1000).alias("streamflow")
    )
    asked = t.incidents.select("incident_id", "site_id", F.col("site_id").alias("reach_id"), "date")
    out = flow.flow_on(flow.flow_on(asked, t.flow_daily, "date", "flow_nwm"), other, "date", "flow_geo")
    out = out.withColumns({"flow_nwm": r("flow_nwm"), "flow_geo": r("flow_geo", 9)})
    return out.drop("reach_id").withColumn("date", day("date"))


K1_SQL = f"""WITH {PEAKS.strip()}, {rp_sql().strip()},
wide AS (SELECT reach_id, {", ".join(f"max(CASE WHEN t = {p} THEN q END) AS rp{p}" for p in RP)} FROM rp GROUP BY reach_id),
st AS (SELECT reach_id, quantile_cont(streamflow, 0.5) AS med, max(streamflow) AS mx, {", ".join(f"quantile_cont(streamflow, {(100 - p) / 100}) AS q_ep_{p}" for p in EP)} FROM {{flow_daily}} GROUP BY 1)
SELECT st.reach_id AS comid, {rd('coalesce(d.streamflow, med)')} AS known_baseflow, {rd('med')} AS qout_median, {rd('mx')} AS qout_max,
       {", ".join(f"{rd(f'wide.rp{p}')} AS rp{p}" for p in RP)}, {rd('1.5e0 * mx')} AS qout_max_premium, {rd('1.5e0 * wide.rp100')} AS rp100_premium"""
K1_FROM = """
FROM st JOIN wide ON st.reach_id = wide.reach_id LEFT JOIN {scan_dates} s ON s.reach_id = st.reach_id
LEFT JOIN {flow_daily} d ON d.reach_id = st.reach_id AND d.date = s.scan_date"""


@query("K1_reach_statistics", K1_SQL + K1_FROM)
def _(t):
    out = reach_stats.reach_statistics(t.flow_daily, t.scan_dates)
    return rounded(out, *[c for c in out.columns if c != "comid"])


@query("K2_reach_statistics_with_exceedance", K1_SQL + "".join(f", {rd(f'q_ep_{p}')} AS q_ep_{p}" for p in EP) + K1_FROM)
def _(t):
    out = reach_stats.reach_statistics(t.flow_daily, t.scan_dates, exceedance=True)
    return rounded(out, *[c for c in out.columns if c != "comid"])


@query(
    "K8_incident_exceedance_per_source",
    f"""WITH {FDC.strip()}, curve AS (SELECT reach_id, streamflow AS v, min(exceedance) AS exceedance FROM fdc GROUP BY 1, 2),
        geo AS (SELECT reach_id, streamflow, 100.0e0 * row_number() OVER (PARTITION BY reach_id ORDER BY streamflow DESC)
               / (count(*) OVER (PARTITION BY reach_id) + 1) AS exceedance FROM {{flow_obs}} WHERE streamflow IS NOT NULL),
        gcurve AS (SELECT reach_id, streamflow AS v, min(exceedance) AS exceedance FROM geo GROUP BY 1, 2),
        n AS (SELECT i.site_id, i.date, arg_min(c.exceedance, struct_pack(d := abs(c.v - i.flow_nwm), e := c.exceedance)) AS e
              FROM {{site_incidents}} i JOIN curve c ON i.site_id = c.reach_id GROUP BY 1, 2),
        g AS (SELECT i.site_id, i.date, arg_min(c.exceedance, struct_pack(d := abs(c.v - i.flow_geo), e := c.exceedance)) AS e
              FROM {{site_incidents}} i JOIN gcurve c ON i.site_id = c.reach_id GROUP BY 1, 2)
        SELECT i.site_id, strftime(i.date, '%Y-%m-%d') AS date, {rd('i.flow_nwm')} AS flow_nwm, {rd('i.flow_geo')} AS flow_geo,
               {rd('n.e')} AS exceedance_nwm, {rd('g.e')} AS exceedance_geo
        FROM {{site_incidents}} i LEFT JOIN n ON n.site_id = i.site_id AND n.date = i.date LEFT JOIN g ON g.site_id = i.site_id AND g.date = i.date""",
)
def _(t):
    asked = t.site_incidents.withColumn("reach_id", F.col("site_id"))
    out = reach_stats.exceedance_per_source(asked, {"nwm": t.flow_daily, "geo": t.flow_obs})
    return rounded(out, "flow_nwm", "flow_geo", "exceedance_nwm", "exceedance_geo").drop("reach_id").withColumn("date", day("date"))


@query(
    "S7_reaches_selected",
    f"""SELECT reach_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {rd('streamflow')} AS streamflow FROM {{flow_obs}}
        WHERE reach_id IN (SELECT reach_id FROM {{sites}})""",
)
def _(t):
    out = flow.record_of(t.flow_obs, t.sites)
    return rounded(out, "streamflow").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    "S7_reaches_missing",
    "SELECT DISTINCT c_custkey AS reach_id FROM {customer} WHERE c_custkey NOT IN (SELECT reach_id FROM {flow_obs})",
)
def _(t):
    return flow.missing_from_record(t.flow_obs, t.customer.select(F.col("c_custkey").alias("reach_id")))
