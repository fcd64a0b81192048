"""Validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirspan.functions import text as tx
from weirspan.operators import validate as va
from weirspan.plans.catalog import query
from weirspan.plans.common import day, r, rd, rounded

C = "flowline, streamflow"
BANDS = f"""bands AS (SELECT {C}, site_id, min(prob_max) AS prob_max, max(prob_min) AS prob_min, abs(max(prob_min) - min(prob_max)) AS width
            FROM {{xsections}} WHERE prob_min IS NOT NULL AND prob_max IS NOT NULL GROUP BY {C}, site_id)"""
HITS = f"hits AS (SELECT {C}, site_id, date, bool_or(jump_type = 'C') AS hit FROM {{results}} WHERE jump_type IS NOT NULL GROUP BY {C}, site_id, date)"
COMBOS = "(VALUES ('NHD', 'NWM'), ('NHD', 'GEO'), ('TDX', 'NWM'), ('TDX', 'GEO')) AS c(flowline, streamflow)"
CLASSES = f"""{HITS}, classes AS (SELECT c.flowline, c.streamflow, s.site_id, CASE WHEN h.hit IS NULL THEN 'Unavailable' WHEN h.hit THEN 'True Positive' ELSE 'False Negative' END AS class
            FROM {{sites}} s, {COMBOS} LEFT JOIN (SELECT {C}, site_id, bool_or(hit) AS hit FROM hits GROUP BY {C}, site_id) h
            ON h.site_id = s.site_id AND h.flowline = c.flowline AND h.streamflow = c.streamflow)"""
MED = f"med AS (SELECT {C}, site_id, quantile_cont(p_height, 0.5) AS p_height FROM {{xsections}} WHERE p_height > 0 AND p_height <= 65 GROUP BY {C}, site_id)"
METRICS = f"""count(*) AS n, {rd('CASE WHEN count(*) > 1 THEN sqrt(avg((p_height - p_known) * (p_height - p_known))) END')} AS rmse, {rd('CASE WHEN count(*) > 1 THEN avg(p_height - p_known) END')} AS bias,
            {rd('CASE WHEN count(*) > 1 THEN avg(abs(p_height - p_known)) END')} AS mae, {rd('CASE WHEN count(*) > 1 THEN power(corr(p_height, p_known), 2) END')} AS r2"""
PAIRED = f"""{BANDS}, pa AS (SELECT site_id, least(prob_max, prob_min) AS a_low, greatest(prob_max, prob_min) AS a_high FROM bands WHERE flowline = 'NHD' AND streamflow = 'NWM'),
            pb AS (SELECT site_id, least(prob_max, prob_min) AS b_low, greatest(prob_max, prob_min) AS b_high FROM bands WHERE flowline = 'TDX' AND streamflow = 'GEO')"""
SCORED = f"""{PAIRED}, sc0 AS (SELECT pa.site_id, a_low, a_high, b_low, b_high, greatest(0e0, least(a_high, b_high) - greatest(a_low, b_low)) AS inter FROM pa JOIN pb ON pa.site_id = pb.site_id),
            scored AS (SELECT *, CASE WHEN (a_high - a_low) + (b_high - b_low) - inter > 0 THEN inter / ((a_high - a_low) + (b_high - b_low) - inter)
                       WHEN a_low = b_low AND a_high = b_high THEN 1e0 ELSE 0e0 END AS jaccard FROM sc0)"""
PAIRS_XS = "prs AS (SELECT x.*, s.p_known FROM {xsections} x JOIN {sites} s ON x.site_id = s.site_id WHERE x.p_height > 0 AND x.p_height <= 65)"


def scored(t):
    return va.agreement(va.paired_bands(va.danger_bands(t.xsections), ("NHD", "NWM"), ("TDX", "GEO")))


def pairs(t):
    return va.predicted_and_known(va.plausible(t.xsections), t.sites)


@query("A7_danger_bands", f"WITH {BANDS} SELECT {C}, site_id, {rd('prob_max')} AS prob_max, {rd('prob_min')} AS prob_min, {rd('width')} AS width FROM bands")
def _(t):
    return rounded(va.danger_bands(t.xsections), "prob_max", "prob_min", "width")


@query("A8_incident_hits", f"WITH {HITS} SELECT {C}, site_id, strftime(date, '%Y-%m-%d') AS date, CAST(hit AS bigint) AS hit FROM hits")
def _(t):
    return va.incident_hits(t.results).withColumns({"date": day("date"), "hit": F.col("hit").cast("bigint")})


@query("A9_site_classes", f"WITH {CLASSES} SELECT {C}, site_id, class FROM classes")
def _(t):
    return va.site_classes(t.results, t.sites)


@query("A10_strict_sites", f"WITH {HITS} SELECT {C}, site_id, CAST(bool_and(hit) AS bigint) AS success FROM hits GROUP BY {C}, site_id")
def _(t):
    return va.strict_sites(t.results).withColumn("success", F.col("success").cast("bigint"))


@query("A11_class_shares", f"WITH {CLASSES} SELECT {C}, class, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY {C}) AS bigint) AS total, {rd(f'100e0 * count(*) / sum(count(*)) OVER (PARTITION BY {C})')} AS pct FROM classes GROUP BY {C}, class")
def _(t):
    return rounded(va.class_shares(va.site_classes(t.results, t.sites), "class"), "pct")


@query("A12_jump_shares", f"""SELECT {C}, xs_index, j AS jump_type, count(*) AS total, count(*) FILTER (jump_type = j) AS n, {rd('100e0 * count(*) FILTER (jump_type = j) / count(*)')} AS pct
       FROM {{results}}, (VALUES ('A'), ('C'), ('D')) AS v(j) WHERE jump_type IS NOT NULL GROUP BY {C}, xs_index, j""")
def _(t):
    return rounded(va.jump_shares(t.results), "pct")


@query("A14_danger_rate", f"SELECT {C}, xs_index, count(*) FILTER (jump_type = 'C') AS n, count(*) AS total, {rd('''100e0 * count(*) FILTER (jump_type = 'C') / count(*)''')} AS pct FROM {{results}} WHERE jump_type IS NOT NULL GROUP BY {C}, xs_index")
def _(t):
    return rounded(va.danger_rate(t.results), "pct")


@query("A15_median_heights", f"WITH {MED} SELECT {C}, site_id, {rd('p_height')} AS p_height FROM med")
def _(t):
    return rounded(va.median_heights(t.xsections), "p_height")


@query("A16_error_metrics", f"WITH {PAIRS_XS} SELECT {C}, xs_index, {METRICS} FROM prs GROUP BY {C}, xs_index")
def _(t):
    return rounded(va.error_metrics(pairs(t), [*va.COMBO, "xs_index"]), "rmse", "bias", "mae", "r2")


@query("A16_error_metrics_of_medians", f"WITH {MED} SELECT {C}, {METRICS} FROM med JOIN {{sites}} s ON med.site_id = s.site_id GROUP BY {C}")
def _(t):
    out = va.error_metrics(va.predicted_and_known(va.median_heights(t.xsections), t.sites), va.COMBO)
    return rounded(out, "rmse", "bias", "mae", "r2")


@query("A17_height_summary", f"""SELECT {C}, xs_index, {rd('min(p_height)')} AS min, {rd('max(p_height)')} AS max, {rd('avg(p_height)')} AS mean, count(*) AS n, {rd('quantile_cont(p_height, 0.5)')} AS median
       FROM {{xsections}} WHERE p_height >= 0 AND p_height <= 65 AND xs_index BETWEEN 1 AND 4 GROUP BY {C}, xs_index""")
def _(t):
    return rounded(va.height_summary(t.xsections), "min", "max", "mean", "median")


@query("A18_incident_counts", f"SELECT {C}, count(DISTINCT (site_id, date)) AS incidents, count(DISTINCT site_id) AS sites, {rd('count(DISTINCT (site_id, date)) / CAST(count(DISTINCT site_id) AS double)')} AS per_site FROM {{results}} WHERE jump_type IS NOT NULL GROUP BY {C}")
def _(t):
    return rounded(va.incident_counts(t.results), "per_site")


def hist(least):
    return f"""WITH {BANDS}, w AS (SELECT * FROM bands WHERE width >= {least}), tot AS (SELECT {C}, count(*) AS total, avg(width) AS mean_width FROM w GROUP BY {C})
       SELECT tot.flowline, tot.streamflow, CAST(b AS bigint) AS bin, total, {rd('mean_width')} AS mean_width,
              (SELECT count(*) FROM w WHERE w.flowline = tot.flowline AND w.streamflow = tot.streamflow AND w.width <= 100 AND least(9, floor(w.width / 10)) = b) AS n,
              {rd('100e0 * (SELECT count(*) FROM w WHERE w.flowline = tot.flowline AND w.streamflow = tot.streamflow AND w.width <= 100 AND least(9, floor(w.width / 10)) = b) / total')} AS pct
       FROM tot, (SELECT unnest(range(0, 10)) AS b)"""


@query("A19_band_histogram", hist("0"))
def _(t):
    return rounded(va.band_histogram(va.danger_bands(t.xsections)), "mean_width", "pct")


@query("A19_band_histogram_wide_only", hist("10"))
def _(t):
    return rounded(va.band_histogram(va.danger_bands(t.xsections), 10), "mean_width", "pct")


@query("A20_band_agreement", f"WITH {SCORED} SELECT site_id, {rd('a_low')} AS a_low, {rd('a_high')} AS a_high, {rd('b_low')} AS b_low, {rd('b_high')} AS b_high, {rd('jaccard')} AS jaccard FROM scored")
def _(t):
    return rounded(scored(t), "a_low", "a_high", "b_low", "b_high", "jaccard")


@query("A20_agreement_summary", f"WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (jaccard = 0) AS zero, count(*) FILTER (jaccard >= 0.99e0) AS near_perfect, {rd('avg(jaccard)')} AS mean, {rd('quantile_cont(jaccard, 0.5)')} AS median FROM scored")
def _(t):
    return rounded(va.agreement_summary(scored(t)), "mean", "median")


@query("A21_slope_quartiles", f"WITH {PAIRS_XS} SELECT {rd('quantile_cont(slope, 0.25)')} AS q1, {rd('quantile_cont(slope, 0.5)')} AS q2, {rd('quantile_cont(slope, 0.75)')} AS q3 FROM prs")
def _(t):
    return rounded(va.slope_quartiles(pairs(t)).drop("all"), "q1", "q2", "q3")


@query("A22_fit_by_slope_class", f"""WITH {PAIRS_XS}, q AS (SELECT quantile_cont(slope, 0.25) AS q1, quantile_cont(slope, 0.5) AS q2, quantile_cont(slope, 0.75) AS q3 FROM prs),
       k AS (SELECT prs.*, CASE WHEN slope <= q1 THEN 'Low' WHEN slope <= q2 THEN 'Medium' WHEN slope <= q3 THEN 'High' ELSE 'Very High' END AS slope_class FROM prs, q)
       SELECT {C}, slope_class, count(*) AS n, {rd('power(corr(p_known, p_height), 2)')} AS r2 FROM k GROUP BY {C}, slope_class HAVING count(*) > 1""")
def _(t):
    return rounded(va.slope_class_fit(pairs(t)), "r2")


@query("A23_slope_cdf", f"SELECT {C}, {rd('slope')} AS slope, {rd(f'row_number() OVER (PARTITION BY {C} ORDER BY slope) / CAST(count(*) OVER (PARTITION BY {C}) AS double)')} AS cdf FROM {{xsections}} WHERE slope > 0 AND slope <= 0.5")
def _(t):
    return rounded(va.empirical_cdf(t.xsections.where("slope > 0 AND slope <= 0.5"), va.COMBO, "slope"), "slope", "cdf")


@query("A24_height_density", f"""WITH v AS (SELECT {C}, p_height AS v FROM {{xsections}} WHERE p_height > 0 AND p_height <= 65),
       m AS (SELECT {C}, count(*) AS n, max(v) AS top, stddev_samp(v) * power(count(*), -0.2e0) AS h FROM v GROUP BY {C})
       SELECT m.flowline, m.streamflow, CAST(i AS bigint) AS i, {rd('m.top * i / 499')} AS x, {rd('sum(exp(-0.5e0 * power((m.top * i / 499 - v.v) / m.h, 2))) / (m.n * m.h * sqrt(2 * pi()))')} AS density
       FROM m JOIN v ON m.flowline = v.flowline AND m.streamflow = v.streamflow, (SELECT unnest(range(0, 500)) AS i) GROUP BY m.flowline, m.streamflow, m.top, m.n, m.h, i""")
def _(t):
    out = va.kernel_density(va.plausible(t.xsections), va.COMBO, "p_height")
    return rounded(out, "x", "density").withColumn("i", F.col("i").cast("bigint"))


@query("J30_paired_bands", f"WITH {PAIRED} SELECT coalesce(pa.site_id, pb.site_id) AS site_id, {rd('a_low')} AS a_low, {rd('a_high')} AS a_high, {rd('b_low')} AS b_low, {rd('b_high')} AS b_high FROM pa FULL JOIN pb ON pa.site_id = pb.site_id")
def _(t):
    return rounded(va.paired_bands(va.danger_bands(t.xsections), ("NHD", "NWM"), ("TDX", "GEO")), "a_low", "a_high", "b_low", "b_high")


@query("J35_predicted_and_known", f"WITH {PAIRS_XS} SELECT {C}, site_id, xs_index, {rd('p_height')} AS p_height, {rd('p_known')} AS p_known FROM prs")
def _(t):
    return rounded(pairs(t).select(*va.COMBO, "site_id", "xs_index", "p_height", "p_known"), "p_height", "p_known")


@query("W7_site_rank_and_band", "SELECT site_id, dense_rank() OVER (ORDER BY site_id) - 1 AS rank, (dense_rank() OVER (ORDER BY site_id) - 1) % 2 AS band FROM (SELECT DISTINCT site_id FROM {results})")
def _(t):
    return va.site_banding(t.results)


@query("W8_agreement_order", f"WITH {SCORED} SELECT site_id, {rd('jaccard')} AS jaccard, rank() OVER (ORDER BY jaccard) - 1 AS place FROM scored")
def _(t):
    return rounded(va.agreement_order(scored(t)).select("site_id", "jaccard", "place"), "jaccard")


@query("W8_agreement_marks", f"""WITH {SCORED}, o AS (SELECT jaccard, rank() OVER (ORDER BY jaccard) - 1 AS place FROM scored)
       SELECT m AS mark, arg_min(place, struct_pack(d := abs(jaccard - m), p := place)) AS place, {rd('arg_min(jaccard, struct_pack(d := abs(jaccard - m), p := place))')} AS jaccard
       FROM o, (VALUES (0e0), (0.25e0), (0.5e0), (0.75e0), (1e0)) AS v(m) GROUP BY m""")
def _(t):
    return rounded(va.agreement_marks(scored(t)), "jaccard")


@query("K10_incident_summary", f"""WITH b AS (SELECT site_id, (dense_rank() OVER (ORDER BY site_id) - 1) % 2 AS band FROM (SELECT DISTINCT site_id FROM {{results}}))
       SELECT r.flowline, r.streamflow, r.site_id, strftime(r.date, '%Y-%m-%d') AS date, r.xs_index, r.jump_type, b.band,
       {rd('r.y_2 * 3.281e0', 10)} AS y_2_ft, {rd('r.y_t * 3.281e0', 10)} AS y_t_ft, {rd('r.y_flip * 3.281e0', 10)} AS y_flip_ft FROM {{results}} r JOIN b ON r.site_id = b.site_id""")
def _(t):
    out = t.results.join(va.site_banding(t.results).drop("rank"), "site_id")
    feet = {f"{c}_ft": r(F.col(c) * tx.METRES_TO_FEET, 10) for c in ("y_2", "y_t", "y_flip")}
    return out.withColumns(feet).select(*va.COMBO, "site_id", day("date").alias("date"), "xs_index", "jump_type", "band", *feet)


@query("K13_validation_report", f"""WITH {CLASSES}, {SCORED}, {MED}, {PAIRS_XS},
       q AS (SELECT quantile_cont(slope, 0.25) AS q1, quantile_cont(slope, 0.5) AS q2, quantile_cont(slope, 0.75) AS q3 FROM prs),
       sl AS (SELECT prs.*, CASE WHEN slope <= q1 THEN 'Low' WHEN slope <= q2 THEN 'Medium' WHEN slope <= q3 THEN 'High' ELSE 'Very High' END AS slope_class FROM prs, q),
       strict AS (SELECT {C}, site_id, bool_and(hit) AS ok FROM hits GROUP BY {C}, site_id),
       su AS (SELECT {C}, xs_index, min(p_height) AS min, max(p_height) AS max, avg(p_height) AS mean, quantile_cont(p_height, 0.5) AS median, CAST(count(*) AS double) AS n
              FROM {{xsections}} WHERE p_height >= 0 AND p_height <= 65 AND xs_index BETWEEN 1 AND 4 GROUP BY {C}, xs_index),
       ag AS (SELECT CAST(count(*) AS double) AS n, CAST(count(*) FILTER (jaccard = 0) AS double) AS zero, CAST(count(*) FILTER (jaccard >= 0.99e0) AS double) AS near_perfect, avg(jaccard) AS mean, quantile_cont(jaccard, 0.5) AS median FROM scored),
       cl AS (SELECT {C}, class, 100e0 * count(*) / sum(count(*)) OVER (PARTITION BY {C}) AS pct FROM classes GROUP BY {C}, class),
       js AS (SELECT {C}, xs_index, j, 100e0 * count(*) FILTER (jump_type = j) / count(*) AS pct FROM {{results}}, (VALUES ('A'), ('C'), ('D')) AS v(j) WHERE jump_type IS NOT NULL GROUP BY {C}, xs_index, j),
       tot AS (SELECT {C}, count(*) AS total FROM bands GROUP BY {C}),
       h AS (SELECT {C}, {METRICS} FROM med JOIN {{sites}} s ON med.site_id = s.site_id GROUP BY {C})
       SELECT {C}, 'site class %' AS statistic, class AS label, {rd('pct')} AS value FROM cl
       UNION ALL SELECT {C}, 'strict success %', 'all', {rd('100e0 * avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END)')} FROM strict GROUP BY {C}
       UNION ALL SELECT {C}, 'height r2 by slope', slope_class, {rd('power(corr(p_known, p_height), 2)')} FROM sl GROUP BY {C}, slope_class HAVING count(*) > 1
       UNION ALL SELECT {C}, concat('section height ', k), CAST(xs_index AS string), {rd('v')} FROM (UNPIVOT su ON min, max, mean, median, n INTO NAME k VALUE v)
       UNION ALL SELECT 'all', 'all', concat('agreement ', k), 'all', {rd('v')} FROM (UNPIVOT ag ON n, zero, near_perfect, mean, median INTO NAME k VALUE v)
       UNION ALL SELECT 'all', 'all', concat('slope ', k), 'all', {rd('v')} FROM (UNPIVOT q ON q1, q2, q3 INTO NAME k VALUE v)
       UNION ALL SELECT {C}, 'jump share %', concat(CAST(xs_index AS string), ' ', j), {rd('pct')} FROM js
       UNION ALL SELECT {C}, 'danger rate %', CAST(xs_index AS string), {rd('pct')} FROM js WHERE j = 'C'
       UNION ALL SELECT tot.flowline, tot.streamflow, 'band width %', CAST(b AS string), {rd('100e0 * (SELECT count(*) FROM bands w WHERE w.flowline = tot.flowline AND w.streamflow = tot.streamflow AND w.width <= 100 AND least(9, floor(w.width / 10)) = b) / total')} FROM tot, (SELECT unnest(range(0, 10)) AS b)
       UNION ALL SELECT {C}, 'incidents per site', 'all', {rd('count(DISTINCT (site_id, date)) / CAST(count(DISTINCT site_id) AS double)')} FROM hits GROUP BY {C}
       UNION ALL SELECT {C}, concat('height ', k), 'all', v FROM (UNPIVOT (SELECT {C}, rmse, bias, mae, r2 FROM h) ON rmse, bias, mae, r2 INTO NAME k VALUE v)""")
def _(t):
    return rounded(va.report(t.results, t.xsections, t.sites), "value")
