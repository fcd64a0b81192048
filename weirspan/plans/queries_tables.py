"""Queries over the project tables: ingest filters, keyed joins, upserts, cleaning jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirspan.functions import text as tx
from weirspan.operators import keyed, ranking
from weirspan.plans import cleaning, reach_stats
from weirspan.plans.catalog import query
from weirspan.plans.common import day, r, rd, rounded

# Model coverage of the two flow sources (fixed values).
NWM_FROM, NWM_TO, GEO_FROM = cleaning.NWM_FROM, cleaning.NWM_TO, cleaning.GEO_FROM


@query("P1_enforce_schema", "SELECT site_id, CAST(NULL AS double) AS lidar_year, weir_length, name, CAST(NULL AS string) AS ep_value FROM {sites}")
def _(t):
    fields = [("site_id", T.LongType()), ("lidar_year", T.DoubleType()), ("weir_length", T.DoubleType()), ("name", T.StringType()), ("ep_value", T.StringType())]
    return keyed.enforce_schema(t.sites, T.StructType([T.StructField(n, d) for n, d in fields]))


@query("P2_normalised_names", "SELECT s_suppkey AS site_id, s_name AS name, s_nationkey AS nation FROM {supplier}")
def _(t):
    messy = t.supplier.select("s_suppkey", "s_name", "s_nationkey").toDF(" Site ID", "NAME ", "Nation")
    return keyed.normalise_names(messy, {"site id": "site_id"}).withColumn("nation", F.col("nation").cast("int"))


@query("P3_results_of_sites", "SELECT site_id, strftime(date, '%Y-%m-%d') AS date, xs_index, jump_type FROM {results} WHERE site_id IN (SELECT site_id FROM {sites} WHERE flowline_source = 'TDX-Hydro')")
def _(t):
    wanted = t.sites.where(F.col("flowline_source") == "TDX-Hydro")
    return keyed.rows_of(t.results, wanted).select("site_id", day("date").alias("date"), "xs_index", "jump_type")


@query("P4_drop_removed", "SELECT incident_id, comments FROM {incident_text} WHERE comments IS NULL OR lower(trim(comments)) <> 'removed'")
def _(t):
    return keyed.not_removed(t.incident_text).select("incident_id", "comments")


@query("P5_exclude_comments", "SELECT incident_id, comments FROM {incident_text} WHERE comments IS NULL OR comments NOT IN ('duplicate', '5-LOW')")
def _(t):
    return keyed.without_comments(t.incident_text, ["duplicate", "5-LOW"]).select("incident_id", "comments")


@query("P6_dates_from_parts", "SELECT incident_id, strftime(make_date(y, m, d), '%Y-%m-%d') AS date FROM {incident_text} WHERE y <> 0 AND m <> 0 AND d <> 0")
def _(t):
    out = t.incident_text.withColumn("date", tx.date_of_parts(F.col("y"), F.col("m"), F.col("d"))).where("date IS NOT NULL")
    return out.select("incident_id", day("date").alias("date"))


@query("P7_parsed_dates", "SELECT incident_id, strftime(CAST(coalesce(TRY_CAST(date_text AS timestamp), try_strptime(date_text, ['%m/%d/%Y', '%b %d, %Y'])) AS date), '%Y-%m-%d') AS date FROM {incident_text} WHERE CAST(coalesce(TRY_CAST(date_text AS timestamp), try_strptime(date_text, ['%m/%d/%Y', '%b %d, %Y'])) AS date) IS NOT NULL")
def _(t):
    out = t.incident_text.withColumn("date", tx.parse_date(F.col("date_text"))).where("date IS NOT NULL")
    return out.select("incident_id", day("date").alias("date"))


@query("P8_model_windows", f"""SELECT incident_id, strftime(date, '%Y-%m-%d') AS date, CASE WHEN date BETWEEN DATE '{NWM_FROM}' AND DATE '{NWM_TO}' THEN 1 ELSE 0 END AS in_nwm,
       CASE WHEN date >= DATE '{GEO_FROM}' THEN 1 ELSE 0 END AS in_geo FROM {{incidents}}""")
def _(t):
    out = t.incidents.withColumns({"in_nwm": cleaning.in_nwm("date").cast("int"), "in_geo": cleaning.in_geo("date").cast("int")})
    return out.select("incident_id", day("date").alias("date"), "in_nwm", "in_geo")


@query("P9_numeric_text", f"SELECT incident_id, {rd('TRY_CAST(height_text AS double)')} AS height FROM {{incident_text}}")
def _(t):
    return t.incident_text.select("incident_id", r(tx.number(F.col("height_text"))).alias("height"))


@query("P10_plausible_heights", f"SELECT site_id, xs_index, {rd('p_height')} AS p_height, {rd('slope')} AS slope FROM {{xsections}} WHERE p_height > 0 AND p_height <= 65 AND slope > 0 AND slope <= 0.5")
def _(t):
    out = t.xsections.where(keyed.within(F.col("p_height"), 0, 65) & keyed.within(F.col("slope"), 0, 0.5))
    return rounded(out.select("site_id", "xs_index", "p_height", "slope"), "p_height", "slope")


@query("P11_complete_rows", f"SELECT site_id, xs_index, {rd('p_height')} AS p_height, {rd('prob_min')} AS prob_min, {rd('prob_max')} AS prob_max FROM {{xsections}} WHERE p_height IS NOT NULL AND prob_min IS NOT NULL AND prob_max IS NOT NULL")
def _(t):
    cols = ["p_height", "prob_min", "prob_max"]
    return rounded(t.xsections.dropna(subset=cols).select("site_id", "xs_index", *cols), *cols)


LIST = "string_split_regex(trim(regexp_replace(profile, '[\\[\\]]', '', 'g')), '[,\\s]+')"


@query("P12_scalar_of_list", f"SELECT xs_key, TRY_CAST({LIST}[1] AS double) AS value FROM {{profile_text}}")
def _(t):
    return t.profile_text.select("xs_key", tx.scalar(F.col("profile")).alias("value"))


@query("P13_parsed_lists", f"SELECT xs_key, CAST(i AS bigint) AS i, TRY_CAST(list[i] AS double) AS value FROM (SELECT xs_key, {LIST} AS list, unnest(range(1, len({LIST}) + 1)) AS i FROM {{profile_text}})")
def _(t):
    out = t.profile_text.select("xs_key", F.posexplode(tx.parse_list(F.col("profile"))).alias("i", "value"))
    return out.withColumn("i", (F.col("i") + 1).cast("bigint"))


@query("P14_long_profiles", f"SELECT xs_key, CAST(len({LIST}) AS bigint) AS n FROM {{profile_text}} WHERE len({LIST}) >= 2")
def _(t):
    out = t.profile_text.withColumn("n", F.size(tx.parse_list(F.col("profile"))).cast("bigint"))
    return out.where(F.col("n") >= 2).select("xs_key", "n")


@query("P20_valid_flow", f"SELECT i.incident_id, {rd('i.flow')} AS flow, {rd('s.p_known')} AS p_known FROM {{incidents}} i JOIN {{sites}} s ON i.site_id = s.site_id WHERE i.flow > 0 AND s.p_known IS NOT NULL")
def _(t):
    out = t.incidents.join(t.sites.select("site_id", "p_known"), "site_id").where("flow > 0 AND p_known IS NOT NULL")
    return rounded(out.select("incident_id", "flow", "p_known"), "flow", "p_known")


@query("P21_flow_by_source", f"""SELECT i.site_id, strftime(i.date, '%Y-%m-%d') AS date, s.streamflow_source, {rd("CASE WHEN s.streamflow_source = 'National Water Model' THEN i.flow_nwm ELSE i.flow_geo END")} AS flow
       FROM {{site_incidents}} i JOIN {{sites}} s ON i.site_id = s.site_id""")
def _(t):
    out = t.site_incidents.join(t.sites.select("site_id", "streamflow_source"), "site_id")
    out = out.withColumn("flow", r(cleaning.by_source(F.col("streamflow_source"), F.col("flow_nwm"), F.col("flow_geo"))))
    return out.select("site_id", day("date").alias("date"), "streamflow_source", "flow")


@query("P22_own_or_shared", "SELECT incident_id, coalesce(nullif(CASE WHEN y = 0 THEN '' ELSE comments END, ''), height_text) AS value FROM {incident_text}")
def _(t):
    own = F.nullif(F.when(F.col("y") == 0, F.lit("")).otherwise(F.col("comments")), F.lit(""))
    return t.incident_text.select("incident_id", F.coalesce(own, "height_text").alias("value"))


@query("P23_baseflow_by_method", f"""SELECT incident_id, CAST(least(100, greatest(10, round_even(ep / 10.0e0, 0) * 10)) AS bigint) AS level,
       {rd("CASE WHEN method = 'Median' THEN 3.5e0 WHEN method = 'EP' THEN least(100, greatest(10, round_even(ep / 10.0e0, 0) * 10)) / 4.0e0 ELSE height END")} AS baseflow
       FROM (SELECT incident_id, height, d * 9 AS ep, CASE m % 3 WHEN 0 THEN 'Median' WHEN 1 THEN 'EP' ELSE 'Known' END AS method FROM {{incident_text}})""")
def _(t):
    src = t.incident_text.select(
        "incident_id", "height", (F.col("d") * 9).alias("ep"),
        F.when(F.col("m") % 3 == 0, "Median").when(F.col("m") % 3 == 1, "EP").otherwise("Known").alias("method"),
    )
    levels = {p: F.lit(p / 4) for p in range(10, 101, 10)}
    flow = tx.baseflow(F.col("method"), F.col("ep"), F.col("height"), F.lit(3.5), levels)
    return src.select("incident_id", tx.tens(F.col("ep")).cast("bigint").alias("level"), r(flow).alias("baseflow"))


@query("P24_table_of_pair", "SELECT site_id, strftime(date, '%Y-%m-%d') AS date, xs_index, concat(flowline, streamflow) AS pair FROM {results} WHERE flowline = 'TDX' AND streamflow = 'GEO'")
def _(t):
    out = t.results.where((F.col("flowline") == "TDX") & (F.col("streamflow") == "GEO"))
    return out.select("site_id", day("date").alias("date"), "xs_index", tx.source_pair(F.col("flowline"), F.col("streamflow")).alias("pair"))


@query("P25_defaults", f"SELECT site_id, {rd('coalesce(baseflow_geo, 10)')} AS baseflow_geo FROM {{sites}}")
def _(t):
    return t.sites.select("site_id", r(F.coalesce("baseflow_geo", F.lit(10.0))).alias("baseflow_geo"))


@query("P26_fill_if_absent", f"SELECT site_id, {rd('CASE WHEN coalesce(baseflow_nwm, 0) = 0 THEN weir_length / 4 ELSE baseflow_nwm END')} AS baseflow_nwm FROM {{sites}}")
def _(t):
    return t.sites.select("site_id", r(cleaning.if_absent(F.col("baseflow_nwm"), F.col("weir_length") / 4)).alias("baseflow_nwm"))


@query("P27_label_index_and_distance", """SELECT x.xs_key, CASE WHEN x.xs_index = 1 THEN 'Upstream' ELSE concat('Downstream', CAST(x.xs_index AS string)) END AS label,
       CASE WHEN x.xs_index = 1 THEN 0 ELSE x.xs_index END AS xs_no, CAST(trunc(CASE WHEN x.xs_index = 1 THEN 0 ELSE x.xs_index END * (s.weir_length + 0.5e0)) AS bigint) AS distance
       FROM {xs_water} x JOIN {sites} s ON x.site_id = s.site_id""")
def _(t):
    out = t.xs_water.join(t.sites.select("site_id", "weir_length"), "site_id")
    out = out.withColumn("label", F.when(F.col("xs_index") == 1, "Upstream").otherwise(F.concat(F.lit("Downstream"), F.col("xs_index"))))
    return out.select(
        "xs_key", "label", tx.label_index(F.col("label")).cast("bigint").alias("xs_no"),
        tx.label_distance(F.col("label"), F.col("weir_length") + 0.5).cast("bigint").alias("distance"),
    )


@query("P28_feet", f"SELECT xs_key, {rd('y_t * 3.281e0')} AS y_t_ft FROM {{xs_water}}")
def _(t):
    return t.xs_water.select("xs_key", r(F.col("y_t") * tx.METRES_TO_FEET).alias("y_t_ft"))


@query("P30_extent_of_geometry", f"SELECT linkno, {rd('min(x) - 0.002e0')} AS xmin, {rd('min(y) - 0.002e0')} AS ymin, {rd('max(x) + 0.002e0')} AS xmax, {rd('max(y) + 0.002e0')} AS ymax FROM {{reach_vertices}} GROUP BY linkno")
def _(t):
    return rounded(keyed.extent(t.reach_vertices, "linkno"), "xmin", "ymin", "xmax", "ymax")


@query("P31_downstream_rows", "SELECT xs_key, site_id, xs_index FROM {xs_water} WHERE xs_index > 1")
def _(t):
    return t.xs_water.where("xs_index > 1").select("xs_key", "site_id", "xs_index")


@query("P32_site_dimension", "SELECT site_id, arg_min(comments, incident_id) AS comments, min(incident_id) AS incident_id FROM {incident_text} WHERE comments IS NOT NULL GROUP BY site_id")
def _(t):
    rows = t.incident_text.where("comments IS NOT NULL").select("site_id", "comments", "incident_id")
    return keyed.first_per_key(rows, ["site_id"], ["incident_id"])


STATS = "(SELECT reach_id AS comid, quantile_cont(streamflow, 0.5) AS qout_median, max(streamflow) AS qout_max FROM {flow_daily} GROUP BY 1)"


def stats(t):
    out = ranking.median(t.flow_daily, ["reach_id"], "streamflow", "qout_median").withColumnRenamed("reach_id", "comid")
    top = t.flow_daily.groupBy(F.col("reach_id").alias("comid")).agg(F.max("streamflow").alias("qout_max"))
    return out.join(top, "comid")


@query("J1_rekey_nhd_to_tdx", f"SELECT x.linkno AS comid, {rd('s.qout_median')} AS qout_median, {rd('s.qout_max')} AS qout_max FROM {STATS} s JOIN {{crosswalk}} x ON s.comid = x.nhdplusid")
def _(t):
    return rounded(keyed.rekey(stats(t), t.crosswalk, "nhdplusid", "linkno", "comid"), "qout_median", "qout_max")


@query("J2_rekey_tdx_to_nhd", f"""SELECT x.nhd AS comid, {rd('s.flow')} AS flow FROM (SELECT 700000000 + l_partkey % 25 AS linkno, max(l_extendedprice) AS flow FROM {{lineitem}} GROUP BY 1) s
       JOIN (SELECT linkno, min(nhdplusid) AS nhd FROM {{crosswalk}} GROUP BY 1) x ON s.linkno = x.linkno""")
def _(t):
    tdx = t.lineitem.groupBy((F.lit(700000000) + F.col("l_partkey") % 25).alias("comid")).agg(F.max("l_extendedprice").alias("flow"))
    pairs = keyed.one_per_target(t.crosswalk, "nhdplusid")
    return rounded(keyed.rekey(tdx, pairs, "linkno", "nhdplusid", "comid"), "flow")


@query("J3_replace_columns", f"SELECT s.site_id, {rd('m.qout_median')} AS weir_length FROM {{sites}} s LEFT JOIN {STATS} m ON s.site_id = m.comid + 7")
def _(t):
    fresh = stats(t).select((F.col("comid") + 7).alias("site_id"), F.col("qout_median").alias("weir_length"))
    return rounded(reach_stats.replace_columns(t.sites.select("site_id", "weir_length"), fresh, "site_id"), "weir_length")


J4 = f"""SELECT s.site_id, s.name, coalesce(i.n, 0) AS incidents, {rd('x.qmin')} AS qmin, {rd('x.qmax')} AS qmax FROM {{sites}} s
       LEFT JOIN (SELECT site_id, count(*) AS n FROM {{incidents}} GROUP BY 1) i ON s.site_id = i.site_id
       LEFT JOIN (SELECT site_id, min(qmin) AS qmin, max(qmax) AS qmax FROM {{xsections}} WHERE xs_index = 3 GROUP BY 1) x ON s.site_id = x.site_id"""


@query("J4_enriched_sites", J4)
def _(t):
    return rounded(cleaning.publication_table(t.sites, t.incidents, t.xsections), "qmin", "qmax")


@query("K12_publication_table", J4)
def _(t):
    return rounded(cleaning.publication_table(t.sites, t.incidents, t.xsections), "qmin", "qmax")


@query("J5_keys_present", "SELECT site_id, xs_index, jump_type, strftime(date, '%Y-%m-%d') AS date FROM {results} r WHERE EXISTS (SELECT 1 FROM {incidents} i WHERE i.site_id = r.site_id AND i.date = r.date)")
def _(t):
    out = t.results.join(t.incidents.select("site_id", "date"), ["site_id", "date"], "left_semi")
    return out.select("site_id", "xs_index", "jump_type", day("date").alias("date"))


@query("J6_keys_absent", "SELECT incident_id, site_id FROM {incidents} i WHERE NOT EXISTS (SELECT 1 FROM {flow_daily} f WHERE f.reach_id = i.site_id AND f.date = i.date)")
def _(t):
    have = t.flow_daily.select(F.col("reach_id").alias("site_id"), "date")
    return t.incidents.join(have, ["site_id", "date"], "left_anti").select("incident_id", "site_id")


@query("J7_composite_join", f"SELECT c.cell_id, s.stage_id, {rd('c.elev')} AS elev, {rd('s.wse')} AS wse FROM {{cells}} c JOIN {{stage_cells}} s ON c.comid = s.comid AND c.row_ = s.row_ AND c.col_ = s.col_")
def _(t):
    out = t.cells.drop("site_id").join(t.stage_cells.drop("site_id"), ["comid", "row_", "col_"])
    return rounded(out.select("cell_id", "stage_id", "elev", "wse"), "elev", "wse")


@query("J8_network_attributes", "SELECT l.l_orderkey, l.l_linenumber, r.hydroseq, r.dnhydroseq FROM {lineitem} l LEFT JOIN {reaches} r ON l.l_partkey + 1 = r.linkno")
def _(t):
    seq = t.reaches.select("linkno", "hydroseq", "dnhydroseq")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") + 1).alias("linkno"))
    return rows.join(seq, "linkno", "left").drop("linkno")


@query("J9_work_once_per_place", f"SELECT i.incident_id, i.site_id, {rd('s.latitude * 2')} AS twice FROM {{incidents}} i JOIN {{sites}} s ON i.site_id = s.site_id")
def _(t):
    rows = t.incidents.join(t.sites.select("site_id", "latitude", "longitude"), "site_id")
    out = keyed.expand_duplicates(rows, ["site_id", "latitude", "longitude"], lambda d: d.withColumn("twice", r(F.col("latitude") * 2)))
    return out.select("incident_id", "site_id", "twice")


@query("J10_labels_of_reach", f"SELECT s.stage_id, s.comid, c.label, {rd('s.wse')} AS wse FROM {{stage_cells}} s LEFT JOIN (SELECT DISTINCT comid, concat('Downstream', CAST(1 + row_ % 4 AS string)) AS label FROM {{cells}}) c ON s.comid = c.comid")
def _(t):
    labels = t.cells.select("comid", F.concat(F.lit("Downstream"), 1 + F.col("row_") % 4).alias("label")).distinct()
    return rounded(t.stage_cells.join(labels, "comid", "left").select("stage_id", "comid", "label", "wse"), "wse")


@query("J25_roughness", f"""SELECT s.site_id, {rd('coalesce(round(coalesce(CASE WHEN g.owp_roughness_bathy > 0 THEN g.owp_roughness_bathy END, CASE WHEN g.owp_roughness_no_bathy > 0 THEN g.owp_roughness_no_bathy END), 4), 0.03e0)')} AS n
       FROM {{run_log}} s LEFT JOIN {{channel_geometry}} g ON g.feature_id = s.site_id * 2""")
def _(t):
    ids = t.run_log.select("site_id", (F.col("site_id") * 2).alias("feature"))
    return rounded(keyed.roughness(ids, t.channel_geometry, "feature", 0.03).select("site_id", "n"), "n")


@query("J26_mapped_column", "SELECT i.incident_id, m.name FROM {incidents} i LEFT JOIN (SELECT site_id, arg_max(coalesce(comments, ''), incident_id) AS name FROM {incident_text} GROUP BY 1) m ON i.site_id = m.site_id")
def _(t):
    last = t.incident_text.select("site_id", F.col("incident_id").alias("nr"), F.coalesce("comments", F.lit("")).alias("n"))
    return keyed.lookup(t.incidents, last, "site_id", "n", "name", "nr").select("incident_id", "name")


@query("J27_with_upstream_section", f"""SELECT x.xs_key, x.site_id, {rd('x.y_t')} AS y_t, {rd('u.y_t')} AS y_t_up FROM (SELECT *, xs_index - 1 AS i0 FROM {{xs_water}}) x
       JOIN (SELECT site_id, arg_min(y_t, struct_pack(a := xs_index, b := xs_key)) AS y_t FROM {{xs_water}} GROUP BY 1) u ON x.site_id = u.site_id""")
def _(t):
    rows = t.xs_water.withColumn("xs_index", F.col("xs_index") - 1)
    return rounded(keyed.with_upstream(rows, ["xs_key", "y_t"]).select("xs_key", "site_id", "y_t", "y_t_up"), "y_t", "y_t_up")


@query("J31_results_with_slope", f"""SELECT r.site_id, strftime(r.date, '%Y-%m-%d') AS date, {rd('r.y_t')} AS y_t, {rd('x.slope')} AS slope FROM {{results}} r JOIN {{xsections}} x
       ON r.site_id = x.site_id AND r.xs_index = x.xs_index AND r.flowline = x.flowline AND r.streamflow = x.streamflow WHERE r.xs_index = 3""")
def _(t):
    out = t.results.join(t.xsections.select("site_id", "xs_index", "flowline", "streamflow", "slope"), ["site_id", "xs_index", "flowline", "streamflow"])
    out = out.where("xs_index = 3").orderBy("site_id", "slope")
    return rounded(out.select("site_id", day("date").alias("date"), "y_t", "slope"), "y_t", "slope")


@query("J33_runs_compared", f"""SELECT a.site_id, a.xs_index, {rd('a.h')} AS h_nhd, {rd('b.h')} AS h_tdx, {rd('a.h - b.h')} AS diff FROM
       (SELECT site_id, xs_index, max(p_height) AS h FROM {{xsections}} WHERE flowline = 'NHD' GROUP BY 1, 2) a JOIN (SELECT site_id, xs_index, max(p_height) AS h FROM {{xsections}} WHERE flowline = 'TDX' GROUP BY 1, 2) b
       ON a.site_id = b.site_id AND a.xs_index = b.xs_index""")
def _(t):
    def run(source):
        return t.xsections.where(F.col("flowline") == source).groupBy("site_id", "xs_index").agg(F.max("p_height").alias(f"h_{source.lower()}"))

    out = run("NHD").join(run("TDX"), ["site_id", "xs_index"]).withColumn("diff", F.col("h_nhd") - F.col("h_tdx"))
    return rounded(out, "h_nhd", "h_tdx", "diff")


@query("J36_features_per_region", "SELECT linkno, huc4, hydroseq FROM {reaches} r WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey + 1000000 = r.hydroseq AND concat('0', CAST(100 + l.l_suppkey % 25 AS string)) = r.huc4)")
def _(t):
    wanted = t.lineitem.select((F.col("l_partkey") + 1000000).alias("hydroseq"), F.concat(F.lit("0"), (100 + F.col("l_suppkey") % 25).cast("string")).alias("huc4"))
    return t.reaches.join(wanted, ["huc4", "hydroseq"], "left_semi").select("linkno", "huc4", "hydroseq")


@query("A25_incidents_per_site", "SELECT site_id, count(*) AS n FROM {incidents} GROUP BY 1")
def _(t):
    return t.incidents.groupBy("site_id").agg(F.count("*").alias("n"))


@query("A26_joined_sets", "SELECT site_id, string_agg(c, '; ' ORDER BY c) AS comments FROM (SELECT DISTINCT site_id, trim(comments) AS c FROM {incident_text} WHERE comments IS NOT NULL) GROUP BY 1")
def _(t):
    return keyed.joined_set(t.incident_text.withColumn("c", F.trim("comments")), "site_id", "c", "comments")


@query("A27_reindexed_ids", """SELECT linkno, h - CASE WHEN low > 1000000000 THEN low - 1 ELSE 0 END AS h, CASE WHEN low > 1000000000 THEN 'FIXED' ELSE 'OK' END AS state
       FROM (SELECT *, min(h) OVER (PARTITION BY huc4) AS low FROM (SELECT linkno, huc4, hydroseq + CASE WHEN huc4 < '0112' THEN 2000000000 ELSE 0 END AS h FROM {reaches}))""")
def _(t):
    rows = t.reaches.select("linkno", "huc4", (F.col("hydroseq") + F.when(F.col("huc4") < "0112", 2000000000).otherwise(0)).alias("h"))
    return keyed.reindex_large(rows, ["h"], "h", "huc4").select("linkno", "h", "state")


@query("A28_wanted_ids", "SELECT DISTINCT l_suppkey AS reach_id FROM {lineitem} UNION SELECT user_id FROM {events}")
def _(t):
    return t.lineitem.select(F.col("l_suppkey").alias("reach_id")).union(t.events.select("user_id")).distinct()


@query("A29_run_status", "SELECT s.site_id, CASE WHEN l.outcome = 'ok' THEN 'Success' WHEN l.outcome IS NOT NULL THEN concat('Failed: ', l.message) ELSE 'Not Run' END AS status FROM (SELECT p_partkey AS site_id FROM {part}) s LEFT JOIN {run_log} l ON s.site_id = l.site_id")
def _(t):
    return keyed.run_status(t.part.select(F.col("p_partkey").alias("site_id")), t.run_log).select("site_id", "status")


@query("W4_first_row_per_key", "SELECT linkno, min(nhdplusid) AS nhdplusid FROM {crosswalk} GROUP BY 1")
def _(t):
    return keyed.first_per_key(t.crosswalk.withColumn("k", F.col("nhdplusid")), ["linkno"], ["nhdplusid"]).select("linkno", "nhdplusid")


@query("U1_union_of_tables", "SELECT site_id, strftime(date, '%Y-%m-%d') AS date, CAST(NULL AS bigint) IS NULL AS x, flow FROM (SELECT site_id, date, round(flow, 6) + 0e0 AS flow FROM {incidents} UNION ALL SELECT site_id, date, NULL FROM {results})".replace("CAST(NULL AS bigint) IS NULL AS x, ", ""))
def _(t):
    a = t.incidents.select("site_id", "date", r("flow").alias("flow"))
    out = a.unionByName(t.results.select("site_id", "date"), allowMissingColumns=True)
    return out.withColumn("date", day("date"))


@query("U2_common_keys", "SELECT site_id, strftime(date, '%Y-%m-%d') AS date FROM (SELECT site_id, date FROM {incidents} INTERSECT SELECT site_id, date FROM {results})")
def _(t):
    out = t.incidents.select("site_id", "date").intersect(t.results.select("site_id", "date"))
    return out.withColumn("date", day("date"))


@query("U3_keys_of_one_side", """SELECT side, site_id, strftime(date, '%Y-%m-%d') AS date FROM (SELECT 'left' AS side, * FROM (SELECT site_id, date FROM {incidents} EXCEPT SELECT site_id, date FROM {results})
       UNION ALL SELECT 'right' AS side, * FROM (SELECT site_id, date FROM {results} EXCEPT SELECT site_id, date FROM {incidents}))""")
def _(t):
    a, b = t.incidents.select("site_id", "date"), t.results.select("site_id", "date")
    out = a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))
    return out.select("side", "site_id", day("date").alias("date"))


@query("U4_distinct_rows", "SELECT DISTINCT site_id, strftime(date, '%Y-%m-%d') AS date FROM {results}")
def _(t):
    return t.results.select("site_id", day("date").alias("date")).distinct()


@query("U5_first_per_key", "SELECT site_id, min(incident_id) AS incident_id, round(arg_min(flow, incident_id), 6) + 0e0 AS flow FROM {incidents} GROUP BY 1")
def _(t):
    return keyed.first_per_key(t.incidents.select("site_id", "incident_id", r("flow").alias("flow")), ["site_id"], ["incident_id"])


@query("U6_replace_rows_of_keys", """SELECT site_id, strftime(date, '%Y-%m-%d') AS date, round(flow, 6) + 0e0 AS flow FROM {incidents} WHERE site_id NOT IN (SELECT site_id + 3 FROM {sites} WHERE flowline_source = 'NHDPlus')
       UNION ALL SELECT site_id + 3, NULL, weir_length + 0e0 FROM {sites} WHERE flowline_source = 'NHDPlus' AND weir_length IS NOT NULL""")
def _(t):
    fresh = t.sites.where("flowline_source = 'NHDPlus'").select((F.col("site_id") + 3).alias("site_id"), F.lit(None).cast("date").alias("date"), F.col("weir_length").alias("flow"))
    return rounded(keyed.replace_keys(t.incidents.select("site_id", "date", "flow"), fresh, ["site_id"]), "flow").withColumn("date", day("date"))


@query("U7_upsert", f"""SELECT coalesce(s.site_id, f.site_id) AS site_id, {rd('coalesce(f.w, s.weir_length)')} AS weir_length, {rd('s.p_known')} AS p_known
       FROM {{sites}} s FULL JOIN (SELECT c_custkey AS site_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS w FROM {{customer}}) f ON s.site_id = f.site_id""")
def _(t):
    fresh = t.customer.select(F.col("c_custkey").alias("site_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("weir_length"), F.lit(1).alias("unknown"))
    return rounded(keyed.upsert(t.sites.select("site_id", "weir_length", "p_known"), fresh, ["site_id"]), "weir_length", "p_known")


@query("U8_skip_empty_rows", f"SELECT site_id, xs_index, {rd('p_height')} AS p_height, {rd('prob_min')} AS prob_min FROM {{xsections}} WHERE p_height IS NOT NULL OR prob_min IS NOT NULL")
def _(t):
    return rounded(t.xsections.select("site_id", "xs_index", "p_height", "prob_min").dropna(how="all", subset=["p_height", "prob_min"]), "p_height", "prob_min")


@query("O1_sorted_output", f"SELECT site_id, xs_index, {rd('slope')} AS slope FROM {{xsections}} ORDER BY site_id, slope")
def _(t):
    return rounded(t.xsections.select("site_id", "xs_index", "slope"), "slope").orderBy("site_id", "slope")


@query("O3_top_row_by_key", "SELECT huc4, max(strm_order) AS strm_order, arg_max(linkno, struct_pack(a := strm_order, b := -linkno)) AS linkno FROM {reaches} GROUP BY 1")
def _(t):
    return t.reaches.groupBy("huc4").agg(F.max("strm_order").alias("strm_order"), F.max_by("linkno", F.struct("strm_order", -F.col("linkno"))).alias("linkno"))


@query("O4_head_of_sorted", "SELECT incident_id, round(flow, 6) + 0e0 AS flow FROM {incidents} ORDER BY flow DESC, incident_id LIMIT 5")
def _(t):
    return t.incidents.select("incident_id", r("flow").alias("flow")).orderBy(F.desc("flow"), "incident_id").limit(5)


CLEAN = """SELECT incident_id, site_id, CAST(coalesce(TRY_CAST(date_text AS timestamp), try_strptime(date_text, ['%m/%d/%Y', '%b %d, %Y'])) AS date) AS d FROM {incident_text} WHERE (comments IS NULL OR lower(trim(comments)) <> 'removed') AND CAST(coalesce(TRY_CAST(date_text AS timestamp), try_strptime(date_text, ['%m/%d/%Y', '%b %d, %Y'])) AS date) IS NOT NULL"""


@query("K11_cleaned_slices", f"""SELECT 'NWM' AS slice, incident_id, site_id, strftime(d, '%Y-%m-%d') AS date FROM ({CLEAN}) WHERE d BETWEEN DATE '{NWM_FROM}' AND DATE '{NWM_TO}'
       UNION ALL SELECT 'GEO', incident_id, site_id, strftime(d, '%Y-%m-%d') FROM ({CLEAN}) WHERE d >= DATE '{GEO_FROM}'""")
def _(t):
    return cleaning.source_slices(t.incident_text).select("slice", "incident_id", "site_id", day("date").alias("date"))


@query("K14_baseflow_resolution", f"""SELECT s.site_id, strftime(s.d, '%Y-%m-%d') AS scan_date, {rd('CASE WHEN coalesce(s.baseflow_geo, 0) = 0 THEN coalesce(f.streamflow, m.q) ELSE s.baseflow_geo END')} AS baseflow
       FROM (SELECT site_id, baseflow_geo, CASE WHEN site_id % 4 = 0 THEN DATE '2011-09-14' + CAST(site_id AS int) WHEN site_id % 4 = 1 THEN make_date(1996 + CAST(site_id % 5 AS int), 6, 15) ELSE NULL END AS d FROM {{sites}}) s
       LEFT JOIN {{flow_daily}} f ON s.site_id = f.reach_id AND s.d = f.date LEFT JOIN (SELECT reach_id, quantile_cont(streamflow, 0.5) AS q FROM {{flow_daily}} GROUP BY 1) m ON m.reach_id = s.site_id""")
def _(t):
    sites = t.sites.select(
        "site_id", F.col("site_id").alias("reach_id"), F.col("baseflow_geo").alias("baseflow"),
        F.when(F.col("site_id") % 4 == 0, F.col("site_id") * 86400).alias("gps"),
        F.when(F.col("site_id") % 4 == 1, F.concat(F.lit("Basin_"), 1996 + F.col("site_id") % 5)).otherwise("none").alias("project"),
    )
    out = cleaning.resolve_baseflow(sites, t.flow_daily)
    return out.select("site_id", day("scan_date").alias("scan_date"), r("baseflow").alias("baseflow"))


@query("F22_significant_figures", f"""SELECT vec_id, CASE WHEN e = 0 THEN 0e0 ELSE {rd('round_even(e * power(10e0, 2 - floor(log10(abs(e)))), 0) / power(10e0, 2 - floor(log10(abs(e))))', 9)} END AS value FROM (SELECT vec_id, CAST(embedding[1] AS double) AS e FROM {{embeddings}})""")
def _(t):
    return t.embeddings.select("vec_id", r(tx.significant(F.col("embedding")[0].cast("double"), 3), 9).alias("value"))


@query("F24_gps_dates", "SELECT event_id, strftime(make_timestamp((event_id * 86399 + 1000000000 + 315964800) * 1000000), '%Y-%m-%d') AS date FROM {events}")
def _(t):
    return t.events.select("event_id", day(tx.gps_date(F.col("event_id") * 86399)).alias("date"))


@query("F25_date_normalised", "SELECT event_id, strftime(CAST(ts AS date), '%Y-%m-%d') AS date FROM {events}")
def _(t):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return t.events.select("event_id", day(tx.parse_date(stamp)).alias("date"))


@query("F36_table_names_of_pairs", "SELECT concat('Results', flowline, streamflow) AS name, count(*) AS n FROM {results} GROUP BY 1")
def _(t):
    name = F.concat(F.lit("Results"), tx.source_pair(F.col("flowline"), F.col("streamflow")))
    return t.results.groupBy(name.alias("name")).agg(F.count("*").alias("n"))


@query("F26_scan_date_fallback", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN strftime(make_date(CAST(1990 + p_size AS int), 6, 15), '%Y-%m-%d') WHEN p_partkey % 3 = 1 THEN strftime(make_date(CAST(2010 + p_size % 10 AS int), 6, 15), '%Y-%m-%d') ELSE NULL END AS scan_date FROM {part}")
def _(t):
    project = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("USGS_"), 1990 + F.col("p_size"), F.lit("_D18"))).when(
        F.col("p_partkey") % 3 == 1, F.concat(F.lit("CO_FY"), 10 + F.col("p_size") % 10)).otherwise("none")
    return t.part.select("p_partkey", day(tx.scan_date(F.lit(None).cast("date"), project)).alias("scan_date"))


@query("F27_id_in_path", "SELECT page_id, TRY_CAST(regexp_extract(url, '/([0-9]+)[?]', 1) AS bigint) IS NOT NULL AS x, TRY_CAST(nullif(regexp_extract(concat('/data/vpu_', CAST(page_id AS string), '.gpkg'), '([0-9]+)[.][A-Za-z0-9]+$', 1), '') AS bigint) AS id FROM {pages}".replace("TRY_CAST(regexp_extract(url, '/([0-9]+)[?]', 1) AS bigint) IS NOT NULL AS x, ", ""))
def _(t):
    return t.pages.select("page_id", tx.id_in_path(F.concat(F.lit("/data/vpu_"), F.col("page_id"), F.lit(".gpkg"))).alias("id"))


@query("F28_safe_filenames", """SELECT page_id, regexp_replace(url, '[<>:"/\\\\|?*]', '-', 'g') AS name FROM {pages}""")
def _(t):
    return t.pages.select("page_id", tx.safe_filename(F.col("url")).alias("name"))


@query("F29_padded_codes", "SELECT vpu, lpad(CAST(vpu AS string), 4, '0') AS code, left(lpad(CAST(vpu AS string), 8, '0'), 4) AS prefix, concat(CAST(vpu * 10 AS string), '-', CAST(vpu * 10 + 10 AS string), '%') AS label FROM {regions}")
def _(t):
    v = F.col("vpu").cast("string")
    return t.regions.select("vpu", F.lpad(v, 4, "0").alias("code"), F.left(F.lpad(v, 8, "0"), F.lit(4)).alias("prefix"),
                            F.concat(F.col("vpu") * 10, F.lit("-"), F.col("vpu") * 10 + 10, F.lit("%")).alias("label"))
