"""Source, sink and streaming queries. Sinks write to a fresh folder next to the checkpoints and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirspan.functions import geo
from weirspan.plans import reach_stats
from weirspan.plans.catalog import query
from weirspan.plans.common import day, r, rd, rounded
from weirspan.operators import flow, keyed
from weirspan.sources import schemas, tables
from weirspan.streaming import flow_stream


def arriving(t):
    raw = t.spark.readStream.schema(t.events.schema).parquet(f"{t.root}/events*.parquet")
    return raw.select(F.col("user_id").alias("reach_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("streamflow"))


def drained(stream, name):
    path = flow_stream.scratch_table(stream.sparkSession, name)
    return flow_stream.run_available(stream, f"{path}/table", f"{path}/state")


@query(
    "ST1_daily_mean_stream",
    f"""SELECT reach_id, strftime(CAST(ts AS date), '%Y-%m-%d') AS date, {rd('avg(streamflow)')} AS streamflow FROM {{flow_obs}}
        GROUP BY reach_id, CAST(ts AS date) HAVING CAST(ts AS date) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM {{flow_obs}})""",
)
def _(t):
    out = drained(flow_stream.daily_mean_stream(arriving(t)), "daily")
    return rounded(out, "streamflow").withColumn("date", day("date"))


@query(
    "ST2_dangerous_flow_stream",
    f"""SELECT e.event_id, x.xs_key, {rd('e.value')} AS streamflow FROM {{events}} e JOIN (SELECT p_partkey AS xs_key, p_partkey % (SELECT count(*) FROM {{supplier}}) AS reach_id,
        1 + (p_partkey * 7 % 90) * 1.0e0 AS qmin, 20 + (p_partkey * 11 % 400) * 1.0e0 AS qmax FROM {{part}}) x ON x.reach_id = e.user_id WHERE e.value BETWEEN x.qmin AND x.qmax""",
)
def _(t):
    n = t.supplier.count()
    k = F.col("p_partkey")
    sections = t.part.select(k.alias("xs_key"), (k % n).alias("reach_id"), (1 + k * 7 % 90).cast("double").alias("qmin"), (20 + k * 11 % 400).cast("double").alias("qmax"))
    raw = t.spark.readStream.schema(t.events.schema).parquet(f"{t.root}/events*.parquet")
    obs = raw.select("event_id", F.col("user_id").alias("reach_id"), F.col("value").alias("streamflow"))
    out = drained(flow_stream.dangerous_flows(obs, sections), "danger")
    return rounded(out.select("event_id", "xs_key", "streamflow"), "streamflow")


@query(
    "S8_rows_to_append",
    f"""SELECT reach_id, strftime(CAST(ts AS date), '%Y-%m-%d') AS date, {rd('avg(streamflow)')} AS streamflow FROM {{flow_obs}}
        WHERE reach_id NOT IN (SELECT reach_id FROM {{flow_daily}}) AND reach_id IN (SELECT c_custkey FROM {{customer}}) GROUP BY reach_id, CAST(ts AS date)""",
)
def _(t):
    out = tables.daily_means_to_append(t.flow_obs, t.customer.select(F.col("c_custkey").alias("reach_id")), t.flow_daily)
    return rounded(out, "streamflow").withColumn("date", day("date"))


@query("S6_rows_of_asked_features", f"SELECT feature_id, {rd('owp_roughness_bathy')} AS owp_roughness_bathy FROM {{channel_geometry}} WHERE feature_id IN (SELECT site_id * 2 FROM {{run_log}})")
def _(t):
    path = flow_stream.scratch_table(t.spark, "geometry")
    t.channel_geometry.write.parquet(path)
    ids = t.run_log.select((F.col("site_id") * 2).alias("feature_id"))
    return rounded(tables.read_rows_of(t.spark, path, ["feature_id", "owp_roughness_bathy"], ids, "feature_id"), "owp_roughness_bathy")


@query("S13_sites_with_output", "SELECT c_custkey AS site_id FROM {customer} WHERE c_custkey IN (SELECT site_id FROM {stage_cells})")
def _(t):
    return tables.sites_with_output(t.customer.select(F.col("c_custkey").alias("site_id")), t.stage_cells)


@query("S12_union_of_sources", "SELECT name, nation, CAST(acct AS double) AS acct FROM (SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS acct FROM {customer} UNION ALL SELECT s_name, s_nationkey, NULL FROM {supplier})")
def _(t):
    # Two tables as files; the second has no balance.
    path = flow_stream.scratch_table(t.spark, "sources")
    t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").cast("double").alias("acct")).write.parquet(f"{path}/a")
    t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).write.parquet(f"{path}/b")
    return tables.union_of_files(t.spark, [f"{path}/a", f"{path}/b"]).select("name", "nation", "acct")


SYSTEMS = (geo.DEGREES, geo.ALBERS_CODE, geo.WEB_MERCATOR_CODE, None)


@query("S12_one_reference_system", f"SELECT linkno, seq, {rd('x')} AS x, {rd('y')} AS y FROM {{reach_vertices}}")
def _(t):
    # A layer for each kind of system; every UTM zone the reaches lie in is a layer of its own.
    path = flow_stream.scratch_table(t.spark, "systems")
    kind = F.pmod("linkno", F.lit(len(SYSTEMS)))
    systems = {}
    for k, code in enumerate(SYSTEMS):
        rows = t.reach_vertices.where(kind == k)
        zones = [None] if code else [z[0] for z in rows.select(geo.utm_zone(F.col("x"))).distinct().collect()]
        for zone in zones:
            system = code or geo.UTM_CODES[0] + zone
            layer = rows if code else rows.where(geo.utm_zone(F.col("x")) == zone)
            x, y = geo.from_degrees(system, F.col("y"), F.col("x"))
            systems[f"{path}/{system}"] = system
            layer.select("linkno", "seq", x.alias("x"), y.alias("y")).write.parquet(f"{path}/{system}")
    return rounded(tables.union_in_one_system(t.spark, systems).select("linkno", "seq", "x", "y"), "x", "y")


@query(
    "S8_repeated_append",
    f"SELECT reach_id, strftime(CAST(ts AS date), '%Y-%m-%d') AS date, {rd('avg(streamflow)')} AS streamflow FROM {{flow_obs}} WHERE reach_id IN (SELECT c_custkey FROM {{customer}}) GROUP BY reach_id, CAST(ts AS date)",
)
def _(t):
    # Two overlapping batches, the first of them sent twice.
    store = flow_stream.scratch_table(t.spark, "daily")
    ids = t.customer.select(F.col("c_custkey").alias("reach_id"))
    for batch in (ids.where("reach_id % 3 < 2"), ids.where("reach_id % 3 < 2"), ids):
        tables.append_reaches(t.flow_obs, batch, store)
    return rounded(tables.read_daily_store(t.spark, store), "streamflow").withColumn("date", day("date"))


RP = flow.RETURN_PERIODS


@query(
    "K1_reach_statistics_from_table",
    f"""WITH st AS (SELECT reach_id, quantile_cont(streamflow, 0.5) AS med, max(streamflow) AS mx FROM {{flow_daily}} GROUP BY 1),
        tb AS (SELECT comid, {", ".join(f"coalesce(max(CASE WHEN return_period = {p} THEN flow END), 0) AS rp{p}" for p in RP)} FROM {{return_periods}} GROUP BY 1)
        SELECT st.reach_id AS comid, {rd('coalesce(d.streamflow, med)')} AS known_baseflow, {rd('med')} AS qout_median, {rd('mx')} AS qout_max,
        {", ".join(f"{rd(f'coalesce(tb.rp{p}, 0)')} AS rp{p}" for p in RP)}, {rd('1.5e0 * mx')} AS qout_max_premium, {rd('1.5e0 * coalesce(tb.rp100, 0)')} AS rp100_premium
        FROM st LEFT JOIN tb ON st.reach_id = tb.comid LEFT JOIN {{scan_dates}} s ON s.reach_id = st.reach_id LEFT JOIN {{flow_daily}} d ON d.reach_id = st.reach_id AND d.date = s.scan_date""",
)
def _(t):
    out = reach_stats.reach_statistics_from_table(t.flow_daily, t.return_periods, t.scan_dates)
    return rounded(out, *[c for c in out.columns if c != "comid"])


RESULT_ROWS = "SELECT site_id, strftime(date, '%Y-%m-%d') AS date, CAST(xs_index AS bigint) AS xs_index, flowline, streamflow, jump_type FROM {results}"


def project_back(t, part):
    root = flow_stream.scratch_table(t.spark, "project")
    tables.write_project({"results": t.results, "sites": t.sites}, root)
    return tables.read_project(t.spark, root)[part]


@query("S1_project_tables_read", "SELECT site_id, name, weir_length, streamflow_source FROM {sites}")
def _(t):
    return project_back(t, "sites").select("site_id", "name", "weir_length", "streamflow_source")


@query("S2_project_tables_written", RESULT_ROWS)
def _(t):
    out = project_back(t, "results")
    return out.select("site_id", day("date").alias("date"), F.col("xs_index").cast("bigint").alias("xs_index"), "flowline", "streamflow", "jump_type")


@query("S3_codes_from_csv", "SELECT linkno, huc4 FROM {reaches}")
def _(t):
    path = flow_stream.scratch_table(t.spark, "codes")
    t.reaches.select("linkno", "huc4").write.option("header", True).csv(path)
    return tables.read_codes_csv(t.spark, path, schemas.schema("linkno BIGINT, huc4 STRING"))


@query("S4_simulator_text", f"SELECT cell_id AS \"COMID\", row_ AS \"Row\", {rd('elev')} AS \"Elev\" FROM {{cells}}")
def _(t):
    path = flow_stream.scratch_table(t.spark, "text")
    t.cells.select(F.col("cell_id").alias(" COMID "), F.col("row_").alias("Row  "), F.col("elev").alias("  Elev")).write.option("header", True).option("sep", "\t").csv(path)
    return rounded(tables.read_simulator(t.spark, path, "\t", schemas.schema("COMID BIGINT, Row BIGINT, Elev DOUBLE")), "Elev")


@query("S5_statistics_csv", f"SELECT site_id AS comid, 0.0e0 AS known_baseflow, {rd('coalesce(baseflow_geo, 0)')} AS qout_median FROM {{sites}}")
def _(t):
    path = flow_stream.scratch_table(t.spark, "stats")
    stats = t.sites.select(F.col("site_id").alias("comid"), F.col("baseflow_geo").alias("qout_median"))
    tables.write_stats_csv(stats, ["comid", "known_baseflow", "qout_median"], path)
    back = tables.read_codes_csv(t.spark, path, schemas.schema("comid BIGINT, known_baseflow DOUBLE, qout_median DOUBLE"))
    return rounded(back, "qout_median")


@query("S9_flow_store", f"SELECT reach_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {rd('streamflow')} AS streamflow FROM {{flow_obs}}")
def _(t):
    path = flow_stream.scratch_table(t.spark, "flow")
    tables.write_flow_store(t.flow_obs, path)
    return rounded(t.spark.read.parquet(path), "streamflow").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    "J24_incident_flows_bucketed",
    f"""SELECT i.incident_id, strftime(i.date, '%Y-%m-%d') AS date, {rd('n.streamflow')} AS flow_nwm
        FROM {{incidents}} i LEFT JOIN {{flow_daily}} n ON i.site_id = n.reach_id AND i.date = n.date""",
)
def _(t):
    path = flow_stream.scratch_table(t.spark, "bucketed")
    store = tables.write_daily_table(t.flow_daily, "flow_" + path.rsplit("-", 1)[1], path)
    asked = t.incidents.select("incident_id", F.col("site_id").alias("reach_id"), "date")
    return rounded(flow.flow_on(asked, store, "date", "flow_nwm").drop("reach_id"), "flow_nwm").withColumn("date", day("date"))


@query("U6_replace_rows_in_place", """SELECT site_id, strftime(date, '%Y-%m-%d') AS date, round(flow, 6) + 0e0 AS flow FROM {incidents} WHERE site_id NOT IN (SELECT site_id + 3 FROM {sites} WHERE flowline_source = 'NHDPlus')
       UNION ALL SELECT site_id + 3, NULL, weir_length + 0e0 FROM {sites} WHERE flowline_source = 'NHDPlus' AND weir_length IS NOT NULL""")
def _(t):
    path = flow_stream.scratch_table(t.spark, "keyed")
    stored = t.incidents.select("site_id", "date", "flow")
    tables.write_keyed(stored, path, ["site_id"], 16)
    fresh = t.sites.where("flowline_source = 'NHDPlus'").select((F.col("site_id") + 3).alias("site_id"), F.lit(None).cast("date").alias("date"), F.col("weir_length").alias("flow"))
    tables.merge_keyed(fresh, path, stored.schema, ["site_id"], keyed.replace_keys)
    return rounded(tables.read_keyed(t.spark, path, stored.schema), "flow").withColumn("date", day("date"))


@query("U7_upsert_in_place", f"""SELECT coalesce(s.site_id, f.site_id) AS site_id, {rd('coalesce(f.w, s.weir_length)')} AS weir_length, {rd('s.p_known')} AS p_known
       FROM {{sites}} s FULL JOIN (SELECT c_custkey AS site_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS w FROM {{customer}}) f ON s.site_id = f.site_id""")
def _(t):
    path = flow_stream.scratch_table(t.spark, "keyed")
    stored = t.sites.select("site_id", "weir_length", "p_known")
    tables.write_keyed(stored, path, ["site_id"], 16)
    fresh = t.customer.select(F.col("c_custkey").alias("site_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("weir_length"))
    tables.merge_keyed(fresh, path, stored.schema, ["site_id"], keyed.upsert)
    return rounded(tables.read_keyed(t.spark, path, stored.schema), "weir_length", "p_known")


@query("S11_tables_per_site", "SELECT cell_id, site_id, comid FROM {cells}")
def _(t):
    path = flow_stream.scratch_table(t.spark, "sites")
    tables.write_per_site(t.cells.select("cell_id", "site_id", "comid"), path)
    return t.spark.read.parquet(path)


@query("S14_files_lacking_a_column", "SELECT 'cells' AS name, CAST(0 AS bigint) AS lacking WHERE EXISTS (SELECT 1 FROM {cells}) UNION ALL SELECT 'stage', 1 WHERE EXISTS (SELECT 1 FROM {stage_cells})")
def _(t):
    root = flow_stream.scratch_table(t.spark, "labels")
    layers = {"cells": t.cells, "stage": t.stage_cells.drop("comid")}
    tables.write_layers(layers, root)
    lacking = tables.files_lacking(t.spark, [f"{root}/{n}" for n in layers], "comid")
    names = t.spark.createDataFrame([(n,) for n in layers], "name string")
    hits = lacking.select(F.regexp_extract("file", "/([a-z]+)/[^/]*$", 1).alias("name")).distinct().withColumn("lacking", F.lit(1).cast("bigint"))
    return names.join(hits, "name", "left").withColumn("lacking", F.coalesce("lacking", F.lit(0)))


@query("S15_layers", "SELECT 'sites' AS layer, site_id AS id FROM {sites} UNION ALL SELECT 'reaches', linkno FROM {reaches}")
def _(t):
    root = flow_stream.scratch_table(t.spark, "layers")
    tables.write_layers({"sites": t.sites.select(F.col("site_id").alias("id")), "reaches": t.reaches.select(F.col("linkno").alias("id"))}, root)
    return t.spark.read.parquet(f"{root}/sites").withColumn("layer", F.lit("sites")).unionByName(t.spark.read.parquet(f"{root}/reaches").withColumn("layer", F.lit("reaches"))).select("layer", "id")


@query("S17_fallback_encoding", "SELECT page_id, concat('Rivière ', url) AS name FROM {pages}")
def _(t):
    # Half of the pages in either encoding, in one folder.
    path = flow_stream.scratch_table(t.spark, "latin")
    named = t.pages.select("page_id", F.concat(F.lit("Rivière "), "url").alias("name"))
    for rest, encoding in enumerate(("ISO-8859-1", "UTF-8")):
        half = named.where(F.pmod("page_id", F.lit(2)) == rest)
        half.write.mode("append").option("header", True).option("encoding", encoding).csv(path)
    return tables.read_any_encoding(t.spark, path, schemas.schema("page_id BIGINT, name STRING"))


@query("S16_point_read", f"""WITH first AS (SELECT min(reach_id) AS reach_id FROM {{flow_obs}}), day AS (SELECT min(CAST(ts AS date)) AS d FROM {{flow_obs}} WHERE reach_id = (SELECT reach_id FROM first))
    SELECT reach_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {rd('streamflow')} AS streamflow FROM {{flow_obs}} WHERE reach_id = (SELECT reach_id FROM first) AND CAST(ts AS date) = (SELECT d FROM day)""")
def _(t):
    # The first reach on its first day, read from the flow store.
    path = flow_stream.scratch_table(t.spark, "store")
    tables.write_flow_store(t.flow_obs, path)
    store = t.spark.read.schema(t.flow_obs.schema).parquet(path)
    reach = store.agg(F.min("reach_id")).first()[0]
    date = store.where(F.col("reach_id") == reach).agg(F.date_format(F.min("ts"), "yyyy-MM-dd")).first()[0]
    found = tables.flow_at(store, reach, date)
    return rounded(found.select("reach_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "streamflow"), "streamflow")
