"""The domain tables as projections of the driver's tables.

Each entry is one SELECT that both Spark and the checking engine accept; where the two differ in array
syntax a pair ``(spark, check)`` is given. ``{name}`` stands for a driver table or another binding.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# A site's position also seeds the reach vertices, so every site has reaches close by.
SQL: dict[str, str | tuple[str, str]] = {
    "sites": """
        SELECT s_suppkey AS site_id, s_suppkey AS reach_id, 700000000 + s_nationkey AS linkno,
               30 + (s_suppkey * 37 % 1500) / 100.0e0 AS latitude,
               -120 + (s_suppkey * 53 % 4500) / 100.0e0 AS longitude,
               CAST(5 + (s_suppkey * 13 % 90) AS double) AS weir_length,
               0.5e0 + (s_suppkey * 7 % 60) / 10.0e0 AS p_known,
               CASE WHEN s_suppkey % 9 = 0 THEN 0.0e0 ELSE 1 + (s_suppkey * 11 % 400) / 10.0e0 END AS baseflow_nwm,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 1 + (s_suppkey * 17 % 400) / 10.0e0 END AS baseflow_geo,
               CASE WHEN s_suppkey % 2 = 0 THEN 'NHDPlus' ELSE 'TDX-Hydro' END AS flowline_source,
               CASE WHEN s_suppkey % 3 = 0 THEN 'GEOGLOWS' ELSE 'National Water Model' END AS streamflow_source,
               s_name AS name, s_acctbal AS acct
        FROM {supplier}""",
    "incidents": """
        SELECT o_orderkey AS incident_id, o_custkey % (SELECT count(*) FROM {supplier}) AS site_id,
               CAST(o_orderdate AS date) AS date, o_totalprice / 1000 AS flow
        FROM {orders}""",
    "site_incidents": """
        SELECT site_id, date, max(flow) AS flow_nwm, min(flow) * 0.9e0 AS flow_geo
        FROM {incidents} GROUP BY site_id, date""",
    "incident_text": """
        SELECT o_orderkey AS incident_id, o_custkey % (SELECT count(*) FROM {supplier}) AS site_id,
               CASE WHEN o_orderkey % 11 = 0 THEN ' Removed ' WHEN o_orderkey % 13 = 0 THEN NULL
                    WHEN o_orderkey % 17 = 0 THEN 'duplicate' ELSE o_orderpriority END AS comments,
               CASE WHEN o_orderkey % 19 = 0 THEN 'unknown'
                    WHEN o_orderkey % 23 = 0 THEN NULL
                    WHEN o_orderkey % 5 = 1 THEN concat(CAST(extract(month FROM o_orderdate) AS string), '/', CAST(extract(day FROM o_orderdate) AS string), '/', CAST(extract(year FROM o_orderdate) AS string))
                    WHEN o_orderkey % 5 = 2 THEN concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * extract(month FROM o_orderdate) - 2 AS int), 3), ' ', CAST(extract(day FROM o_orderdate) AS string), ', ', CAST(extract(year FROM o_orderdate) AS string))
                    WHEN o_orderkey % 5 = 3 THEN concat(CAST(CAST(o_orderdate AS date) AS string), ' 14:05:00')
                    ELSE CAST(CAST(o_orderdate AS date) AS string) END AS date_text,
               CASE WHEN o_orderkey % 10 = 3 THEN 0 ELSE CAST(extract(year FROM o_orderdate) AS int) END AS y,
               CASE WHEN o_orderkey % 10 = 5 THEN 0 ELSE CAST(extract(month FROM o_orderdate) AS int) END AS m,
               CASE WHEN o_orderkey % 10 = 7 THEN 0 ELSE CAST(extract(day FROM o_orderdate) AS int) END AS d,
               CASE WHEN o_orderkey % 29 = 0 THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice) AS bigint) AS string) END AS height_text,
               o_totalprice / 10000 AS height
        FROM {orders}""",
    "flow_daily": """
        SELECT l_suppkey AS reach_id, CAST(l_shipdate AS date) AS date, avg(l_quantity) AS streamflow
        FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS date)""",
    "flow_obs": "SELECT user_id AS reach_id, ts, value AS streamflow FROM {events}",
    "xs_water": """
        SELECT p_partkey AS xs_key, p_partkey % (SELECT count(*) FROM {supplier}) AS site_id,
               1 + CAST(floor(p_partkey / (SELECT count(*) FROM {supplier})) AS bigint) % 4 AS xs_index,
               0.3e0 + p_size / 20.0e0 AS y_t, 0.2e0 + (p_retailprice - 900) / 50.0e0 AS delta_wse,
               0.2e0 + p_size / 100.0e0 AS depth_a, 0.3e0 + (p_partkey % 30) / 100.0e0 AS depth_b
        FROM {part}""",
    "xs_profile": (
        """
        SELECT vec_id AS xs_key, CAST(1 + label % 5 AS double) AS dx,
               transform(slice(embedding, 1, 32), e -> abs(CAST(e AS double)) * 10) AS xs1,
               transform(slice(embedding, 33, 32), e -> abs(CAST(e AS double)) * 10) AS xs2
        FROM {embeddings}""",
        """
        SELECT vec_id AS xs_key, CAST(1 + label % 5 AS double) AS dx,
               list_transform(embedding[1:32], lambda e: abs(CAST(e AS double)) * 10) AS xs1,
               list_transform(embedding[33:64], lambda e: abs(CAST(e AS double)) * 10) AS xs2
        FROM {embeddings}""",
    ),
    # The same profiles with invalid cells: every ninth element from a position that depends on the key.
    "xs_raw": (
        """
        SELECT vec_id AS xs_key, CAST(1 + label % 5 AS double) AS dx, 100 + (vec_id % 50) / 20.0e0 AS wse,
               transform(slice(embedding, 1, 32), (e, i) -> CASE WHEN (i + vec_id) % 29 = 7 THEN -1e6 ELSE 100 + abs(CAST(e AS double)) * 10 END) AS xs1,
               transform(slice(embedding, 33, 32), (e, i) -> CASE WHEN (i + vec_id) % 37 = 11 THEN -1e6 ELSE 100 + abs(CAST(e AS double)) * 10 END) AS xs2
        FROM {embeddings}""",
        """
        SELECT vec_id AS xs_key, CAST(1 + label % 5 AS double) AS dx, 100 + (vec_id % 50) / 20.0e0 AS wse,
               list_transform(embedding[1:32], lambda e, i: CASE WHEN (i - 1 + vec_id) % 29 = 7 THEN -1e6 ELSE 100 + abs(CAST(e AS double)) * 10 END) AS xs1,
               list_transform(embedding[33:64], lambda e, i: CASE WHEN (i - 1 + vec_id) % 37 = 11 THEN -1e6 ELSE 100 + abs(CAST(e AS double)) * 10 END) AS xs2
        FROM {embeddings}""",
    ),
    # Merged simulator output: one row per section of a site, index 0 upstream.
    "surveys": (
        """
        SELECT vec_id AS xs_key, vec_id % (SELECT count(*) FROM {supplier}) AS site_id,
               CAST(floor(vec_id / (SELECT count(*) FROM {supplier})) AS bigint) % 5 AS xs_index,
               CAST(1 + label % 5 AS double) AS dx, (vec_id % 40) / 1000.0e0 AS slope,
               112.0e0 - 2.2e0 * (CAST(floor(vec_id / (SELECT count(*) FROM {supplier})) AS bigint) % 5) + (vec_id % 10) / 10.0e0 AS wse,
               0.2e0 + (vec_id % 50) / 100.0e0 AS depth_a, 0.3e0 + (vec_id % 30) / 100.0e0 AS depth_b,
               transform(slice(embedding, 1, 32), (e, i) -> CASE WHEN i >= 29 AND vec_id % 3 = 1 THEN -1e6 ELSE 100 + abs(CAST(e AS double)) * 10 + i * 0.2e0 END) AS xs1, transform(slice(embedding, 33, 32), (e, i) -> CASE WHEN i >= 25 AND vec_id % 4 = 1 THEN -1e6 ELSE 100 + abs(CAST(e AS double)) * 10 + i * 0.2e0 END) AS xs2
        FROM {embeddings}""",
        """
        SELECT vec_id AS xs_key, vec_id % (SELECT count(*) FROM {supplier}) AS site_id,
               CAST(floor(vec_id / (SELECT count(*) FROM {supplier})) AS bigint) % 5 AS xs_index,
               CAST(1 + label % 5 AS double) AS dx, (vec_id % 40) / 1000.0e0 AS slope,
               112.0e0 - 2.2e0 * (CAST(floor(vec_id / (SELECT count(*) FROM {supplier})) AS bigint) % 5) + (vec_id % 10) / 10.0e0 AS wse,
               0.2e0 + (vec_id % 50) / 100.0e0 AS depth_a, 0.3e0 + (vec_id % 30) / 100.0e0 AS depth_b,
               list_transform(embedding[1:32], lambda e, i: CASE WHEN i - 1 >= 29 AND vec_id % 3 = 1 THEN -1e6 ELSE 100 + abs(CAST(e AS double)) * 10 + (i - 1) * 0.2e0 END) AS xs1, list_transform(embedding[33:64], lambda e, i: CASE WHEN i - 1 >= 25 AND vec_id % 4 = 1 THEN -1e6 ELSE 100 + abs(CAST(e AS double)) * 10 + (i - 1) * 0.2e0 END) AS xs2
        FROM {embeddings}""",
    ),
    "profile_text": (
        """
        SELECT vec_id AS xs_key,
               CASE vec_id % 4 WHEN 0 THEN concat('[', array_join(transform(embedding, e -> CAST(CAST(e * 1000 AS int) AS string)), ', '), ']')
                               WHEN 1 THEN concat(' [', array_join(transform(embedding, e -> CAST(CAST(e * 1000 AS int) AS string)), '  '), '] ')
                               WHEN 2 THEN concat('[', CAST(CAST(embedding[0] * 1000 AS int) AS string), ']')
                               ELSE CAST(CAST(embedding[0] * 1000 AS int) AS string) END AS profile
        FROM {embeddings}""",
        """
        SELECT vec_id AS xs_key,
               CASE vec_id % 4 WHEN 0 THEN concat('[', array_to_string(list_transform(embedding, lambda e: CAST(CAST(trunc(e * 1000) AS int) AS varchar)), ', '), ']')
                               WHEN 1 THEN concat(' [', array_to_string(list_transform(embedding, lambda e: CAST(CAST(trunc(e * 1000) AS int) AS varchar)), '  '), '] ')
                               WHEN 2 THEN concat('[', CAST(CAST(trunc(embedding[1] * 1000) AS int) AS varchar), ']')
                               ELSE CAST(CAST(trunc(embedding[1] * 1000) AS int) AS varchar) END AS profile
        FROM {embeddings}""",
    ),
    "reaches": """
        SELECT p_partkey + 1 AS linkno,
               CASE WHEN p_partkey = 0 THEN -1 ELSE CAST(floor((p_partkey + 1) / 2) AS bigint) END AS dslinkno,
               p_retailprice AS length_m, p_size AS strm_order,
               1000000 + p_partkey AS hydroseq, 999999 + p_partkey AS dnhydroseq,
               concat('0', CAST(100 + p_partkey % 25 AS string)) AS huc4
        FROM {part}""",
    "reach_vertices": (
        """
        SELECT p_partkey + 1 AS linkno, i AS seq,
               -120 + ((p_partkey % (SELECT count(*) FROM {supplier})) * 53 % 4500) / 100.0e0 + 0.001e0 * (p_partkey % 7 - 3) + 0.002e0 * i AS x,
               30 + ((p_partkey % (SELECT count(*) FROM {supplier})) * 37 % 1500) / 100.0e0 + 0.0005e0 * (p_partkey % 11 - 5) + 0.001e0 * (i % 2) AS y
        FROM {part} LATERAL VIEW explode(array(0, 1, 2, 3)) v AS i""",
        """
        SELECT p_partkey + 1 AS linkno, i AS seq,
               -120 + ((p_partkey % (SELECT count(*) FROM {supplier})) * 53 % 4500) / 100.0e0 + 0.001e0 * (p_partkey % 7 - 3) + 0.002e0 * i AS x,
               30 + ((p_partkey % (SELECT count(*) FROM {supplier})) * 37 % 1500) / 100.0e0 + 0.0005e0 * (p_partkey % 11 - 5) + 0.001e0 * (i % 2) AS y
        FROM {part}, (VALUES (0), (1), (2), (3)) AS v(i)""",
    ),
    # Up to 24 parts a site, named out of order and some drawn backwards; gaps, and for some sites loops and forks.
    "line_parts": (
        """
        SELECT site_id, (j * 11 + site_id) % 24 AS part, i AS seq,
               -120 + (site_id * 53 % 4500) / 100.0e0 + 0.002e0 * (CASE WHEN i = 1 THEN j + 0.5e0 WHEN (i = 0) = turned THEN CASE WHEN site_id % 5 = 0 AND j = 7 THEN 4 WHEN site_id % 5 = 1 AND j = 23 THEN 20 ELSE j + 1 END ELSE j END) AS x,
               30 + (site_id * 37 % 1500) / 100.0e0 + 0.0007e0 * (CASE WHEN i = 1 THEN 1 + j % 3 WHEN (i = 0) = turned THEN CASE WHEN site_id % 5 = 0 AND j = 7 THEN 4 WHEN site_id % 5 = 1 AND j = 23 THEN 20 ELSE j + 1 END ELSE j END % 2) AS y
        FROM (SELECT DISTINCT l_suppkey AS site_id, l_partkey % 24 AS j, (l_partkey % 24 * 3 + l_suppkey) % 4 = 0 AS turned FROM {lineitem} WHERE (l_suppkey * 5 + l_partkey % 24 * 7) % 11 <> 0) p LATERAL VIEW explode(array(0, 1, 2)) v AS i""",
        """
        SELECT site_id, (j * 11 + site_id) % 24 AS part, i AS seq,
               -120 + (site_id * 53 % 4500) / 100.0e0 + 0.002e0 * (CASE WHEN i = 1 THEN j + 0.5e0 WHEN (i = 0) = turned THEN CASE WHEN site_id % 5 = 0 AND j = 7 THEN 4 WHEN site_id % 5 = 1 AND j = 23 THEN 20 ELSE j + 1 END ELSE j END) AS x,
               30 + (site_id * 37 % 1500) / 100.0e0 + 0.0007e0 * (CASE WHEN i = 1 THEN 1 + j % 3 WHEN (i = 0) = turned THEN CASE WHEN site_id % 5 = 0 AND j = 7 THEN 4 WHEN site_id % 5 = 1 AND j = 23 THEN 20 ELSE j + 1 END ELSE j END % 2) AS y
        FROM (SELECT DISTINCT l_suppkey AS site_id, l_partkey % 24 AS j, (l_partkey % 24 * 3 + l_suppkey) % 4 = 0 AS turned FROM {lineitem} WHERE (l_suppkey * 5 + l_partkey % 24 * 7) % 11 <> 0) p, (VALUES (0), (1), (2)) AS v(i)""",
    ),
    "crosswalk": "SELECT DISTINCT l_suppkey AS nhdplusid, 700000000 + l_partkey % 25 AS linkno FROM {lineitem}",
    "regions": """
        SELECT n_nationkey AS vpu, -121e0 + 9.2e0 * (n_nationkey % 5) AS x0, 29e0 + 3.4e0 * floor(n_nationkey / 5) AS y0,
               -121e0 + 9.2e0 * (n_nationkey % 5) + 9.2e0 AS x1, 29e0 + 3.4e0 * floor(n_nationkey / 5) + 3.4e0 AS y1
        FROM {nation}""",
    "gauges": """
        SELECT c_custkey AS gauge_no, CASE WHEN c_custkey % 10 = 9 THEN concat('999', CAST(10000000 + c_custkey AS string))
                                           ELSE CAST(10000000 + c_custkey AS string) END AS site_no,
               30 + (c_custkey * 37 % 1500) / 100.0e0 + (c_custkey % 13 - 6) * 0.006e0 AS dec_lat_va,
               -120 + (c_custkey * 53 % 4500) / 100.0e0 + (c_custkey % 17 - 8) * 0.006e0 AS dec_long_va,
               CAST(10010000 + c_custkey % 8999 AS string) AS huc_cd
        FROM {customer}""",
    "scan_dates": """
        SELECT l_suppkey AS reach_id, CASE WHEN l_suppkey % 5 = 0 THEN DATE '2011-09-14' ELSE max(CAST(l_shipdate AS date)) END AS scan_date
        FROM {lineitem} WHERE l_returnflag = 'A' AND l_suppkey % 11 <> 3 GROUP BY l_suppkey""",
    "return_periods": """
        SELECT l_suppkey AS comid, CAST(CASE l_linenumber % 7 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 10 WHEN 4 THEN 25 WHEN 5 THEN 50 WHEN 6 THEN 100 ELSE 500 END AS int) AS return_period,
               max(l_extendedprice) / 1000 AS flow
        FROM {lineitem} WHERE l_suppkey % 8 <> l_linenumber
        GROUP BY l_suppkey, CAST(CASE l_linenumber % 7 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 10 WHEN 4 THEN 25 WHEN 5 THEN 50 WHEN 6 THEN 100 ELSE 500 END AS int)""",
    "results": """
        SELECT l_suppkey AS site_id, CAST(l_shipdate AS date) AS date, 1 + l_partkey % 4 AS xs_index,
               CASE WHEN l_orderkey % 2 = 0 THEN 'NHD' ELSE 'TDX' END AS flowline,
               CASE WHEN l_linenumber % 2 = 0 THEN 'NWM' ELSE 'GEO' END AS streamflow,
               max(l_quantity) / 10 AS y_2, max(l_extendedprice) / 15000 AS y_t, max(l_quantity) / 10 + max(abs(l_tax)) * 20 AS y_flip,
               CASE WHEN max(l_extendedprice) / 15000 < max(l_quantity) / 10 THEN 'A'
                    WHEN max(l_extendedprice) / 15000 = max(l_quantity) / 10 THEN 'B'
                    WHEN max(l_extendedprice) / 15000 < max(l_quantity) / 10 + max(abs(l_tax)) * 20 THEN 'C'
                    ELSE 'D' END AS jump_type
        FROM {lineitem}
        GROUP BY l_suppkey, CAST(l_shipdate AS date), 1 + l_partkey % 4,
                 CASE WHEN l_orderkey % 2 = 0 THEN 'NHD' ELSE 'TDX' END, CASE WHEN l_linenumber % 2 = 0 THEN 'NWM' ELSE 'GEO' END""",
    "xsections": """
        SELECT p_partkey % (SELECT count(*) FROM {supplier}) AS site_id,
               CAST(floor(p_partkey / (SELECT count(*) FROM {supplier})) AS bigint) % 5 AS xs_index,
               CASE WHEN CAST(floor(p_partkey / (SELECT count(*) FROM {supplier})) AS bigint) % 2 = 0 THEN 'NHD' ELSE 'TDX' END AS flowline,
               CASE WHEN CAST(floor(p_partkey / (SELECT count(*) FROM {supplier})) AS bigint) % 3 = 0 THEN 'NWM' ELSE 'GEO' END AS streamflow,
               p_size / 100.0e0 AS slope,
               CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE 0.1e0 + (p_retailprice - 900) / 1.4e0 END AS p_height,
               1 + (p_partkey * 7 % 90) * 1.0e0 AS qmin, 20 + (p_partkey * 11 % 400) * 1.0e0 AS qmax,
               CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE 40 + (p_partkey * 7919 % 600) / 10.0e0 END AS prob_min,
               CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE (p_partkey * 104729 % 550) / 10.0e0 END AS prob_max
        FROM {part}""",
    "cells": """
        SELECT p_partkey AS cell_id, p_partkey % (SELECT count(*) FROM {supplier}) AS site_id, 1 + p_partkey % 40 AS comid,
               (p_partkey * 7) % 97 AS row_, (p_partkey * 13) % 89 AS col_, p_retailprice AS elev, p_size / 100.0e0 AS slope
        FROM {part}""",
    "stage_cells": """
        SELECT l_orderkey * 8 + l_linenumber AS stage_id, l_suppkey AS site_id, 1 + l_partkey % 40 AS comid,
               (l_partkey * 7 + l_orderkey % 6 - 3) % 97 AS row_, (l_partkey * 13 + l_linenumber % 6 - 3) % 89 AS col_,
               l_quantity AS wse
        FROM {lineitem}""",
    "rating": (
        """
        SELECT vec_id AS xs_key, 100 + (vec_id % 20) / 10.0e0 AS bed, i AS k,
               CASE WHEN (vec_id + i) % 23 = 0 THEN NULL ELSE abs(CAST(embedding[i - 1] AS double)) * 500 END AS q,
               99 + abs(CAST(embedding[29 + i] AS double)) * 20 AS wse
        FROM {embeddings} LATERAL VIEW explode(sequence(1, 30)) s AS i""",
        """
        SELECT vec_id AS xs_key, 100 + (vec_id % 20) / 10.0e0 AS bed, i AS k,
               CASE WHEN (vec_id + i) % 23 = 0 THEN NULL ELSE abs(CAST(embedding[i] AS double)) * 500 END AS q,
               99 + abs(CAST(embedding[30 + i] AS double)) * 20 AS wse
        FROM {embeddings}, unnest(range(1, 31)) AS s(i)""",
    ),
    "channel_geometry": """
        SELECT p_partkey AS feature_id,
               CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 0.0e0 ELSE p_size / 777.0e0 END AS owp_roughness_bathy,
               CASE WHEN p_size % 3 = 0 THEN -1.0e0 ELSE p_size / 555.0e0 END AS owp_roughness_no_bathy
        FROM {part}""",
    "run_log": """
        SELECT c_custkey AS site_id, CASE WHEN c_custkey % 3 = 0 THEN 'ok' ELSE 'failed' END AS outcome, concat('code ', CAST(c_custkey % 5 AS string)) AS message
        FROM {customer}""",
}

_REF = re.compile(r"\{(\w+)\}")


class Tables:
    """Driver tables and bindings as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.spark.read.parquet(f"{self.root}/{name}.parquet")
        text = SQL[name]
        text = text[0] if isinstance(text, tuple) else text
        return self.spark.sql(text, **{ref: getattr(self, ref) for ref in set(_REF.findall(text))})


def check_sql(query: str) -> str:
    """Expand ``{name}`` references of a checking query into common table expressions."""
    parts: dict[str, str] = {}

    def need(text: str) -> None:
        for ref in dict.fromkeys(_REF.findall(text)):
            if ref not in DRIVER_TABLES and ref not in parts:
                body = SQL[ref]
                body = body[1] if isinstance(body, tuple) else body
                need(body)
                parts[ref] = _REF.sub(r"\1", body).strip()

    need(query)
    body = _REF.sub(r"\1", query).strip()
    if not parts:
        return body
    ctes = ",\n".join(f"{k} AS ({v})" for k, v in parts.items())
    recursive = "RECURSIVE " if body[:15].upper().startswith("WITH RECURSIVE") else ""
    if body[:5].upper() == "WITH ":
        rest = body[15:] if recursive else body[5:]
        return f"WITH {recursive}{ctes},\n{rest.strip()}"
    return f"WITH {ctes}\n{body}"
