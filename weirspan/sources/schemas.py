"""Schemas of the project tables."""

from __future__ import annotations

from pyspark.sql import types as T

TYPES = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType()}


def schema(text: str) -> T.StructType:
    """Schema from ``name TYPE, ...``; unlike the DDL parser this needs no session."""
    return T.StructType([T.StructField(n, TYPES[t]) for n, t in (f.split() for f in text.split(","))])


SITES = schema(
    "site_id BIGINT, name STRING, comments STRING, latitude DOUBLE, longitude DOUBLE, weir_length DOUBLE, reach_id BIGINT, linkno BIGINT, "
    "p_known DOUBLE, lidar_date DATE, baseflow_nwm DOUBLE, baseflow_geo DOUBLE, flowline_source STRING, streamflow_source STRING, "
    "arc_flowline_source STRING, arc_streamflow_source STRING, baseflow_method STRING, ep_value DOUBLE, manning_n_mode STRING, "
    "manning_n_value DOUBLE, arc_run_date TIMESTAMP, arc_run_status STRING"
)
INCIDENTS = schema("site_id BIGINT, date DATE, flow_nwm DOUBLE, flow_geo DOUBLE")
XSECTIONS = schema(
    "site_id BIGINT, xs_index INT, slope DOUBLE, p_height DOUBLE, qmin DOUBLE, qmax DOUBLE, depth_a DOUBLE, depth_b DOUBLE, vel_a DOUBLE, "
    "vel_b DOUBLE, tw_a DOUBLE, tw_b DOUBLE, prob_min DOUBLE, prob_max DOUBLE, flowline STRING, streamflow STRING"
)
RESULTS = schema(
    "site_id BIGINT, date DATE, xs_index INT, y_t DOUBLE, y_flip DOUBLE, y_2 DOUBLE, jump_type STRING, y_1 DOUBLE, fr_1 DOUBLE, m1 DOUBLE, "
    "m2 DOUBLE, flowline STRING, streamflow STRING"
)
FLOW_OBS = schema("reach_id BIGINT, ts TIMESTAMP, streamflow DOUBLE")
FLOW_DAILY = schema("reach_id BIGINT, date DATE, streamflow DOUBLE")

PROJECT = {"sites": SITES, "incidents": INCIDENTS, "xsections": XSECTIONS, "results": RESULTS}
# Tables kept once per pair of sources.
PAIRED = ("xsections", "results")
PAIR = ["flowline", "streamflow"]
# Hydraulic columns whose missing values other tools expect as a marker.
SENTINEL = -9999.0
