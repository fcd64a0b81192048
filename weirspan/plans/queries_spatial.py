"""Spatial, network and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirspan.functions import geo
from weirspan.operators import chains, near, network
from weirspan.plans import site_geometry
from weirspan.plans.catalog import query
from weirspan.plans.common import chain, r, rd, rounded
from weirspan.session import merged
from weirspan.sources import lines
from weirspan.streaming import flow_stream

E2S, E1S, AX = "0.006694380022903416e0", "0.08181919104283185e0", "6378137.0e0"


def albers_sql(lat: str, lon: str) -> tuple[str, str]:
    """Projected x and y of the equal-area projection, from its published closed form."""

    def m2(d: str) -> str:
        return f"power(cos(radians({d})), 2) / (1 - {E2S} * power(sin(radians({d})), 2))"

    def q(d: str) -> str:
        s = f"sin(radians({d}))"
        return f"((1 - {E2S}) * ({s} / (1 - {E2S} * {s} * {s}) - ln((1 - {E1S} * {s}) / (1 + {E1S} * {s})) / (2 * {E1S})))"

    n = f"(({m2('29.5e0')} - {m2('45.5e0')}) / ({q('45.5e0')} - {q('29.5e0')}))"
    c = f"({m2('29.5e0')} + {n} * {q('29.5e0')})"
    rho = f"({AX} * sqrt({c} - {n} * {q(lat)}) / {n})"
    return f"({rho} * sin({n} * radians({lon} + 96e0)))", f"({AX} * sqrt({c} - {n} * {q('23e0')}) / {n} - {rho} * cos({n} * radians({lon} + 96e0)))"


def hav(lat1, lon1, lat2, lon2):
    return f"2 * 6371e0 * asin(sqrt(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)))"


def seg_dist(px, py, x1, y1, x2, y2):
    f = f"greatest(0e0, least(1e0, (({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1})) / (power({x2} - {x1}, 2) + power({y2} - {y1}, 2))))"
    return f"sqrt(power({px} - ({x1} + {f} * ({x2} - {x1})), 2) + power({py} - ({y1} + {f} * ({y2} - {y1})), 2))"


SEGS = "segs AS (SELECT a.linkno, a.seq, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM {reach_vertices} a JOIN {reach_vertices} b ON a.linkno = b.linkno AND b.seq = a.seq + 1)"
_ax, _ay = albers_sql("y", "x")
_px, _py = albers_sql("latitude", "longitude")
# A segment meets the box of 500 m to each side when their extents meet and not all corners lie on one side of its line.
_corner = [f"(x2 - x1) * (py {b} - y1) - (y2 - y1) * (px {a} - x1)" for a in ("- 500e0", "+ 500e0") for b in ("- 500e0", "+ 500e0")]
NEAR_BOX = f"""flat AS (SELECT linkno, seq, {_ax} AS x, {_ay} AS y FROM {{reach_vertices}}),
  fseg AS (SELECT a.linkno, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM flat a JOIN flat b ON a.linkno = b.linkno AND b.seq = a.seq + 1),
  placed0 AS (SELECT site_id, latitude, longitude, {_px} AS px, {_py} AS py FROM {{sites}}),
  prs AS (SELECT DISTINCT p.site_id, p.latitude, p.longitude, p.px, p.py, f.linkno FROM placed0 p JOIN fseg f
     ON least(x1, x2) <= px + 500e0 AND greatest(x1, x2) >= px - 500e0 AND least(y1, y2) <= py + 500e0 AND greatest(y1, y2) >= py - 500e0
     WHERE least({", ".join(_corner)}) <= 0 AND greatest({", ".join(_corner)}) >= 0)"""
PRIORITY = f"""{NEAR_BOX},
  dd AS (SELECT p.site_id, p.linkno, min({seg_dist('px', 'py', 'x1', 'y1', 'x2', 'y2')}) AS dist FROM prs p JOIN fseg f ON p.linkno = f.linkno GROUP BY 1, 2),
  top AS (SELECT d.site_id, arg_min(struct_pack(linkno := d.linkno, strm_order := r.strm_order, dist := d.dist), struct_pack(o := -r.strm_order, d := d.dist, l := d.linkno)) AS b FROM dd d JOIN {{reaches}} r ON r.linkno = d.linkno GROUP BY 1)"""
GAUGE = f"""gnear AS (SELECT s.site_id, min({hav('s.latitude', 's.longitude', 'g.dec_lat_va', 'g.dec_long_va')}) AS km,
  arg_min(struct_pack(site_no := g.site_no, huc4 := left(g.huc_cd, 4)), struct_pack(d := {hav('s.latitude', 's.longitude', 'g.dec_lat_va', 'g.dec_long_va')}, n := g.site_no)) AS g
  FROM {{sites}} s JOIN {{gauges}} g ON abs(s.latitude - g.dec_lat_va) <= 0.1e0 AND abs(s.longitude - g.dec_long_va) <= 0.1e0 WHERE length(g.site_no) <= 8 GROUP BY 1)"""
REGION = "reg AS (SELECT s.site_id, min(g.vpu) AS vpu FROM {sites} s JOIN {regions} g ON s.longitude > g.x0 AND s.longitude < g.x1 AND s.latitude > g.y0 AND s.latitude < g.y1 GROUP BY 1)"


def regions(t):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return t.regions.select("vpu", F.array(F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))).alias("rings"))


@query("F23_great_circle_distance", f"SELECT site_id, {rd(hav('latitude', 'longitude', '40e0', '-100e0'))} AS km FROM {{sites}}")
def _(t):
    return t.sites.select("site_id", r(geo.haversine(F.col("latitude"), F.col("longitude"), F.lit(40.0), F.lit(-100.0))).alias("km"))


@query("P29_box_around_point", f"SELECT site_id, {rd('longitude - 2e0 / 111 / cos(radians(latitude))')} AS xmin, {rd('latitude - 2e0 / 111')} AS ymin, {rd('longitude + 2e0 / 111 / cos(radians(latitude))')} AS xmax, {rd('latitude + 2e0 / 111')} AS ymax FROM {{sites}}")
def _(t):
    b = geo.box(F.col("latitude"), F.col("longitude"), 2.0)
    return t.sites.select("site_id", *[r(v).alias(k) for k, v in b.items()])


@query("F30_grid_cells", f"SELECT linkno, seq, CAST(trunc((47e0 - y) / 0.001e0) AS bigint) AS row_, CAST(trunc((x + 121e0) / 0.0013e0) AS bigint) AS col_, {rd('-121e0 + (trunc((x + 121e0) / 0.0013e0) + 0.5e0) * 0.0013e0')} AS cx, {rd('47e0 - (trunc((47e0 - y) / 0.001e0) + 0.5e0) * 0.001e0')} AS cy FROM {{reach_vertices}}")
def _(t):
    grid = [F.lit(v) for v in (-121.0, 47.0, 0.0013, 0.001)]
    row, col = geo.grid_cell(F.col("x"), F.col("y"), *grid)
    out = t.reach_vertices.withColumns({"row_": row, "col_": col})
    cx, cy = geo.cell_centre(F.col("row_"), F.col("col_"), *grid)
    return out.select("linkno", "seq", F.col("row_").cast("bigint").alias("row_"), F.col("col_").cast("bigint").alias("col_"), r(cx).alias("cx"), r(cy).alias("cy"))


@query("F31_albers_projection", f"SELECT site_id, {rd(_px, 4)} AS x, {rd(_py, 4)} AS y FROM {{sites}}")
def _(t):
    x, y = geo.albers(F.col("latitude"), F.col("longitude"))
    return t.sites.select("site_id", r(x, 4).alias("x"), r(y, 4).alias("y"))


@query("F31_web_mercator", f"SELECT site_id, {rd(f'{AX} * radians(longitude)', 4)} AS x, {rd(f'{AX} * ln(tan(pi() / 4 + radians(latitude) / 2))', 4)} AS y, {rd('latitude', 8)} AS lat, {rd('longitude', 8)} AS lon FROM {{sites}}")
def _(t):
    x, y = geo.web_mercator(F.col("latitude"), F.col("longitude"))
    rows = t.sites.select("site_id", x.alias("x"), y.alias("y"))
    lat, lon = geo.web_mercator_inverse(F.col("x"), F.col("y"))
    return rows.select("site_id", r("x", 4).alias("x"), r("y", 4).alias("y"), r(lat, 8).alias("lat"), r(lon, 8).alias("lon"))


UTM = [
    "CAST(floor((longitude + 180) / 6) AS int) + 1 AS zone, radians(latitude) AS f, 0.006694380022903416e0 AS e, 0.006694380022903416e0 / (1 - 0.006694380022903416e0) AS ep",
    f"{AX} / sqrt(1 - e * power(sin(f), 2)) AS n, power(tan(f), 2) AS t, ep * power(cos(f), 2) AS c, cos(f) * radians(longitude - (zone * 6 - 183)) AS a, "
    f"{AX} * ((1 - e / 4 - 3 * e * e / 64 - 5 * e * e * e / 256) * f - (3 * e / 8 + 3 * e * e / 32 + 45 * e * e * e / 1024) * sin(2 * f) + (15 * e * e / 256 + 45 * e * e * e / 1024) * sin(4 * f) - 35 * e * e * e / 3072 * sin(6 * f)) AS m",
    "500000 + 0.9996e0 * n * (a + (1 - t + c) * power(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * power(a, 5) / 120) AS x, "
    "0.9996e0 * (m + n * tan(f) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * power(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * power(a, 6) / 720)) AS y",
]


@query("F31_utm_projection", f"SELECT site_id, zone, {rd('x', 4)} AS x, {rd('y', 4)} AS y FROM ({chain('SELECT site_id, latitude, longitude FROM {sites}', UTM)})")
def _(t):
    x, y = geo.utm(F.col("latitude"), F.col("longitude"))
    return t.sites.select("site_id", geo.utm_zone(F.col("longitude")).alias("zone"), r(x, 4).alias("x"), r(y, 4).alias("y"))


ALBERS_BACK = [
    f"{E2S} AS e, {E1S} AS e1, {AX} AS ax, sin(radians(29.5e0)) AS s1, sin(radians(45.5e0)) AS s2, sin(radians(23e0)) AS s0",
    ", ".join(f"(1 - e) * ({v} / (1 - e * {v} * {v}) - ln((1 - e1 * {v}) / (1 + e1 * {v})) / (2 * e1)) AS q{v[1]}" for v in ("s1", "s2", "s0")) + ", 1 - (1 - e) / (2 * e1) * ln((1 - e1) / (1 + e1)) AS qp",
    "((1 - s1 * s1) / (1 - e * s1 * s1) - (1 - s2 * s2) / (1 - e * s2 * s2)) / (q2 - q1) AS n",
    "(1 - s1 * s1) / (1 - e * s1 * s1) + n * q1 AS c",
    "ax * sqrt(c - n * q0) / n - y AS down",
    "(c - (x * x + down * down) * n * n / (ax * ax)) / n AS q",
    "asin(greatest(-1e0, least(1e0, q / qp))) AS b",
    "b + (e / 3 + 31 * e * e / 180 + 517 * e * e * e / 5040) * sin(2 * b) + (23 * e * e / 360 + 251 * e * e * e / 3780) * sin(4 * b) + 761 * e * e * e / 45360 * sin(6 * b) AS f",
    "1 - e * sin(f) * sin(f) AS w",
    "degrees(f + w * w / (2 * cos(f)) * (q / (1 - e) - sin(f) / w + ln((1 - e1 * sin(f)) / (1 + e1 * sin(f))) / (2 * e1))) AS lat, -96 + degrees(atan2(x, down)) / n AS lon",
]


@query("F31_albers_inverse", f"SELECT linkno, seq, {rd('lat', 8)} AS lat, {rd('lon', 8)} AS lon FROM ({chain(f'SELECT linkno, seq, {_ax} AS x, {_ay} AS y FROM {{reach_vertices}}', ALBERS_BACK)})")
def _(t):
    x, y = geo.albers(F.col("y"), F.col("x"))
    lat, lon = geo.albers_inverse(F.col("x"), F.col("y"))
    return t.reach_vertices.select("linkno", "seq", x.alias("x"), y.alias("y")).select("linkno", "seq", r(lat, 8).alias("lat"), r(lon, 8).alias("lon"))


UTM_BACK = [
    "(1 - sqrt(1 - e)) / (1 + sqrt(1 - e)) AS k, y / 0.9996e0 / (6378137.0e0 * (1 - e / 4 - 3 * e * e / 64 - 5 * e * e * e / 256)) AS mu",
    "mu + (3 * k / 2 - 27 * power(k, 3) / 32) * sin(2 * mu) + (21 * k * k / 16 - 55 * power(k, 4) / 32) * sin(4 * mu) + 151 * power(k, 3) / 96 * sin(6 * mu) + 1097 * power(k, 4) / 512 * sin(8 * mu) AS g",
    f"power(tan(g), 2) AS t1, ep * power(cos(g), 2) AS c1, {AX} / sqrt(1 - e * power(sin(g), 2)) AS n1, {AX} * (1 - e) / power(1 - e * power(sin(g), 2), 1.5) AS r1",
    "(x - 500000) / (0.9996e0 * n1) AS d",
    "degrees(g - n1 * tan(g) / r1 * (d * d / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * ep) * power(d, 4) / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * ep - 3 * c1 * c1) * power(d, 6) / 720)) AS lat, "
    "zone * 6 - 183 + degrees((d - (1 + 2 * t1 + c1) * power(d, 3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * ep + 24 * t1 * t1) * power(d, 5) / 120) / cos(g)) AS lon",
]


@query("F31_utm_inverse", f"SELECT linkno, seq, zone, {rd('lat', 8)} AS lat, {rd('lon', 8)} AS lon FROM ({chain('SELECT linkno, seq, x AS longitude, y AS latitude FROM {reach_vertices}', UTM + UTM_BACK)})")
def _(t):
    x, y = geo.utm(F.col("y"), F.col("x"))
    flat = t.reach_vertices.select("linkno", "seq", geo.utm_zone(F.col("x")).alias("zone"), x.alias("x"), y.alias("y"))
    lat, lon = geo.utm_inverse(F.col("x"), F.col("y"), F.col("zone"))
    return flat.select("linkno", "seq", "zone", r(lat, 8).alias("lat"), r(lon, 8).alias("lon"))


@query("F32_point_line_distance", f"WITH {PRIORITY} SELECT site_id, linkno, {rd('dist', 4)} AS dist FROM dd")
def _(t):
    return rounded(near.point_line_distance(near.reaches_in_box(t.sites, t.reach_vertices), t.reach_vertices), "dist", places=4)


@query("S10_reaches_in_box", f"WITH {NEAR_BOX} SELECT site_id, linkno FROM prs")
def _(t):
    return near.reaches_in_box(t.sites, t.reach_vertices).select("site_id", "linkno")


AREA = (-112.0, 33.0, -95.0, 41.0)
_area_corner = [f"(x2 - x1) * ({y}e0 - y1) - (y2 - y1) * ({x}e0 - x1)" for x in AREA[::2] for y in AREA[1::2]]


@query(
    "S10_box_scan_by_curve",
    f"""WITH {SEGS}, hit AS (SELECT DISTINCT linkno FROM segs WHERE least(x1, x2) <= {AREA[2]}e0 AND greatest(x1, x2) >= {AREA[0]}e0 AND least(y1, y2) <= {AREA[3]}e0 AND greatest(y1, y2) >= {AREA[1]}e0
          AND least({", ".join(_area_corner)}) <= 0 AND greatest({", ".join(_area_corner)}) >= 0)
        SELECT linkno, {rd('min(x)')} AS xmin, {rd('min(y)')} AS ymin, {rd('max(x)')} AS xmax, {rd('max(y)')} AS ymax, CAST(count(*) AS int) AS n_points FROM {{reach_vertices}} JOIN hit USING (linkno) GROUP BY linkno""",
)
def _(t):
    path = flow_stream.scratch_table(t.spark, "lines")
    lines.write_lines(t.reach_vertices, path)
    found = lines.read_box(t.spark, path, AREA)
    return rounded(found.select("linkno", "xmin", "ymin", "xmax", "ymax", F.size("points").alias("n_points")), "xmin", "ymin", "xmax", "ymax")


@query("J11_tolerance_join", f"""WITH pairs AS (SELECT c.cell_id, s.wse, s.stage_id, abs(c.row_ - s.row_) + abs(c.col_ - s.col_) AS d FROM {{cells}} c JOIN {{stage_cells}} s
       ON c.comid = s.comid AND abs(c.row_ - s.row_) <= 2 AND abs(c.col_ - s.col_) <= 2),
       best AS (SELECT cell_id, arg_min(struct_pack(w := wse, i := stage_id), struct_pack(d := d, i := stage_id)) AS b FROM pairs GROUP BY 1)
       SELECT c.cell_id, {rd('c.elev')} AS elev, {rd('b.b.w')} AS wse, CAST(coalesce(b.b.i, -1) AS bigint) AS stage_id FROM {{cells}} c LEFT JOIN best b ON c.cell_id = b.cell_id""")
def _(t):
    right = t.stage_cells.select("comid", "row_", "col_", "wse", F.col("stage_id").alias("ord"))
    out = near.tolerance_join(t.cells, right)
    return rounded(out.select("cell_id", "elev", "wse", F.coalesce("ord", F.lit(-1)).alias("stage_id")), "elev", "wse")


@query("J11_tolerance_join_compat", f"""WITH hit AS (SELECT DISTINCT c.cell_id FROM {{cells}} c JOIN {{stage_cells}} s ON c.comid = s.comid AND abs(c.row_ - s.row_) <= 2 AND abs(c.col_ - s.col_) <= 2),
       best AS (SELECT c.cell_id, arg_min(s.stage_id, struct_pack(d := abs(c.row_ - s.row_) + abs(c.col_ - s.col_), i := s.stage_id)) AS i FROM {{cells}} c JOIN hit h ON h.cell_id = c.cell_id JOIN {{stage_cells}} s ON c.comid = s.comid GROUP BY 1)
       SELECT c.cell_id, CAST(coalesce(b.i, -1) AS bigint) AS stage_id FROM {{cells}} c LEFT JOIN best b ON c.cell_id = b.cell_id""")
def _(t):
    right = t.stage_cells.select("comid", "row_", "col_", F.col("stage_id").alias("ord"))
    return near.tolerance_join(t.cells, right, compat=True).select("cell_id", F.coalesce("ord", F.lit(-1)).alias("stage_id"))


@query("J13_nearest_cell", """SELECT c.cell_id, arg_min(s.stage_id, struct_pack(d := power(c.row_ - s.row_, 2) + power(c.col_ - s.col_, 2), i := s.stage_id)) AS stage_id
       FROM {cells} c JOIN {stage_cells} s ON c.site_id = s.site_id GROUP BY 1""")
def _(t):
    d = lambda c: F.col(c).cast("double")
    left = t.cells.select("cell_id", "site_id", d("row_").alias("x"), d("col_").alias("y"))
    right = t.stage_cells.select("site_id", d("row_").alias("x2"), d("col_").alias("y2"), "stage_id", F.col("stage_id").alias("ord"))
    return near.nearest_point(left, right, ["site_id"], 8.0).select("cell_id", "stage_id")


@query("J14_nearest_feature", f"""SELECT s.site_id, arg_min(v.linkno, struct_pack(d := round(sqrt(power(s.longitude - v.x, 2) + power(s.latitude - v.y, 2)), 9), i := v.linkno)) AS linkno, {rd('min(sqrt(power(s.longitude - v.x, 2) + power(s.latitude - v.y, 2)))')} AS dist
       FROM (SELECT site_id, longitude + 0.05e0 * (site_id % 7) AS longitude, latitude FROM {{sites}}) s, {{reach_vertices}} v GROUP BY 1""")
def _(t):
    left = t.sites.select("site_id", (F.col("longitude") + F.col("site_id") % 7 * 0.05).alias("x"), F.col("latitude").alias("y"))
    right = t.reach_vertices.select(F.col("x").alias("x2"), F.col("y").alias("y2"), "linkno", F.col("linkno").alias("ord"))
    # Nine decimals: positions that are equal on paper differ in the last bits.
    d = F.round(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")), 9)
    return near.nearest_point(left, right, [], 0.01, d).select("site_id", "linkno", r("dist").alias("dist"))


@query("J15_nearest_gauge", f"WITH {GAUGE} SELECT s.site_id, n.g.site_no AS site_no, n.g.huc4 AS huc4, {rd('n.km')} AS gauge_km FROM {{sites}} s LEFT JOIN gnear n ON n.site_id = s.site_id")
def _(t):
    return near.nearest_gauge(t.sites, t.gauges).select("site_id", "site_no", "huc4", r("gauge_km").alias("gauge_km"))


@query("J16_priority_nearest_reach", f"WITH {PRIORITY} SELECT s.site_id, CAST(coalesce(t.b.linkno, -1) AS bigint) AS linkno, {rd('t.b.dist', 4)} AS dist FROM {{sites}} s LEFT JOIN top t ON t.site_id = s.site_id")
def _(t):
    out = near.priority_nearest(t.sites.drop("linkno"), t.reaches, t.reach_vertices)
    return out.select("site_id", F.coalesce("linkno", F.lit(-1)).alias("linkno"), r("dist", 4).alias("dist"))


@query("J17_region_of_site", f"WITH {REGION} SELECT s.site_id, CAST(coalesce(reg.vpu, -1) AS bigint) AS vpu FROM {{sites}} s LEFT JOIN reg ON reg.site_id = s.site_id")
def _(t):
    return near.region_of(t.sites, regions(t)).select("site_id", F.coalesce("vpu", F.lit(-1)).cast("bigint").alias("vpu"))


@query("K3_reach_identification", f"""WITH {PRIORITY}, {GAUGE}, {REGION} SELECT s.site_id, n.g.huc4 AS huc4, CAST(coalesce(reg.vpu, -1) AS bigint) AS vpu, CAST(coalesce(t.b.linkno, -1) AS bigint) AS linkno, {rd('t.b.dist', 4)} AS dist
       FROM {{sites}} s LEFT JOIN top t ON t.site_id = s.site_id LEFT JOIN gnear n ON n.site_id = s.site_id LEFT JOIN reg ON reg.site_id = s.site_id""")
def _(t):
    out = site_geometry.identify_reaches(t.sites.drop("linkno"), t.gauges, regions(t), t.reaches, t.reach_vertices)
    return out.select("site_id", "huc4", F.coalesce("vpu", F.lit(-1)).cast("bigint").alias("vpu"), F.coalesce("linkno", F.lit(-1)).alias("linkno"), r("dist", 4).alias("dist"))


# --- nearest lines: the reaches of a site fall into two sources by their place in the table ---
N = "(SELECT count(*) FROM {supplier})"
LINES = f"""{SEGS}, two AS (SELECT *, (linkno - 1) % {N} AS site_id, CAST(floor((linkno - 1) / {N}) AS bigint) % 2 AS src FROM segs),
  lp AS (SELECT a.site_id, a.linkno AS left_id, b.linkno AS right_id, min(least({seg_dist('a.x1', 'a.y1', 'b.x1', 'b.y1', 'b.x2', 'b.y2')}, {seg_dist('a.x2', 'a.y2', 'b.x1', 'b.y1', 'b.x2', 'b.y2')},
     {seg_dist('b.x1', 'b.y1', 'a.x1', 'a.y1', 'a.x2', 'a.y2')}, {seg_dist('b.x2', 'b.y2', 'a.x1', 'a.y1', 'a.x2', 'a.y2')})
     * CASE WHEN sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) < 0
             AND sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) < 0 THEN 0 ELSE 1 END) AS dist
     FROM two a JOIN two b ON a.site_id = b.site_id AND a.src = 0 AND b.src = 1 GROUP BY 1, 2, 3),
  nl AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY site_id, left_id ORDER BY round(dist, 9)) AS k FROM lp) WHERE k = 1)"""


def nearest_lines(t):
    n = t.supplier.count()
    seg = near.line_segments(t.reach_vertices).withColumns({"site_id": (F.col("linkno") - 1) % n, "src": F.floor((F.col("linkno") - 1) / n) % 2})
    side = lambda k, name: seg.where(F.col("src") == k).select("site_id", F.col("linkno").alias(name), "x1", "y1", "x2", "y2")
    # Nine decimals of a degree: distances that are equal on paper differ in the last bits.
    return near.nearest_lines(side(0, "left_id"), side(1, "right_id"), ["site_id"], 0.005, places=9)


@query("J18_nearest_lines", f"WITH {LINES} SELECT site_id, left_id, min(right_id) AS first_right, {rd('min(dist)')} AS dist FROM nl GROUP BY 1, 2")
def _(t):
    out = nearest_lines(t).groupBy("site_id", "left_id").agg(F.min("right_id").alias("first_right"), F.min("dist").alias("dist"))
    return rounded(out, "dist")


@query("J19_crosswalk_tdx_to_nhd", f"WITH {LINES} SELECT right_id AS linkno, min(left_id) AS nhdplusid FROM nl GROUP BY 1")
def _(t):
    order = t.reaches.select(F.col("linkno").alias("nhdplusid"), "hydroseq")
    return site_geometry.crosswalks(nearest_lines(t), order)[1].select("linkno", "nhdplusid")


@query("K4_crosswalk_and_rekey", f"WITH {LINES}, x AS (SELECT right_id AS linkno, min(left_id) AS nhd FROM nl GROUP BY 1) SELECT x.linkno AS comid, r.length_m AS qout_median FROM x JOIN {{reaches}} r ON r.linkno = x.nhd")
def _(t):
    order = t.reaches.select(F.col("linkno").alias("nhdplusid"), "hydroseq")
    stats = t.reaches.select(F.col("linkno").alias("comid"), F.col("length_m").alias("qout_median"))
    return site_geometry.rekeyed_both_ways(stats, nearest_lines(t), order).select("comid", "qout_median")


# --- network ---
@query("J29_main_stem", "SELECT dslinkno AS linkno, arg_max(linkno, struct_pack(o := strm_order, l := -linkno)) AS next FROM {reaches} WHERE dslinkno <> -1 GROUP BY 1")
def _(t):
    return network.main_upstream(t.reaches)


WALK = """WITH RECURSIVE main AS (SELECT dslinkno AS linkno, arg_max(linkno, struct_pack(o := strm_order, l := -linkno)) AS next FROM {reaches} WHERE dslinkno <> -1 GROUP BY 1),
  starts AS (SELECT DISTINCT l_partkey + 1 AS linkno FROM {lineitem}),
  w(start, linkno, direction, total) AS (SELECT s.linkno, s.linkno, d, r.length_m FROM starts s JOIN {reaches} r ON r.linkno = s.linkno, (VALUES ('up'), ('down')) AS v(d)
    UNION ALL SELECT w.start, n.linkno, w.direction, w.total + n.length_m FROM w JOIN {reaches} c ON c.linkno = w.linkno LEFT JOIN main m ON m.linkno = w.linkno
      JOIN {reaches} n ON n.linkno = CASE WHEN w.direction = 'up' THEN m.next ELSE c.dslinkno END
    WHERE w.total < CASE WHEN w.direction = 'up' THEN 3000e0 ELSE 5000e0 END)"""


def walked(t):
    return network.walk(t.lineitem.select((F.col("l_partkey") + 1).alias("linkno")), t.reaches, 3000.0, 5000.0)


@query("J28_network_walk", f"{WALK} SELECT DISTINCT start, linkno FROM w")
def _(t):
    return walked(t).select("start", "linkno").distinct()


@query("W11_walked_length", f"{WALK} SELECT start, linkno, direction, {rd('total')} AS total FROM w")
def _(t):
    return rounded(walked(t), "total")


@query("W5_stream_distance", f"""SELECT cell_id, {rd('sum(coalesce(gap, 0)) OVER (PARTITION BY site_id ORDER BY seq)')} AS distance FROM (SELECT cell_id, site_id, seq,
       sqrt(power(row_ - lag(row_) OVER (PARTITION BY site_id ORDER BY seq), 2) + power(col_ - lag(col_) OVER (PARTITION BY site_id ORDER BY seq), 2)) AS gap
       FROM (SELECT *, CAST(floor(cell_id / {N}) AS bigint) AS seq FROM {{cells}}))""")
def _(t):
    n = t.supplier.count()
    out = network.stream_distance(t.cells.withColumn("seq", F.floor(F.col("cell_id") / n)))
    return rounded(out.select("cell_id", "distance"), "distance")


NUMBERED = """SELECT cell_id, site_id, CASE WHEN arg_min(elev, struct_pack(r := row_, c := col_)) OVER (PARTITION BY site_id) < arg_max(elev, struct_pack(r := row_, c := col_)) OVER (PARTITION BY site_id)
       THEN max(k) OVER (PARTITION BY site_id) - k ELSE k END AS xs_no FROM (SELECT *, dense_rank() OVER (PARTITION BY site_id ORDER BY row_, col_) - 1 AS k FROM {cells})"""


@query("W6_direction_of_cells", f"SELECT cell_id, xs_no FROM ({NUMBERED})")
def _(t):
    return network.numbered_cells(t.cells).select("cell_id", "xs_no")


@query("W10_first_cell_of_site", f"SELECT site_id, min(cell_id) AS cell_id FROM ({NUMBERED}) WHERE xs_no = 0 GROUP BY 1")
def _(t):
    return network.numbered_cells(t.cells).where("xs_no = 0").groupBy("site_id").agg(F.min("cell_id").alias("cell_id"))


@query("O2_cells_in_order", "SELECT site_id, cell_id, row_, col_ FROM {cells} ORDER BY site_id, row_, col_")
def _(t):
    return t.cells.select("site_id", "cell_id", "row_", "col_").orderBy("site_id", "row_", "col_")


FRAC = "greatest(0e0, least(1e0, coalesce(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif(power(x2 - x1, 2) + power(y2 - y1, 2), 0), 0)))"
LEN = "sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))"
OFF = f"sqrt(power(px - (x1 + {FRAC} * (x2 - x1)), 2) + power(py - (y1 + {FRAC} * (y2 - y1)), 2))"


def measured_sql(vertices: str) -> str:
    """``ms``: segments of the lines ``vertices(linkno, seq, x, y)`` with their length and the length before."""
    return f"""lv AS ({vertices}), sg AS (SELECT a.linkno, a.seq, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM lv a JOIN lv b ON a.linkno = b.linkno AND b.seq = a.seq + 1),
  ms AS (SELECT *, {LEN} AS len, sum({LEN}) OVER (PARTITION BY linkno ORDER BY seq) - {LEN} AS pos FROM sg)"""


def position_sql(vertices: str, points: str) -> str:
    return f"""{measured_sql(vertices)}, pt AS ({points}),
  loc AS (SELECT p.linkno, any_value(p.step) AS step, arg_min(pos + {FRAC} * len, struct_pack(d := {OFF}, s := seq)) AS position FROM pt p JOIN ms ON p.linkno = ms.linkno GROUP BY 1)"""


def targets_sql(vertices: str, points: str) -> str:
    """``tp``: the five target points (label, order o, point p) of each line."""
    return f"""{position_sql(vertices, points)}, whole AS (SELECT linkno, sum(len) AS whole FROM ms GROUP BY 1),
  ask AS (SELECT a.linkno, label, o, greatest(0e0, least(w.whole, a.position + k * a.step)) AS s FROM loc a JOIN whole w ON w.linkno = a.linkno, (VALUES (-1, 'Upstream', 0), (1, 'Downstream1', 1), (2, 'Downstream2', 2), (3, 'Downstream3', 3), (4, 'Downstream4', 4)) AS v(k, label, o)),
  tp AS (SELECT a.linkno, a.label, a.o, arg_max(struct_pack(x := x1 + least(1e0, (s - pos) / len) * (x2 - x1), y := y1 + least(1e0, (s - pos) / len) * (y2 - y1)), seq) AS p FROM ask a JOIN ms ON ms.linkno = a.linkno AND ms.pos <= a.s GROUP BY 1, 2, 3)"""


VERTS = "SELECT linkno, seq, x, y FROM {reach_vertices}"
POINTS = "SELECT linkno, avg(x) + 0.0004e0 * (linkno % 5) AS px, avg(y) + 0.0003e0 AS py, 0.0011e0 AS step FROM {reach_vertices} GROUP BY 1"
MEASURED, POSITION, TARGETS = measured_sql(VERTS), position_sql(VERTS, POINTS), targets_sql(VERTS, POINTS)


def as_sites(t):
    line = t.reach_vertices.withColumnRenamed("linkno", "site_id")
    pts = line.groupBy("site_id").agg((F.avg("x") + F.col("site_id") % 5 * 0.0004).alias("px"), (F.avg("y") + 0.0003).alias("py"))
    return line, pts.withColumn("weir_length", F.lit(0.0011))


@query("W9_position_along_line", f"WITH {MEASURED} SELECT linkno, seq, {rd('pos', 9)} AS pos, {rd('len', 9)} AS len FROM ms")
def _(t):
    out = network.measured_segments(t.reach_vertices, "linkno")
    return rounded(out.select("linkno", "seq", "pos", "len"), "pos", "len", places=9)


@query("F33_position_of_point", f"WITH {POSITION} SELECT linkno, {rd('position', 9)} AS position FROM loc")
def _(t):
    line, pts = as_sites(t)
    out = network.position_on_line(pts, network.measured_segments(line))
    return out.select(F.col("site_id").alias("linkno"), r("position", 9).alias("position"))


@query("F38_target_points", f"WITH {TARGETS} SELECT linkno, label, {rd('p.x', 9)} AS x, {rd('p.y', 9)} AS y FROM tp")
def _(t):
    line, pts = as_sites(t)
    out = network.target_points(pts, network.measured_segments(line))
    return out.select(F.col("site_id").alias("linkno"), "label", r("x", 9).alias("x"), r("y", 9).alias("y"))


MID = "pts AS (SELECT p_partkey AS point_id, p_partkey + 1 AS linkno, v.x + 0.0001e0 * p_size AS x1, v.y AS y1, v.x AS x2, v.y + 0.00005e0 * p_size AS y2 FROM {part} JOIN {reach_vertices} v ON v.linkno = p_partkey + 1 AND v.seq = 1)"


def section_lines(t):
    v = t.reach_vertices.where("seq = 1").select("linkno", "x", "y")
    rows = t.part.select("p_partkey", "p_size", (F.col("p_partkey") + 1).alias("linkno")).join(merged(v), "linkno")
    return rows.select(
        F.col("linkno").alias("site_id"), F.col("p_partkey").alias("xs_key"), (F.col("x") + 0.0001 * F.col("p_size")).alias("x1"), F.col("y").alias("y1"),
        F.col("x").alias("x2"), (F.col("y") + 0.00005 * F.col("p_size")).alias("y2"),
        F.when(F.col("p_size") % 3 == 0, "Upstream").alias("label"),
    )


@query("F35_midpoints", f"WITH {MID} SELECT point_id, {rd('(x1 + x2) / 2')} AS x, {rd('(y1 + y2) / 2')} AS y FROM pts")
def _(t):
    return section_lines(t).select(F.col("xs_key").alias("point_id"), r((F.col("x1") + F.col("x2")) / 2).alias("x"), r((F.col("y1") + F.col("y2")) / 2).alias("y"))


LABEL = "arg_min(tp.label, struct_pack(d := round(sqrt(power((q.x1 + q.x2) / 2 - tp.p.x, 2) + power((q.y1 + q.y2) / 2 - tp.p.y, 2)), 12), o := tp.o))"


@query("J20_nearest_label", f"WITH {TARGETS}, {MID} SELECT q.point_id, {LABEL} AS label FROM pts q JOIN tp ON tp.linkno = q.linkno GROUP BY 1")
def _(t):
    line, pts = as_sites(t)
    targets = network.target_points(pts, network.measured_segments(line))
    mid = section_lines(t).select("site_id", F.col("xs_key").alias("point_id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return near.nearest_label(mid, targets).select("point_id", "label")


@query("K16_repaired_labels", f"WITH {TARGETS}, {MID} SELECT q.point_id AS xs_key, CASE WHEN p.p_size % 3 = 0 THEN 'Upstream' ELSE {LABEL} END AS label FROM pts q JOIN {{part}} p ON p.p_partkey = q.point_id JOIN tp ON tp.linkno = q.linkno GROUP BY q.point_id, p.p_size")
def _(t):
    line, pts = as_sites(t)
    targets = network.target_points(pts, network.measured_segments(line))
    return site_geometry.repair_labels(section_lines(t), targets).select("xs_key", "label")


STEPS = f"""steps AS (SELECT s.site_id, r0.linkno, 0 AS place FROM {{sites}} s JOIN {{reaches}} r0 ON r0.linkno = s.site_id + {N}
  UNION ALL SELECT s.site_id, r1.linkno, 1 FROM {{sites}} s JOIN {{reaches}} r0 ON r0.linkno = s.site_id + {N} JOIN {{reaches}} r1 ON r1.linkno = r0.dslinkno)"""


def steps(t):
    n = t.supplier.count()
    first = t.sites.select("site_id", (F.col("site_id") + n).alias("linkno")).join(merged(t.reaches.select("linkno", "dslinkno")), "linkno")
    second = first.where("dslinkno <> -1").select("site_id", F.col("dslinkno").alias("linkno"), F.lit(1).alias("place"))
    return first.select("site_id", "linkno", F.lit(0).alias("place")).unionByName(second)


@query("F34_merged_line", f"WITH {STEPS} SELECT s.site_id, CAST(row_number() OVER (PARTITION BY s.site_id ORDER BY s.place, v.seq DESC) - 1 AS bigint) AS seq, {rd('v.x')} AS x, {rd('v.y')} AS y FROM steps s JOIN {{reach_vertices}} v ON v.linkno = s.linkno")
def _(t):
    return rounded(network.merged_line(steps(t), t.reach_vertices), "x", "y")


@query(
    "F34_merged_unordered_parts",
    f"""WITH RECURSIVE half AS (SELECT site_id, part, seq = 0 AS at_head, x, y FROM {{line_parts}} WHERE seq <> 1),
        node AS (SELECT site_id, x, y FROM half GROUP BY site_id, x, y HAVING count(*) = 2),
        mate AS (SELECT a.site_id, a.part, a.at_head, b.part AS p2, b.at_head AS h2 FROM half a JOIN node n ON n.site_id = a.site_id AND n.x = a.x AND n.y = a.y
          JOIN half b ON b.site_id = a.site_id AND b.x = a.x AND b.y = a.y WHERE a.part <> b.part OR a.at_head <> b.at_head),
        walk AS (SELECT DISTINCT site_id, part AS p0, f AS f0, part, f AS fwd, 0 AS place FROM half, (VALUES (true), (false)) AS v(f)
          UNION ALL SELECT w.site_id, w.p0, w.f0, m.p2, m.h2, w.place + 1 FROM walk w JOIN mate m ON m.site_id = w.site_id AND m.part = w.part AND m.at_head = NOT w.fwd WHERE NOT (m.p2 = w.p0 AND m.h2 = w.f0)),
        way AS (SELECT site_id, p0, f0, min(part) AS chain, sum(CAST(fwd AS int)) AS n_fwd, arg_min(fwd, part) AS first_fwd FROM walk GROUP BY site_id, p0, f0),
        whole AS (SELECT w.* FROM way w LEFT JOIN mate m ON m.site_id = w.site_id AND m.part = w.p0 AND m.at_head = w.f0
          WHERE m.part IS NULL OR w.p0 = w.chain AND EXISTS (SELECT 1 FROM walk k JOIN mate e ON e.site_id = k.site_id AND e.part = k.part AND e.at_head = NOT k.fwd
            WHERE k.site_id = w.site_id AND k.p0 = w.p0 AND k.f0 = w.f0 AND e.p2 = w.p0 AND e.h2 = w.f0)),
        chosen AS (SELECT site_id, chain, arg_max(struct_pack(p := p0, f := f0), struct_pack(n := n_fwd, f := first_fwd)) AS b FROM whole GROUP BY site_id, chain),
        line AS (SELECT c.site_id, c.chain, 2 * w.place + CASE WHEN w.fwd THEN v.seq ELSE 2 - v.seq END AS seq, v.x, v.y FROM chosen c JOIN walk w ON w.site_id = c.site_id AND w.p0 = c.b.p AND w.f0 = c.b.f
          JOIN {{line_parts}} v ON v.site_id = w.site_id AND v.part = w.part WHERE w.place = 0 OR CASE WHEN w.fwd THEN v.seq ELSE 2 - v.seq END > 0),
        far AS (SELECT s.site_id, s.flowline_source, a.chain, round(min({seg_dist('s.longitude', 's.latitude', 'a.x', 'a.y', 'b.x', 'b.y')}), 9) AS dist, max(b.seq) AS top
          FROM {{sites}} s JOIN line a ON a.site_id = s.site_id JOIN line b ON b.site_id = a.site_id AND b.chain = a.chain AND b.seq = a.seq + 1 GROUP BY 1, 2, 3),
        best AS (SELECT site_id, arg_min(struct_pack(c := chain, t := top, d := flowline_source = 'TDX-Hydro'), struct_pack(d := dist, c := chain)) AS b FROM far GROUP BY site_id)
        SELECT l.site_id, l.chain, CAST(CASE WHEN b.b.d THEN b.b.t - l.seq ELSE l.seq END AS bigint) AS seq, {rd('l.x')} AS x, {rd('l.y')} AS y FROM line l JOIN best b ON b.site_id = l.site_id AND l.chain = b.b.c""",
)
def _(t):
    sites = t.sites.select("site_id", F.col("longitude").alias("px"), F.col("latitude").alias("py"), (F.col("flowline_source") == "TDX-Hydro").alias("turned"))
    return rounded(chains.flow_line(sites, t.line_parts, places=9), "x", "y")


LINE_OF_SITE = "SELECT s.site_id AS linkno, row_number() OVER (PARTITION BY s.site_id ORDER BY s.place, v.seq DESC) - 1 AS seq, v.x, v.y FROM steps s JOIN {reach_vertices} v ON v.linkno = s.linkno"
SITE_POINTS = "SELECT site_id AS linkno, longitude AS px, latitude AS py, weir_length / 100000 AS step FROM {sites}"


@query(
    "K5_extracted_sections",
    f"""WITH {STEPS}, {targets_sql(LINE_OF_SITE, SITE_POINTS)},
        cl AS (SELECT s.site_id, s.linkno AS comid, CAST(trunc((47e0 - v.y) / 0.001e0) AS int) AS r, CAST(trunc((v.x + 121e0) / 0.0013e0) AS int) AS c, s.linkno * 10 + v.seq AS ord FROM steps s JOIN {{reach_vertices}} v ON v.linkno = s.linkno),
        tc AS (SELECT linkno AS site_id, label, CAST(trunc((47e0 - p.y) / 0.001e0) AS int) AS r, CAST(trunc((p.x + 121e0) / 0.0013e0) AS int) AS c FROM tp),
        hit AS (SELECT t.site_id, t.label, arg_min(struct_pack(comid := cl.comid, r := cl.r, c := cl.c), struct_pack(d := power(t.r - cl.r, 2) + power(t.c - cl.c, 2), o := cl.ord)) AS h FROM tc t JOIN cl ON cl.site_id = t.site_id GROUP BY 1, 2)
        SELECT site_id, label, h.comid AS comid, h.r AS row_, h.c AS col_, 2 AS n1 FROM hit WHERE h.comid % 7 <> 0""",
)
def _(t):
    line = network.merged_line(steps(t), t.reach_vertices)
    sites = t.sites.select("site_id", F.col("longitude").alias("px"), F.col("latitude").alias("py"), (F.col("weir_length") / 100000).alias("weir_length"))
    grid = (-121.0, 47.0, 0.0013, 0.001)
    row, col = geo.grid_cell(F.col("x"), F.col("y"), *[F.lit(v) for v in grid])
    cells = steps(t).join(merged(t.reach_vertices), "linkno").select("site_id", F.col("linkno").alias("comid"), row.alias("row_"), col.alias("col_"), (F.col("linkno") * 10 + F.col("seq")).alias("ord"))
    text = F.concat(F.lit("["), F.col("row_"), F.lit(", "), F.col("col_"), F.lit("]"))
    profiles = cells.select("comid", "row_", "col_").distinct().withColumns({"xs1": text, "xs2": F.when(F.col("comid") % 7 == 0, F.lit("[1]")).otherwise(text)})
    out = site_geometry.extract_sections(sites, line, cells, profiles, grid)
    return out.select("site_id", "label", "comid", "row_", "col_", F.size("xs1").alias("n1"))


@query("J12_merged_simulator_tables", f"""WITH pairs AS (SELECT c.cell_id, s.wse, s.stage_id, abs(c.row_ - s.row_) + abs(c.col_ - s.col_) AS d FROM {{cells}} c JOIN {{stage_cells}} s
       ON c.comid = s.comid AND abs(c.row_ - s.row_) <= 2 AND abs(c.col_ - s.col_) <= 2),
       best AS (SELECT cell_id, arg_min(wse, struct_pack(d := d, i := stage_id)) AS wse FROM pairs GROUP BY 1),
       p2 AS (SELECT c.cell_id, arg_min(x.slope, struct_pack(d := abs(c.row_ - x.row_) + abs(c.col_ - x.col_), i := x.cell_id)) AS profile FROM {{cells}} c JOIN {{cells}} x
       ON c.comid = x.comid AND abs(c.row_ - x.row_) <= 2 AND abs(c.col_ - x.col_) <= 2 GROUP BY 1),
       n AS ({NUMBERED})
       SELECT c.cell_id, n.xs_no, {rd('b.wse')} AS wse, {rd('p2.profile')} AS profile FROM {{cells}} c JOIN n ON n.cell_id = c.cell_id LEFT JOIN best b ON c.cell_id = b.cell_id LEFT JOIN p2 ON p2.cell_id = c.cell_id""")
def _(t):
    stage = t.stage_cells.select("comid", "row_", "col_", "wse", F.col("stage_id").alias("ord"))
    profiles = t.cells.select("comid", "row_", "col_", F.col("slope").alias("profile"), F.col("cell_id").alias("ord"))
    out = site_geometry.merge_simulator_tables(t.cells, stage, profiles)
    return rounded(out.select("cell_id", "xs_no", "wse", "profile"), "wse", "profile")


@query("J34_cells_in_profile", f"SELECT c.cell_id, s.stage_id, {rd('s.wse')} AS wse FROM {{cells}} c JOIN {{stage_cells}} s ON c.site_id = s.site_id AND c.row_ = s.row_ AND c.col_ = s.col_")
def _(t):
    out = t.cells.select("cell_id", "site_id", "row_", "col_").join(t.stage_cells.drop("comid"), ["site_id", "row_", "col_"])
    return rounded(out.select("cell_id", "stage_id", "wse"), "wse")


@query("K15_stream_profile", f"""SELECT x.cell_id, {rd('x.elev')} AS elev, {rd('x.distance')} AS distance, {rd('l.wse')} AS wse FROM (SELECT *, sum(coalesce(gap, 0)) OVER (PARTITION BY site_id ORDER BY seq) AS distance FROM (SELECT *,
       sqrt(power(row_ - lag(row_) OVER (PARTITION BY site_id ORDER BY seq), 2) + power(col_ - lag(col_) OVER (PARTITION BY site_id ORDER BY seq), 2)) AS gap
       FROM (SELECT *, CAST(floor(cell_id / {N}) AS bigint) AS seq FROM {{cells}}))) x LEFT JOIN (SELECT comid, row_, col_, max(wse) AS wse FROM {{stage_cells}} GROUP BY 1, 2, 3) l
       ON l.comid = x.comid AND l.row_ = x.row_ AND l.col_ = x.col_""")
def _(t):
    n = t.supplier.count()
    out = site_geometry.stream_profile(t.cells.withColumn("seq", F.floor(F.col("cell_id") / n)), t.stage_cells)
    return rounded(out.select("cell_id", "elev", "distance", "wse"), "elev", "distance", "wse")
