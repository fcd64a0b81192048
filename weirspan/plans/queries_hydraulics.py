"""Hydraulic queries: weir head, jump depths, section geometry, danger range, site analysis."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from weirspan.functions import hydraulics as hy
from weirspan.functions import sections as sx
from weirspan.operators import flow, jumps, keyed
from weirspan.plans import site_analysis
from weirspan.plans.catalog import query
from weirspan.plans.common import chain, day, r, rd, rounded
from weirspan.plans.queries_flow import FDC

# The formulas in SQL, as select lists each laid over the one before; they read q, l (length), p (height).
HEAD = ["power(1.5e0 * q / l / 0.62e0 / sqrt(2 * 9.81e0), 2 / 3e0) AS h"]
Y1 = [
    "1 + p / h AS b_, 4 / 9e0 * 0.62e0 * 0.62e0 * (1 + 0.1e0 * p / h) AS d_",
    "1 - 13.5e0 * d_ / (b_ * b_ * b_) AS arg_",
    "CASE WHEN abs(arg_) <= 1 THEN b_ / 3 * (1 + 2 * cos((acos(CASE WHEN abs(arg_) <= 1 THEN arg_ END) - 2 * pi()) / 3)) END AS x_",
    "h * (x_ - (x_ * x_ * x_ - b_ * x_ * x_ + d_) / (3 * x_ * x_ - 2 * b_ * x_)) AS y_1",
]
FROUDE = [
    "1 + 0.1e0 * p / h AS a_, power(9 / (4 * 0.62e0 * 0.62e0), 1 / 3e0) AS k_",
    "k_ * (1 + p / h) / a_ AS m_, 1 - power(9 / (4 * 0.62e0 * 0.62e0) * 0.5e0, 1 / 3e0) * (1 + p / h) + 0.5e0 * a_ AS f1_, "
    "1 - power(9 / (4 * 0.62e0 * 0.62e0) * 200e0, 1 / 3e0) * (1 + p / h) + 200e0 * a_ AS f20_",
    "1.5e0 / a_ / (-m_) * sqrt(3 / m_) AS farg_",
    "CASE WHEN f1_ * f20_ <= 0 AND abs(farg_) <= 1 THEN sqrt(2 * power(2 * sqrt(m_ / 3) * cos(acos(CASE WHEN abs(farg_) <= 1 THEN farg_ END) / 3), 3)) ELSE 1 END AS fr_1",
]
FLIP = [
    "power(1.5e0 * q / (sqrt(0.4e0) * l * sqrt(2 * 9.81e0)), 2) AS c2_, 1 - 1 / 1.21e0 AS ga_, 0.2e0 * p / 1.21e0 AS gb_, -0.01e0 * p * p / 1.21e0 AS gc_",
    "power(c2_ / (1 - 0.48e0 * 0.48e0), 1 / 3e0) AS h1_, (3 * ga_ * gc_ - gb_ * gb_) / (3 * ga_ * ga_) AS pp_, "
    "(2 * gb_ * gb_ * gb_ - 9 * ga_ * gb_ * gc_ - 27 * ga_ * ga_ * c2_) / (27 * ga_ * ga_ * ga_) AS qq_",
    "CASE WHEN pp_ < 0 THEN 1.5e0 * abs(qq_) / (-pp_) * sqrt(-3 / pp_) END AS w_",
    "CASE WHEN h1_ <= 0.1e0 * p / 0.472e0 THEN h1_ WHEN w_ IS NULL THEN power(c2_ / ga_, 1 / 3e0) "
    "WHEN w_ <= 1 THEN 2 * sqrt(-pp_ / 3) * cos(acos(CASE WHEN w_ <= 1 THEN -sign(qq_) * w_ END) / 3) - gb_ / (3 * ga_) "
    "ELSE -2 * sign(qq_) * sqrt(-pp_ / 3) * cosh(acosh(CASE WHEN w_ > 1 THEN w_ END) / 3) - gb_ / (3 * ga_) END AS hf_",
    "greatest(0.48e0, (1 - 0.1e0 * p / hf_) / 1.1e0) * hf_ + p AS y_flip",
]
Y2 = ["y_1 / 2 * (sqrt(1 + 8 * fr_1 * fr_1) - 1) AS y_2"]
ALL = [*HEAD, *Y1, *FROUDE, *FLIP, *Y2]
CLASS = """CASE WHEN y_2 IS NULL OR y_flip IS NULL OR y_2 <= 0 THEN 'N/A' WHEN y_t < y_2 THEN 'A' WHEN y_t = y_2 THEN 'B'
            WHEN y_t > y_2 AND y_t < y_flip THEN 'C' WHEN y_t >= y_flip THEN 'D' ELSE 'N/A' END"""


PAIRS = """SELECT i.incident_id, i.site_id, x.xs_key, x.xs_index, i.date, i.flow AS q, s.weir_length AS l, s.p_known AS p, x.depth_a * power(i.flow, x.depth_b) AS y_t
         FROM {xs_water} x JOIN {sites} s ON x.site_id = s.site_id JOIN {incidents} i ON i.site_id = x.site_id WHERE i.flow > 0"""
POINTS = """SELECT i.incident_id, i.flow AS q, s.weir_length AS l, s.p_known AS p, 0.4e0 * power(i.flow, 0.45e0) AS y_t
         FROM {incidents} i JOIN {sites} s ON i.site_id = s.site_id WHERE i.flow > 0"""


def sections(t):
    return t.xs_water.join(t.sites.select("site_id", "weir_length", F.col("p_known").alias("p_height")), "site_id")


@query(
    "jump_class",
    f"""SELECT incident_id, site_id, xs_key, CAST(xs_index AS bigint) AS xs_index, strftime(date, '%Y-%m-%d') AS date, {rd('y_t')} AS y_t, {rd('y_1')} AS y_1,
               {rd('fr_1')} AS fr_1, {rd('y_2')} AS y_2, {rd('y_flip')} AS y_flip, {CLASS} AS jump_type FROM ({chain(PAIRS, ALL)})""",
)
def _(t):
    out = jumps.jumps_at_incidents(sections(t), t.incidents)
    out = rounded(out, "y_t", "y_1", "fr_1", "y_2", "y_flip").withColumn("date", day("date"))
    return out.select("incident_id", "site_id", "xs_key", "xs_index", "date", "y_t", "y_1", "fr_1", "y_2", "y_flip", "jump_type")


def points(t):
    """Each incident flow with the length, height and a common tailwater curve of its site."""
    s = t.sites.select("site_id", "weir_length", F.col("p_known").alias("p_height"))
    out = t.incidents.where("flow > 0").join(s, "site_id")
    return out.withColumns({"depth_a": F.lit(0.4), "depth_b": F.lit(0.45)})


def scalar_query(name: str, sql: str, fn):
    def run(t):
        rows = points(t).withColumn("h", hy.weir_head(F.col("flow"), F.col("weir_length")))
        c = SimpleNamespace(q=F.col("flow"), l=F.col("weir_length"), p=F.col("p_height"), h=F.col("h"), a=F.col("depth_a"), b=F.col("depth_b"))
        return rows.select("incident_id", fn(c).alias("value"))

    query(name, f"SELECT incident_id, {sql} AS value FROM ({chain(POINTS, ALL)})")(run)


scalar_query("F1_weir_head", rd("h"), lambda c: r(hy.weir_head(c.q, c.l)))
scalar_query("F2_weir_coefficient", rd("0.611e0 + 0.075e0 * h / p"), lambda c: r(hy.rehbock_coefficient(c.h, c.p)))
scalar_query("F5_supercritical_depth", rd("y_1"), lambda c: r(hy.y1(c.h, c.p)))
scalar_query("F6_froude_number", rd("fr_1"), lambda c: r(hy.froude_y1(c.h, c.p)))
scalar_query("F7_conjugate_depth", rd("y_2"), lambda c: r(hy.conjugate_depth_of_head(c.h, c.p)))
scalar_query("F8_flip_depth", rd("y_flip"), lambda c: r(hy.flip_depth(c.q, c.l, c.p)))
scalar_query("F9_simple_flip_depth", rd("(h + p) / 1.1e0"), lambda c: r(hy.flip_depth_simple(c.h, c.p)))
scalar_query(
    "F10_jump_residual",
    rd("1 - power(9 / (4 * 0.62e0 * 0.62e0) * 0.5e0 * 4, 1 / 3e0) * (1 + p / h) + 0.5e0 * 4 * (1 + 0.1e0 * p / h)"),
    lambda c: r(hy.jump_residual(F.lit(2.0), c.h / c.p)),
)
scalar_query("F16_tailwater_depth", rd("y_t"), lambda c: r(hy.tailwater(c.q, c.a, c.b)))
scalar_query(
    "F17_jump_type", CLASS,
    lambda c: hy.jump_type(hy.conjugate_depth_of_head(c.h, c.p), hy.tailwater(c.q, c.a, c.b), hy.flip_depth(c.q, c.l, c.p)),
)

# --- weir geometry: bisection of the discharge residual over [0.1, 10] x free-flow head ---


def residual_sql(h: str) -> str:
    return f"""(CASE WHEN yt + dw - {h} <= 0 THEN 1e9 ELSE 2 / 3e0 * (CASE WHEN {h} <= dw THEN 0.611e0 + 0.075e0 * {h} / (yt + dw - {h})
               ELSE sqrt(0.4e0) * sqrt(1 - power(least(({h} - dw) / {h}, 0.999e0), 2)) END) * l * sqrt(2 * 9.81e0) * power({h}, 1.5e0) - q END)"""


def bisect_sql(lo: str, hi: str, right: str, n: int) -> str:
    """``right`` is written in terms of ``((s.lo + s.hi) / 2)``."""
    mid = "((s.lo + s.hi) / 2)"
    out = f"list_reduce(range(1, {n + 1}), lambda s, i: CASE WHEN {right} THEN {{'lo': {mid}, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': {mid}}} END, {{'lo': {lo}, 'hi': {hi}}})"
    return f"(({out}).lo + ({out}).hi) / 2"


VALID = "list_filter(list_concat(xs1, xs2), lambda z: z > -1e5)"
UPSTREAM = "(SELECT site_id, arg_min(wse, struct_pack(a := CASE WHEN xs_index = 0 THEN 0 ELSE 1 END, b := xs_index, c := wse)) AS wse_up FROM {surveys} GROUP BY site_id)"
GEOM = f"""SELECT x.xs_key, x.site_id, x.xs_index, x.depth_a AS a, x.depth_b AS b, x.slope, s.weir_length AS l, CASE WHEN s.baseflow_nwm = 0 THEN s.weir_length / 4 ELSE s.baseflow_nwm END AS q,
       x.wse - list_min({VALID}) AS yt, u.wse_up - x.wse AS dw FROM {{surveys}} x JOIN {{sites}} s ON x.site_id = s.site_id JOIN {UPSTREAM} u ON u.site_id = x.site_id"""
GEOM_STEPS = [
    "power(1.5e0 * q / l / 0.62e0 / sqrt(2 * 9.81e0), 2 / 3e0) AS h0",
    f"{residual_sql('(0.1e0 * h0)')} AS r_lo, {residual_sql('(10e0 * h0)')} AS r_hi",
    f"CASE WHEN r_lo * r_hi < 0 THEN {bisect_sql('0.1e0 * h0', '10e0 * h0', residual_sql('((s.lo + s.hi) / 2)') + ' * sign(r_lo) > 0', 60)} ELSE h0 END AS hs",
    "CASE WHEN xs_index > 0 AND yt + dw - hs >= 0 THEN hs END AS head, CASE WHEN xs_index > 0 AND yt + dw - hs >= 0 THEN yt + dw - hs END AS p_height",
]


def site_inputs(t):
    flow_ = F.when(F.col("baseflow_nwm") == 0, F.col("weir_length") / 4).otherwise(F.col("baseflow_nwm"))
    return t.sites.select("site_id", "reach_id", "weir_length", flow_.alias("baseflow"))


@query("F4_weir_geometry", f"SELECT xs_key, {rd('head')} AS head, {rd('p_height')} AS p_height FROM ({chain(GEOM, GEOM_STEPS)})")
def _(t):
    return rounded(site_analysis.section_heights(t.surveys, site_inputs(t)).select("xs_key", "head", "p_height"), "head", "p_height")


@query("F3_weir_head_any_regime", f"SELECT xs_key, {rd('hs')} AS head FROM ({chain(GEOM, GEOM_STEPS)})")
def _(t):
    rows = jumps.with_profiles(t.surveys).join(site_inputs(t), "site_id")
    rows = keyed.with_upstream(rows, ["wse"])
    head = hy.weir_head_any_regime(F.col("baseflow"), F.col("weir_length"), F.col("wse") - F.col("bed"), F.col("wse_up") - F.col("wse"))
    return rows.select("xs_key", r(head).alias("head"))


@query(
    "F37_depth_crest_and_fall",
    f"""SELECT xs_key, {rd('yt')} AS depth, {rd('dw')} AS fall, {rd('bed + p_height')} AS crest
        FROM (SELECT g.*, list_min({VALID}) AS bed FROM ({chain(GEOM, GEOM_STEPS)}) g JOIN {{surveys}} x ON g.xs_key = x.xs_key)""",
)
def _(t):
    rows = keyed.with_upstream(site_analysis.section_heights(t.surveys, site_inputs(t)), ["wse"])
    return rows.select("xs_key", r(F.col("wse") - F.col("bed")).alias("depth"), r(F.col("wse_up") - F.col("wse")).alias("fall"), r(F.col("bed") + F.col("p_height")).alias("crest"))


# --- danger range, rectangular mode: 60 halvings as a recursion over all sections at once ---
RANGE = """SELECT x.xs_key, s.weir_length AS l, s.p_known AS p, x.depth_a AS a, x.depth_b AS b, f.q_lo, f.q_hi FROM {xs_water} x JOIN {sites} s ON x.site_id = s.site_id
       JOIN (SELECT reach_id, min(streamflow) AS q_lo, max(streamflow) AS q_hi FROM {flow_daily} GROUP BY 1) f ON f.reach_id = s.reach_id"""


def gaps(src: str) -> str:
    """Rows of ``src`` (with a discharge q) plus ``gap`` of their kind."""
    return f"""SELECT *, CASE WHEN q <= 0.001e0 THEN 1e6 ELSE coalesce(CASE WHEN kind = 'conjugate' THEN y_2 ELSE y_flip END, -9999e0) - a * power(q, b) END AS gap FROM ({chain(src, ALL)})"""


def range_sql(rows: str, key: str = "xs_key") -> str:
    """CTEs ending in ``found(key, kind, root)`` for ``rows`` with l, p, a, b, q_lo, q_hi."""
    ends = f"SELECT s.*, k.kind FROM ({rows}) s, (VALUES ('conjugate'), ('flip')) AS k(kind) WHERE p IS NOT NULL"
    return f"""ends AS ({ends}),
       e_lo AS (SELECT {key}, kind, gap FROM ({gaps('SELECT *, q_lo AS q FROM ends')})), e_hi AS (SELECT {key}, kind, gap FROM ({gaps('SELECT *, q_hi AS q FROM ends')})),
       both_ends AS (SELECT e.{key}, e.kind, e.l, e.p, e.a, e.b, e.q_lo, e.q_hi, a.gap AS g_lo, z.gap AS g_hi FROM ends e JOIN e_lo a ON a.{key} = e.{key} AND a.kind = e.kind JOIN e_hi z ON z.{key} = e.{key} AND z.kind = e.kind),
       halving({key}, kind, l, p, a, b, g_lo, lo, hi, i) AS (SELECT {key}, kind, l, p, a, b, g_lo, q_lo, q_hi, 0 FROM both_ends WHERE g_lo * g_hi < 0
         UNION ALL SELECT {key}, kind, l, p, a, b, g_lo, CASE WHEN gap * sign(g_lo) > 0 THEN q ELSE lo END, CASE WHEN gap * sign(g_lo) > 0 THEN hi ELSE q END, i + 1
         FROM ({gaps('SELECT *, (lo + hi) / 2 AS q FROM halving WHERE i < 60')})),
       found AS (SELECT e.{key}, e.kind, CASE WHEN e.g_lo * e.g_hi < 0 THEN (h.lo + h.hi) / 2 WHEN e.g_lo < 0 THEN e.q_lo ELSE e.q_hi END AS root FROM both_ends e LEFT JOIN (SELECT * FROM halving WHERE i = 60) h ON h.{key} = e.{key} AND h.kind = e.kind)"""


def range_inputs(t):
    ranges = flow.reach_range(t.flow_daily).withColumnRenamed("reach_id", "site_id")
    return sections(t).join(ranges, "site_id")


@query(
    "F19_danger_range_rectangular",
    f"WITH RECURSIVE {range_sql(RANGE)} SELECT xs_key, {rd('''max(CASE WHEN kind = 'conjugate' THEN root END)''')} AS qmin, {rd('''max(CASE WHEN kind = 'flip' THEN root END)''')} AS qmax FROM found GROUP BY xs_key",
)
def _(t):
    return rounded(jumps.with_danger_range(range_inputs(t), jumps.RECTANGULAR).select("xs_key", "qmin", "qmax"), "qmin", "qmax")


@query("F20_root_or_bound", f"WITH {range_sql(RANGE).split('halving(')[0].rstrip().rstrip(',')} SELECT xs_key, kind, CASE WHEN g_lo * g_hi < 0 THEN 'root' WHEN g_lo < 0 THEN 'lower' ELSE 'upper' END AS outcome FROM both_ends")
def _(t):
    rows = jumps.with_danger_range(range_inputs(t), jumps.RECTANGULAR)
    long = rows.select("xs_key", "q_lo", "q_hi", F.explode(F.array(
        F.struct(F.lit("conjugate").alias("kind"), F.col("qmin").alias("root")), F.struct(F.lit("flip").alias("kind"), F.col("qmax").alias("root")))).alias("x"))
    outcome = F.when(F.col("x.root") == F.col("q_lo"), "lower").when(F.col("x.root") == F.col("q_hi"), "upper").otherwise("root")
    return long.select("xs_key", "x.kind", outcome.alias("outcome"))


@query(
    "F21_mode_dispatch",
    f"""SELECT g.xs_key, m AS mode, CAST(CASE WHEN g.p_height <> 0 THEN 1 ELSE 0 END AS bigint) AS ranges FROM ({chain(GEOM, GEOM_STEPS)}) g
        JOIN (SELECT DISTINCT reach_id FROM {{flow_daily}}) f ON f.reach_id = g.site_id, (VALUES ('rectangular'), ('momentum')) AS v(m)""",
)
def _(t):
    rows = site_analysis.section_heights(t.surveys, site_inputs(t)).join(flow.reach_range(t.flow_daily), "reach_id")
    found = (F.col("qmin").isNotNull() & F.col("qmax").isNotNull()).cast("bigint").alias("ranges")
    modes = [jumps.with_danger_range(rows, m).select("xs_key", F.lit(m).alias("mode"), found) for m in (jumps.RECTANGULAR, jumps.MOMENTUM)]
    return modes[0].unionByName(modes[1])


@query("F18_danger_range_momentum")
def _(t):
    rows = site_analysis.section_heights(t.surveys, site_inputs(t)).join(flow.reach_range(t.flow_daily), "reach_id")
    return rounded(jumps.with_danger_range(rows, jumps.MOMENTUM).select("xs_key", "p_height", "qmin", "qmax"), "p_height", "qmin", "qmax")


# --- section geometry ---
BED_KEPT = "CASE WHEN list_position(list_transform({a}, lambda z: z > -1e5), false) > 0 THEN {a}[1:list_position(list_transform({a}, lambda z: z > -1e5), false) - 1] ELSE {a} END"


@query("P15_valid_bed_points", f"SELECT xs_key, {rd('(i - 1) * dx')} AS x, {rd('z[i]')} AS z FROM (SELECT xs_key, dx, list_concat(list_reverse(xs1), xs2) AS z, unnest(range(1, 65)) AS i FROM {{xs_raw}}) WHERE z[i] > -1e5")
def _(t):
    out = t.xs_raw.select("xs_key", F.inline(sx.bed_points(F.col("xs1"), F.col("xs2"), F.col("dx"))))
    return rounded(out, "x", "z")


def depth_rows(side: str) -> str:
    return f"""SELECT xs_key, '{side}' AS side, unnest(range(1, len(k) + 1)) AS i, k, bed FROM (SELECT xs_key, CASE WHEN len(k0) = 0 THEN [bed, bed] ELSE k0 END AS k, bed
       FROM (SELECT xs_key, {BED_KEPT.format(a=side)} AS k0, list_min({VALID}) AS bed FROM {{xs_raw}}))"""


@query("P16_depth_profiles", f"SELECT xs_key, side, i, {rd('k[i] - bed')} AS depth FROM ({depth_rows('xs1')} UNION ALL {depth_rows('xs2')})")
def _(t):
    rows = t.xs_raw.withColumn("bed", sx.bed_elevation(F.col("xs1"), F.col("xs2")))
    sides = [rows.select("xs_key", F.lit(s).alias("side"), F.posexplode(sx.depth_profile(F.col(s), F.col("bed"))).alias("i", "depth")) for s in ("xs1", "xs2")]
    return rounded(sides[0].unionByName(sides[1]).withColumn("i", (F.col("i") + 1).cast("bigint")), "depth")


@query("P17_bed_elevation", f"SELECT xs_key, {rd(f'list_min({VALID})')} AS bed FROM {{xs_raw}}")
def _(t):
    return t.xs_raw.select("xs_key", r(sx.bed_elevation(F.col("xs1"), F.col("xs2"))).alias("bed"))


@query("P18_profile_coordinates", f"SELECT xs_key, {rd('len(xs1) * dx')} AS centre, {rd('(len(xs1) + len(xs2) - 1) * dx')} AS right_end FROM {{xs_raw}}")
def _(t):
    n1, n2 = F.size("xs1"), F.size("xs2")
    return t.xs_raw.select("xs_key", r(n1 * F.col("dx")).alias("centre"), r((n1 + n2 - 1) * F.col("dx")).alias("right_end"))


WET = "CASE WHEN list_position(list_transform({a}, lambda z: wse >= z AND z > -1e5), false) > 0 THEN list_position(list_transform({a}, lambda z: wse >= z AND z > -1e5), false) - 1 ELSE len({a}) END"


@query("P19_wetted_stretch", f"SELECT xs_key, CAST({WET.format(a='xs1')} AS bigint) AS n_left, CAST({WET.format(a='xs2')} AS bigint) AS n_right FROM {{xs_raw}}")
def _(t):
    return t.xs_raw.select("xs_key", *[sx.wetted_cells(F.col(c), F.col("wse")).cast("bigint").alias(n) for c, n in (("xs1", "n_left"), ("xs2", "n_right"))])


SEGS = """SELECT xs_key, dx, bed[i] - z0 AS za, bed[i + 1] - z0 AS zb FROM (SELECT *, unnest(range(1, len(bed))) AS i FROM
       (SELECT xs_key, dx, list_concat(list_reverse(xs1), xs2[2:]) AS bed, list_min(list_concat(xs1, xs2)) AS z0 FROM {xs_profile}))"""
DEPTHS = f"""WITH seg AS ({SEGS}), y AS (SELECT i * 0.31e0 AS y, i FROM (SELECT unnest(range(0, 12)) AS i)),
       part AS (SELECT xs_key, i, y, dx, least(za, zb) AS m, greatest(za, zb) AS g, za, zb FROM seg, y),
       props AS (SELECT xs_key, i, y, sum(CASE WHEN y <= m THEN 0 WHEN y >= g THEN dx ELSE dx * (y - m) / (g - m) END) AS t,
         sum(CASE WHEN y <= m THEN 0 WHEN y >= g THEN dx * ((y - za) + (y - zb)) / 2 ELSE dx * (y - m) / (g - m) * (y - m) / 2 END) AS a,
         sum(CASE WHEN y <= m THEN 0 WHEN y >= g THEN dx / 6 * (power(y - za, 2) + (y - za) * (y - zb) + power(y - zb, 2)) ELSE dx * (y - m) / (g - m) * power(y - m, 2) / 6 END) AS s
       FROM part GROUP BY xs_key, i, y)"""


def profile_stage(t):
    rows = t.xs_profile.withColumn("z0", F.array_min(F.concat("xs1", "xs2")))
    for c in ("xs1", "xs2"):
        rows = rows.withColumn(c, F.transform(c, lambda z: z - F.col("z0")))
    return rows.withColumn("stage", sx.stage_table(F.col("xs1"), F.col("xs2"), F.col("dx")))


def at_depths(t):
    rows = profile_stage(t).select("xs_key", "stage", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint"))).alias("i"))
    return rows.withColumn("y", F.col("i") * 0.31)


@query("F11_top_width", f"{DEPTHS} SELECT xs_key, i, {rd('CASE WHEN y <= 0 OR t <= 0 THEN 1e-3 ELSE t END')} AS t FROM props")
def _(t):
    return at_depths(t).select("xs_key", "i", r(sx.top_width(F.col("stage"), F.col("y"))).alias("t"))


@query("F12_area_and_centroid", f"{DEPTHS} SELECT xs_key, i, {rd('CASE WHEN y <= 0 OR a <= 0 THEN 1e-4 ELSE a END')} AS a, {rd('CASE WHEN y <= 0 OR a <= 0 THEN 1e-4 ELSE s / a END')} AS yc FROM props")
def _(t):
    out = at_depths(t).withColumn("g", sx.area_and_centroid(F.col("stage"), F.col("y")))
    return out.select("xs_key", "i", r("g.a").alias("a"), r("g.yc").alias("yc"))


@query("F13_section_froude", f"{DEPTHS} SELECT xs_key, i, {rd('CASE WHEN y <= 0 THEN 0 ELSE 25e0 / a / sqrt(9.81e0 * a / t) END')} AS fr FROM props")
def _(t):
    return at_depths(t).select("xs_key", "i", r(sx.section_froude(F.lit(25.0), F.col("stage"), F.col("y"))).alias("fr"))


def list_a(y: str) -> str:
    return f"list_sum(list_transform(seg, lambda u: CASE WHEN {y} <= least(u.a, u.b) THEN 0e0 WHEN {y} >= greatest(u.a, u.b) THEN dx * (({y} - u.a) + ({y} - u.b)) / 2 ELSE dx * power({y} - least(u.a, u.b), 2) / abs(u.b - u.a) / 2 END))"


def list_t(y: str) -> str:
    return f"list_sum(list_transform(seg, lambda u: CASE WHEN {y} <= least(u.a, u.b) THEN 0e0 WHEN {y} >= greatest(u.a, u.b) THEN dx ELSE dx * ({y} - least(u.a, u.b)) / abs(u.b - u.a) END))"


def list_s(y: str) -> str:
    return f"list_sum(list_transform(seg, lambda u: CASE WHEN {y} <= least(u.a, u.b) THEN 0e0 WHEN {y} >= greatest(u.a, u.b) THEN dx / 6 * (power({y} - u.a, 2) + ({y} - u.a) * ({y} - u.b) + power({y} - u.b, 2)) ELSE dx * power({y} - least(u.a, u.b), 3) / abs(u.b - u.a) / 6 END))"


def fast(y: str) -> str:
    return f"({list_a(y)} <= 0 OR q * q * {list_t(y)} > 9.81e0 * power({list_a(y)}, 3))"


def force(y: str) -> str:
    return f"(q * q / (9.81e0 * {list_a(y)}) + {list_s(y)})"


MID = "((s.lo + s.hi) / 2)"
YC_SRC = """SELECT *, 20e0 + xs_key % 60 AS q, list_transform(range(1, len(bed)), lambda i: {'a': bed[i] - z0, 'b': bed[i + 1] - z0}) AS seg, list_sort(list_distinct(list_transform(bed, lambda z: z - z0))) AS pts
       FROM (SELECT xs_key, dx, list_concat(list_reverse(xs1), xs2[2:]) AS bed, list_min(list_concat(xs1, xs2)) AS z0 FROM {xs_profile})"""
YC_STEPS = [
    f"coalesce(list_filter(pts, lambda z: z > 1e-4 AND NOT {fast('z')})[1], 30720e0) AS top",
    "greatest(1e-4, coalesce(list_max(list_filter(pts, lambda z: z < top)), 0e0)) AS low",
    f"CASE WHEN top = 30720e0 AND {fast('30720e0')} THEN NULL ELSE {bisect_sql('low', 'top', fast(MID), 60)} END AS yc",
]
Y2_STEPS = [
    *YC_STEPS,
    "0.1e0 + (xs_key % 9) / 20e0 AS y1, 6e0 + xs_key % 5 AS l",
    "q * q / (9.81e0 * y1 * l) + y1 * l * y1 / 2 AS m1",
    f"coalesce(list_filter(pts, lambda z: z > yc AND {force('z')} >= m1)[1], 1e5) AS top2",
    "greatest(yc, coalesce(list_max(list_filter(pts, lambda z: z < top2)), 0e0)) AS low2",
    f"CASE WHEN {force('yc')} <= m1 THEN {bisect_sql('low2', 'top2', force(MID) + ' < m1', 70)} END AS y2",
]


@query("F14_critical_depth", f"SELECT xs_key, {rd('yc')} AS yc FROM ({chain(YC_SRC, YC_STEPS)})")
def _(t):
    return profile_stage(t).select("xs_key", r(sx.critical_depth(F.lit(20.0) + F.col("xs_key") % 60, F.col("stage"))).alias("yc"))


@query("F15_conjugate_by_momentum", f"SELECT xs_key, {rd('y2')} AS y2, {rd('m1')} AS m1, {rd(force('y2'))} AS m2 FROM ({chain(YC_SRC, Y2_STEPS)})")
def _(t):
    k = F.col("xs_key")
    m = sx.conjugate_by_momentum(F.lit(20.0) + k % 60, F.lit(0.1) + (k % 9) / 20, F.lit(6.0) + k % 5, F.col("stage"))
    out = profile_stage(t).withColumn("m", m)
    return out.select("xs_key", r("m.y2").alias("y2"), r("m.m1").alias("m1"), r("m.m2").alias("m2"))


@query("O5_rating_pairs", f"SELECT xs_key, row_number() OVER (PARTITION BY xs_key ORDER BY q, wse) AS k, {rd('q')} AS q, {rd('greatest(0e0, wse - bed)')} AS depth FROM {{rating}} WHERE q IS NOT NULL")
def _(t):
    e = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    cols = {}
    for i in range(1, 31):
        cols[f"q_{i}"] = F.when((F.col("vec_id") + i) % 23 != 0, e(i - 1) * 500)
        cols[f"wse_{i}"] = F.lit(99) + e(29 + i) * 20
    wide = t.embeddings.select(F.col("vec_id").alias("xs_key"), (F.lit(100) + F.col("vec_id") % 20 / 10).alias("bed"), *[v.alias(k) for k, v in cols.items()])
    out = wide.select("xs_key", F.posexplode(sx.rating_pairs_of(wide.columns, F.col("bed"))).alias("k", "p"))
    return out.select("xs_key", (F.col("k") + 1).cast("bigint").alias("k"), r("p.q").alias("q"), r("p.depth").alias("depth"))


GRID = f"SELECT xs_key, i, l, p, a, b, q0 + i * (q_hi - q0) / 99 AS q FROM (SELECT *, CASE WHEN q_lo = 0 THEN 0.01e0 ELSE q_lo END AS q0 FROM ({RANGE})), (SELECT unnest(range(0, 100)) AS i)"


@query("K9_danger_curves", f"SELECT xs_key, i, {rd('q')} AS q, {rd('a * power(q, b)')} AS y_t, {rd('y_2')} AS y_2, {rd('y_flip')} AS y_flip FROM ({chain(GRID, ALL)})")
def _(t):
    out = jumps.danger_curves(range_inputs(t)).withColumn("i", F.col("i").cast("bigint"))
    return rounded(out.select("xs_key", "i", "q", "y_t", "y_2", "y_flip"), "q", "y_t", "y_2", "y_flip")


@query("J32_discharge_grid", f"SELECT xs_key, i, {rd('q')} AS q FROM ({GRID})")
def _(t):
    return jumps.with_grid(range_inputs(t)).select("xs_key", F.col("i").cast("bigint").alias("i"), r(F.col("q")).alias("q"))


# --- site analysis ---
K6_ROWS = f"""SELECT g.xs_key, g.site_id, g.xs_index, g.slope, g.l, g.a, g.b, CASE WHEN g.p_height <> 0 THEN g.p_height END AS p, g.p_height, f.q_lo, f.q_hi FROM ({chain(GEOM, GEOM_STEPS)}) g
       JOIN (SELECT reach_id, min(streamflow) AS q_lo, max(streamflow) AS q_hi FROM {{flow_daily}} GROUP BY 1) f ON f.reach_id = g.site_id"""


@query(
    "K6_site_analysis_sections",
    f"""WITH RECURSIVE {range_sql(K6_ROWS)}, {FDC.strip()}, curve AS (SELECT reach_id, streamflow AS v, min(exceedance) AS e FROM fdc GROUP BY 1, 2),
        rng AS (SELECT xs_key, max(CASE WHEN kind = 'conjugate' THEN root END) AS qmin, max(CASE WHEN kind = 'flip' THEN root END) AS qmax FROM found GROUP BY xs_key),
        x AS (SELECT k.*, r.qmin, r.qmax FROM ({K6_ROWS}) k LEFT JOIN rng r ON r.xs_key = k.xs_key)
        SELECT x.xs_key, x.site_id, x.xs_index, {rd('CASE WHEN slope = 0 THEN 0e0 ELSE round_even(slope * power(10e0, 2 - floor(log10(abs(slope)))), 0) / power(10e0, 2 - floor(log10(abs(slope)))) END', 9)} AS slope,
               {rd('p_height')} AS p_height, {rd('qmin')} AS qmin, {rd('qmax')} AS qmax,
               {rd('(SELECT arg_min(e, struct_pack(d := abs(v - x.qmin), e := e)) FROM curve c WHERE c.reach_id = x.site_id AND x.qmin IS NOT NULL)')} AS prob_min,
               {rd('(SELECT arg_min(e, struct_pack(d := abs(v - x.qmax), e := e)) FROM curve c WHERE c.reach_id = x.site_id AND x.qmax IS NOT NULL)')} AS prob_max FROM x""",
)
def _(t):
    out = site_analysis.analyse_sections(t.surveys, site_inputs(t), t.flow_daily, jumps.RECTANGULAR)
    out = rounded(out.select("xs_key", "site_id", "xs_index", "slope", "p_height", "qmin", "qmax", "prob_min", "prob_max"), "p_height", "qmin", "qmax", "prob_min", "prob_max")
    return out.withColumn("slope", r("slope", 9))


K6_PAIRS = f"""SELECT g.xs_key, g.xs_index, i.incident_id, i.date, i.flow AS q, g.l, g.p_height AS p, g.a * power(i.flow, g.b) AS y_t FROM ({chain(GEOM, GEOM_STEPS)}) g JOIN {{incidents}} i ON i.site_id = g.site_id
       WHERE g.xs_index > 0 AND g.p_height <> 0 AND i.flow > 0"""


@query(
    "K6_site_analysis_results",
    f"SELECT xs_key, incident_id, {rd('y_t')} AS y_t, {rd('y_flip')} AS y_flip, {rd('y_2')} AS y_2, {rd('y_1')} AS y_1, {rd('fr_1')} AS fr_1, {CLASS} AS jump_type FROM ({chain(K6_PAIRS, ALL)})",
)
def _(t):
    out = site_analysis.analyse_incidents(t.surveys, site_inputs(t), t.incidents, jumps.RECTANGULAR)
    out = rounded(out, "y_t", "y_flip", "y_2", "y_1", "fr_1")
    return out.select("xs_key", "incident_id", "y_t", "y_flip", "y_2", "y_1", "fr_1", "jump_type")


@query("K6_site_analysis_results_momentum")
def _(t):
    out = site_analysis.analyse_incidents(t.surveys, site_inputs(t), t.incidents, jumps.MOMENTUM)
    out = rounded(out, "y_t", "y_flip", "y_2", "y_1", "fr_1", "m1", "m2")
    return out.select("xs_key", "incident_id", "y_t", "y_flip", "y_2", "y_1", "fr_1", "m1", "m2", "jump_type")


@query("K7_recomputed_heads", f"SELECT xs_key, site_id, xs_index, {rd('head')} AS head_new, {rd('p_height * 1.5e0')} AS p_height FROM ({chain(GEOM, GEOM_STEPS)})")
def _(t):
    stored = site_analysis.section_heights(t.surveys, site_inputs(t)).withColumn("p_height", F.col("p_height") * 1.5)
    out = site_analysis.recompute_heads(stored, t.surveys, site_inputs(t))
    return rounded(out.select("xs_key", "site_id", "xs_index", "head_new", "p_height"), "head_new", "p_height")
