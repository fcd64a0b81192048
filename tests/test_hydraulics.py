"""Closed forms against their equations, section geometry and solvers against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirspan import session
from weirspan.functions import hydraulics as hy
from weirspan.functions import sections as sx
from weirspan.functions import text as tx
from weirspan.operators import jumps

G = 9.81
C = F.col


def test_jump_types(spark):
    rows = [(2.0, 1.0, 3.0, "A"), (2.0, 2.0, 3.0, "B"), (2.0, 2.5, 3.0, "C"), (2.0, 3.0, 3.0, "D"), (None, 1.0, 3.0, "N/A"), (0.0, 1.0, 3.0, "N/A"), (3.0, 3.5, 2.0, "D"), (2.0, 1.0, None, "N/A")]
    df = spark.createDataFrame(rows, "y2 double, yt double, yf double, want string")
    got = df.withColumn("got", hy.jump_type(C("y2"), C("yt"), C("yf"))).collect()
    assert all(r.got == r.want for r in got)


def test_closed_forms_satisfy_their_equations(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, x)) for x in zip(rng.uniform(0.1, 2000, 400), rng.uniform(3, 200, 400), rng.uniform(0.05, 16, 400))]
    df = spark.createDataFrame(rows, "q double, l double, p double").withColumn("h", hy.weir_head(C("q"), C("l")))
    df = df.withColumns({"y1": hy.y1(C("h"), C("p")), "fr": hy.froude_y1(C("h"), C("p")), "flip": hy.flip_depth(C("q"), C("l"), C("p"))})
    staged = hy.with_flip_depth(hy.with_froude(hy.with_y1(df, C("h"), C("p"), "y1s"), C("h"), C("p"), "frs"), C("q"), C("l"), C("p"), "flips")
    for r in staged.collect():
        assert r.flips == pytest.approx(r.flip) and r.frs == pytest.approx(r.fr) and (r.y1 is None) == (r.y1s is None)
        if r.y1 is not None:
            x = r.y1 / r.h
            roots = [z.real for z in np.roots([1, -(1 + r.p / r.h), 0, 4 / 9 * 0.62**2 * (1 + 0.1 * r.p / r.h)]) if abs(z.imag) < 1e-12 and z.real > 0]
            assert x == pytest.approx(min(roots), rel=1e-7)
        if r.fr != 1.0:
            res = 1 - (9 / (4 * 0.62**2) * 0.5 * r.fr**2) ** (1 / 3) * (1 + r.p / r.h) + 0.5 * r.fr**2 * (1 + 0.1 * r.p / r.h)
            assert abs(res) < 1e-8
        # flip depth = s h + p: recover h from either regime and test the discharge
        hs = [(r.flip - r.p) / 0.48, ((r.flip - r.p) * 1.1 + 0.1 * r.p)]
        ok = []
        for h in hs:
            s = max(0.48, (1 - 0.1 * r.p / h) / 1.1)
            ok.append(abs(2 / 3 * math.sqrt(0.4) * math.sqrt(1 - s * s) * r.l * math.sqrt(2 * G) * h**1.5 / r.q - 1))
        assert min(ok) < 1e-8


def test_missing_or_negative_height_gives_null(spark):
    df = spark.createDataFrame([(5.0, 10.0, None), (5.0, 10.0, -1.0)], "q double, l double, p double")
    df = df.withColumn("h", hy.weir_head(C("q"), C("l")))
    for r in df.select(hy.y1(C("h"), C("p")), hy.froude_y1(C("h"), C("p")), hy.flip_depth(C("q"), C("l"), C("p"))).collect():
        assert list(r) == [None, None, None]


def test_weir_geometry_solves_the_discharge(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(map(float, x)) for x in zip(rng.uniform(1, 300, 200), rng.uniform(5, 80, 200), rng.uniform(0.3, 4, 200), rng.uniform(0.1, 5, 200))]
    df = spark.createDataFrame(rows, "q double, l double, yt double, dw double")
    res = hy.weir_residual(C("head"), C("q"), C("l"), C("yt") + C("dw"), C("dw"))
    solved = hy.with_weir_geometry(df, C("q"), C("l"), C("yt"), C("dw")).withColumn("res", res).collect()
    exact = 0
    for r in solved:
        if r.head is None:
            continue
        assert r.head + r.p_height == pytest.approx(r.yt + r.dw)
        h0 = (1.5 * r.q / r.l / 0.62 / math.sqrt(2 * G)) ** (2 / 3)
        # a root, the free-flow head where the bracket has none, or the jump of the coefficient between the regimes
        at_jump = abs(r.head - r.dw) < 1e-6 or abs(r.p_height) < 1e-6
        assert abs(r.res) < 1e-6 * r.q or r.head == pytest.approx(h0) or at_jump
        exact += abs(r.res) < 1e-6 * r.q
    assert exact > 100


def props(y, z, dx):
    width = area = moment = 0.0
    for a, b in zip(z[:-1], z[1:]):
        da, db = y - a, y - b
        if da <= 0 and db <= 0:
            continue
        w = dx
        if min(da, db) <= 0:
            w, da, db = dx * max(da, db) / (max(da, db) - min(da, db)), max(da, db), 0.0
        width, area, moment = width + w, area + w * (da + db) / 2, moment + w / 6 * (da * da + da * db + db * db)
    return width, area, moment


@pytest.fixture(scope="module")
def channel(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(24):
        n = int(rng.integers(4, 25))
        a = np.abs(np.linspace(0, rng.uniform(1, 6), n) + rng.normal(0, 0.4, n))
        b = np.abs(np.linspace(0, rng.uniform(1, 6), n) + rng.normal(0, 0.4, n))
        if k % 5 == 0:
            a[2] = a[1]
        low = min(a.min(), b[1:].min())
        rows.append((k, [float(v - low) for v in a], [float(v - low) for v in b], *map(float, (rng.uniform(0.5, 3), rng.uniform(1, 60), rng.uniform(5, 40), rng.uniform(0.3, 4), rng.uniform(0.3, 1), rng.uniform(0.3, 0.6)))))
    df = spark.createDataFrame(rows, "k long, xs1 array<double>, xs2 array<double>, dx double, q double, l double, p double, a double, b double")
    return df.repartition(8).withColumn("stage", sx.stage_table(C("xs1"), C("xs2"), C("dx")))


def bed(r):
    return np.array(list(r.xs1)[::-1] + list(r.xs2)[1:])


def test_section_properties(channel):
    rows = channel.withColumns({f"g{i}": sx.area_and_centroid(C("stage"), F.lit(y)) for i, y in enumerate((0.0, 0.4, 1.3, 9.0))})
    rows = rows.withColumns({f"t{i}": sx.top_width(C("stage"), F.lit(y)) for i, y in enumerate((0.0, 0.4, 1.3, 9.0))})
    for r in rows.collect():
        for i, y in enumerate((0.0, 0.4, 1.3, 9.0)):
            t, a, s = props(y, bed(r), r.dx)
            assert r[f"t{i}"] == pytest.approx(t if t > 0 else 1e-3)
            assert r[f"g{i}"].a == pytest.approx(a if a > 0 else 1e-4)
            assert r[f"g{i}"].yc == pytest.approx(s / a if a > 0 else 1e-4)


def brute_critical(q, z, dx):
    for y in np.arange(1e-4, 40, 2e-3):
        t, a, _ = props(y, z, dx)
        if a > 0 and q * q * t <= G * a**3:
            return y
    return None


def brute_conjugate(q, y1, length, z, dx):
    a1 = y1 * length
    m1 = q * q / (G * a1) + a1 * y1 / 2
    yc = brute_critical(q, z, dx)

    def m(y):
        _, a, s = props(y, z, dx)
        return q * q / (G * a) + s

    if yc is None or m(yc) > m1 * (1 + 1e-6):
        return None
    lo, hi = yc, max(2 * yc, 2 * y1)
    while m(hi) < m1:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if m(mid) < m1 else (lo, mid)
    return lo


def test_critical_and_conjugate_depth(channel):
    rows = hy.with_y1(channel.withColumn("h", hy.weir_head(C("q"), C("l"))), C("h"), C("p"))
    rows = rows.withColumns({"yc": sx.critical_depth(C("q"), C("stage")), "m": sx.conjugate_by_momentum(C("q"), C("y_1"), C("l"), C("stage"))})
    for r in rows.collect():
        assert r.yc == pytest.approx(brute_critical(r.q, bed(r), r.dx), abs=2.1e-3)
        want = brute_conjugate(r.q, r.y_1, r.l, bed(r), r.dx)
        if want is None or r.m.y2 is None:
            assert r.m.y2 is None or want is None
        else:
            assert r.m.y2 == pytest.approx(want, abs=1e-6)
            assert r.m.m2 == pytest.approx(r.m.m1)


def test_momentum_range_against_brute_force(channel):
    lo, hi = sx.danger_range_momentum(C("l"), C("p"), C("a"), C("b"), C("stage"), F.lit(0.5), F.lit(150.0))
    rows = channel.where("k < 8").withColumns({"qmin": lo, "qmax": hi}).collect()

    def gap(q, r):
        h = (1.5 * q / r.l / 0.62 / math.sqrt(2 * G)) ** (2 / 3)
        roots = [z.real for z in np.roots([1, -(1 + r.p / h), 0, 4 / 9 * 0.62**2 * (1 + 0.1 * r.p / h)]) if abs(z.imag) < 1e-12 and z.real > 0]
        y2 = brute_conjugate(q, min(roots) * h, r.l, bed(r), r.dx) if roots else None
        return 1e6 if y2 is None else y2 - r.a * q**r.b

    for r in rows:
        ends = gap(0.5, r), gap(150.0, r)
        if ends[0] * ends[1] >= 0:
            assert r.qmin == (0.5 if ends[0] < 0 else 150.0)
        else:
            assert (gap(r.qmin - 1e-3, r) > 0) != (gap(r.qmin + 1e-3, r) > 0)


def test_rectangular_channel_closed_form(spark):
    walls = [0.0] * 6 + [50.0]
    df = spark.createDataFrame([(walls, walls, 2.0, 30.0)], "xs1 array<double>, xs2 array<double>, dx double, q double")
    df = df.withColumn("stage", sx.stage_table(C("xs1"), C("xs2"), C("dx")))
    r = df.select(sx.critical_depth(C("q"), C("stage")).alias("yc"), sx.area_and_centroid(C("stage"), F.lit(0.5)).alias("g")).first()
    width = 20.0
    # the walls slope over one step, which widens the section slightly
    assert r.yc == pytest.approx((30.0**2 / width**2 / G) ** (1 / 3), rel=0.01)
    assert r.g.a == pytest.approx(width * 0.5, rel=0.01) and r.g.yc == pytest.approx(0.25, rel=0.01)


def test_profiles(spark):
    df = spark.createDataFrame([([1.0, 0.5, -1e6, 0.2], [-2e5, 4.0])], "a array<double>, b array<double>")
    r = df.select(sx.depth_profile(C("a"), F.lit(0.5)).alias("a"), sx.depth_profile(C("b"), F.lit(0.5)).alias("b"), sx.bed_elevation(C("a"), C("b")).alias("bed"), sx.wetted_cells(C("a"), F.lit(0.7)).alias("none"), sx.wetted_cells(C("a"), F.lit(2.0)).alias("two")).first()
    assert (r.a, r.b, r.bed, r.none, r.two) == ([0.5, 0.0], [0.0, 0.0], 0.2, 0, 2)


def test_list_text(spark):
    texts = ["[1.2, 3.4]", "[1.2 3.4]", "[1.2]", "1.2", None, "[]", " [1.5,  2.5] "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = [r.v for r in df.select("i", tx.parse_list(C("x")).alias("v")).orderBy("i").collect()]
    assert got == [[1.2, 3.4], [1.2, 3.4], [1.2], [1.2], None, [], [1.5, 2.5]]


def test_exceedance_levels_round_half_to_even(spark):
    df = spark.createDataFrame([(44, 40), (45, 40), (55, 60), (5, 10), (250, 100)], "ep int, want int")
    assert all(r.got == r.want for r in df.select("want", tx.tens(C("ep")).alias("got")).collect())


def test_upstream_section_has_no_results(spark):
    sections = spark.createDataFrame([(1, 0, 10.0, 2.0, 0.4, 0.4), (1, 1, 10.0, 2.0, 0.4, 0.4), (1, 2, 10.0, 0.0, 0.4, 0.4), (1, 3, 10.0, None, 0.4, 0.4)], "site_id long, xs_index int, weir_length double, p_height double, depth_a double, depth_b double")
    incidents = spark.createDataFrame([(1, 5.0), (1, 0.0), (1, None), (2, 5.0)], "site_id long, flow double")
    got = jumps.jumps_at_incidents(sections, incidents).collect()
    assert [(r.xs_index, r.flow) for r in got] == [(1, 5.0)]


def test_thin_rows_and_a_busy_site_use_all_cores(spark):
    few = spark.range(20_000, numPartitions=1)
    sizes = session.spread(few).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < 2 * 20_000 / len(sizes)
    sections = spark.createDataFrame([(1, i, 2.0, 10.0, 0.5, 0.4) for i in range(5)], "site_id long, xs_index int, p_height double, weir_length double, depth_a double, depth_b double")
    incidents = few.select((F.col("id") % 1 + 1).alias("site_id"), F.col("id").alias("incident_id"), (F.col("id") + 1.0).alias("flow"))
    out = jumps.jumps_at_incidents(sections, incidents)
    assert out.select("incident_id", "xs_index").distinct().count() == out.count() == 4 * 20_000
    assert "__part" not in out.columns
    used = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(used) >= 4 and max(r["count"] for r in used) < 40_000
