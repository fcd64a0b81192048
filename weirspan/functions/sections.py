"""Cross-section geometry as column expressions over the two half profiles of a section.

A half profile runs from the channel centre outwards, in steps of ``dx``. The number of cells is a
property of the survey, so the arrays of a row stay small whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirspan.functions.hydraulics import (
    FLIP_STEPS, GRAVITY, NO_FLOW, SMALLEST_FLOW, Y1_STEPS, lit, root_or_bound, tailwater, weir_head,
)
from weirspan.functions.steps import bisect, inline, let

# Profile cells at or below INVALID carry no ground; a segment this flat counts as level;
# top width and area of a dry section; search range of the critical depth.
INVALID = -1e5
LEVEL = 1e-9
DRY_WIDTH, DRY_AREA = 1e-3, 1e-4
LOWEST_DEPTH, HIGHEST_DEPTH = 1e-4, 30.0 * 2**10
HALVINGS = 45


def valid(z: Column) -> Column:
    return z > INVALID


def prefix_while(profile: Column, keep) -> Column:
    """Cells from the centre up to the first one that fails ``keep``."""
    stop = F.array_position(F.transform(profile, lambda z: ~F.coalesce(keep(z), F.lit(False))), True)
    return F.when(stop == 0, profile).otherwise(F.slice(profile, F.lit(1), F.greatest(F.lit(0), (stop - 1).cast("int"))))


def bed_points(xs1: Column, xs2: Column, dx: Column) -> Column:
    """Ground points ``(x, z)`` from bank to bank without the invalid cells."""
    z = F.concat(F.reverse(xs1), xs2)
    points = F.transform(z, lambda v, i: F.struct((i * dx).alias("x"), v.alias("z")))
    return F.filter(points, lambda p: valid(p["z"]))


def bed_elevation(xs1: Column, xs2: Column) -> Column:
    return F.coalesce(F.array_min(F.filter(F.concat(xs1, xs2), valid)), F.lit(0.0))


def depth_profile(profile: Column, bed: Column) -> Column:
    """Heights above the bed up to the first invalid cell; ``[0, 0]`` when nothing is left."""
    kept = prefix_while(profile, valid)
    return F.when(F.size(kept) > 0, F.transform(kept, lambda z: z - bed)).otherwise(F.array(lit(0), lit(0)))


def wetted_cells(profile: Column, wse: Column) -> Column:
    """Number of cells under water without a gap from the centre."""
    return F.size(prefix_while(profile, lambda z: (wse >= z) & valid(z)))


def rating_pairs(pairs: list[tuple[Column, Column]], bed: Column) -> Column:
    """Complete (q, depth) pairs by rising discharge; depth above the bed, never negative."""
    made = F.array(*[F.struct(q.alias("q"), F.greatest(lit(0), wse - bed).alias("depth")) for q, wse in pairs])
    known = F.filter(made, lambda p: p["q"].isNotNull() & p["depth"].isNotNull())
    return F.array_sort(known)


def rating_pairs_of(names: list[str], bed: Column) -> Column:
    """``rating_pairs`` from the wide columns ``q_<n>`` and ``wse_<n>`` that are present."""
    n = [c[2:] for c in names if c.startswith("q_") and c[2:].isdigit() and f"wse_{c[2:]}" in names]
    both = [(F.when(F.col(f"wse_{i}").isNotNull(), F.col(f"q_{i}")), F.col(f"wse_{i}")) for i in n]
    return rating_pairs(both, bed)


def stage_table(xs1: Column, xs2: Column, dx: Column) -> Column:
    """Pieces of depth between which width, area and first moment are polynomials.

    Every segment of the bed starts to widen the water surface at its lower end and stops at its upper
    one. In depth order each piece holds its start ``e`` and end ``e2``, width ``t``, area ``a`` and
    moment ``s`` at the start, the growth ``c`` of the width, and area, moment and critical discharge
    at the end. The last piece is open and ends at the highest depth searched.
    """
    bed = F.concat(F.reverse(xs1), F.slice(xs2, F.lit(2), F.size(xs2)))

    def events(a: Column, b: Column) -> Column:
        low, high = F.least(a, b), F.greatest(a, b)
        grow = dx / F.when(high - low > LEVEL, high - low)
        sloped = F.array(
            F.struct(low.alias("e"), grow.alias("dc"), lit(0).alias("dt")),
            F.struct(high.alias("e"), (-grow).alias("dc"), lit(0).alias("dt")),
        )
        level = F.array(F.struct(low.alias("e"), lit(0).alias("dc"), dx.cast("double").alias("dt")))
        return F.when(high - low > LEVEL, sloped).otherwise(level)

    per_segment = let(
        bed,
        lambda z: F.zip_with(
            F.slice(z, F.lit(1), F.greatest(F.lit(0), F.size(z) - 1)), F.slice(z, F.lit(2), F.size(z)), events
        ),
    )
    ordered = F.array_sort(F.flatten(per_segment))
    piece = "struct<e:double,e2:double,t:double,c:double,a:double,s:double,a2:double,s2:double,qc2:double>"

    def close(s: Column, end: Column) -> Column:
        d = end - s["e"]

        def made(v: Column) -> Column:
            qc = F.when(v["t"] > 0, F.sqrt(lit(GRAVITY) * F.pow(v["a"], lit(3)) / F.when(v["t"] > 0, v["t"])))
            return F.struct(
                s["e"].alias("e"), end.alias("e2"), s["t"].alias("t"), s["c"].alias("c"), s["a"].alias("a"), s["s"].alias("s"),
                v["a"].alias("a2"), v["s"].alias("s2"), F.coalesce(qc, lit(0)).alias("qc2"),
            )

        at_end = F.struct(
            (s["t"] + s["c"] * d).alias("t"),
            (s["a"] + s["t"] * d + s["c"] * d * d / lit(2)).alias("a"),
            (s["s"] + s["a"] * d + s["t"] * d * d / lit(2) + s["c"] * d * d * d / lit(6)).alias("s"),
        )
        return let(at_end, made)

    def add(s: Column, ev: Column) -> Column:
        d = ev["e"] - s["e"]
        moved = F.struct(
            ev["e"].alias("e"), (s["t"] + s["c"] * d + ev["dt"]).alias("t"), (s["c"] + ev["dc"]).alias("c"),
            (s["a"] + s["t"] * d + s["c"] * d * d / lit(2)).alias("a"),
            (s["s"] + s["a"] * d + s["t"] * d * d / lit(2) + s["c"] * d * d * d / lit(6)).alias("s"),
            F.when(d > 0, F.concat(s["out"], F.array(close(s, ev["e"])))).otherwise(s["out"]).alias("out"),
        )
        return moved

    def begin(o: Column) -> Column:
        start = F.struct(
            F.get(o, F.lit(0))["e"].alias("e"), lit(0).alias("t"), lit(0).alias("c"), lit(0).alias("a"), lit(0).alias("s"),
            F.array().cast(f"array<{piece}>").alias("out"),
        )
        return F.aggregate(o, start, add, lambda s: F.concat(s["out"], F.array(close(s, lit(HIGHEST_DEPTH)))))

    return let(ordered, begin)


def top_width(stage: Column, y: Column) -> Column:
    def width(p: Column) -> Column:
        t = p["t"] + p["c"] * (y - p["e"])
        return F.when((y > 0) & (t > 0), t).otherwise(lit(DRY_WIDTH))

    return let(F.try_element_at(F.filter(stage, lambda p: p["e"] < y), F.lit(-1)), width)


def area_and_centroid(stage: Column, y: Column) -> Column:
    """``(a, yc)``: wetted area and depth of its centroid below the surface."""

    def props(p: Column) -> Column:
        d = y - p["e"]
        a = p["a"] + p["t"] * d + p["c"] * d * d / lit(2)
        s = p["s"] + p["a"] * d + p["t"] * d * d / lit(2) + p["c"] * d * d * d / lit(6)
        wet = (y > 0) & (a > 0)
        return F.struct(
            F.when(wet, a).otherwise(lit(DRY_AREA)).alias("a"),
            F.when(wet, s / F.when(wet, a)).otherwise(lit(DRY_AREA)).alias("yc"),
        )

    return let(F.try_element_at(F.filter(stage, lambda p: p["e"] < y), F.lit(-1)), props)


def section_froude(q: Column, stage: Column, y: Column) -> Column:
    def fr(g: Column) -> Column:
        return q / g["a"] / F.sqrt(lit(GRAVITY) * g["a"] / g["t"])

    both = let(area_and_centroid(stage, y), lambda p: F.struct(p["a"].alias("a"), top_width(stage, y).alias("t")))
    return F.when(y <= 0, lit(0)).otherwise(let(both, fr))


def critical_depth(q: Column, stage: Column) -> Column:
    """Lowest depth at which the section runs critical; NULL when there is none in the search range."""

    def solve(p: Column) -> Column:
        def faster(y: Column) -> Column:
            d = y - p["e"]
            a = p["a"] + d * (p["t"] + p["c"] * d / lit(2))
            return let(a, lambda a: q * q * (p["t"] + p["c"] * d) > lit(GRAVITY) * a * a * a)

        open_end = p["e2"] >= HIGHEST_DEPTH
        beyond = p["e"] + (F.cbrt(q * q * p["t"] / lit(GRAVITY)) - p["a"]) / F.when(p["t"] > 0, p["t"])
        root = bisect(F.greatest(p["e"], lit(LOWEST_DEPTH)), p["e2"], faster, HALVINGS)
        return F.when(open_end, F.greatest(p["e"], beyond)).otherwise(root)

    first = F.get(F.filter(stage, lambda p: (p["qc2"] >= q) & (p["e2"] > LOWEST_DEPTH)), F.lit(0))
    return F.when(q > 0, let(first, solve))


def momentum_at(q: Column, p: Column, y: Column) -> Column:
    # Nested products: searches walk this tree at every halving, so the depth stands in it as seldom as can be.
    d = y - p["e"]
    a = p["a"] + d * (p["t"] + d * p["c"] / lit(2))
    s = p["s"] + d * (p["a"] + d * (p["t"] / lit(2) + d * p["c"] / lit(6)))
    return let(a, lambda a: q * q / (lit(GRAVITY) * F.when(a > 0, a))) + s


def conjugate_by_momentum(q: Column, y1: Column, length: Column, stage: Column) -> Column:
    """``(y2, m1, m2)``: sequent depth in the surveyed section and the momentum on both sides."""
    a1 = y1 * length
    none = F.lit(None).cast("double")

    def with_m1(m1: Column) -> Column:
        def with_yc(yc: Column) -> Column:
            def with_piece(p: Column) -> Column:
                lo = F.greatest(p["e"], yc)
                # the moment alone reaches m1 at this depth, so the root is not beyond it
                hi = F.when(p["e2"] >= HIGHEST_DEPTH, p["e"] + F.sqrt(lit(2) * m1 / F.when(p["t"] > 0, p["t"]))).otherwise(p["e2"])
                y2 = bisect(lo, F.greatest(lo, hi), lambda y: momentum_at(q, p, y) < m1, HALVINGS)
                return let(
                    F.when(p["e"].isNotNull() & yc.isNotNull(), y2),
                    lambda y: F.struct(y.alias("y2"), m1.alias("m1"), momentum_at(q, p, y).alias("m2")),
                )

            at_yc = let(F.try_element_at(F.filter(stage, lambda p: p["e"] < yc), F.lit(-1)), lambda p: momentum_at(q, p, yc))
            pieces = F.filter(
                stage, lambda p: (p["e2"] > yc) & (q * q / (lit(GRAVITY) * F.when(p["a2"] > 0, p["a2"])) + p["s2"] >= m1)
            )
            return let(F.when(at_yc <= m1, F.get(pieces, F.lit(0))), with_piece)

        return let(critical_depth(q, stage), with_yc)

    solved = let(F.when(a1 > DRY_AREA, q * q / (lit(GRAVITY) * a1) + a1 * y1 / lit(2)), with_m1)
    empty = F.struct(none.alias("y2"), none.alias("m1"), none.alias("m2"))
    return F.when(a1 > DRY_AREA, solved).otherwise(empty)


def danger_range_momentum(
    length: Column, p: Column, a: Column, b: Column, stage: Column, q_lo: Column, q_hi: Column
) -> tuple[Column, Column]:
    """Discharges at which the tailwater curve meets the momentum conjugate depth and the flip depth."""

    def gap(target):
        def residual(q: Column) -> Column:
            def from_head(h: Column) -> Column:
                def from_y1(y1: Column) -> Column:
                    return F.when(y1.isNotNull(), target(q, y1) - tailwater(q, a, b))

                return let(inline({"h": h, "p": p}, Y1_STEPS, "y1"), from_y1)

            value = F.coalesce(let(weir_head(q, length), from_head), lit(NO_FLOW))
            return F.when(q <= lit(SMALLEST_FLOW), lit(NO_FLOW)).otherwise(value)

        return residual

    conjugate = gap(lambda q, y1: conjugate_by_momentum(q, y1, length, stage)["y2"])
    flip = gap(lambda q, _y1: inline({"q": q, "l": length, "p": p}, FLIP_STEPS, "flip"))
    known = p.isNotNull()
    return (
        F.when(known, root_or_bound(conjugate, q_lo, q_hi, HALVINGS)),
        F.when(known, root_or_bound(flip, q_lo, q_hi, HALVINGS)),
    )
