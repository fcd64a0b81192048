"""Weir and hydraulic-jump formulas as column expressions. Undefined results are NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirspan.functions.steps import Step, bisect, inline, let, project

# Fixed values of the hydraulic model: gravity, free-flow weir coefficient, the Rehbock pair of the
# plunging regime, the submergence limit and the flip-depth divisor.
GRAVITY = 9.81
WEIR_COEFFICIENT = 0.62
REHBOCK_BASE, REHBOCK_SLOPE = 0.611, 0.075
SUBMERGENCE_LIMIT = 0.48
SUBMERGENCE_CAP = 0.999
FLIP_DIVISOR = 1.1

ROOT_2G = math.sqrt(2 * GRAVITY)
SUBMERGED_FACTOR = math.sqrt(0.4)


def lit(x: float) -> Column:
    return F.lit(float(x))


def weir_head(q: Column, length: Column) -> Column:
    """Free-flow head over the crest."""
    return F.pow(lit(1.5) * q / length / lit(WEIR_COEFFICIENT) / lit(ROOT_2G), lit(2 / 3))


def rehbock_coefficient(h: Column, p: Column) -> Column:
    return F.when(p != 0, lit(REHBOCK_BASE) + lit(REHBOCK_SLOPE) * h / p)


def flip_depth_simple(h: Column, p: Column) -> Column:
    return (h + p) / lit(FLIP_DIVISOR)


def jump_residual(fr: Column, x: Column) -> Column:
    """Energy balance of the jump toe for a Froude number and a height ratio ``x = H/P``."""
    half = lit(0.5) * fr * fr
    return (
        lit(1)
        - F.cbrt(lit(9 / (4 * WEIR_COEFFICIENT**2)) * half) * (lit(1) + lit(1) / x)
        + half * (lit(1) + lit(0.1) / x)
    )


# Supercritical depth: the smaller positive root of x^3 - b x^2 + d = 0 with x = y1/H.
Y1_STEPS: list[Step] = [
    ("ratio", lambda c: F.when(c.h > 0, c.p / c.h)),
    ("b", lambda c: lit(1) + c.ratio),
    ("d", lambda c: lit(4 / 9 * WEIR_COEFFICIENT**2) * (lit(1) + lit(0.1) * c.ratio)),
    ("arg", lambda c: lit(1) - lit(13.5) * c.d / (c.b * c.b * c.b)),
    ("ok", lambda c: (c.b > 0) & (F.abs(c.arg) <= 1)),
    (
        "x0",
        lambda c: F.when(
            c.ok, c.b / lit(3) * (lit(1) - lit(2) * F.cos((F.acos(F.when(c.ok, c.arg)) + lit(math.pi)) / lit(3)))
        ),
    ),
    # One Newton step: the small root is a difference of two nearly equal numbers.
    ("x", lambda c: c.x0 - (c.x0 * c.x0 * (c.x0 - c.b) + c.d) / (c.x0 * (lit(3) * c.x0 - lit(2) * c.b))),
    ("y1", lambda c: F.when((c.p >= 0) & (c.h <= 0), lit(0)).when((c.p >= 0) & (c.x > 0), c.x * c.h)),
]

# Froude number at y1: largest root of (1+0.1r) u^3 - k (1+r) u + 1 = 0 with Fr^2 = 2 u^3, kept only
# when the residual changes sign between Froude 1 and 20, else critical flow.
FROUDE_K = (9 / (4 * WEIR_COEFFICIENT**2)) ** (1 / 3)
FROUDE_STEPS: list[Step] = [
    ("ratio", lambda c: F.when(c.h > 0, c.p / c.h)),
    ("a", lambda c: lit(1) + lit(0.1) * c.ratio),
    ("m", lambda c: lit(FROUDE_K) * (lit(1) + c.ratio) / c.a),
    ("arg", lambda c: lit(-1.5) / (c.a * c.m) * F.sqrt(lit(3) / c.m)),
    ("f1", lambda c: lit(1) - lit(FROUDE_K * 0.5 ** (1 / 3)) * (lit(1) + c.ratio) + lit(0.5) * c.a),
    ("f20", lambda c: lit(1) - lit(FROUDE_K * 200.0 ** (1 / 3)) * (lit(1) + c.ratio) + lit(200) * c.a),
    ("ok", lambda c: (c.f1 * c.f20 <= 0) & (F.abs(c.arg) <= 1)),
    ("u", lambda c: F.when(c.ok, lit(2) * F.sqrt(c.m / lit(3)) * F.cos(F.acos(F.when(c.ok, c.arg)) / lit(3)))),
    (
        "fr",
        lambda c: F.when(c.h.isNull() | c.p.isNull() | (c.p < 0), None)
        .when(c.h <= 0, lit(0))
        .when(c.ok, F.sqrt(lit(2) * c.u * c.u * c.u))
        .otherwise(lit(1)),
    ),
]

# Flip depth s*H + P, with s the larger of the submergence limit and (1 - 0.1 P/H)/1.1.
FLIP_A = 1 - 1 / FLIP_DIVISOR**2
FLIP_STEPS: list[Step] = [
    ("c2", lambda c: F.when((c.q > 0) & (c.p >= 0), F.pow(lit(1.5) * c.q / (lit(SUBMERGED_FACTOR) * c.l * lit(ROOT_2G)), lit(2)))),
    ("h1", lambda c: F.cbrt(c.c2 / lit(1 - SUBMERGENCE_LIMIT**2))),
    # depressed cubic of the second regime: t^3 + pp t + qq = 0, H = t - b/3
    ("b", lambda c: lit(0.2 / FLIP_DIVISOR**2 / FLIP_A) * c.p),
    ("cc", lambda c: lit(-0.01 / FLIP_DIVISOR**2 / FLIP_A) * c.p * c.p),
    ("pp", lambda c: c.cc - c.b * c.b / lit(3)),
    ("qq", lambda c: lit(2 / 27) * c.b * c.b * c.b - c.b * c.cc / lit(3) - c.c2 / lit(FLIP_A)),
    ("r", lambda c: F.sqrt(-c.pp / lit(3))),
    ("arg", lambda c: F.when(c.r > 0, -c.qq / (lit(2) * c.r * c.r * c.r))),
    (
        "t",
        lambda c: F.when(c.arg.isNull(), F.cbrt(-c.qq))
        .when(F.abs(c.arg) <= 1, lit(2) * c.r * F.cos(F.acos(F.when(F.abs(c.arg) <= 1, c.arg)) / lit(3)))
        .otherwise(
            lit(2) * F.signum(c.arg) * c.r * F.cosh(F.acosh(F.when(F.abs(c.arg) > 1, F.abs(c.arg))) / lit(3))
        ),
    ),
    ("h", lambda c: F.when(c.h1 <= lit(0.1 / 0.472) * c.p, c.h1).otherwise(c.t - c.b / lit(3))),
    (
        "flip",
        lambda c: F.greatest(lit(SUBMERGENCE_LIMIT), (lit(1) - lit(0.1) * c.p / c.h) / lit(FLIP_DIVISOR)) * c.h + c.p,
    ),
]


def y1(h: Column, p: Column) -> Column:
    return inline({"h": h, "p": p}, Y1_STEPS, "y1")


def froude_y1(h: Column, p: Column) -> Column:
    return inline({"h": h, "p": p}, FROUDE_STEPS, "fr")


def flip_depth(q: Column, length: Column, p: Column) -> Column:
    return inline({"q": q, "l": length, "p": p}, FLIP_STEPS, "flip")


def conjugate_depth(y1_: Column, fr: Column) -> Column:
    """Sequent depth of a rectangular jump."""
    return y1_ / lit(2) * (F.sqrt(lit(1) + lit(8) * fr * fr) - lit(1))


def conjugate_depth_of_head(h: Column, p: Column) -> Column:
    return let(F.struct(y1(h, p).alias("y"), froude_y1(h, p).alias("f")), lambda s: conjugate_depth(s["y"], s["f"]))


def with_y1(df: DataFrame, h: Column, p: Column, out: str = "y_1") -> DataFrame:
    return project(df, {"h": h, "p": p}, Y1_STEPS, {"y1": out})


def with_froude(df: DataFrame, h: Column, p: Column, out: str = "fr_1") -> DataFrame:
    return project(df, {"h": h, "p": p}, FROUDE_STEPS, {"fr": out})


def with_flip_depth(df: DataFrame, q: Column, length: Column, p: Column, out: str = "y_flip") -> DataFrame:
    return project(df, {"q": q, "l": length, "p": p}, FLIP_STEPS, {"flip": out})


def tailwater(q: Column, a: Column, b: Column) -> Column:
    return a * F.pow(q, b)


def jump_type(y2: Column, yt: Column, flip: Column) -> Column:
    """A swept out, B optimal, C submerged with a surface roller (dangerous), D flipped."""
    return (
        F.when(y2.isNull() | flip.isNull() | (y2 <= 0), F.lit("N/A"))
        .when(yt < y2, F.lit("A"))
        .when(yt == y2, F.lit("B"))
        .when((yt > y2) & (yt < flip), F.lit("C"))
        .when(yt >= flip, F.lit("D"))
        .otherwise(F.lit("N/A"))
    )


def weir_residual(h: Column, q: Column, length: Column, total: Column, dwse: Column) -> Column:
    """Discharge over the crest minus ``q``: plunging regime up to ``h = dwse``, submerged above."""
    p = total - h
    s = F.least((h - dwse) / h, lit(SUBMERGENCE_CAP))
    coefficient = F.when(h <= dwse, lit(REHBOCK_BASE) + lit(REHBOCK_SLOPE) * h / p).otherwise(
        lit(SUBMERGED_FACTOR) * F.sqrt(lit(1) - s * s)
    )
    flow = lit(2 / 3) * coefficient * length * lit(ROOT_2G) * F.pow(h, lit(1.5)) - q
    return F.when(p <= 0, lit(1e9)).otherwise(flow)


def weir_head_any_regime(q: Column, length: Column, yt: Column, dwse: Column) -> Column:
    """Head by bisection on [0.1, 10] x the free-flow head; that head itself without a sign change."""
    total = yt + dwse

    def solve(h0: Column) -> Column:
        lo, hi = lit(0.1) * h0, lit(10) * h0
        ends = F.struct(
            weir_residual(lo, q, length, total, dwse).alias("lo"), weir_residual(hi, q, length, total, dwse).alias("hi")
        )

        def search(e: Column) -> Column:
            root = bisect(lo, hi, lambda mid: weir_residual(mid, q, length, total, dwse) * F.signum(e["lo"]) > 0)
            return F.when(e["lo"] * e["hi"] < 0, root).otherwise(h0)

        return let(ends, search)

    return let(weir_head(q, length), solve)


def with_weir_geometry(
    df: DataFrame, q: Column, length: Column, yt: Column, dwse: Column, head: str = "head", height: str = "p_height"
) -> DataFrame:
    """Head and structure height; both NULL when the height would be negative."""
    out = df.withColumn("__h", weir_head_any_regime(q, length, yt, dwse)).withColumn("__p", yt + dwse - F.col("__h"))
    keep = [c for c in df.columns if c not in (head, height)]
    return out.select(
        *keep,
        F.when(F.col("__p") >= 0, F.col("__h")).alias(head),
        F.when(F.col("__p") >= 0, F.col("__p")).alias(height),
    )


def root_or_bound(residual, lo: Column, hi: Column, halvings: int = 45) -> Column:
    """Root of ``residual`` on [lo, hi]; without a sign change the lower bound if negative, else the upper."""
    ends = F.struct(residual(lo).alias("lo"), residual(hi).alias("hi"))

    def search(e: Column) -> Column:
        root = bisect(lo, hi, lambda mid: residual(mid) * F.signum(e["lo"]) > 0, halvings)
        return F.when(e["lo"] * e["hi"] < 0, root).when(e["lo"] < 0, lo).otherwise(hi)

    return let(ends, search)


# Residual at flows too small to have a target depth, that flow, and the depth that stands for a missing target.
NO_FLOW = 1e6
SMALLEST_FLOW = 0.001
NO_DEPTH = -9999.0


def danger_range_rectangular(
    length: Column, p: Column, a: Column, b: Column, q_lo: Column, q_hi: Column
) -> tuple[Column, Column]:
    """Discharges at which the tailwater curve meets the conjugate and the flip depth.

    Where no target depth exists it lies below any tailwater, so the search also ends where the depth vanishes.
    """

    def gap(target):
        def residual(q: Column) -> Column:
            value = F.coalesce(target(q), lit(NO_DEPTH)) - tailwater(q, a, b)
            return F.when(q <= lit(SMALLEST_FLOW), lit(NO_FLOW)).otherwise(value)

        return residual

    conjugate = gap(lambda q: let(weir_head(q, length), lambda h: conjugate_depth_of_head(h, p)))
    flip = gap(lambda q: flip_depth(q, length, p))
    known = p.isNotNull()
    return (
        F.when(known, root_or_bound(conjugate, q_lo, q_hi)),
        F.when(known, root_or_bound(flip, q_lo, q_hi)),
    )
