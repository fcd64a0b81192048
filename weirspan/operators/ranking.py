"""Exact ranks, quantiles and nearest-value lookups that survive one key holding most of the rows.

A window over a key would put that key's rows into one task. Equal values are therefore counted together first (a
combine before the shuffle), and the values of every key are cut into fixed steps of a monotone scale, so no task
sorts more than one step of one key. Ranks come from the running count inside the step plus the counts of the
steps before it. One plan serves all sizes: nothing is sampled and nothing visits the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirspan.session import merged

# Steps per e-fold of a value, and the size from which on the scale is logarithmic; a key has under two million steps.
STEPS_PER_E_FOLD = 1024
SMALLEST = 1e-6
# Rows per block of a running sum.
SUM_BLOCK = 1_000_000
# Rows written per task when a heavily repeated value is expanded again.
EXPAND_BLOCK = 100_000


def step_of(v: Column) -> Column:
    """Whole number that never falls when ``v`` rises: sign and logarithm of the value, cut into steps."""
    size = F.least(F.log1p(F.abs(v) / F.lit(SMALLEST)) * STEPS_PER_E_FOLD, F.lit(2e6))
    return F.floor(F.when(v < 0, -size).otherwise(size)).cast("int")


def _known(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.select(*keys, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key and distinct value with its multiplicity ``cnt``; NULL and NaN values left out."""
    return _known(df, keys, value).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("cnt"))


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values ``v`` with ``cnt``, the number of smaller rows ``before`` and the key's ``total``."""
    keys = list(keys)
    values = value_counts(df, keys, value).withColumn("step", step_of(F.col("v")))
    inside = W.partitionBy(*keys, "step").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    across = W.partitionBy(*keys).orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = values.groupBy(*keys, "step").agg(F.sum("cnt").alias("rows"))
    steps = steps.select(*keys, "step", (F.sum("rows").over(across) - F.col("rows")).alias("offset"), F.sum("rows").over(W.partitionBy(*keys)).alias("total"))
    ranked = values.withColumn("upto", F.sum("cnt").over(inside)).join(steps, [*keys, "step"])
    return ranked.select(*keys, "v", "cnt", (F.col("offset") + F.col("upto") - F.col("cnt")).alias("before"), "total")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, names: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row per key, one column per entry of ``names``."""
    cum = cumulative_counts(df, keys, value)
    last = F.col("total") - 1

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("cnt")), F.col("v")))

    picks, outs = [], []
    for name, p in names.items():
        place = last * F.lit(float(p))
        picks += [at(F.floor(place)).alias(f"{name}__lo"), at(F.ceil(place)).alias(f"{name}__hi")]
        part = (F.col("total__") - 1) * F.lit(float(p))
        part = part - F.floor(part)
        outs.append((F.col(f"{name}__lo") + (F.col(f"{name}__hi") - F.col(f"{name}__lo")) * part).alias(name))
    return cum.groupBy(*keys).agg(F.first("total").alias("total__"), *picks).select(*keys, *outs)


def median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5})


def ranked_rows(df: DataFrame, keys: Sequence[str], value: str, descending: bool = False) -> DataFrame:
    """One row per input row: ``keys, v, rank, total`` with ranks 1..total, ties in consecutive ranks."""
    cum = cumulative_counts(df, keys, value)
    first = (F.col("total") - F.col("before") - F.col("cnt")) if descending else F.col("before")
    blocks = cum.select(
        *keys, "v", "cnt", "total", first.alias("first"),
        F.explode(F.sequence(F.lit(0), F.floor((F.col("cnt") - 1) / EXPAND_BLOCK))).alias("block"),
    ).repartition(*keys, "v", "block")
    start = F.col("block") * EXPAND_BLOCK
    return blocks.select(
        *keys, "v", "total", "first",
        F.explode(F.sequence(start + 1, F.least(start + EXPAND_BLOCK, F.col("cnt")))).alias("i"),
    ).select(*keys, "v", (F.col("first") + F.col("i")).alias("rank"), "total")


def _point(v: str, pay: str, known: Column) -> Column:
    return F.when(known, F.struct(F.col(v).alias("v"), F.col(pay).alias("pay")))


def nearest_answers(asked: DataFrame, curve: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """``keys, q, value, payload`` for every distinct asked value ``q``: the curve point nearest in value.

    ``asked`` holds ``(keys, q)``, ``curve`` distinct ``(keys, v)`` with ``payload``. Both sides are merged in
    value order and each question sees the last point below and the first point above, so no question meets
    more than two points. A tie takes the larger value.
    """
    keys = list(keys)
    questions = value_counts(asked, keys, "q").select(*keys, "v", F.lit(None).cast("double").alias("pay"), F.lit(1).alias("side"))
    known = curve.select(*keys, "v", F.col(payload).cast("double").alias("pay"), F.lit(0).alias("side"))
    merged = known.unionByName(questions).withColumn("step", step_of(F.col("v")))
    group = [*keys, "step"]
    on_curve = F.col("side") == 0
    order = W.partitionBy(*group).orderBy("v", "side")
    point = _point("v", "pay", on_curve)
    seen = merged.select(
        *group, "v", "side",
        F.last(point, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("below"),
        F.first(point, ignorenulls=True).over(order.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("above"),
    ).where(F.col("side") == 1)
    # Points carried in from neighbouring steps; one row per key and step.
    at = F.when(on_curve, F.col("v"))
    ends = merged.groupBy(*group).agg(
        F.max(at).alias("hi_v"), F.max_by("pay", at).alias("hi_p"), F.min(at).alias("lo_v"), F.min_by("pay", at).alias("lo_p")
    )
    line = W.partitionBy(*keys).orderBy("step")
    ends = ends.select(
        *group,
        F.last(_point("hi_v", "hi_p", F.col("hi_v").isNotNull()), ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)).alias("carry_below"),
        F.first(_point("lo_v", "lo_p", F.col("lo_v").isNotNull()), ignorenulls=True).over(line.rowsBetween(1, W.unboundedFollowing)).alias("carry_above"),
    )
    seen = seen.join(ends, group)
    below, above = F.coalesce("below", "carry_below"), F.coalesce("above", "carry_above")
    take_above = below.isNull() | (above["v"] - F.col("v") <= F.col("v") - below["v"])
    best = F.when(take_above & above.isNotNull(), above).otherwise(below)
    found = seen.select(*keys, F.col("v").alias("q"), best.alias("best"))
    return found.select(*keys, "q", F.col("best.v").alias("value"), F.col("best.pay").alias("payload"))


def nearest_value(lookups: DataFrame, curve: DataFrame, keys: Sequence[str], outs: dict[str, str], payload: str) -> DataFrame:
    """Add the payload of the nearest curve point for each value column of ``outs`` (value -> new column)."""
    keys = list(keys)
    asked = lookups.select(*keys, F.explode(F.array(*[F.col(c).cast("double") for c in outs])).alias("q"))
    answers = nearest_answers(asked, curve, keys, payload)
    for c, out in outs.items():
        one = answers.select(*keys, F.col("q").alias("__q"), F.col("payload").alias(out))
        lookups = lookups.withColumn("__q", F.col(c).cast("double")).join(one, [*keys, "__q"], "left").drop("__q")
    return lookups


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, block: int = SUM_BLOCK) -> DataFrame:
    """Sum of ``value`` up to and including the row, by the whole-number column ``order``.

    The order is cut into blocks, so a key with very many rows is summed by many tasks.
    """
    keys = list(keys)
    cut = df.withColumns({"__b": F.floor(F.col(order) / block), "__x": value})
    inside = W.partitionBy(*keys, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    across = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = cut.groupBy(*keys, "__b").agg(F.sum("__x").alias("__s"))
    sums = sums.select(*keys, "__b", (F.sum("__s").over(across) - F.col("__s")).alias("__before"))
    own = cut.withColumn("__own", F.sum("__x").over(inside))
    return own.join(merged(sums), [*keys, "__b"]).select(*df.columns, (F.col("__before") + F.coalesce("__own", F.lit(0.0))).alias(out))
