"""Validation of predictions against recorded incidents and surveyed heights, per source combination."""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirspan.operators import keyed, ranking

# A combination of flow-line and streamflow source; there are two of each, so a table with one row per
# combination (or per combination and cross-section) always fits a broadcast.
COMBO = ["flowline", "streamflow"]
# Plausible heights, jump classes reported, slope classes, histogram bins, density grid,
# agreement marks.
MAX_HEIGHT = 65
REPORTED_JUMPS = ("A", "C", "D")
SLOPE_CLASSES = ("Low", "Medium", "High", "Very High")
BAND_BINS = 10
GRID_POINTS = 500
# Width of a cell and reach of a kernel in bandwidths, and terms of the series, of a density.
DENSITY_CELL, DENSITY_REACH, DENSITY_TERMS = 0.5, 9.0, 16
AGREEMENT_MARKS = (0.0, 0.25, 0.5, 0.75, 1.0)


def danger_bands(sections: DataFrame) -> DataFrame:
    """Exceedance band of a site: lowest upper and highest lower probability of its sections."""
    known = sections.dropna(subset=["prob_min", "prob_max"])
    bands = known.groupBy(*COMBO, "site_id").agg(F.min("prob_max").alias("prob_max"), F.max("prob_min").alias("prob_min"))
    return bands.withColumn("width", F.abs(F.col("prob_min") - F.col("prob_max")))


def incident_hits(results: DataFrame) -> DataFrame:
    """Whether any section of the site was dangerous (class C) on the day of the incident."""
    known = results.dropna(subset=["jump_type", "date"])
    return known.groupBy(*COMBO, "site_id", "date").agg(F.bool_or(F.col("jump_type") == "C").alias("hit"))


def site_classes(results: DataFrame, sites: DataFrame) -> DataFrame:
    """Per combination and site: any incident caught, none caught, or no results at all."""
    combos = F.explode(F.array(*[F.struct(F.lit(a).alias("flowline"), F.lit(b).alias("streamflow")) for a in ("NHD", "TDX") for b in ("NWM", "GEO")]))
    wanted = sites.select("site_id", combos.alias("c")).select("c.*", "site_id")
    hits = incident_hits(results).groupBy(*COMBO, "site_id").agg(F.bool_or("hit").alias("hit"))
    text = F.when(F.col("hit").isNull(), "Unavailable").when(F.col("hit"), "True Positive").otherwise("False Negative")
    return wanted.join(hits, [*COMBO, "site_id"], "left").select(*COMBO, "site_id", text.alias("class"))


def strict_sites(results: DataFrame) -> DataFrame:
    """A site succeeds only if all of its incidents were caught."""
    return incident_hits(results).groupBy(*COMBO, "site_id").agg(F.bool_and("hit").alias("success"))


def class_shares(classes: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each class within its combination."""
    counts = classes.groupBy(*COMBO, column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*COMBO).agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), COMBO).withColumn("pct", F.lit(100.0) * F.col("n") / F.col("total"))


def jump_shares(results: DataFrame) -> DataFrame:
    """Share of each reported jump class per combination and cross-section."""
    known = results.where(F.col("jump_type").isNotNull())
    wide = known.groupBy(*COMBO, "xs_index").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("jump_type") == j).alias(j) for j in REPORTED_JUMPS]
    )
    long = wide.unpivot([*COMBO, "xs_index", "total"], list(REPORTED_JUMPS), "jump_type", "n")
    return long.withColumn("pct", F.lit(100.0) * F.col("n") / F.col("total"))


def danger_rate(results: DataFrame) -> DataFrame:
    """Share of class C per cross-section."""
    known = results.where(F.col("jump_type").isNotNull())
    out = known.groupBy(*COMBO, "xs_index").agg(F.count_if(F.col("jump_type") == "C").alias("n"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("pct", F.lit(100.0) * F.col("n") / F.col("total"))


def plausible(sections: DataFrame, open_low: bool = True) -> DataFrame:
    return sections.where(keyed.within(F.col("p_height"), 0, MAX_HEIGHT, open_low))


def median_heights(sections: DataFrame) -> DataFrame:
    return ranking.median(plausible(sections), [*COMBO, "site_id"], "p_height", "p_height")


def predicted_and_known(sections: DataFrame, sites: DataFrame) -> DataFrame:
    known = sites.where(F.col("p_known").isNotNull()).select("site_id", "p_known")
    return sections.join(known, "site_id")


def error_metrics(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMSE, bias, MAE and squared correlation of predicted against known heights; NULL for a single pair."""
    e = F.col("p_height") - F.col("p_known")
    many = F.count(F.lit(1)) > 1
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(many, F.sqrt(F.avg(e * e))).alias("rmse"),
        F.when(many, F.avg(e)).alias("bias"),
        F.when(many, F.avg(F.abs(e))).alias("mae"),
        F.when(many, F.pow(F.corr("p_height", "p_known"), F.lit(2.0))).alias("r2"),
    )


def height_summary(sections: DataFrame) -> DataFrame:
    keys = [*COMBO, "xs_index"]
    rows = plausible(sections, open_low=False).where("xs_index BETWEEN 1 AND 4")
    stats = rows.groupBy(*keys).agg(
        F.min("p_height").alias("min"), F.max("p_height").alias("max"), F.avg("p_height").alias("mean"), F.count("p_height").alias("n")
    )
    return stats.join(ranking.median(rows, keys, "p_height"), keys)


def incident_counts(results: DataFrame) -> DataFrame:
    days = incident_hits(results).groupBy(*COMBO, "site_id").agg(F.count(F.lit(1)).alias("k"))
    out = days.groupBy(*COMBO).agg(F.sum("k").alias("incidents"), F.count(F.lit(1)).alias("sites"))
    return out.withColumn("per_site", F.col("incidents") / F.col("sites"))


def band_histogram(bands: DataFrame, least: float = 0.0) -> DataFrame:
    """Ten bins of band width from 0 to 100, the last one closed; empty bins included."""
    rows = bands.where(F.col("width") >= least)
    b = F.when(F.col("width") <= 100, F.least(F.lit(BAND_BINS - 1), F.floor(F.col("width") / 10)))
    counts = rows.groupBy(*COMBO, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy(*COMBO).agg(F.count(F.lit(1)).alias("total"), F.avg("width").alias("mean_width"))
    frame = totals.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BAND_BINS - 1).cast("bigint"))))
    out = frame.join(counts, [*COMBO, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("pct", F.lit(100.0) * F.col("n") / F.col("total"))


def paired_bands(bands: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Bands of two combinations side by side; either may be missing for a site."""

    def one(combo: tuple[str, str], tag: str) -> DataFrame:
        rows = bands.where((F.col("flowline") == combo[0]) & (F.col("streamflow") == combo[1]))
        return rows.select("site_id", F.least("prob_max", "prob_min").alias(f"{tag}_low"), F.greatest("prob_max", "prob_min").alias(f"{tag}_high"))

    return one(a, "a").join(one(b, "b"), "site_id", "full")


def jaccard(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Overlap of two intervals over their union; two points agree only if equal."""
    both = F.greatest(F.lit(0.0), F.least(a_high, b_high) - F.greatest(a_low, b_low))
    union = (a_high - a_low) + (b_high - b_low) - both
    same = F.when((a_low == b_low) & (a_high == b_high), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(union > 0, both / F.when(union > 0, union)).otherwise(same)


def agreement(pairs: DataFrame) -> DataFrame:
    both = pairs.dropna()
    return both.withColumn("jaccard", jaccard(*[F.col(c) for c in ("a_low", "a_high", "b_low", "b_high")]))


def agreement_summary(scored: DataFrame) -> DataFrame:
    whole = scored.withColumn("all", F.lit(0))
    out = whole.groupBy("all").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("jaccard") == 0).alias("zero"),
        F.count_if(F.col("jaccard") >= 0.99).alias("near_perfect"), F.avg("jaccard").alias("mean"),
    )
    return out.join(ranking.median(whole, ["all"], "jaccard"), "all").drop("all")


def agreement_order(scored: DataFrame) -> DataFrame:
    """Sites by rising agreement; ``place`` counts the sites with a smaller agreement."""
    whole = scored.withColumns({"all": F.lit(0), "v": F.col("jaccard")})
    places = ranking.cumulative_counts(whole, ["all"], "v").select("all", "v", F.col("before").alias("place"), "cnt")
    return whole.join(places, ["all", "v"]).drop("all", "v")


def agreement_marks(scored: DataFrame) -> DataFrame:
    """For each mark the place of the site whose agreement is closest, the first on a tie."""
    order = agreement_order(scored)
    picks = [F.min_by(F.struct("place", "jaccard"), F.struct(F.abs(F.col("jaccard") - m), F.col("place"))).alias(f"m{i}") for i, m in enumerate(AGREEMENT_MARKS)]
    marks = F.array(*[F.struct(F.lit(m).alias("mark"), F.col(f"m{i}.place").alias("place"), F.col(f"m{i}.jaccard").alias("jaccard")) for i, m in enumerate(AGREEMENT_MARKS)])
    return order.agg(*picks).select(F.inline(marks))


def slope_quartiles(rows: DataFrame) -> DataFrame:
    return ranking.quantiles(rows.withColumn("all", F.lit(0)), ["all"], "slope", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


def slope_class_fit(pairs: DataFrame) -> DataFrame:
    """Squared correlation per combination and slope class; classes are the quartiles over all combinations."""
    q = F.broadcast(slope_quartiles(pairs))  # one row
    rows = pairs.withColumn("all", F.lit(0)).join(q, "all")
    s = F.col("slope")
    label = F.when(s <= F.col("q1"), SLOPE_CLASSES[0]).when(s <= F.col("q2"), SLOPE_CLASSES[1]).when(s <= F.col("q3"), SLOPE_CLASSES[2]).otherwise(SLOPE_CLASSES[3])
    fits = rows.withColumn("slope_class", label).groupBy(*COMBO, "slope_class").agg(
        F.count(F.lit(1)).alias("n"), F.pow(F.corr("p_known", "p_height"), F.lit(2.0)).alias("r2")
    )
    return fits.where(F.col("n") > 1)


def empirical_cdf(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    out = ranking.ranked_rows(rows, keys, value)
    return out.select(*keys, F.col("v").alias(value), (F.col("rank") / F.col("total")).alias("cdf"))


def kernel_density(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Gaussian density with Scott's bandwidth at 500 points from 0 to the largest value of each key.

    A fast Gauss sum: values are cut into cells half a bandwidth wide, and each cell is summed into the first
    ``DENSITY_TERMS`` coefficients of its Hermite series, so all values of a cell are one row before the shuffle. A cell
    is evaluated at the points within ``DENSITY_REACH`` bandwidths only. Cells times points then depend on neither the
    number of values nor that of distinct ones. What the two cuts leave out is under 1e-16 of the largest possible
    density. A key with one value or equal values only has no bandwidth, and NULL densities; NaN counts as NULL.
    ``keys`` are those of a combination, so the moments are a handful of rows.
    """
    known = rows.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    moments = known.groupBy(*keys).agg(
        F.count("v").alias("n"), F.max("v").alias("top"), F.nullif(F.stddev_samp("v") * F.pow(F.count("v").cast("double"), F.lit(-0.2)), F.lit(0.0)).alias("h")
    )
    step = F.col("top") / F.lit(GRID_POINTS - 1)
    centre = (F.col("cell") + 0.5) * F.col("h") * F.lit(DENSITY_CELL)
    scale = F.col("h") * F.lit(2.0**0.5)
    in_cells = known.join(F.broadcast(moments), list(keys)).where("h is not null").withColumn("cell", F.floor(F.col("v") / (F.col("h") * F.lit(DENSITY_CELL))))
    near = in_cells.withColumn("t", (F.col("v") - centre) / scale)
    cells = near.groupBy(*keys, "n", "h", "top", "cell").agg(*[F.sum(F.pow("t", F.lit(float(k))) / F.lit(float(factorial(k)))).alias(f"a{k}") for k in range(DENSITY_TERMS)])
    # The points a cell reaches, in either direction of the grid.
    ends = [(centre + F.lit(sign * DENSITY_REACH) * F.col("h")) / step for sign in (-1, 1)]
    first, last = F.greatest(F.ceil(F.least(*ends)), F.lit(0)), F.least(F.floor(F.greatest(*ends)), F.lit(GRID_POINTS - 1))
    reached = cells.where((step != 0) & (first <= last)).withColumn("i", F.explode(F.sequence(first, last)))
    reached = reached.unionByName(cells.where(step == 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(GRID_POINTS - 1).cast("bigint")))))
    parts = reached.withColumn("u", (step * F.col("i") - centre) / scale)

    def term(acc: Column, a: Column) -> Column:
        """Hermite polynomials by their recurrence, summed with their coefficients."""
        following = F.col("u") * 2 * acc["cur"] - acc["k"] * 2 * acc["prev"]
        return F.struct(acc["cur"].alias("prev"), following.alias("cur"), (acc["sum"] + a * acc["cur"]).alias("sum"), (acc["k"] + 1).alias("k"))

    start = F.struct(F.lit(0.0).alias("prev"), F.lit(1.0).alias("cur"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("k"))
    series = F.aggregate(F.array(*[F.col(f"a{k}") for k in range(DENSITY_TERMS)]), start, term, lambda acc: acc["sum"])
    sums = parts.groupBy(*keys, "i").agg(F.sum(F.exp(-F.col("u") * F.col("u")) * series).alias("s"))
    grid = moments.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(GRID_POINTS - 1).cast("bigint"))))
    root_2pi = 2.5066282746310002
    density = F.when(F.col("h").isNotNull(), F.coalesce("s", F.lit(0.0))) / (F.col("n") * F.col("h") * F.lit(root_2pi))
    return grid.join(sums, [*keys, "i"], "left").select(*keys, "i", (F.col("top") * F.col("i") / F.lit(GRID_POINTS - 1)).alias("x"), density.alias("density"))


def site_banding(rows: DataFrame, key: str = "site_id") -> DataFrame:
    """Consecutive rank of each site in id order, and the alternating band it is drawn on."""
    ids = rows.select(key).distinct().withColumns({"all": F.lit(0), "k": F.col(key)})
    ranks = ranking.cumulative_counts(ids, ["all"], "k")
    return ranks.select(F.col("v").cast("bigint").alias(key), F.col("before").alias("rank"), (F.col("before") % 2).alias("band"))


# The two combinations whose bands are compared.
AGREEING = (("NHD", "NWM"), ("TDX", "GEO"))


def report(results: DataFrame, sections: DataFrame, sites: DataFrame) -> DataFrame:
    """The validation figures of every combination as one long table."""

    def long(df: DataFrame, name: str, label: Column, value: str) -> DataFrame:
        return df.select(*COMBO, F.lit(name).alias("statistic"), label.cast("string").alias("label"), F.col(value).cast("double").alias("value"))

    def whole(df: DataFrame) -> DataFrame:
        """Figures over all combinations."""
        return df.withColumns({c: F.lit("all") for c in COMBO})

    bands = danger_bands(sections)
    heights = error_metrics(predicted_and_known(median_heights(sections), sites), COMBO)
    pairs = predicted_and_known(plausible(sections), sites)
    strict = strict_sites(results).groupBy(*COMBO).agg((F.lit(100.0) * F.avg(F.col("success").cast("double"))).alias("pct"))
    summary = height_summary(sections)
    overlap = whole(agreement_summary(agreement(paired_bands(bands, *AGREEING))))
    quartiles = whole(slope_quartiles(pairs))
    parts = [
        long(class_shares(site_classes(results, sites), "class"), "site class %", F.col("class"), "pct"),
        long(strict, "strict success %", F.lit("all"), "pct"),
        long(jump_shares(results), "jump share %", F.concat_ws(" ", "xs_index", "jump_type"), "pct"),
        long(danger_rate(results), "danger rate %", F.col("xs_index"), "pct"),
        long(band_histogram(bands), "band width %", F.col("bin"), "pct"),
        long(incident_counts(results), "incidents per site", F.lit("all"), "per_site"),
        long(slope_class_fit(pairs), "height r2 by slope", F.col("slope_class"), "r2"),
        *[long(heights, f"height {m}", F.lit("all"), m) for m in ("rmse", "bias", "mae", "r2")],
        *[long(summary, f"section height {m}", F.col("xs_index"), m) for m in ("min", "max", "mean", "median", "n")],
        *[long(overlap, f"agreement {m}", F.lit("all"), m) for m in ("n", "zero", "near_perfect", "mean", "median")],
        *[long(quartiles, f"slope {q}", F.lit("all"), q) for q in ("q1", "q2", "q3")],
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
