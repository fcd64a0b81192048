"""River network: main stems, walks from a reach, positions along a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirspan.functions import geo
from weirspan.operators import near, ranking
from weirspan.session import cut_lineage, merged

# Walk lengths in metres, the end marker of the network, target points in weir lengths.
UP_METRES, DOWN_METRES = 1000.0, 2000.0
NETWORK_END = -1
TARGETS = ((-1, "Upstream"), (1, "Downstream1"), (2, "Downstream2"), (3, "Downstream3"), (4, "Downstream4"))


def main_upstream(reaches: DataFrame) -> DataFrame:
    """For each junction the contributing reach of the highest stream order (lowest id on a tie)."""
    inflow = reaches.where(F.col("dslinkno") != NETWORK_END)
    return inflow.groupBy(F.col("dslinkno").alias("linkno")).agg(
        F.max_by("linkno", F.struct("strm_order", -F.col("linkno"))).alias("next")
    )


def _next_reaches(reaches: DataFrame, up: float, down: float) -> DataFrame:
    """``linkno, direction, limit, dest, gain, part``: each reach's next one either way.

    ``gain`` is the length added by going there, ``part`` what of it lies before the last reach.
    """
    rows = [main_upstream(reaches).select("linkno", "next", F.lit("up").alias("direction"), F.lit(up).alias("limit"))]
    onward = reaches.where(F.col("dslinkno") != NETWORK_END)
    rows.append(onward.select("linkno", F.col("dslinkno").alias("next"), F.lit("down").alias("direction"), F.lit(down).alias("limit")))
    gains = reaches.select(F.col("linkno").alias("dest"), F.col("length_m").alias("gain"))
    ahead = rows[0].unionByName(rows[1]).withColumnRenamed("next", "dest").join(gains, "dest")
    return ahead.select("linkno", "direction", "limit", "dest", "gain", F.lit(0.0).alias("part"))


def walk(starts: DataFrame, reaches: DataFrame, up: float = UP_METRES, down: float = DOWN_METRES) -> DataFrame:
    """Reaches met from each start: ``start, linkno, direction, total`` with the length walked including the reach.

    A direction goes on while the walked length stays below its threshold; upstream it follows the main stem. A walk
    ends where it would meet a reach again.

    Pointers to the reach 2^k steps ahead, with the length on the way, are built by joining the table of pointers with
    itself, so a walk of n reaches takes log2(n) rounds: round k takes everything met so far 2^k steps on. Pointers
    longer than the threshold of their direction are dropped, as no walk can use them. A reach met twice keeps its
    first place; everything behind it has been met too, so a loop ends as soon as a round brings nothing new.
    """
    pointers = cut_lineage(_next_reaches(reaches, up, down))
    ways = F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(m).alias("limit")) for d, m in (("up", up), ("down", down))]))
    own = reaches.select("linkno", F.col("length_m").alias("total"))
    met = starts.select("linkno").distinct().join(own, "linkno").withColumn("w", ways)
    met = cut_lineage(met.select(F.col("linkno").alias("start"), "linkno", "w.direction", "w.limit", "total", F.lit(0).cast("long").alias("place")))
    size, step = met.count(), 1
    while True:
        ahead = pointers.select("linkno", "direction", "dest", "gain", "part")
        going = met.where(F.col("total") < F.col("limit")).join(ahead, ["linkno", "direction"])
        going = going.where(F.col("total") + F.col("part") < F.col("limit")).select(
            "start", F.col("dest").alias("linkno"), "direction", "limit", (F.col("total") + F.col("gain")).alias("total"), (F.col("place") + step).alias("place")
        )
        first = F.min(F.struct("place", "total")).alias("first")
        met = met.unionByName(going).groupBy("start", "linkno", "direction", "limit").agg(first)
        met = cut_lineage(met.select("start", "linkno", "direction", "limit", "first.total", "first.place"))
        now = met.count()
        if now == size:
            return met.select("start", "linkno", "direction", "total")
        size, step = now, 2 * step
        then = ahead.select(F.col("linkno").alias("dest"), "direction", F.col("dest").alias("far"), F.col("gain").alias("more"), F.col("part").alias("rest"))
        pointers = pointers.join(then, ["dest", "direction"]).select(
            "linkno", "direction", "limit", F.col("far").alias("dest"), (F.col("gain") + F.col("more")).alias("gain"), (F.col("gain") + F.col("rest")).alias("part")
        )
        pointers = cut_lineage(pointers.where(F.col("part") < F.col("limit")))


def stem_of_sites(sites: DataFrame, reaches: DataFrame, up: float = UP_METRES, down: float = DOWN_METRES) -> DataFrame:
    """Distinct reaches around each site; sites that share a reach share one walk."""
    met = walk(sites, reaches, up, down).select(F.col("start").alias("linkno"), F.col("linkno").alias("met")).distinct()
    return sites.select("site_id", "linkno").join(met, "linkno").select("site_id", F.col("met").alias("linkno"))


def merged_line(steps: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices of a walk as one downstream-running line ``site_id, seq, x, y``.

    ``steps``: site_id, linkno, place (rising downstream). Vertices of a reach run against the flow in this
    source, so they are taken in reverse; a vertex shared by two reaches stays twice, as a segment of length 0.
    """
    size = vertices.groupBy("linkno").agg(F.max("seq").alias("top"), F.count(F.lit(1)).alias("n"))
    placed = steps.join(merged(size), "linkno")
    placed = ranking.running_sum(placed, ["site_id"], "place", F.col("n").cast("double"), "upto")
    start = (F.col("upto") - F.col("n")).cast("bigint")
    rows = placed.select("site_id", "linkno", "top", start.alias("start")).join(merged(vertices), "linkno")
    return rows.select("site_id", (F.col("start") + F.col("top") - F.col("seq")).alias("seq"), "x", "y")


def measured_segments(line: DataFrame, key: str = "site_id") -> DataFrame:
    """Segments with their length and the length of the line before them."""
    seg = near.line_segments(line, key).withColumn("len", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    seg = ranking.running_sum(seg, [key], "seq", F.col("len"), "upto")
    return seg.withColumn("pos", F.col("upto") - F.col("len")).drop("upto")


def position_on_line(points: DataFrame, segments: DataFrame, key: str = "site_id") -> DataFrame:
    """Length along the line at which it comes closest to the point ``px, py``."""
    args = [F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2")]
    pairs = points.join(merged(segments), key)
    at = F.col("pos") + geo.segment_fraction(*args) * F.col("len")
    best = pairs.groupBy(key).agg(F.min_by(at, F.struct(geo.segment_distance(*args), F.col("seq"))).alias("position"))
    return points.join(merged(best), key, "left")


def point_at(asks: DataFrame, segments: DataFrame, ids: list[str], key: str = "site_id") -> DataFrame:
    """Coordinates at ``position`` along the line, clamped to its ends."""
    whole = segments.groupBy(key).agg(F.sum("len").alias("__whole"))
    asked = asks.join(merged(whole), key).withColumn("__s", F.greatest(F.lit(0.0), F.least(F.col("position"), F.col("__whole"))))
    hit = asked.join(merged(segments), key).where(F.col("pos") <= F.col("__s"))
    f = F.when(F.col("len") > 0, F.least(F.lit(1.0), (F.col("__s") - F.col("pos")) / F.when(F.col("len") > 0, F.col("len")))).otherwise(F.lit(0.0))
    x, y = F.col("x1") + f * (F.col("x2") - F.col("x1")), F.col("y1") + f * (F.col("y2") - F.col("y1"))
    best = hit.groupBy(*ids).agg(F.max_by(F.struct(x.alias("x"), y.alias("y")), F.col("seq")).alias("p"))
    return asks.join(merged(best), ids, "left").select(*asks.columns, "p.x", "p.y")


def target_points(sites: DataFrame, segments: DataFrame) -> DataFrame:
    """Five points along the line, one weir length above the structure and one to four below it.

    ``sites``: site_id, px, py, weir_length in the units of the line.
    """
    placed = position_on_line(sites, segments)
    marks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("label"), F.lit(i).alias("label_ord")) for i, (k, n) in enumerate(TARGETS)]))
    asks = placed.withColumn("m", marks).select(
        "site_id", "m.label", "m.label_ord", (F.col("position") + F.col("m.k") * F.col("weir_length")).alias("position")
    )
    return point_at(asks, segments, ["site_id", "label"])


def stream_distance(cells: DataFrame, order: str = "seq") -> DataFrame:
    """Length along the stream in cell units, cells of a site taken in ``order``."""
    before = cells.select("site_id", (F.col(order) + 1).alias(order), F.col("row_").alias("r0"), F.col("col_").alias("c0"))
    gap = F.coalesce(F.hypot((F.col("row_") - F.col("r0")).cast("double"), (F.col("col_") - F.col("c0")).cast("double")), F.lit(0.0))
    paired = cells.join(before, ["site_id", order], "left").withColumn("gap", gap).drop("r0", "c0")
    return ranking.running_sum(paired, ["site_id"], order, F.col("gap"), "distance").drop("gap")


def numbered_cells(cells: DataFrame) -> DataFrame:
    """Cells of a site numbered from 0 at the upstream end.

    Cells are taken by row and column; if the first lies lower than the last the order is turned round.
    """
    key = F.col("row_") * F.lit(2.0**26) + F.col("col_")
    keyed = cells.withColumn("__k", key)
    ends = cells.groupBy("site_id").agg(F.min_by("elev", F.struct("row_", "col_")).alias("__first"), F.max_by("elev", F.struct("row_", "col_")).alias("__last"))
    places = ranking.cumulative_counts(keyed.select("site_id", "__k").distinct(), ["site_id"], "__k")
    places = places.select("site_id", F.col("v").alias("__k"), "before", "total")
    turned = F.when(F.col("__first") < F.col("__last"), F.col("total") - 1 - F.col("before")).otherwise(F.col("before"))
    out = keyed.join(places, ["site_id", "__k"]).join(ends, "site_id")
    return out.withColumn("xs_no", turned).drop("__k", "before", "total", "__first", "__last")

