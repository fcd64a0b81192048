"""A line layer clustered by a space-filling curve, and the scan of a box that skips most of it.

Every line gets a key: the depth of the smallest grid whose cells are as wide as the line, and the place of the cell of
its lower left corner on the Z curve of that grid. Rows are written in the order of the key. A box is taken apart into
ranges of keys, depth by depth; the ranges are plain comparisons, which the reader holds against the statistics of the
row groups, so row groups far from the box are never read. The exact test of the segments comes last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirspan.functions.steps import let

#: The grids halve a square of this many degrees, with its lower left corner here, up to the deepest one.
WORLD, WEST, SOUTH = 360.0, -180.0, -90.0
DEEPEST = 20
#: Key ranges kept for a depth; finer pieces of a box are given up for their parent.
MOST_RANGES = 8
GROUP_BYTES = 8 << 20

Box = tuple[float, float, float, float]


def _spaced(n: Column) -> Column:
    """The 20 bits of ``n`` with a zero bit between each two."""

    def moved(shift: int, mask: int):
        return lambda v: v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))

    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        n = let(n, moved(shift, mask))
    return n


def curve_key(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Depth and Z place of the cell in which the lower left corner lies; lines reach into the next cells at most."""
    size = F.greatest(xmax - xmin, ymax - ymin)
    fits = F.when(size > 0, F.floor(F.log2(F.lit(WORLD) / size) - 1e-9)).otherwise(F.lit(DEEPEST))
    depth = F.greatest(F.lit(0), F.least(F.lit(DEEPEST), fits)).cast("int")

    def key(k: Column) -> Column:
        cells = F.pow(F.lit(2.0), k)

        def place(v: Column, low: float) -> Column:
            at = F.floor((v - F.lit(low)) / F.lit(WORLD) * cells)
            return _spaced(F.greatest(F.lit(0), F.least(cells - 1, at)).cast("bigint"))

        z = place(xmin, WEST).bitwiseOR(F.shiftleft(place(ymin, SOUTH), 1))
        return F.shiftleft(k.cast("bigint"), 2 * DEEPEST).bitwiseOR(z)

    return let(depth, key)


def _cells_of(box: Box, depth: int) -> tuple[int, int, int, int]:
    cells = 1 << depth

    def at(v: float, low: float) -> int:
        return max(0, min(cells - 1, int((v - low) / WORLD * cells // 1)))

    # A line may begin one cell to the left of or below the box; one more for rounding.
    return max(0, at(box[0], WEST) - 2), max(0, at(box[1], SOUTH) - 2), at(box[2], WEST) + 1, at(box[3], SOUTH) + 1


def key_ranges(box: Box, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of keys (ends included) that hold every line meeting the box ``xmin, ymin, xmax, ymax``."""
    found: list[tuple[int, int]] = []
    for depth in range(DEEPEST + 1):
        x0, y0, x1, y1 = _cells_of(box, depth)
        open_, done = [(0, 0, depth)], []  # squares of the grid: corner and the halvings left
        while open_:
            if len(open_) + len(done) + 3 > most:
                done += open_
                break
            x, y, left = open_.pop(0)
            side = 1 << left
            if x0 <= x and y0 <= y and x + side - 1 <= x1 and y + side - 1 <= y1:
                done.append((x, y, left))
                continue
            half = side >> 1
            parts = [(x + i * half, y + j * half, left - 1) for j in (0, 1) for i in (0, 1)]
            open_ += [p for p in parts if p[0] <= x1 and p[1] <= y1 and p[0] + half > x0 and p[1] + half > y0]
        for x, y, left in done:
            z = sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(depth))
            low = depth << 2 * DEEPEST | z
            found.append((low, low + (1 << 2 * left) - 1))
    found.sort()
    merged = found[:1]
    for a, b in found[1:]:
        if a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def with_extent(vertices: DataFrame, key: str = "linkno") -> DataFrame:
    """One row a line: ``key, xmin, ymin, xmax, ymax, curve, points`` (x, y in order). Vertices without finite coordinates are left out."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("x", "y")]
    rows = vertices.where(finite[0] & finite[1]).groupBy(key).agg(
        F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"),
    )
    return rows.withColumn("curve", curve_key(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))


def write_lines(vertices: DataFrame, path: str, key: str = "linkno", group_bytes: int = GROUP_BYTES) -> None:
    """The lines of ``vertices`` (key, seq, x, y) in the order of the curve; small row groups, as a box wants few rows of each file."""
    rows = with_extent(vertices, key).repartitionByRange("curve").sortWithinPartitions("curve")
    rows.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


def meets_box(points: Column, box: Box) -> Column:
    """Whether a line of two points or more meets the box: a segment's extent meets it and its corners lie on both sides, or a point lies in it."""
    x0, y0, x1, y1 = (F.lit(float(v)) for v in box)

    def meets(a: Column, b: Column) -> Column:
        extent = (F.least(a["x"], b["x"]) <= x1) & (F.greatest(a["x"], b["x"]) >= x0) & (F.least(a["y"], b["y"]) <= y1) & (F.greatest(a["y"], b["y"]) >= y0)
        sides = [(b["x"] - a["x"]) * (cy - a["y"]) - (b["y"] - a["y"]) * (cx - a["x"]) for cx in (x0, x1) for cy in (y0, y1)]
        return extent & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    n = F.size(points)
    ends = F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(1))), F.slice(points, F.least(n, F.lit(2)), F.greatest(n - 1, F.lit(1))), meets)
    return F.exists(ends, lambda hit: hit)


def read_box(spark: SparkSession, path: str, box: Box) -> DataFrame:
    """The lines of a written layer that meet the box ``xmin, ymin, xmax, ymax``, ends included."""
    rows = spark.read.parquet(path)
    near = [F.col("curve").between(a, b) for a, b in key_ranges(box)]
    xmin, ymin, xmax, ymax = box
    rows = rows.where(reduce(lambda a, b: a | b, near))
    rows = rows.where((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))
    return rows.where(meets_box(F.col("points"), box))
