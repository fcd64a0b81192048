"""Dangerous ranges where no conjugate depth exists, and grids that would start without flow."""

from pyspark.sql import functions as F

from weirspan.functions import hydraulics as hy
from weirspan.operators import jumps


def test_range_ends_where_the_conjugate_depth_vanishes(spark):
    row = spark.createDataFrame([(10.0, 0.2, 0.05, 0.3, 5.0, 2000.0)], "l double, p double, a double, b double, lo double, hi double")
    qmin, _ = hy.danger_range_rectangular(*[F.col(c) for c in ("l", "p", "a", "b", "lo", "hi")])
    q = row.select(qmin.alias("q")).first().q
    assert 5 < q < 2000

    def depth(at):
        head = hy.weir_head(F.lit(at), F.lit(10.0))
        return spark.range(1).select(hy.conjugate_depth_of_head(head, F.lit(0.2)).alias("y")).first().y

    assert depth(q * 0.999) is not None and depth(q * 1.001) is None


def test_grid_without_flow_starts_above_zero(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0), (2, 1.0, 100.0)], "k int, q_lo double, q_hi double")
    got = {}
    for r in jumps.with_grid(df).collect():
        got.setdefault(r.k, []).append(r.q)
    assert len(got[1]) == len(got[2]) == 100
    assert min(got[1]) == 0.01 and abs(max(got[1]) - 10) < 1e-9 and min(got[2]) == 1.0 and abs(max(got[2]) - 100) < 1e-9
