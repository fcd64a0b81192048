"""Merging of unordered line parts that touch, as joins and pointer doubling.

Parts are linked where exactly two part ends of a site meet; at a fork, where more meet, lines end. A part is walked in
two ways, so each way is a state with at most one next state. Every round replaces the pointer of a state by the pointer
of the state it points to, so chains of n parts are ordered in log2(n) rounds, whatever their number. States that still
point somewhere after enough rounds lie on loops; a loop is opened before its smallest part and ordered like a chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirspan.functions import geo
from weirspan.operators import ranking
from weirspan.session import cut_lineage


def _finite(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) != float("inf"))
    return out


def part_ends(vertices: DataFrame) -> DataFrame:
    """``site_id, part, head (x, y), tail (x, y), n`` of the parts with two vertices or more."""
    point = F.struct("x", "y")
    rows = vertices.groupBy("site_id", "part").agg(F.min_by(point, "seq").alias("head"), F.max_by(point, "seq").alias("tail"), F.count(F.lit(1)).alias("n"))
    return rows.where("n > 1")


def _states(ends: DataFrame) -> DataFrame:
    """``site_id, part, fwd, to`` for both ways through each part; ``to`` is the state walked next, NULL at an end."""
    half = ends.select("site_id", "part", F.explode(F.array(F.struct(F.lit(True).alias("at_head"), F.col("head").alias("node")), F.struct(F.lit(False).alias("at_head"), F.col("tail").alias("node")))).alias("h"))
    half = half.select("site_id", "part", "h.at_head", (F.col("h.node.x") + 0.0).alias("x"), (F.col("h.node.y") + 0.0).alias("y"))
    end = F.struct("part", "at_head")
    meets = half.groupBy("site_id", "x", "y").agg(F.min(end).alias("a"), F.max(end).alias("b"), F.count(F.lit(1)).alias("ends")).where("ends = 2")
    pairs = meets.select("site_id", F.explode(F.array(F.struct(F.col("a").alias("leave"), F.col("b").alias("enter")), F.struct(F.col("b").alias("leave"), F.col("a").alias("enter")))).alias("p"))
    # A part walked forwards is left at its tail and entered at its head.
    steps = pairs.select("site_id", F.col("p.leave.part").alias("part"), (~F.col("p.leave.at_head")).alias("fwd"), F.struct(F.col("p.enter.part").alias("part"), F.col("p.enter.at_head").alias("fwd")).alias("to"))
    both = ends.select("site_id", "part", F.explode(F.array(F.lit(True), F.lit(False))).alias("fwd"))
    return both.join(steps, ["site_id", "part", "fwd"], "left")


def _doubled(states: DataFrame, rounds: int) -> DataFrame:
    """Adds ``hops`` to the last state met, that state as ``last``, and ``least``, the smallest state met; ``to`` stays on loops."""
    own = F.struct("part", "fwd")
    rows = cut_lineage(states.select("site_id", "part", "fwd", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.coalesce("to", own).alias("last"), F.least(own, F.coalesce("to", own)).alias("least")))
    for _ in range(rounds):
        ahead = rows.select("site_id", F.struct("part", "fwd").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("last").alias("last2"), F.col("least").alias("least2"))
        open_ = rows.where("to is not null").join(ahead, ["site_id", "to"])
        moved = open_.select("site_id", "part", "fwd", F.col("to2").alias("to"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("last2").alias("last"), F.least("least", "least2").alias("least"))
        rows = cut_lineage(rows.where("to is null").unionByName(moved))
        if rows.where("to is not null").isEmpty():
            break
    return rows


def chains(vertices: DataFrame) -> DataFrame:
    """``site_id, chain, part, fwd, place, n``: each part's chain (named after its smallest part), way and place from 0.

    ``vertices``: site_id, part, seq, x, y, parts in any order. A chain runs the way of most of its parts, on a tie that
    of its smallest part. Parts of fewer than two vertices are left out; part ends touch if their coordinates are equal.
    """
    ends = cut_lineage(part_ends(vertices.where(_finite("x", "y"))))
    most = ends.groupBy("site_id").count().agg(F.max("count")).first()[0] or 0
    rounds = max(1, int(2 * most).bit_length())
    states = cut_lineage(_states(ends))
    ranked = _doubled(states, rounds)
    loops = ranked.where("to is not null").select("site_id", "part", "fwd", "least")
    straight = ranked.where("to is null")
    if not loops.isEmpty():
        opened = states.join(loops, ["site_id", "part", "fwd"])
        opened = opened.select("site_id", "part", "fwd", F.when(F.col("to") != F.col("least"), F.col("to")).alias("to"))
        straight = straight.unionByName(_doubled(opened, rounds))
    # ``last`` names a walked way; both ways of a chain have the same parts.
    ways = straight.groupBy("site_id", "last").agg(F.min("part").alias("chain"), F.min_by("fwd", "part").alias("first_fwd"), F.sum(F.col("fwd").cast("int")).alias("n_fwd"), F.max("hops").alias("top"))
    best = ways.groupBy("site_id", "chain").agg(F.max(F.struct("n_fwd", "first_fwd", "last", "top")).alias("w")).select("site_id", "chain", F.col("w.last").alias("last"), F.col("w.top").alias("top"))
    chosen = straight.join(best, ["site_id", "last"]).select("site_id", "chain", "part", "fwd", (F.col("top") - F.col("hops")).alias("place"))
    return chosen.join(ends.select("site_id", "part", "n"), ["site_id", "part"])


def merged_chains(vertices: DataFrame) -> DataFrame:
    """``site_id, chain, seq, x, y``: the vertices of each chain in its order, a joint of two parts once."""
    found = cut_lineage(chains(vertices))
    sized = found.withColumn("size", F.col("n") - F.when(F.col("place") > 0, 1).otherwise(0))
    placed = ranking.running_sum(sized, ["site_id", "chain"], "place", F.col("size").cast("double"), "upto")
    placed = placed.select("site_id", "chain", "part", "fwd", "n", "place", (F.col("upto") - F.col("size")).cast("bigint").alias("start"))
    # Vertices are numbered from 0 in their part, whatever their seq.
    numbered = ranking.running_sum(vertices.where(_finite("x", "y")).select("site_id", "part", "seq", "x", "y"), ["site_id", "part"], "seq", F.lit(1.0), "upto")
    rows = numbered.withColumn("at", F.col("upto").cast("bigint") - 1).join(placed, ["site_id", "part"])
    along = F.when(F.col("fwd"), F.col("at")).otherwise(F.col("n") - 1 - F.col("at"))
    joint = F.when(F.col("place") > 0, 1).otherwise(0)
    rows = rows.withColumn("along", along - joint).where("along >= 0")
    return rows.select("site_id", "chain", (F.col("start") + F.col("along")).alias("seq"), "x", "y")


def nearest_chain(sites: DataFrame, merged: DataFrame, places: int | None = None) -> DataFrame:
    """``site_id, chain, seq, x, y``: of each site's chains the one nearest to it (smallest name on a tie).

    With ``places``, distances that agree to so many decimals are ties.

    ``sites``: site_id, px, py and ``turned``: lines drawn against the flow are turned round. Sites without coordinates
    or without a chain have no line.
    """
    after = merged.select("site_id", "chain", (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    segments = merged.join(after, ["site_id", "chain", "seq"])
    asked = sites.where(_finite("px", "py")).select("site_id", "px", "py", "turned")
    away = geo.segment_distance(*[F.col(c) for c in ("px", "py", "x", "y", "x2", "y2")])
    away = away if places is None else F.round(away, places)
    far = asked.join(segments, "site_id").groupBy("site_id", "chain", "turned").agg(F.min(away).alias("dist"), F.max("seq").alias("top"))
    best = far.groupBy("site_id").agg(F.min(F.struct("dist", "chain", "turned", "top")).alias("b")).select("site_id", "b.chain", "b.turned", (F.col("b.top") + 1).alias("top"))
    seq = F.when(F.col("turned"), F.col("top") - F.col("seq")).otherwise(F.col("seq"))
    return merged.join(best, ["site_id", "chain"]).select("site_id", "chain", seq.alias("seq"), "x", "y")


def flow_line(sites: DataFrame, vertices: DataFrame, places: int | None = None) -> DataFrame:
    """The merged line of each site from unordered parts: touching parts joined, the nearest chain taken, turned to run with the flow."""
    return nearest_chain(sites, cut_lineage(merged_chains(vertices)), places)
