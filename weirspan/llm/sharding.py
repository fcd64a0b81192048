"""Shards of equal size that keep linked documents together, by balanced label propagation.

Every linked document starts in a shard of its own hash. In each round the neighbours' shards are counted by a join
over the links, and a document asks to move to the shard that holds most of its neighbours. A shard admits as large a
share of those who ask as its quota has room for, counting those who leave. A round has a random order of the shards,
every second round the reverse of the one before, and documents may ask for later shards only: of two neighbours one
asks, so they never swap. Rounds go on until no request has room in either direction. At the end each shard keeps its best-supported documents up to its quota;
the others, and all documents without links, fill the shards that have room left. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirspan.llm.common import cut_lineage, stored

SHARDS = 40
#: Rounds end as well when the number of links inside shards has not grown for so many of them (requests that take turns).
STALLED = 12
#: Bytes that each document counts besides its text.
OVERHEAD = 16


def _unit(*of: Column) -> Column:
    """A number from 0 to 1 made of the values."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / float(1 << 30)


def positions(df: DataFrame, group: str, order: list[str | Column]) -> DataFrame:
    """Add ``position``, gapless from 0 within each ``group`` in ``order``, without sorting a group in one task.

    Rows are sorted by range; a partition's rows are numbered in place, and the counts of earlier partitions of the
    group are added. A group has a row of counts for each partition it lies in.
    """
    rows = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__row", 33)))
    before = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(group, "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    counts = counts.select(group, "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = rows.join(counts, [group, "__part"])
    return joined.select(*df.columns, (F.col("__before") + F.col("__row") - F.col("__first")).alias("position"))


def propagate(links: DataFrame, quota: Callable[[Column], Column], shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """``node, shard, support`` for every node of ``links`` (src, dst), each link given once.

    ``quota`` gives the quota of a shard. ``support`` is the number of neighbours in the same shard. ``rounds`` are the
    most that are made; None goes on until the labels have settled.
    """
    both = cut_lineage(links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    labels = both.select(F.col("src").alias("node")).distinct()
    labels = cut_lineage(labels.select("node", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard")))
    if labels.isEmpty():
        return labels.withColumn("support", F.lit(0).cast("long"))
    best, best_round, quiet, round_ = -1, 0, 0, 0
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "shard"), "dst").groupBy("src", "shard").agg(F.count(F.lit(1)).alias("n"))
        near = near.groupBy(F.col("src").alias("node")).agg(F.collect_list(F.struct("n", "shard")).alias("all"))  # at most a row per shard
        own = F.coalesce(F.get(F.filter("all", lambda x: x["shard"] == F.col("shard")), F.lit(0))["n"], F.lit(0))
        rows = labels.join(near, "node").select("node", "shard", "all", own.alias("own"))
        place, back = _unit(F.lit(round_ // 2), F.col("shard")), round_ % 2 == 1

        def later(x: Column) -> Column:
            there = _unit(F.lit(round_ // 2), x["shard"])
            return (x["n"] > F.col("own")) & (there < place if back else there > place)

        rows = cut_lineage(rows.select("node", "shard", "own", F.array_max(F.filter("all", later))["shard"].alias("target")))
        here = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("leave"))
        come = rows.where("target is not null").groupBy("target").agg(F.count(F.lit(1)).alias("come"))
        room = come.join(here.withColumnRenamed("shard", "target"), "target", "left")
        room = cut_lineage(room.select("target", ((quota(F.col("target")) - F.coalesce("n", F.lit(0)) + F.coalesce("leave", F.lit(0))) / F.col("come")).alias("share")))
        quiet = quiet + 1 if room.where("share > 0").isEmpty() else 0
        inside = rows.agg(F.sum("own")).first()[0]
        if inside > best:
            best, best_round = inside, round_
        if quiet == 2 or round_ - best_round >= STALLED or round_ == rounds:
            return rows.select("node", "shard", F.col("own").alias("support"))
        if not quiet:
            rows = rows.join(F.broadcast(room), "target", "left")  # a row per shard at most
            moved = F.coalesce(_unit(F.lit(round_), F.col("node")) < F.col("share"), F.lit(False))
            labels = cut_lineage(rows.select("node", F.when(moved, F.col("target")).otherwise(F.col("shard")).alias("shard")))
        round_ += 1


def balanced_shards(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """``node, shard, slot`` for every row of ``nodes`` (node long, unique), given ``links`` (src, dst) between them.

    The counts of the shards differ by one at most; slots are gapless from 0 in each shard. Without links the
    documents are dealt in the order of their numbers. An empty table gives an empty result.
    """
    total = nodes.count()

    def quota(shard: Column) -> Column:
        return F.lit(total // shards) + F.when(shard < total % shards, 1).otherwise(0)

    labels = propagate(links, quota, shards, rounds)
    inside = positions(labels.select("node", "shard", "support"), "shard", [F.desc("support"), F.col("node")])
    inside = cut_lineage(inside.select("node", "shard", "position", (F.col("position") < quota(F.col("shard"))).alias("stays")))
    stays = inside.where("stays")
    held = {r["shard"]: r["n"] for r in stays.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number per shard
    taken = [held.get(s, 0) for s in range(shards)]
    free = [total // shards + (s < total % shards) - taken[s] for s in range(shards)]
    ends = [sum(free[: s + 1]) for s in range(shards)]
    rest = nodes.select("node").join(stays.select("node"), "node", "left_anti").join(inside.select("node", "shard"), "node", "left")
    rest = positions(rest.select("node", F.coalesce("shard", F.lit(shards)).alias("was"), F.lit(0).alias("pool")), "pool", ["was", "node"])
    shard = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("position")))
    start = F.get(F.array(*[F.lit(e - f - t).cast("long") for e, f, t in zip(ends, free, taken)]), shard)
    filled = rest.select("node", shard.alias("shard"), (F.col("position") - start).alias("slot"))
    return stays.select("node", "shard", F.col("position").alias("slot")).unionByName(filled)


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``, by the law ``rows``.

    Documents with equal texts are linked, each to the first of them, so a group of any size has one link a document.
    NULL texts are equal to each other and count no bytes; repeated rows are documents of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("text").isNull(), "text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"),
    )
    rows = stored(rows.withColumn("node", F.monotonically_increasing_id()))
    first = rows.groupBy("h1", "h2").agg(F.min("node").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = rows.join(first, ["h1", "h2"]).select(F.col("node").alias("src"), "dst").where("src <> dst")
    placed = balanced_shards(rows.select("node"), links, shards, rounds)
    return rows.join(placed, "node").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
