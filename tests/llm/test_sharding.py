import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import documents, frame
from weirspan.llm import sharding


def check_even(rows, shards, total):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(shards))
    for s in range(shards):
        assert sorted(slots.get(s, [])) == list(range(total // shards + (s < total % shards)))


def test_documents_are_dealt_evenly(spark):
    rows = documents()
    got = sharding.shard_documents(frame(spark, rows), shards=7).collect()
    check_even(got, 7, len(rows))
    key = lambda r: tuple((x is None, x) for x in r)
    want = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(want, key=key)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_groups_of_equal_texts_stay_together(spark):
    """Eighty groups of five and many single documents: nearly all links lie inside a shard, though sizes stay even."""
    rows = [(i, f"group {i % 80}") for i in range(400)] + [(1000 + i, f"single {i}") for i in range(400)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=8, rounds=8).collect()
    check_even(got, 8, 800)
    shard = {r.doc_id: r.shard for r in got}
    together = sum(max(Counter(shard[i] for i in range(g, 400, 80)).values()) - 1 for g in range(80))
    assert together >= 0.85 * 320


def test_one_group_larger_than_all_shards(spark):
    got = sharding.shard_documents(spark.createDataFrame([(i, "same") for i in range(101)], "doc_id long, text string"), shards=10).collect()
    check_even(got, 10, 101)


def test_general_links(spark):
    """Sixteen cliques of ten in a ring, four shards: far fewer links are cut than the three quarters of a random split."""
    links = [(a, b) for g in range(0, 160, 10) for a in range(g, g + 10) for b in range(g, a)] + [(g, (g + 10) % 160) for g in range(0, 160, 10)]
    nodes = spark.range(160).select(F.col("id").alias("node"))
    got = sharding.balanced_shards(nodes, spark.createDataFrame(links, "src long, dst long"), shards=4, rounds=12).collect()
    check_even(got, 4, 160)
    shard = {r.node: r.shard for r in got}
    assert sum(shard[a] != shard[b] for a, b in links) <= 0.4 * len(links)


@pytest.mark.parametrize("total", [0, 1, 3])
def test_fewer_documents_than_shards(spark, total):
    got = sharding.shard_documents(frame(spark, documents()[:total]), shards=5).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, 0) for s in range(total)]


def test_positions_of_a_hot_group(spark):
    df = spark.range(500).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 3).alias("g"), (F.col("id") * 37 % 500).alias("v")).repartition(5)
    got = sharding.positions(df, "g", ["v"]).collect()
    for g in {r.g for r in got}:
        own = sorted((r.v, r.position) for r in got if r.g == g)
        assert [p for _, p in own] == list(range(len(own)))


def test_pairs_end_together_with_production_parameters(spark):
    """Two thousand pairs among as many single documents, forty shards with room for all: no pair is cut."""
    rows = [(i, f"pair {i % 2000}") for i in range(4000)] + [(5000 + i, f"single {i}") for i in range(4000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_even(got, sharding.SHARDS, 8000)
    shard = {r.doc_id: r.shard for r in got}
    assert sum(shard[i] != shard[i + 2000] for i in range(2000)) == 0
