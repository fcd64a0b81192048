"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, queries walk it greedily.

The graph starts from exact neighbours inside random blocks of bounded size. In each NN-descent round every node brings
its neighbours and reverse neighbours together, and each of these learns of the others: joins of neighbours of
neighbours. A search holds the best nodes it knows for each query and asks all of them it has not asked yet for their
neighbours, until none is left. Rounds work on vectors of one byte a component; the scores returned are exact.
Equal vectors are one node; of its rows those with the smallest ids are given out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirspan.llm.common import stored

TOP = 20
EVERY = 20
DEGREE = 24
TABLES = 6
BLOCK = 1000
ROUNDS = 3
#: Candidates that each meeting offers to a member.
OFFERS = 8
#: Best nodes that a search holds, most rounds, and nodes that are scored exactly at the end.
WIDTH = 300
SEARCH_ROUNDS = 16
EXACT = 60
#: Nodes or queries that a Python group handles at a time.
GROUP = 2048

EDGE = "src long, dst long, sim float"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, v`` (array<double>) of the rows that take part: an id, and a vector that is not NULL or zero, has only finite
    components, and has the most frequent length (the longest of several)."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _pack(v: np.ndarray) -> list[bytes]:
    """One byte a component, behind a 4-byte scale."""
    scale = (np.abs(v).max(1) / 127).astype("<f4")
    low = np.rint(v / scale[:, None]).astype(np.int8)
    return [s.tobytes() + row.tobytes() for s, row in zip(scale, low)]


def _unpack(packed: pa.Array | pa.ChunkedArray) -> np.ndarray:
    items = packed.to_pylist()
    if not items:
        return np.empty((0, 1), np.float32)
    raw = np.frombuffer(b"".join(items), np.uint8).reshape(len(items), -1)
    scale = np.ascontiguousarray(raw[:, :4]).view("<f4")
    return raw[:, 4:].view(np.int8).astype(np.float32) * scale


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            v = np.array(batch.column(1).to_pylist(), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_pack(v), pa.binary())], names=["node", "h"])


def _cells(tables: int, bits: int):
    """Each node once per table, with the signs of ``bits`` random projections as its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unpack(batch.column(1))
            for t in range(tables):
                planes = np.random.default_rng(t).standard_normal((v.shape[1], bits)).astype(np.float32)
                cell = ((v @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64)) + (t << 48)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1)], names=["cell", "node", "h"])

    return run


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(sims.shape[1]), (len(sims), 1))


def _edges(src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> pa.Table:
    return pa.table([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(sim, pa.float32())], names=["src", "dst", "sim"])


def _block_neighbours(degree: int):
    def run(group: pa.Table) -> pa.Table:
        node, v = group.column("node").to_numpy(), _unpack(group.column("h"))
        parts = []
        for at in range(0, len(node), 512):
            sims = v[at : at + 512] @ v.T
            sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -np.inf
            i = _best(sims, min(degree, len(node)))
            parts.append((np.repeat(node[at : at + 512], i.shape[1]), node[i].ravel(), np.take_along_axis(sims, i, 1).ravel()))
        src, dst, sim = (np.concatenate(p) for p in zip(*parts))
        real = src != dst
        return _edges(src[real], dst[real], sim[real])

    return run


def _top_edges(degree: int):
    """The best ``degree`` different neighbours of each node of the group."""

    def run(group: pa.Table) -> pa.Table:
        src, dst, sim = (group.column(c).to_numpy() for c in ("src", "dst", "sim"))
        order = np.lexsort((dst, -sim, src))
        src, dst, sim = src[order], dst[order], sim[order]
        first = ~pd.DataFrame({"s": src, "d": dst}).duplicated().to_numpy()
        src, dst, sim = src[first], dst[first], sim[first]
        start = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
        place = np.arange(len(src)) - np.repeat(start, np.diff(np.r_[start, len(src)]))
        keep = place < degree
        return _edges(src[keep], dst[keep], sim[keep])

    return run


def _meet(offers: int):
    """Every node's members learn of each other; an offer must beat the worst neighbour that its receiver has."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        at, member, bar, v = group.column("at").to_numpy(), group.column("node").to_numpy(), group.column("bar").to_numpy(), _unpack(group.column("h"))
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(at)]):
            if hi - lo < 2:
                continue
            sims = v[lo:hi] @ v[lo:hi].T
            np.fill_diagonal(sims, -np.inf)
            i = _best(sims, min(offers, hi - lo - 1))
            best = np.take_along_axis(sims, i, 1)
            row, column = np.nonzero(best > bar[lo:hi, None])
            parts.append((member[lo + row], member[lo + i[row, column]], best[row, column]))
        src, dst, sim = (np.concatenate(p) for p in zip(*parts))
        if not len(src):
            return _edges(src, dst, sim)
        return _top_edges(4 * offers)(_edges(src, dst, sim))

    return run


def _by_group(df: DataFrame, key: str, groups: int) -> DataFrame:
    return df.withColumn("g", F.pmod(F.xxhash64(key), F.lit(groups)))


def build_graph(nodes: DataFrame, size: int, degree: int = DEGREE, tables: int = TABLES, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """``src, dst, sim``: about ``degree`` near neighbours of every one of the ``size`` rows of ``nodes`` (node, h)."""
    groups = -(-size // GROUP)
    bits = max(1, int(np.ceil(np.log2(max(2, size / block)))))
    if size <= block:
        tables = 1
    cells = stored(nodes.mapInArrow(_cells(tables, bits if size > block else 0), "cell long, node long, h binary"))
    # Cells that came out too large are dealt into parts; a group is never larger than twice a block or so.
    parts = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (1.5 * block)).alias("parts"))
    dealt = cells.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("node", "cell"), F.col("parts")))
    found = dealt.groupBy("cell", "part").applyInArrow(_block_neighbours(degree), EDGE)
    graph = stored(_by_group(found, "src", groups).groupBy("g").applyInArrow(_top_edges(degree), EDGE))
    if size <= block:
        return graph  # already exact
    for r in range(rounds):
        ahead = graph.select(F.col("src").alias("at"), F.col("dst").alias("node"))
        back = graph.select(F.col("dst").alias("at"), F.col("src").alias("node"))
        few = W.partitionBy("at").orderBy(F.xxhash64("node", F.lit(r)))
        back = back.withColumn("n", F.row_number().over(few)).where(F.col("n") <= degree).drop("n")
        bars = graph.groupBy(F.col("src").alias("node")).agg(F.when(F.count(F.lit(1)) >= degree, F.min("sim")).otherwise(F.lit(float("-inf")).cast("float")).alias("bar"))
        known = nodes.join(bars, "node", "left").select("node", "h", F.coalesce("bar", F.lit(float("-inf")).cast("float")).alias("bar"))
        members = ahead.unionByName(back).distinct().join(known, "node")
        new = _by_group(members, "at", groups).groupBy("g").applyInArrow(_meet(OFFERS), EDGE)
        graph = stored(_by_group(graph.unionByName(new), "src", groups).groupBy("g").applyInArrow(_top_edges(degree), EDGE))
    return graph


def _adjacency(group: pa.Table) -> pa.Table:
    group = group.sort_by("src")
    src = group.column("src").to_numpy()
    dst, h = group.column("dst").to_numpy(), group.column("h").to_pylist()
    start = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]).tolist()
    rows = [(int(src[lo]), dst[lo:hi].tobytes(), b"".join(h[lo:hi])) for lo, hi in zip(start, [*start[1:], len(src)])]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["src", "dsts", "hs"])


STATE = "q long, qh binary, ids binary, sims binary, asked binary"


def _frontier(width: int):
    """A row for each node that a query still has to ask, with the similarity that a find must beat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, qh, ids, sims, asked = (batch.column(i).to_pylist() for i in range(5))
            out: list[tuple] = []
            for i in range(batch.num_rows):
                held, done = np.frombuffer(sims[i], np.float32), np.frombuffer(asked[i], np.bool_)
                bar = float(held[-1]) if len(held) >= width else -np.inf
                out += [(q[i], qh[i], n, bar) for n in np.frombuffer(ids[i], np.int64)[~done].tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64(), pa.float32()))], names=["q", "qh", "src", "bar"])

    return run


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The neighbours of the nodes asked that are good enough."""
    for batch in batches:
        q, dsts, hs = batch.column(0).to_numpy(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
        bar, mine = batch.column(2).to_numpy(), _unpack(batch.column(1))
        out = []
        for i in range(batch.num_rows):
            ids = np.frombuffer(dsts[i], np.int64)
            raw = np.frombuffer(hs[i], np.uint8).reshape(len(ids), -1)
            sims = (raw[:, 4:].view(np.int8) @ mine[i]) * np.ascontiguousarray(raw[:, :4]).view("<f4")[:, 0]
            good = sims > bar[i]
            if good.any():
                out.append((int(q[i]), ids[good].tobytes(), sims[good].astype(np.float32).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["of", "ids", "sims"])


def _update(width: int):
    def run(states: pa.Table, finds: pa.Table) -> pa.Table:
        new: dict[int, list[tuple[bytes, bytes]]] = {}
        for of, ids, sims in zip(*(finds.column(c).to_pylist() for c in ("of", "ids", "sims"))):
            new.setdefault(of, []).append((ids, sims))
        rows = []
        for q, qh, ids, sims, asked in zip(*(states.column(c).to_pylist() for c in ("q", "qh", "ids", "sims", "asked"))):
            more = new.get(q, [])
            node = np.frombuffer(ids + b"".join(a for a, _ in more), np.int64)
            sim = np.frombuffer(sims + b"".join(b for _, b in more), np.float32)
            done = np.r_[np.ones(len(asked), np.bool_), np.zeros(len(node) - len(asked), np.bool_)]
            first = np.unique(node, return_index=True)[1]  # an asked node comes first
            best = first[np.lexsort((node[first], -sim[first]))][:width]
            rows.append((q, qh, node[best].tobytes(), sim[best].tobytes(), done[best].tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["q", "qh", "ids", "sims", "asked"])

    return run


def _exact_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.array(batch.column(i).to_pylist(), np.float64) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.einsum("ij,ij->i", a, b))], names=["q", "node", "score"])


def _held(exact: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, np.int64)[:exact] for x in batch.column(1).to_pylist()]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in ids])), pa.array(np.concatenate(ids))], names=["q", "node"])

    return run


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, size: int, width: int = WIDTH, exact: int = EXACT) -> DataFrame:
    """``q, node``: the ``exact`` best nodes found for each of ``queries`` (q: a node of the graph), itself included."""
    near = graph.join(nodes.select(F.col("node").alias("dst"), "h"), "dst")
    near = stored(_by_group(near, "src", -(-size // GROUP)).groupBy("g").applyInArrow(_adjacency, "src long, dsts binary, hs binary"))
    one = F.unhex(F.lit("0000807f"))  # a first similarity above all others; each query begins at its own node
    padded = queries.select(F.col("q").alias("node")).join(nodes, "node").select(F.col("node"), F.col("h").alias("qh"))
    state = padded.select(F.col("node").alias("q"), "qh", _long_bytes(F.col("node")).alias("ids"), one.alias("sims"), F.unhex(F.lit("00")).alias("asked"))
    state = stored(state)
    groups = max(1, size // EVERY // 256)
    for _ in range(SEARCH_ROUNDS):
        frontier = stored(state.mapInArrow(_frontier(width), "q long, qh binary, src long, bar float"))
        if frontier.isEmpty():
            break
        finds = frontier.join(near, "src").select("q", "qh", "bar", "dsts", "hs").mapInArrow(_ask, "of long, ids binary, sims binary")
        state = stored(_by_group(state, "q", groups).groupBy("g").cogroup(_by_group(finds, "of", groups).groupBy("g")).applyInArrow(_update(width), STATE))
    return state.select("q", "ids").mapInArrow(_held(exact), "q long, node long")


def _long_bytes(x):
    """The 8 bytes of a whole number, lowest first."""
    return F.unhex(F.regexp_replace(F.lpad(F.hex(x), 16, "0"), "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1"))


def nearest(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = EVERY, top: int = TOP, width: int = WIDTH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest rows found for each row whose id is divisible by ``every``.

    Nearness is the inner product in double precision; ties go to the smaller id; a row is no candidate of its own.
    With fewer rows all candidates are given. A repeated row counts once; an id with several vectors takes part
    with the smallest. Unusable vectors (see ``usable``) take no part; an empty table gives an empty result.
    """
    rows = stored(usable(vectors, id_column, vector_column).groupBy("id").agg(F.min("v").alias("v")))
    nodes = stored(rows.groupBy("v").agg(F.min("id").alias("node")).select("node", "v"))
    size = nodes.count()
    packed = stored(nodes.select("node", "v").mapInArrow(_packed, "node long, h binary"))
    graph = build_graph(packed, max(1, size))
    of_node = rows.join(nodes, "v").select("node", "id")
    asked = of_node.where(F.col("id") % every == 0)
    found = search(packed, graph, asked.select(F.col("node").alias("q")).distinct(), max(1, size), width)
    mine = nodes.select(F.col("node").alias("q"), F.col("v").alias("qv"))
    scored = found.join(mine, "q").join(nodes, "node").select("q", "node", "qv", "v").mapInArrow(_exact_scores, "q long, node long, score double")
    # Of a node no more than top + 1 rows can be among the nearest.
    first = W.partitionBy("node").orderBy("id")
    members = of_node.withColumn("n", F.row_number().over(first)).where(F.col("n") <= top + 1).select("node", "id")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best_nodes = W.partitionBy("q").orderBy(F.desc("score"), "node")
    scored = scored.withColumn("n", F.row_number().over(best_nodes)).where(F.col("n") <= top + 1).drop("n")
    answers = scored.join(members.withColumnRenamed("id", "vec_id"), "node").join(asked.select(F.col("node").alias("q"), F.col("id").alias("query_id")), "q").where("vec_id <> query_id")
    return answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
