"""Near-duplicate classes by word shingles: texts whose shingle sets have a Jaccard similarity of 0.8 or more are linked.

At that similarity SimHash fingerprints of 64 bits lie ten bits apart on average and up to about twenty, too far for
equal blocks. Candidates are therefore texts that agree in a band of ``ROWS`` of ``BANDS * ROWS`` minima of hashes: a
pair at 0.8 has none in common with a probability of 7e-5, a closer one less. Every candidate pair that can still join
two classes is verified by the shingle sets themselves. A bucket of equal bands is first compared with two of its members,
the smallest and the most central one: that whose bands are shared most. So copies of one text, however many, cost a few
comparisons each.

Members that are then still in different classes are told apart by what they do not share with the central member r of
their bucket; buckets with one r are worked on as one. Be D(x) the shingles that only one of x and r has. Two members
differ by the shingles that only one of D(x) and D(y) has, so members that are similar to each other, while y is not
similar to r, need at least about half of D(x) in D(y). A prefix filter on these sets is exact: put rare shingles first,
and one of the first half of D(x) is in D(y). Copies of one text with edits of their own share the text and r's edits,
which are common and come last, so however many they are, they meet only if they share edits of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirspan.llm.common import cut_lineage, doc_key, stored, words_of
from weirspan.llm.components import components, joined_classes

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
SEED = 42
#: Cells in which the occurrences of shingles are counted; they only put shingles in order, so collisions do no harm.
CELLS = 1 << 18


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, one without words has none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) < shingle:
        hashes = [digest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        hashes = [digest(joined[a:b], SEED) for a, b in zip((ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return np.unique(np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64))


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    words = [[xxhash.xxh64_intdigest(i.to_bytes(4, "big"), s) for i in range(n)] for s in (SEED, SEED + 1)]
    return np.array(words[0], np.uint64), np.array(words[1], np.uint64) | np.uint64(1)


def band_keys(found: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """A signed key for each band of minima of a shingle set that is not empty."""
    flip, factor = _factors(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        mixed = (found[at : at + 2048, None] ^ flip[None, :]) * factor[None, :]
        least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(32))) * factor[None, ::-1]).min(0))
    parts = least.reshape(bands, rows)
    return [int.from_bytes(xxhash.xxh64_digest(p.tobytes(), i), "big", signed=True) for i, p in enumerate(parts)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def _nodes(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = [int.from_bytes(xxhash.xxh64_digest(b" ".join(words_of(t.as_py())), SEED), "big", signed=True) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(node, pa.int64())], names=["doc_id", "k1", "k2", "node"])

    return run


def _banded(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingle_set(text.as_py(), shingle)
                if len(found):
                    nodes.append(node)
                    sizes.append(len(found))
                    keys.append(band_keys(found))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "n", "keys"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "found"])

    return run


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(i)] for i in (2, 3))
            near = pa.array([similarity(x, y) >= least for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough; ``texts`` has (node, text)."""
    pairs = stored(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stored(texts.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(_sets(shingle), "node long, found binary"))
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("sb")), "b")
    return stored(met.select("a", "b", "sa", "sb").mapInArrow(_verified(least), "a long, b long"))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        for found in batch.column(0):
            np.add.at(total, (np.frombuffer(found.as_buffer(), np.uint64) % np.uint64(CELLS)).astype(np.int64), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])


def ordered(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set in the one order of all sets, rare ones first."""
    return found[np.lexsort((found, counts[(found % np.uint64(len(counts))).astype(np.int64)]))]


def least_shared(d: int, n: int, n_low: int, least: float) -> int:
    """How many of the ``d`` shingles between a member of ``n`` and r of ``n_low`` another member must share.

    Holds for any other that is not similar to r.
    """
    return max(1, math.ceil((d + (1 - least) / (1 + least) * (n_low - n)) / 2 - 1e-6))


DIFFERENCES = "low long, node long, component long, n int, n_low int, found binary"
PLACED = "low long, node long, component long, n int, d int, key long, at int, first boolean, far boolean"


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(i)] for i in (3, 4))
        found = [np.setxor1d(x, y, assume_unique=True).tobytes() for x, y in zip(a, b)]
        sizes = [pa.array([len(x) for x in side], pa.int32()) for side in (a, b)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *sizes, pa.array(found, pa.binary())], names=["low", "node", "component", "n", "n_low", "found"])


def _placed(counts: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for low, node, component, n, n_low, found in zip(*(c.to_pylist() for c in batch.columns)):
                keys = ordered(np.frombuffer(found, np.uint64), counts).view(np.int64).tolist()
                d = len(keys)
                first = d - least_shared(d, n, n_low, least) + 1
                far = d * (1 + least) > (1 - least) * (n + n_low) + 1e-6
                rows += [(low, node, component, n, d, key, at, at < first, far) for at, key in enumerate(keys) if far or at < first]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["low", "node", "component", "n", "d", "key", "at", "first", "far"])

    return run


def _fits(a: str, b: str, least: float) -> Column:
    """Sets whose sizes differ by more cannot be similar enough."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(least) - 1e-9


def _open_pairs(sides: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Pairs (a, b) of the members (low, node, component) of one ``low`` and different components that may be similar enough."""
    wanted = sides.select(F.explode(F.array("node", "low")).alias("node")).distinct()
    sets = stored(texts.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(_sets(shingle), "node long, found binary"))
    met = sides.join(sets.select("node", F.col("found").alias("own")), "node").join(sets.select(F.col("node").alias("low"), F.col("found").alias("other")), "low")
    found = stored(met.select("low", "node", "component", "own", "other").mapInArrow(_differences, DIFFERENCES))
    counts = np.zeros(CELLS, np.int64)
    for r in found.select("found").mapInArrow(_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most CELLS rows
        counts[r["cell"]] = r["n"]
    placed = stored(found.mapInArrow(_placed(counts, least), PLACED))
    other = placed.where("far").select("low", "key", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "n", "d", "at")])
    share = (1 - least) / (1 + least)
    needed = (F.col("d") + F.col("d_b") - F.lit(share) * (F.col("n") + F.col("n_b"))) / 2 - 1e-6
    reach = F.least(F.col("d") - F.col("at"), F.col("d_b") - F.col("at_b")) >= needed
    cross = placed.where("first").join(other, ["low", "key"]).where((F.col("component") != F.col("component_b")) & _fits("n", "n_b", least) & reach)
    return cross.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()


def links(texts: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Edges ``a, b`` between the nodes of ``texts`` (node, text) whose components are those of all similar candidate pairs."""
    banded = texts.select("node", "text").mapInArrow(_banded(shingle), "node long, n int, keys array<long>")
    members = stored(banded.select("node", "n", F.posexplode("keys").alias("band", "key")))
    bucket = ["band", "key"]
    crowds = members.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rivals = stored(members.join(crowds, bucket))
    rated = stored(rivals.join(rivals.groupBy("node").agg(F.sum("size").alias("weight")), "node"))
    ends = rated.groupBy(*bucket).agg(F.min(F.struct("node", "n")).alias("least"), F.max(F.struct("weight", "node", "n")).alias("central"))
    rated = stored(rated.join(ends, bucket))
    end = F.explode(F.array(F.struct("least.node", "least.n"), F.struct("central.node", "central.n"))).alias("end")
    stars = rated.select("node", "n", end).where((F.col("node") != F.col("end.node")) & _fits("n", "end.n", least))
    first = _links(stars.select(F.least("node", "end.node").alias("a"), F.greatest("node", "end.node").alias("b")).distinct(), texts, shingle, least)
    # A bucket of two is settled by that.
    named = rated.where("size > 2").select(F.col("central.node").alias("low"), "node").distinct().join(components(first), "node", "left")
    named = stored(named.select("low", "node", F.coalesce("component", "node").alias("component")))
    apart = named.groupBy("low").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("low")
    open_ = stored(named.join(apart, "low", "left_semi"))
    if open_.isEmpty():
        return first
    return first.unionByName(_links(_open_pairs(open_, texts, shingle, least), texts, shingle, least))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, k1, k2, component`` for the rows of ``docs`` (doc_id, text).

    Texts with the same words are one node, however many they are; NULL and empty texts are one class. An empty table
    gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *doc_key(), "text")
    nodes = stored(rows.mapInArrow(_nodes(shingle), "doc_id long, k1 long, k2 long, node long"))
    # One text stands for a node: that of its smallest key.
    chosen = nodes.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("best")).select("node", "best.k1", "best.k2")
    texts = stored(rows.select("k1", "k2", "text").join(chosen.hint("merge"), ["k1", "k2"]).select("node", "text").dropDuplicates(["node"]))
    found = components(links(texts, shingle, least))
    return nodes.join(found, "node", "left").select("doc_id", "k1", "k2", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, also: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the smallest doc_id stays.

    ``also`` (doc_id, k1, k2, component) gives classes of the same rows found in another way, which are joined with these.

    NULL ids come last; among rows with one id the text with the smallest hash stays, and a repeated row stays once.
    All columns are kept.
    """
    found = near_duplicates(docs, shingle, least)
    found = found if also is None else joined_classes(found, also)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    best = cut_lineage(found.groupBy("component").agg(F.min(order).alias("best")).select(F.col("best.k1").alias("__k1"), F.col("best.k2").alias("__k2")))
    k1, k2 = doc_key()
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})
    return keyed.join(best.hint("merge"), ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).select(*[keyed[f"`{c}`"] for c in docs.columns])
