"""SimHash near-duplicate classes by pivot distance tables.

Fingerprints are first reduced to distinct ones. Two that differ in at most four of 64 bits agree in three of seven
blocks, so every link lies in a bucket of equal blocks. Inside a bucket the Hamming distances of its members to many
reference fingerprints form a table; a pair whose coordinates differ by more than four anywhere cannot be a link and
is dropped, and the survivors are verified. A bucket with more members than ``MOST_IN_BUCKET`` is not paired: each
of its members is spread over all words within two bits of it, and two members link exactly if they meet in such a
word. A word meets 2,081 fingerprints at most, so no group grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirspan.llm.common import cut_lineage, doc_key, words_of
from weirspan.llm.components import components

BITS = 64
DISTANCE = 4
SHINGLE = 4
SEED = 42
BLOCKS = 7
PIVOTS = 32
MOST_IN_BUCKET = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the whole text; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) < shingle:
        hashes = [digest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        hashes = [digest(joined[a:b], SEED) for a, b in zip((ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.frombuffer(b"".join(hashes[at : at + 8192]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([fingerprint(t.as_py()) for t in batch.column(3)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=["doc_id", "k1", "k2", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, fp`` of every row of ``docs`` (doc_id, text); NULL and empty texts have fingerprint 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *doc_key(), "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, k1 long, k2 long, fp long")


def _block_masks(blocks: int, distance: int) -> tuple[list[int], list[int], np.ndarray]:
    """Masks of the blocks, of the bucket keys, and for each pattern of equal blocks the first key inside it."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    chosen = list(combinations(range(blocks), blocks - distance))
    first = np.full(1 << blocks, -1, np.int16)
    for pattern in range(1 << blocks):
        first[pattern] = next((i for i, c in enumerate(chosen) if all(pattern >> b & 1 for b in c)), -1)
    return single, [sum(single[b] for b in c) for c in chosen], first


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def pivot_words(pivots: int) -> np.ndarray:
    """The reference fingerprints; any fixed words serve, these are hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "big"), SEED) for i in range(pivots)], np.uint64)


def _links(blocks: int, distance: int, pivots: int, most: int):
    single, _, first = _block_masks(blocks, distance)
    single = np.array(single, np.uint64)
    words = pivot_words(pivots)

    def settle(key: np.ndarray, fp: np.ndarray, combo: np.ndarray) -> pa.RecordBatch:
        """Links (a < b) inside the whole buckets given; a row with a = b marks a member of a bucket too large to pair."""
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (combo[1:] != combo[:-1])])
        length = np.diff(np.r_[start, len(fp)])
        size = np.repeat(length, length)
        outs = [(fp[size > most], fp[size > most])]
        use = (size > 1) & (size <= most)
        run, f, c = np.repeat(np.arange(len(start)), length)[use], fp[use], combo[use]
        table = np.bitwise_count(f[:, None] ^ words[None, :]).astype(np.int8)
        for step in range(1, int(length[length <= most].max(initial=1))):
            i = np.flatnonzero(run[step:] == run[:-step])
            for p in range(pivots):
                i = i[np.abs(table[i, p] - table[i + step, p]) <= distance]
            differing = f[i] ^ f[i + step]
            near = np.bitwise_count(differing) <= distance
            i, differing = i[near], differing[near]
            equal = ((differing[:, None] & single[None, :]) == 0) @ (1 << np.arange(blocks))
            i = i[first[equal] == c[i]]  # a pair that meets in several buckets is given once
            outs.append((f[i], f[i + step]))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*outs))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combo, key, fp = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            combo, key, fp = np.r_[combo, new[0]], np.r_[key, new[1]], np.r_[fp, new[2].view(np.uint64)]
            change = np.flatnonzero((key[1:] != key[:-1]) | (combo[1:] != combo[:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield settle(key[:cut], fp[:cut], combo[:cut])
                combo, key, fp = combo[cut:], key[cut:], fp[cut:]
            if len(fp) > 2 * most + 2:  # surely too large: only enough rows to know it are kept
                dense = pa.array(fp[most + 1 :].view(np.int64))
                yield pa.RecordBatch.from_arrays([dense, dense], names=["a", "b"])
                combo, key, fp = combo[: most + 1], key[: most + 1], fp[: most + 1]
        if len(fp):
            yield settle(key, fp, combo)

    return run


def _words_near(radius: int):
    masks = np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(BITS), r)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                fp = batch.column(0).slice(at, 256).to_numpy(zero_copy_only=False).view(np.uint64)
                word = (fp[:, None] ^ masks[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.repeat(fp.view(np.int64), len(masks)))], names=["word", "fp"])

    return run


def links(distinct: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, pivots: int = PIVOTS, most: int = MOST_IN_BUCKET) -> DataFrame:
    """Edges ``a, b`` between the fingerprints of ``distinct`` (fp) whose components are those of all pairs within ``distance`` bits."""
    if distance % 2:
        raise ValueError("the word midway between two fingerprints needs an even distance")
    _, keys, _ = _block_masks(blocks, distance)
    fp = F.col("fp")
    rows = distinct.select(F.posexplode(F.array(*[fp.bitwiseAND(F.lit(_signed(k))) for k in keys])).alias("combo", "key"), "fp")
    rows = rows.repartition("combo", "key").sortWithinPartitions("combo", "key")
    found = cut_lineage(rows.mapInArrow(_links(blocks, distance, pivots, most), "a long, b long"))
    pairs, dense = found.where("a <> b"), found.where("a = b").select(F.col("a").alias("fp")).distinct()
    if dense.isEmpty():
        return pairs
    met = dense.mapInArrow(_words_near(distance // 2), "word long, fp long").groupBy("word").agg(F.collect_list("fp").alias("fps"))
    stars = met.where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return pairs.unionByName(stars)


def near_duplicates(prints: DataFrame, **options: int) -> DataFrame:
    """``doc_id, k1, k2, fp, component, component_id`` for the rows of ``fingerprints``.

    ``component`` is the smallest fingerprint of the class.
    ``component_id`` is the smallest doc_id reachable over links, NULL only if all ids of the component are NULL.
    Copies share a fingerprint and are one node, however many they are. An empty table gives an empty result.
    """
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select("fp"), **options)).withColumnRenamed("node", "fp")
    named = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    best = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(best, "component").select("fp", "component", "component_id"), "fp").select("doc_id", "k1", "k2", "fp", "component", "component_id")


def report(docs: DataFrame, **options: int) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; the fingerprint as 16 lower-case hex digits."""
    found = near_duplicates(cut_lineage(fingerprints(docs)), **options)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
