"""Importance resampling towards a target text: hashed n-gram features, log ratios of their buckets, Gumbel top-k draws.

Texts are worked on in blocks of words. Every run of one to three words of a block is interned in an open-addressed table
of NumPy arrays: its xxhash64 picks a slot, equal keys are verified byte by byte, and other keys move on to the next slot.
A slot stores the bucket of its n-gram, computed once, and the number of occurrences. Hashes, checks and buckets are array
operations over all n-grams of a block. Counting adds the counts of the
slots by bucket. Scoring looks the gain of each slot up once; the slot ids of the occurrences then gather the gains, and
sums along the documents give their weights. Documents are cut into blocks only for this, not for the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirspan.llm.common import doc_key, stored
from weirspan.llm.sharding import positions

LONGEST = 3
BUCKETS = 10_000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: Words of a block; a table holds at most three n-grams a word.
BLOCK_WORDS = 1 << 14
#: A-Z to a-z, other ASCII than letters and digits to a space; bytes of longer UTF-8 sequences belong to words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


#: The multipliers of xxHash64 and the reversed polynomial of CRC-32: fixed values of these functions.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
CRC_POLYNOMIAL = 0xEDB88320
#: Bytes by which a CRC is moved on at once.
SHIFT_BYTES = 63


def _shift_tables() -> np.ndarray:
    """``[n, k, b]``: byte ``b`` at place ``k`` of a CRC, moved on by ``n`` zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(CRC_POLYNOMIAL) ^ (step >> 1), step >> 1).astype(np.uint32)
    tables = [np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    for _ in range(SHIFT_BYTES):
        tables.append(step[tables[-1] & np.uint32(255)] ^ (tables[-1] >> np.uint32(8)))
    return np.stack(tables)


SHIFTS = _shift_tables()


def crc_joined(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of texts of CRC ``left``, each followed by one of CRC ``right`` and ``sizes`` bytes."""
    left, open_ = left.copy(), np.flatnonzero(sizes)
    moved = 0
    while len(open_):
        n, c = np.minimum(sizes[open_] - moved, SHIFT_BYTES), left[open_]
        left[open_] = SHIFTS[n, 0, c & 255] ^ SHIFTS[n, 1, (c >> 8) & 255] ^ SHIFTS[n, 2, (c >> 16) & 255] ^ SHIFTS[n, 3, c >> 24]
        moved += SHIFT_BYTES
        open_ = open_[sizes[open_] > moved]
    return left ^ right


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64_of(joined: bytes, eights: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxHash64 (seed 0) of many pieces of ``joined``; those of 32 bytes and more, which are few, one by one."""
    found = P5 + sizes.astype(np.uint64)
    for k in range(3):
        on = np.flatnonzero(sizes >= 8 * k + 8)
        found[on] = _turned(found[on] ^ (_turned(eights[starts[on] + 8 * k] * P2, 31) * P1), 27) * P1 + P4
    on = np.flatnonzero(sizes & 4)
    found[on] = _turned(found[on] ^ ((eights[starts[on] + (sizes[on] & ~7)] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    for k in range(3):
        on = np.flatnonzero((sizes & 3) > k)
        found[on] = _turned(found[on] ^ ((eights[starts[on] + (sizes[on] & ~3) + k] & np.uint64(0xFF)) * P5), 11) * P1
    found = (found ^ (found >> np.uint64(33))) * P2
    found = (found ^ (found >> np.uint64(29))) * P3
    found ^= found >> np.uint64(32)
    long, digest = np.flatnonzero(sizes >= 32), xxhash.xxh64_intdigest
    found[long] = np.fromiter((digest(joined[a : a + n]) for a, n in zip(starts[long].tolist(), sizes[long].tolist())), np.uint64, len(long))
    return found


class Interned:
    """The n-grams of one block of words, each in a slot of an open-addressed table.

    ``starts`` and ``ends`` are the byte places of the occurrences in ``joined``; ``ids`` gives the slot of each. An
    occurrence is the words from ``first`` to ``last`` of the block.
    """

    def __init__(self, words: list[bytes], first: np.ndarray, last: np.ndarray):
        self.joined = joined = b" ".join(words)
        known = dict(zip(dict.fromkeys(words), range(len(words))))
        name = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        sizes = np.fromiter(map(len, known), np.int64, len(known))[name]
        stops = np.cumsum(sizes + 1) - 1
        self.starts, self.ends = (stops - sizes)[first], stops[last]
        # Eight bytes from any place of the text at once.
        padded = np.frombuffer(joined + bytes(8), np.uint8)
        self._eights = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(joined) + 1,), (1,))
        self.keys = xxh64_of(joined, self._eights, self.starts, self.ends - self.starts)
        size = 1 << max(4, int(2 * len(first) - 1).bit_length())
        self.owner = np.full(size, -1, np.int64)  # an occurrence that stands for the slot
        self.ids = np.empty(len(first), np.int64)
        self._intern()
        used = np.flatnonzero(self.owner >= 0)
        self.counts = np.bincount(self.ids, minlength=size)
        # The CRC of a run is put together from those of its words.
        alone = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))[name]
        spaced = np.fromiter((zlib.crc32(b" " + w) for w in known), np.uint32, len(known))[name]
        a, b = first[self.owner[used]], last[self.owner[used]]
        crc = alone[a]
        for n in range(1, LONGEST):
            on = np.flatnonzero(b - a >= n)
            crc[on] = crc_joined(crc[on], spaced[a[on] + n], sizes[a[on] + n] + 1)
        self.bucket = np.zeros(size, np.int64)
        self.bucket[used] = crc % BUCKETS

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether occurrences ``a`` and ``b`` are equal in key, length and every byte."""
        size = self.ends[a] - self.starts[a]
        same = (self.keys[a] == self.keys[b]) & (size == self.ends[b] - self.starts[b])
        done, open_ = 0, np.flatnonzero(same)
        while len(open_):
            left = np.minimum(size[open_] - done, 8).astype(np.uint64)
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)
            differ = (self._eights[self.starts[a[open_]] + done] ^ self._eights[self.starts[b[open_]] + done]) & mask
            same[open_[differ != 0]] = False
            done += 8
            open_ = open_[(differ == 0) & (size[open_] > done)]
        return same

    def _intern(self) -> None:
        mask = len(self.owner) - 1
        open_ = np.arange(len(self.starts))
        slot = (self.keys & np.uint64(mask)).astype(np.int64)
        while len(open_):
            free = self.owner[slot] < 0
            self.owner[slot[free]] = open_[free]  # of several, the last one written owns the slot
            same = self._same(open_, self.owner[slot])
            self.ids[open_[same]] = slot[same]
            open_, slot = open_[~same], (slot[~same] + 1) & mask


def blocks(texts: list[str | None], block_words: int = BLOCK_WORDS) -> Iterator[tuple[Interned, np.ndarray]]:
    """The n-grams of ``texts`` block by block, with the text of each occurrence; a run counts where it begins."""
    held: list[tuple[int, list[bytes], int]] = []  # text, words, words at which a run may begin
    size = 0
    for i, text in enumerate(texts):
        words = words_of(text)
        for at in range(0, len(words), block_words):
            begins = min(block_words, len(words) - at)
            held.append((i, words[at : at + begins + LONGEST - 1], begins))
            size += begins
            if size >= block_words:
                yield _block(held)
                held, size = [], 0
    if held:
        yield _block(held)


def _block(held: list[tuple[int, list[bytes], int]]) -> tuple[Interned, np.ndarray]:
    words = [w for _, part, _ in held for w in part]
    lengths = np.array([len(part) for _, part, _ in held])
    stops = np.cumsum(lengths)
    begin = np.concatenate([np.arange(stop - size, stop - size + n) for stop, size, (_, _, n) in zip(stops.tolist(), lengths.tolist(), held)])
    text = np.repeat([i for i, _, _ in held], [n for _, _, n in held])
    stop = np.repeat(stops, [n for _, _, n in held])
    runs = [(begin[ok], begin[ok] + n - 1, text[ok]) for n in range(1, LONGEST + 1) for ok in [begin + n <= stop]]
    first, last, owner = (np.concatenate(x) for x in zip(*runs))
    return Interned(words, first, last), owner


def bucket_counts(texts: DataFrame) -> DataFrame:
    """``bucket, n``: the n-gram occurrences of ``texts`` (text) by bucket; buckets without any are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for found, _ in blocks(batch.column(0).to_pylist()):
                np.add.at(total, found.bucket, found.counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame) -> np.ndarray:
    found = np.zeros(BUCKETS, np.int64)
    for r in counts.collect():  # at most BUCKETS rows
        found[r["bucket"]] = r["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket from its counts in the documents and in the target texts."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, k1, k2, n_words, n_features, weight`` of every row of ``docs`` (doc_id, k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight, words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for found, owner in blocks(batch.column(3).to_pylist()):
                n += np.bincount(owner, minlength=batch.num_rows)
                np.add.at(weight, owner, gain[found.bucket][found.ids])
            # A text of w words, w >= 2, has w + (w - 1) + (w - 2) runs.
            words = np.where(n >= 3, (n + 3) // 3, n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words), pa.array(n), pa.array(weight)], names=["doc_id", "k1", "k2", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Of the documents with ``least_words`` words, ``percent`` in a hundred are drawn by score, ties to the smaller doc_id;
    the rest has a NULL rank. NULL and empty texts have no features and weight 0. A NULL id is hashed as the empty text and comes last
    among ties; rows of one id and score rank in the order of their texts' hashes, a repeated row twice. Empty tables give
    an empty result, an empty target gains from the counts of the documents alone. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *doc_key(), "text")
    gain = gains(_dense(bucket_counts(docs)), _dense(bucket_counts(target)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = stored(weights(docs, gain).withColumn("score", F.col("weight") + gumbel))
    able = F.col("n_words") >= least_words
    order = [F.desc("score"), F.col("doc_id").isNull(), "doc_id", "k2"]
    long_enough = positions(rows.where(able).withColumn("all", F.lit(0)), "all", order)
    drawn = rows.where(able).count() * percent // 100
    rank = F.when(F.col("position") < drawn, F.col("position") + 1).alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return long_enough.select(*columns, rank).unionByName(rows.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
