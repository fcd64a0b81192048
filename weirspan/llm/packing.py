"""Best-fit packing of token pieces into sequences of fixed length by hierarchical residual rounds.

Every round deals the open bins into groups of bounded size and packs each group best-fit decreasing. Bins that
are nearly full, or too full for the smallest bin still open, are emitted. The others go on to the next round as
items, in fewer groups, until one group is left or a round no longer joins anything. A piece finds its place by
following its bin through the rounds.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirspan.llm.common import cut_lineage

CAPACITY = 4096
END_ID = 1
#: Most items that one group packs; bounds the memory of a task.
GROUP_ITEMS = 4096
#: A bin with at most this share of its room left is emitted.
NEARLY_FULL = 1 / 256
MOST_ROUNDS = 8
#: Chunks whose ids a Python worker remembers, about 200 bytes each; the memory is cleared when it is full.
CACHED_CHUNKS = 1_500_000
#: Characters of text that a worker splits at a time.
BLOCK_CHARS = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkIds:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, drops white space and joins neither across it nor between letters and signs. The ids of
    a text are therefore those of its blank-separated chunks in order, and those of a word with signs behind it are
    the word's and the signs'. A part is encoded once while it is remembered.
    """

    #: Stands between parts that are encoded in one call; its id is a single one. Parts that hold it are encoded alone.
    MARK = "|"
    SIGN_BEFORE_STOP = re.compile(r"[.,](?<=[^\w\s][.,]|_[.,]) ")
    WORD_SIGNS = re.compile(r"([^\W\d_]+)([.,;:!?$%&*#]+)")

    def __init__(self, path: str, limit: int = CACHED_CHUNKS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self._ids(self.MARK)
        self.limit = limit
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, parts: list[str]) -> None:
        together = []
        for part in parts:
            if self.MARK in part:
                self.known[part] = np.asarray(self._ids(part), "<u4").tobytes()
            else:
                together.append(part)
        for at in range(0, len(together), 1000):
            few = together[at : at + 1000]
            ids = np.asarray(self._ids(f" {self.MARK} ".join(few)), "<u4")
            ends = [*(4 * np.flatnonzero(ids == self.mark)).tolist(), 4 * len(ids)]
            raw, lo = ids.tobytes(), 0
            for part, hi in zip(few, ends, strict=True):
                self.known[part] = raw[lo:hi]
                lo = hi + 4

    @classmethod
    def _chunks(cls, text: str) -> list[str]:
        # Within Latin-1 lower-casing first changes nothing; elsewhere, and near special tokens, it is left to the tokenizer.
        try:
            text.encode("latin-1")
            text = text if "<|" in text else text.lower()
        except UnicodeEncodeError:
            pass
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        # A stop behind a letter or digit and before a blank is a part of its own in any case.
        if not cls.SIGN_BEFORE_STOP.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ")
        return text.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts = [self._chunks(t) if t else [] for t in texts]
        if len(self.known) > self.limit:
            self.known = {"": b""}
        known = self.known
        found = [list(map(known.get, p)) for p in parts]
        holes = [[i for i, v in enumerate(f) if v is None] for f in found]
        new = {p[i] for p, h in zip(parts, holes) for i in h}
        split = {c: m.groups() for c in new if (m := self.WORD_SIGNS.fullmatch(c))}
        bare = (new - split.keys()).union(*split.values())
        self._learn(list(filterfalse(known.__contains__, bare)))
        for chunk, (word, signs) in split.items():
            known[chunk] = known[word] + known[signs]
        for p, f, h in zip(parts, found, holes):
            for i in h:
                f[i] = known[p[i]]
        return [b"".join(f) for f in found]


_ENCODERS: dict[str, ChunkIds] = {}


def _cuts(chars: np.ndarray) -> list[tuple[int, int]]:
    """Start and number of the rows of each block of about ``BLOCK_CHARS``, given the running sum of their characters."""
    if not len(chars):
        return []
    starts = np.flatnonzero(np.diff(np.r_[-1, chars // BLOCK_CHARS])).tolist()
    return list(zip(starts, np.diff([*starts, len(chars)]).tolist()))


def _pieces_of(path: str, capacity: int, end_id: int):
    end = np.asarray([end_id], "<u4").tobytes()
    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, ChunkIds(path))
        for batch in batches:
            chars = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            for at in _cuts(chars):
                few = batch.slice(*at)
                rows = []
                for doc, ids in zip(few.column(0).to_pylist(), encoder.encode(few.column(1).to_pylist())):
                    ids += end
                    for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[lo : lo + 4 * capacity]
                        rows.append((doc, k, lo // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens of every row of ``docs`` (doc_id, text).

    A NULL or empty text is the end id alone. Repeated rows each give their pieces; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces_of(path or tokenizer_path(), capacity, end_id), PIECES)


def best_fit(fills: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each item the number of its bin and its offset there.

    Bins are found by their room: a bit mask says which rooms occur, and each room has a stack of its bins.
    """
    order = np.argsort(-fills, kind="stable").tolist()
    sizes = fills.tolist()
    bin_of, offset_of = [0] * len(sizes), [0] * len(sizes)
    by_room: dict[int, list[int]] = {}
    mask = bins = 0
    for i in order:
        size = sizes[i]
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        bin_of[i], offset_of[i] = b, capacity - room
        room -= size
        if room:
            by_room.setdefault(room, []).append(b)
            mask |= 1 << room
    return np.asarray(bin_of, np.int64), np.asarray(offset_of, np.int64)


def _pack_group(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        fills = group["fill"].to_numpy()
        number, offset = best_fit(fills, capacity)
        # A bin is named after its first and largest item, so names stay unique over all rounds.
        first = group["bin"].to_numpy()[np.unique(number, return_index=True)[1]]
        total = np.bincount(number, weights=fills).astype(np.int64)
        return pd.DataFrame({"bin": group["bin"], "parent": first[number], "offset": offset, "parent_fill": total[number]})

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, rounds: int = MOST_ROUNDS) -> DataFrame:
    """``item, sequence_id, offset`` for the rows of ``items`` (item long, unique; length long, 1 to ``capacity``)."""
    full = items.where(F.col("length") == capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    state = items.where(F.col("length") < capacity).select(F.col("item").alias("bin"), F.col("length").alias("fill"))
    size, levels = state.count(), []
    for level in range(rounds):
        if not size:
            break
        groups = -(-size // group_items)
        dealt = state.select("bin", "fill", F.pmod(F.xxhash64(F.lit(level), "bin"), F.lit(groups)).alias("g"))
        packed = cut_lineage(dealt.groupBy("g").applyInPandas(_pack_group(capacity), "bin long, parent long, offset long, parent_fill long"))
        levels.append(packed)
        bins = packed.where(F.col("bin") == F.col("parent")).select("bin", F.col("parent_fill").alias("fill"))
        found = bins.agg(F.count("bin"), F.min("fill")).first()
        joined, least = found[0] < size, found[1]
        room = F.lit(capacity) - F.col("fill")
        state = bins.where((room > int(capacity * NEARLY_FULL)) & (room >= least))
        size = state.count()
        if groups == 1 or (not joined and level):
            break
    placed = None
    for packed in levels:
        step = packed.select("bin", "parent", F.col("offset").alias("more"))
        if placed is None:
            placed = step.select(F.col("bin").alias("item"), F.col("parent").alias("sequence_id"), F.col("more").alias("offset"))
        else:
            placed = placed.join(step, placed["sequence_id"] == step["bin"], "left").select(
                "item", F.coalesce("parent", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset")
            )
    return full if placed is None else full.unionByName(placed)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Only texts longer than ``capacity`` tokens are cut. An empty table gives an empty result; ties between equal
    lengths go by an internal number, so equal tables laid out alike pack alike.
    """
    pieces = cut_lineage(token_pieces(docs, path, capacity).withColumn("item", F.monotonically_increasing_id()))
    return pieces.join(pack(pieces.select("item", "length"), capacity, group_items), "item").drop("item")
