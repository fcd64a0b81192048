"""Removal of passages that occur more than once, by level-wise doubling of repeated windows.

Documents are dealt into chunks of bounded size, and chunks are laid out once in a bucketed table, so no later step moves
the texts again. The first level takes short windows of words: each chunk hashes its windows, sends each different hash
once to the bucket of its value, and the bucket answers which of them a second window has. Only runs of windows that are
repeated at one length are extended to twice that length (the asked window at most, first), and so on until no window
survives: a window can only be repeated if all the shorter ones in it are. Short levels compare 32 bits and the bucket,
which only filters; the asked window is compared by 128 bits, and the longer ones, which only tell how long a repeat is,
by 64.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirspan.llm.common import CHECKPOINT_KEY, doc_key, ensure_checkpoint_dir

WINDOW = 35
#: The first level is the window halved so often.
HALVINGS = 2
#: Bytes of text in a chunk and in a file of chunks, and windows in a bucket, at most on average.
CHUNK_BYTES = 2 << 20
FILE_BYTES = 64 << 20
BUCKET_WINDOWS = 2_000_000

EXACT = np.dtype("S16")
LONG = np.dtype("<u8")
SHORT = np.dtype("<u4")


def levels(window: int) -> Iterator[int]:
    """Lengths in words: up to ``window`` by doubling, and on from there."""
    for k in range(HALVINGS, 0, -1):
        if (length := -(-window // (1 << k))) > 1:
            yield length
    while True:
        yield window
        window *= 2


def _mixed(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    first, second = np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[lane]), np.uint64((0xBF58476D1CE4E5B9, 0x94D049BB133111EB)[lane])
    x = (a ^ (a >> np.uint64(32))) * first + b
    x = (x ^ (x >> np.uint64(29))) * second
    return x ^ (x >> np.uint64(32))


def window_hashes(marks: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Hash of the ``length`` word hashes that begin at each place of ``marks``."""
    size = 1
    while size < length and len(marks):
        ahead = min(size, length - size)
        marks, size = _mixed(marks[: max(0, len(marks) - ahead)], marks[ahead:], lane), size + ahead
    return marks


class Windows:
    """The windows of ``length`` words in several pieces of word hashes, each with a bucket and a key inside it."""

    def __init__(self, pieces: list[np.ndarray], length: int, buckets: int, kind: np.dtype):
        marks = np.concatenate(pieces) if pieces else np.empty(0, np.uint64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.begins = np.cumsum(sizes) - sizes
        hashes = window_hashes(marks, length)
        inside = np.zeros(len(marks) + 1, np.int64)
        able = sizes >= length
        np.add.at(inside, self.begins[able], 1)
        np.add.at(inside, (self.begins + sizes - length + 1)[able], -1)
        self.at = np.flatnonzero(np.cumsum(inside))  # places at which a whole window of one piece begins
        self.total = len(marks)
        hashes = hashes[self.at]
        self.bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint64)
        if kind == EXACT:
            other = window_hashes(marks, length, 1)[self.at]
            self.key = np.frombuffer(np.stack([hashes, other], axis=1).tobytes(), EXACT)
        else:
            self.key = hashes if kind == LONG else (hashes & np.uint64(0xFFFFFFFF)).astype(SHORT)

    @staticmethod
    def code(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
        """One value for bucket and key; longer keys fix their bucket."""
        return key if key.dtype != SHORT else (bucket << np.uint64(32)) | key.astype(np.uint64)

    def runs(self, repeated: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
        """Piece, place in it and number of windows of every run of ``least`` or more repeated windows."""
        hit = np.zeros(self.total + 2, np.int8)
        codes = self.code(self.bucket, self.key)
        if codes.dtype == EXACT:
            same = np.isin(codes, repeated)
        else:  # most windows are ruled out by a few bits
            low = np.uint64(0xFFFFF)
            near = np.zeros(1 << 20, bool)
            near[repeated & low] = True
            same = near[codes & low]
            same[same] = np.isin(codes[same], repeated)
        hit[self.at[same] + 1] = 1
        edge = np.diff(hit)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for a, b in zip(first.tolist(), last.tolist()):
            if b - a >= least:
                piece = int(np.searchsorted(self.begins, a, "right")) - 1
                yield piece, a - int(self.begins[piece]), b - a


def _words(texts: pa.ChunkedArray) -> list[list[bytes]]:
    return [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts.to_pylist()]


def _pieces_of_texts(table: pa.Table) -> list[np.ndarray]:
    digest = xxhash.xxh3_64_intdigest
    return [np.fromiter(map(digest, words), np.uint64, len(words)) for words in _words(table["text"])]


def _pieces_of_runs(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(m, np.uint64) for m in table["marks"].to_pylist()]


ASKED = "bucket long, chunk long, once binary, more binary"
ANSWERED = "chunk long, bucket long, found binary"
RUNS = "chunk long, k1 long, k2 long, at int, windows int, marks binary"


def _ask(pieces_of, length: int, buckets: int, kind: np.dtype):
    """The different windows of a chunk, by bucket: those it has once, those it has more than once."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = Windows(pieces_of(table), length, buckets, kind)
        if kind != SHORT:
            order = np.lexsort((found.key, found.bucket))
            bucket, keys = found.bucket[order], found.key[order]
        else:
            codes = np.sort(found.code(found.bucket, found.key))
            bucket, keys = codes >> np.uint64(32), (codes & np.uint64(0xFFFFFFFF)).astype(SHORT)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])
        begins = np.flatnonzero(new)
        more = np.diff(np.append(begins, len(keys))) > 1
        bucket, keys = bucket[begins], keys[begins]
        names, first = np.unique(bucket, return_index=True)
        rows = [(keys[a:b][~more[a:b]].tobytes(), keys[a:b][more[a:b]].tobytes()) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)])]
        columns = [pa.array(names.astype(np.int64)), pa.array([key[0].as_py()] * len(names), pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())]
        return pa.table(columns, names=["bucket", "chunk", "once", "more"])

    return run


def _answer(kind: np.dtype):
    """For each chunk that asked a bucket, those of its windows that the bucket knows more than once."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        once = [np.frombuffer(b, kind) for b in table["once"].to_pylist()]
        more = [np.frombuffer(b, kind) for b in table["more"].to_pylist()]
        values, owner = np.concatenate(once), np.repeat(np.arange(len(once)), [len(o) for o in once])
        known = np.concatenate(more)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        hit = np.zeros(len(values), bool)
        equal = values[1:] == values[:-1]
        hit[1:] |= equal
        hit[:-1] |= equal
        hit |= np.isin(values, known)
        values, owner = values[hit], owner[hit]
        order = np.argsort(owner, kind="stable")
        parts = np.split(values[order], np.cumsum(np.bincount(owner, minlength=len(once)))[:-1])
        chunk, found = table["chunk"].combine_chunks(), [p.tobytes() + m.tobytes() for p, m in zip(parts, more)]
        rows = pa.table([chunk, pa.array([key[0].as_py()] * len(chunk), pa.int64()), pa.array(found, pa.binary())], names=["chunk", "bucket", "found"])
        return rows.filter(pa.array([bool(f) for f in found], pa.bool_()))

    return run


def _surviving(pieces_of, length: int, buckets: int, kind: np.dtype, least: int):
    """The runs of repeated windows of a chunk, with the words they cover; ``least`` windows are enough for the next level."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if answers.num_rows and table.num_rows:
            pieces = pieces_of(table)
            codes = [Windows.code(np.uint64(b), np.frombuffer(f, kind)) for b, f in zip(answers["bucket"].to_pylist(), answers["found"].to_pylist())]
            k1, k2 = table["k1"].to_pylist(), table["k2"].to_pylist()
            before = table["at"].to_pylist() if "at" in table.column_names else [0] * len(pieces)
            for i, at, n in Windows(pieces, length, buckets, kind).runs(np.concatenate(codes), least):
                rows.append((key[0].as_py(), k1[i], k2[i], before[i] + at, n, pieces[i][at : at + n + length - 1].tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["chunk", "k1", "k2", "at", "windows", "marks"])

    return run


def _bucketed(df: DataFrame, files: int) -> DataFrame:
    """``df`` as a table bucketed by chunk in the shared folder: grouping by chunk needs no exchange any more."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"chunks_{uuid.uuid4().hex}"
    folder = f"{spark.sparkContext.getCheckpointDir() or spark.conf.get(CHECKPOINT_KEY)}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", folder).bucketBy(files, "chunk").saveAsTable(name)
    return spark.table(name)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """``doc_id, k1, k2, text, chunk`` of every row, bucketed by chunk, with the number of files and of words at most."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    chunks = max(1, -(-size // chunk_bytes))
    # Dealt by the row, not by its values: rows that are all equal spread like others.
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *doc_key(), "text").withColumn("chunk", chunk)
    return _bucketed(rows.repartition(files, "chunk"), files), files, size // 2


def repeated_runs(texts: DataFrame, files: int, most_words: int, window: int = WINDOW, bucket_windows: int = BUCKET_WINDOWS) -> tuple[DataFrame | None, list[tuple[int, DataFrame]]]:
    """Runs (chunk, k1, k2, at, windows) of repeated windows of ``window`` words, and for each longer level its runs."""
    state, pieces_of, found = texts, _pieces_of_texts, []
    steps = levels(window)
    length = next(steps)
    while most_words:
        following, kind = next(steps), SHORT if length < window else EXACT if length == window else LONG
        buckets = -(-most_words // bucket_windows)
        asked = state.groupBy("chunk").applyInArrow(_ask(pieces_of, length, buckets, kind), ASKED)
        answers = asked.groupBy("bucket").applyInArrow(_answer(kind), ANSWERED)
        least = following - length + 1 if kind == SHORT else 1
        left = state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_surviving(pieces_of, length, buckets, kind, least), RUNS)
        state, pieces_of = _bucketed(left, files), _pieces_of_runs
        if kind != SHORT:
            found.append((length, state))
            state = state.where(F.col("windows") > following - length)
        most_words = (state.agg(F.sum(F.length("marks"))).first()[0] or 0) // 8
        length = following
    return (found[0][1] if found else None), found


def _without(table: pa.Table, runs: pa.Table, window: int) -> pa.Table:
    spans: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for k1, k2, at, windows, longest in zip(*(runs[c].to_pylist() for c in ("k1", "k2", "at", "windows", "longest"))):
        spans.setdefault((k1, k2), []).append((at, at + windows + window - 1, longest))
    rows = []
    for doc, k1, k2, words in zip(table["doc_id"].to_pylist(), table["k1"].to_pylist(), table["k2"].to_pylist(), _words(table["text"])):
        own = sorted(set(spans.get((k1, k2), ())))
        gone, cover = np.zeros(len(words), bool), []
        for a, b, _ in own:
            gone[a:b] = True
            if cover and a <= cover[-1]["end"]:
                cover[-1]["end"] = max(b, cover[-1]["end"])
            else:
                cover.append({"start": a, "end": b})
        kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if own else b" ".join(words)
        rows.append((doc, len(words), int(gone.sum()), max((x for _, _, x in own), default=0), cover, kept.decode("utf-8", "surrogatepass")))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), span, pa.string()]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_words", "n_removed", "longest", "spans", "text"])


def remove_repeated(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """``doc_id, n_words, n_removed, longest, spans, text`` for every row of ``docs`` (doc_id, text).

    Words stand between ASCII white space and are compared unchanged. Every word that lies in a window of ``window`` words
    whose sequence begins anywhere else too, in the same text or another, is removed: no occurrence stays. ``spans`` are
    the removed stretches as word places (end exclusive), ``text`` the kept words joined by one space, ``longest`` the
    length of the longest window at which the doubling found a repeat (0: none). A repeated row is a text of its own, so
    both are removed. NULL and empty texts have no words; a NULL id is kept. Very long texts are whole in one chunk. An empty
    table gives an empty result. Other columns are ignored. The rows should come from files or a stored table, as their
    order there deals them out.
    """
    texts, files, most_words = chunked(docs, chunk_bytes)
    first, found = repeated_runs(texts, files, most_words, window, bucket_windows)
    if first is None:
        runs = texts.select("chunk", "k1", "k2", F.lit(0).alias("at"), F.lit(0).alias("windows"), F.lit(0).alias("longest")).limit(0)
    else:
        # A run of the longer level lies in one of the first level.
        reach = [rows.select("chunk", "k1", "k2", F.lit(length).alias("longest")) for length, rows in found]
        longest = reach[0]
        for more in reach[1:]:
            longest = longest.unionByName(more)
        longest = longest.groupBy("chunk", "k1", "k2").agg(F.max("longest").alias("longest"))
        runs = first.select("chunk", "k1", "k2", "at", "windows").join(longest, ["chunk", "k1", "k2"])
    schema = "doc_id long, n_words long, n_removed long, longest int, spans array<struct<start:int,end:int>>, text string"

    def without(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        return _without(table, found, window)

    return texts.groupBy("chunk").cogroup(runs.groupBy("chunk")).applyInArrow(without, schema)
