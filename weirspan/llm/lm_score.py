"""Scores of texts under a hidden Markov language model trained on the corpus.

A word's class is a hash of its last letters (of the whole word if it is short). Latent states emit classes, and a
class emits its words as often as the training texts have them: P(w) = P(class | state) P(w | class). The states are
trained by Baum-Welch: tasks add up expected counts over their texts, the counts are summed over all tasks, and the
driver only holds the model, whose size is fixed by its parameters. The likelihood of a text is exact.

Texts are coded block by block: each block has a dictionary of its own words. Word counts are summed over all
dictionaries and joined back to them, so each text meets the counts of its words without any table of the whole
vocabulary in one place.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirspan.llm.common import stored, words_of
from weirspan.llm.hidden_markov import Model, batches_by_length, expected_counts, log10_likelihoods

STATES = 8
CLASSES = 4096
ENDING = 3
#: Warm-up rounds of Baum-Welch, each over its own part of the training texts; one round over all of them follows.
PARTS = 4
#: A block ends when it has this many words or tokens.
BLOCK_WORDS = 400_000
BLOCK_TOKENS = 3_000_000
END = b"\n"
ADDED = 0.5

CODED = "block long, doc_id long, held_out boolean, part int, codes binary, classes binary, word binary, code int, class int, n long"


def word_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word if len(word) <= ENDING + 1 else b"~" + word[-ENDING:]) % classes


class _Block(dict):
    """Codes of the words of a block, in the order they come."""

    def __init__(self, classes: int):
        super().__init__()
        self.classes, self.class_of, self.trained, self.tokens = classes, array("H"), [], 0

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        self.class_of.append(word_class(word, self.classes))
        return code

    def add(self, text: str | None, held_out: bool) -> tuple[bytes, bytes]:
        words = words_of(text)
        words.append(END)
        codes = np.fromiter(map(self.__getitem__, words), np.uint32, len(words))
        self.tokens += len(codes)
        if not held_out:
            self.trained.append(codes)
        return codes.tobytes(), np.frombuffer(self.class_of, np.uint16)[codes].tobytes()

    def counts(self) -> np.ndarray:
        return np.bincount(np.concatenate(self.trained), minlength=len(self)) if self.trained else np.zeros(len(self), np.int64)


def _coded(classes: int):
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[k]) for n, k in (f.split() for f in CODED.split(", "))])

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def dictionary(number: int, block: _Block) -> Iterator[pa.RecordBatch]:
        words, n, of = list(block), block.counts(), np.frombuffer(block.class_of, np.uint16)
        for at in range(0, len(words), 50_000):
            few = slice(at, at + 50_000)
            size = len(words[few])
            yield rows(size, block=np.full(size, number), word=words[few], code=np.arange(at, at + size, dtype=np.int32), **{"class": of[few].astype(np.int32)}, n=n[few])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 24, _Block(classes)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                doc, held, part, text = (c.to_pylist() for c in batch.slice(at, 128).columns)
                codes, own = zip(*map(block.add, text, held))
                yield rows(len(doc), block=np.full(len(doc), number), doc_id=doc, held_out=held, part=part, codes=codes, classes=own)
                if len(block) > BLOCK_WORDS or block.tokens > BLOCK_TOKENS:
                    yield from dictionary(number, block)
                    number, block = number + 1, _Block(classes)
        yield from dictionary(number, block)

    return run


def _count(model: Model, classes: int, buffered: int = 2_000_000):
    """Sums the expected counts of a task's texts; one row per parameter of the model leaves the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = np.zeros((len(model.start), 1 + len(model.start) + classes)), [], 0

        def settle() -> None:
            for few in batches_by_length(waiting):
                total.__iadd__(expected_counts(model, few))

        for batch in batches:
            for own in batch.column(0):
                waiting.append(np.frombuffer(own.as_py(), np.uint16))
                size += len(waiting[-1])
                if size > buffered:
                    settle()
                    waiting, size = [], 0
        settle()
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["slot", "value"])

    return run


def train(coded: DataFrame, states: int = STATES, classes: int = CLASSES, parts: int = PARTS) -> Model:
    """The model after one Baum-Welch round over each part of the training texts and one over all of them."""
    model = Model.initial(states, classes)
    texts = coded.where("word is null and not held_out")
    for part in [*range(parts), None]:
        chosen = texts if part is None else texts.where(F.col("part") == part)
        sums = chosen.select("classes").mapInArrow(_count(model, classes), "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value"))
        counts = np.zeros(states * (1 + states + classes))
        for r in sums.toLocalIterator():  # a row per parameter
            counts[r["slot"]] = r["value"]
        if counts.any():
            model = Model.from_counts(counts.reshape(states, -1), classes)
    return model


def _score(model: Model, tokens: int, words: int, class_tokens: np.ndarray, class_words: np.ndarray):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    base_whole, class_whole = tokens + ADDED * (words + 1), class_tokens + ADDED * (class_words + 1)

    def run(texts: pa.Table, dictionary: pa.Table) -> pa.Table:
        code = dictionary.column("code").to_numpy()
        n, own = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        n[code], own[code] = dictionary.column("n").to_numpy(), dictionary.column("class").to_numpy()
        base = np.log10((n + ADDED) / base_whole)
        inside = np.log10((n + ADDED) / class_whole[own])
        codes = [np.frombuffer(c.as_py(), np.uint32) for c in texts.column("codes")]
        found = [(len(c), int(np.count_nonzero(n[c])), float(base[c].sum()), float(inside[c].sum())) for c in codes]
        order = np.argsort([-len(c) for c in codes], kind="stable")
        score = np.array([f[3] for f in found])
        for at in range(0, len(order), 2000):
            few = order[at : at + 2000]
            score[few] += log10_likelihoods(model, [own[codes[i]] for i in few])
        sizes, known, bases, _ = zip(*found) if found else ((), (), (), ())
        return pa.table([texts.column("doc_id"), texts.column("held_out"), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(found), tokens), pa.int64()), pa.array(bases, pa.float64()), pa.array(score)], names=names)

    return run


def score_documents(docs: DataFrame, states: int = STATES, classes: int = CLASSES, parts: int = PARTS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Documents whose crc32(doc_id as text) leaves 1 when divided by 5 are held out of training; a NULL id is not. A
    NULL or empty text is the end token alone. Repeated rows count as often as they occur; other columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), part.alias("part"), "text")
    coded = stored(rows.mapInArrow(_coded(classes), CODED))
    dictionary = coded.where("word is not null").select("block", "word", "code", "class", "n")
    # One shuffle brings the entries of a word together; each keeps its place and learns the total.
    of_word = W.partitionBy("word")
    counted = dictionary.withColumn("total", F.sum("n").over(of_word)).withColumn("first", F.row_number().over(of_word.orderBy("block", "code")) == 1)
    counted = stored(counted.select(F.col("block").alias("of"), "code", "class", F.col("total").alias("n"), "first"))
    by_class = counted.where("first and n > 0").groupBy("class").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")).collect()  # a row per class
    class_tokens, class_words = np.zeros(classes), np.zeros(classes)
    for r in by_class:
        class_tokens[r["class"]], class_words[r["class"]] = r["tokens"], r["words"]
    model = train(coded, states, classes, parts)
    texts = coded.where("word is null").select("block", "doc_id", "held_out", "codes")
    score = _score(model, int(class_tokens.sum()), int(class_words.sum()), class_tokens, class_words)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(counted.select("of", "code", "class", "n").groupBy("of")).applyInArrow(score, schema)
