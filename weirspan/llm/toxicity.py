"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a lexicon, its closeness to second-person words, capitals, punctuation and obfuscation
rates. The lexicon holds the words and word beginnings that toxic training texts have much more often than clean ones;
it, the trees and the calibration are fitted on a bounded sample of labelled rows. Every text is scored as a whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirspan.llm.common import stored

#: Most labelled rows that a model is fitted on, a uniform sample by hash if there are more.
SAMPLE_ROWS = 40_000
THRESHOLD = 0.7
#: Entries of the lexicon: lengths of word beginnings, least share of toxic texts, least lift, most entries.
BEGINNINGS = (4, 5, 6)
LEAST_SHARE = 0.01
LEAST_TEXTS = 5
LEAST_LIFT = 10.0
MOST_ENTRIES = 1000
NEAR_WORDS = 5
#: Fixed word list: second person in the four languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split())
#: Fixed table: signs that stand for letters in obfuscated words.
SIGNS = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[^\W\d_]+")
_OBFUSCATED = re.compile(r"[^\W\d_]+[0-9@$*!#]+[^\W\d_]+")
_UPPER = bytes(range(65, 91))
FEATURES = (
    "words", "hits", "hit_density", "distinct_hits", "strongest", "strong_density", "second_person_density", "second_person_near",
    "capitals", "exclamations", "questions", "repeated_signs", "obfuscated", "obfuscated_hits",
)


@dataclass
class Toxicity:
    """A fitted model; without both labels in the sample ``trees`` is None and every score is ``share``."""

    lexicon: dict[str, float]
    share: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = field(default=None)


def _terms(word: str) -> list[str]:
    return [f"={word}", *[word[:n] for n in BEGINNINGS if len(word) >= n]]


class _Weights(dict):
    """Weight of a word: the largest of its entries in the lexicon, 0 without any."""

    def __init__(self, lexicon: dict[str, float], limit: int = 300_000):
        super().__init__()
        self.lexicon, self.limit = lexicon, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        self[word] = weight = max((self.lexicon.get(t, 0.0) for t in _terms(word)))
        return weight


def features(text: str | None, weights: _Weights) -> list[float]:
    """The numbers named in ``FEATURES``; all 0 for a NULL or empty text."""
    if not text:
        return [0.0] * len(FEATURES)
    words = _WORD.findall(text.lower())
    n, raw = max(1, len(words)), text.encode("utf-8", "surrogatepass")
    found = list(map(weights.__getitem__, words))
    hits = [i for i, w in enumerate(found) if w] if any(found) else []
    near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR_WORDS) : i + NEAR_WORDS + 1]) for i in hits)
    hidden = _OBFUSCATED.findall(text)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return [
        math.log1p(len(words)), math.log1p(len(hits)), len(hits) / n, math.log1p(len({words[i] for i in hits})), max(found, default=0.0),
        sum(found[i] for i in hits) / n, sum(map(words.count, SECOND_PERSON)) / n, near / n,
        upper / len(raw), text.count("!") / n, text.count("?") / n, (text.count("!!") + text.count("??") + text.count("***")) / n,
        len(hidden) / n, float(sum(bool(weights[w]) for h in hidden for w in _WORD.findall(h.lower().translate(SIGNS)))),
    ]


def _feature_batches(lexicon: dict[str, float], text_at: int, keep_text: bool = False):
    """Adds the features of the column at ``text_at`` as ``x``; that column goes unless ``keep_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(lexicon)
        for batch in batches:
            values = pa.array([features(t.as_py(), weights) for t in batch.column(text_at)], pa.list_(pa.float64()))
            kept = [i for i in range(batch.num_columns) if keep_text or i != text_at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), values], names=[*(batch.schema.names[i] for i in kept), "x"])

    return run


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts have each term; summed per task as far as memory allows."""
    toxic, clean = Counter(), Counter()

    def settle() -> Iterator[pa.RecordBatch]:
        terms = list(toxic.keys() | clean.keys())
        for at in range(0, len(terms), 50_000):
            few = terms[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(few, pa.string()), pa.array([toxic[t] for t in few], pa.int64()), pa.array([clean[t] for t in few], pa.int64())], names=["term", "toxic", "clean"])

    for batch in batches:
        for text, label in zip(*(c.to_pylist() for c in batch.columns)):
            own = {t for w in set(_WORD.findall((text or "").lower())) for t in _terms(w)}
            (toxic if label else clean).update(own)
            if len(toxic) + len(clean) > 500_000:
                yield from settle()
                toxic.clear()
                clean.clear()
    yield from settle()


def in_training(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) does not leave 1 when divided by 3; a NULL id is in training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Toxicity:
    """Fit on the rows of ``docs`` whose id is in training and has a label 0 or 1 in ``labels`` (doc_id, toxic).

    An id with several labels counts as toxic if one of them is. Equal texts are used once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = sample_rows / max(1, known.count())
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.broadcast(known.where(unit < rate))  # about sample_rows rows of two numbers at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    sample = stored(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Toxicity({}, toxic / max(1, toxic + clean))
    counts = sample.select("text", "toxic").mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lift = (F.col("toxic") / float(toxic)) / ((F.col("clean") + 1) / float(clean + 1))
    entries = counts.where(F.col("toxic") >= max(LEAST_TEXTS, LEAST_SHARE * toxic)).withColumn("lift", lift).where(F.col("lift") >= LEAST_LIFT)
    best = entries.orderBy(F.desc(F.col("lift") * F.col("toxic")), "term").limit(MOST_ENTRIES).collect()
    lexicon = {r["term"]: math.log(r["lift"]) for r in best}
    table = sample.select("h", F.col("toxic").cast("double").alias("label"), "text").mapInArrow(_feature_batches(lexicon, 2), "h long, label double, x array<double>")
    table = stored(table.select("h", "label", array_to_vector("x").alias("features")))
    held = F.pmod(F.col("h"), F.lit(4)) == 0  # the calibration sees texts that the trees have not seen
    trees = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.3, seed=1, minInstancesPerNode=5).fit(table.where(~held).coalesce(4))
    scored = trees.transform(table.where(held)).select(vector_to_array("probability")[1].alias("features"), "label")
    return Toxicity(lexicon, toxic / (toxic + clean), trees, IsotonicRegression().fit(scored))


def score(docs: DataFrame, model: Toxicity, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` and ``score``, from 0 to 1, of its whole ``text``."""
    if model.trees is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(float(model.share)).alias("score"))
    # Numbered names cannot clash with those that the model adds.
    kinds = dict(docs.dtypes)
    sent = keep if "text" in keep else [*keep, "text"]
    names = [f"__{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(sent)])
    schema = ", ".join([f"{n} {kinds[c]}" for n, c in zip(names, keep)] + ["x array<double>"])
    rows = rows.mapInArrow(_feature_batches(model.lexicon, sent.index("text"), "text" in keep), schema).withColumn("features", array_to_vector("x"))
    rows = model.trees.transform(rows).select(*names, vector_to_array("probability")[1].alias("features"))
    rows = model.calibration.transform(rows)
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("score"))


def report(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``. Empty and NULL texts are scored like others."""
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, sample_rows), ["doc_id"])
    return rows.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` scored below ``THRESHOLD``; all columns and repeated rows are kept."""
    scored = score(docs, fit(docs, labels, sample_rows), docs.columns)
    names = [f"__{i}" for i in range(len(docs.columns))] + ["__score"]
    return scored.toDF(*names).where(F.col("__score") < THRESHOLD).drop("__score").toDF(*docs.columns)
