import random
import zlib

import pytest

from tests.llm.corpus import frame, prose
from weirspan.llm import toxicity

INSULTS = ["grumbold", "snarfing", "blatherer"]


def corpus():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words, bad = prose(i, 40).split(), i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(INSULTS) + rng.choice(["", "!", "x"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None), (5001, ""), (5002, "you blatherer"), (None, prose(3, 20)), (5003, "z" * 50_000), (7, rows[7][1])]
    return rows, labels + [(7, 1, 0), (None, 1, 1), (5005, 0, None)]


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return rows, labels, toxicity.report(frame(spark, rows), table).collect()


def test_held_out_accuracy(scored):
    rows, labels, got = scored
    truth = {d: t for d, _, t in labels if d is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(rows) and len(held) > 100
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_awkward_texts_are_scored_clean(scored):
    by = {r.doc_id: r for r in scored[2]}
    assert by[5000].predicted == by[5001].predicted == by[5003].predicted == 0


def test_keep_clean(spark):
    rows, labels = corpus()
    docs = frame(spark, rows)
    kept = toxicity.keep_clean(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(rows) - sum(r.predicted for r in toxicity.report(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect())
    assert ids.count(7) == 2


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1)]])
def test_without_both_labels_the_score_is_the_share(spark, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.report(frame(spark, [(1, "a b"), (2, "c d"), (3, None)]), table).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1 and got[0].score in (0.0, 1.0)


def test_empty_documents(spark):
    rows, labels = corpus()
    assert toxicity.report(frame(spark, []), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []


def test_features_by_hand():
    weights = toxicity._Weights({"=bad": 2.0, "awfu": 1.0})
    x = dict(zip(toxicity.FEATURES, toxicity.features("You bad awful BAD man!! ok? b4d", weights)))
    assert x["strongest"] == 2.0 and abs(x["hit_density"] - 3 / 8) < 1e-9 and abs(x["second_person_near"] - 3 / 8) < 1e-9
    assert abs(x["exclamations"] - 2 / 8) < 1e-9 and x["obfuscated"] == 1 / 8 and toxicity.features(None, weights) == [0.0] * len(toxicity.FEATURES)
