import random
from collections import Counter

import pytest

from tests.llm.corpus import documents, frame, prose
from weirspan.llm import substrings
from weirspan.llm.common import stored


def brute(rows, window):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def found(docs, **options):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.remove_repeated(docs, **options).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    shared, tail = prose(21, 34), prose(22, 35)
    again = prose(25, 50)
    made = documents()
    made += [(500, f"{prose(31, 9)} {shared}"), (501, f"{shared} {prose(32, 9)}")]  # one word short of a window
    made += [(510, f"{prose(33, 12)} {tail}"), (511, f"{tail}\n\n{prose(34, 12)}"), (512, tail.upper())]  # a window exactly, at the end and the start
    made += [(520, f"{again} x {again} y {again[:-3]}")]  # inside one text
    made += [(530, "a b " * 60), (531, "word " * 34), (532, "term " * 36)]  # periodic
    made += [(540 + i, f"{prose(26, 400)} {prose(700 + i, 20)}") for i in range(3)]
    return made


@pytest.mark.parametrize("window", [35, 8, 3, 2])
def test_equals_brute_force(spark, rows, window):
    docs = stored(frame(spark, rows))
    assert found(docs, window=window) == brute(rows, window)


def test_small_chunks_and_buckets_change_nothing(spark, rows):
    docs = stored(frame(spark, rows).repartition(5))
    assert found(docs, chunk_bytes=200, bucket_windows=50) == brute(rows, 35)


def test_spans_and_longest_repeat(spark):
    again = prose(41, 300)
    docs = stored(spark.createDataFrame([(1, f"{prose(42, 10)} {again}"), (2, f"{again} {prose(43, 5)}"), (3, prose(44, 80))], "doc_id long, text string"))
    got = {r.doc_id: r for r in substrings.remove_repeated(docs).collect()}
    assert [(s.start, s.end) for s in got[1].spans] == [(10, 310)] and [(s.start, s.end) for s in got[2].spans] == [(0, 300)]
    assert got[1].longest == got[2].longest == 280 and got[3].longest == 0 and got[3].spans == []


def test_levels_double():
    steps = substrings.levels(35)
    assert [next(steps) for _ in range(5)] == [9, 18, 35, 70, 140]


def test_a_third_of_all_rows_alike(spark):
    rng = random.Random(4)
    rows = [(7, prose(51, 60))] * 300 + [(1000 + i, " ".join(str(rng.random()) for _ in range(50))) for i in range(600)]
    got = found(stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)))
    assert got == brute(rows, 35) and sum(n for _, _, n, _ in got) == 300 * 60


def test_chunks_are_grouped_without_another_exchange(spark, rows):
    texts, files, _ = substrings.chunked(stored(frame(spark, rows)))
    plan = texts.groupBy("chunk").applyInArrow(substrings._ask(substrings._pieces_of_texts, 9, 4, substrings.SHORT), substrings.ASKED)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_empty_and_very_long(spark):
    assert found(stored(frame(spark, []))) == []
    rng = random.Random(6)
    long = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(10**6)) for _ in range(600_000))
    words = long.split()
    rows = [(1, long), (2, " ".join(words[5000:5100])), (3, None)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeated(stored(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: (600_000, 100), 2: (100, 100), 3: (0, 0)}
