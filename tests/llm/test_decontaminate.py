import hashlib
import random
import re

import pytest

from tests.llm.corpus import documents, frame, prose
from weirspan.llm import decontaminate

ITEM = "item_id long, text string, words string, mark long"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    spans = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            spans.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(s) for s in spans}:
            for i in range(len(w) - n + 1):
                if (s := tuple(w[i : i + n])) in spans:
                    hit |= set(range(i, i + n))
                    found |= spans[s]
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def items():
    rng = random.Random(8)
    made = [(i, prose(500 + i, 25)) for i in range(6)] + [(6, prose(500, 25)), (7, None), (8, ""), (9, "..."), (10, "Stone, bridge"), (11, "漢字 🎉"), (12, " ".join(prose(1, 60).split()[5:16]).upper())]
    rng.shuffle(made)
    return made


def texts():
    inside = [(200 + i, f"{prose(600 + i, 12)}, {' - '.join(prose(500 + i, 25).split()[i : i + 9 + i])}! {prose(700 + i, 5)}") for i in range(6)]
    twice = [(220, prose(500, 25) + " gap " + prose(501, 25) + " " + prose(500, 25)), (221, prose(503, 25)), (221, prose(503, 25))]
    return documents() + inside + twice


key = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("most", [500_000, 0])
def test_report_equals_brute_force(spark, most):
    rows, bench = texts(), items()
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in bench], ITEM)
    got = [tuple(r) for r in decontaminate.report(frame(spark, rows), table, most_broadcast=most).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, bench), key=key)


def test_removal_keeps_clean_rows(spark):
    rows, bench = texts(), items()
    docs = frame(spark, rows)
    kept = decontaminate.remove_contaminated(docs, spark.createDataFrame([(i, t, "w", 1) for i, t in bench], ITEM))
    assert kept.columns == docs.columns
    want = [r for r, b in zip(rows, brute(rows, bench)) if not b[5]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEM)
    assert decontaminate.report(frame(spark, []), none).collect() == []
    assert not any(r.contaminated for r in decontaminate.report(frame(spark), none).collect())
