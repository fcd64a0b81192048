import random

import pytest

from tests.llm.corpus import documents, frame
from weirspan.llm import shingles, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def planted(base, n_words, changed):
    """A text and a copy with single words changed, far enough apart to break five shingles each."""
    rng = random.Random(base)
    words = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    copy = list(words)
    for i in range(changed):
        copy[10 + 12 * i] = f"new{base}x{i}"
    return " ".join(words), " ".join(copy)


def pairs_of(texts):
    sets = [plain_set(t) for t in texts]
    return {(i, j) for j in range(len(texts)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8}


def test_planted_pairs_just_over_and_under(spark):
    """Forty pairs a little over 0.8, of which four bits of SimHash find few, and forty under it."""
    rows, over = [], []
    for g in range(80):
        a, b = planted(g, 200, 4 if g < 40 else 5)
        assert (jaccard(plain_set(a), plain_set(b)) >= 0.8) == (g < 40)
        rows += [(2 * g, a), (2 * g + 1, b)]
        over += [2 * g + 1] if g < 40 else []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in shingles.keep_one(docs).collect()}
    assert kept == {d for d, _ in rows} - set(over)
    prints = simhash.near_duplicates(simhash.fingerprints(docs)).select("component").distinct().count()
    assert prints > len(kept) + 20


def test_chains_in_one_bucket(spark):
    """Members of a crowded bucket that are far from its ends still meet each other."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(160)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    want = list(range(60))
    for i, j in sorted(pairs_of(texts)):
        a, b = want[i], want[j]
        want = [min(a, b) if x in (a, b) else x for x in want]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in shingles.near_duplicates(docs).collect()}
    assert {(want[i], got[i]) for i in range(60)} == {(w, got[w]) for w in set(want)} and len(set(got.values())) == len(set(want))


@pytest.mark.parametrize("edits, most", [((3, 3), 1 / 3), ((2, 5), 1 / 8), ((6, 6), 1 / 100)])
def test_texts_that_are_alike_but_not_enough_do_not_meet(spark, monkeypatch, edits, most):
    """One text with edits of one's own, similarities around 0.5 to 0.79: only texts edited at the same words may meet."""
    rng = random.Random(sum(edits))
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for i in range(150):
        words = list(base)
        for k in rng.sample(range(16), rng.randint(*edits)):
            words[12 * k + rng.randrange(7)] = f"n{i}x{k}"
        texts.append(" ".join(words))
    asked, plain = [], shingles._links

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(shingles, "_links", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in shingles.near_duplicates(docs).collect()}
    want = list(range(150))
    for i, j in sorted(pairs_of(texts)):
        a, b = want[i], want[j]
        want = [min(a, b) if x in (a, b) else x for x in want]
    assert {(want[i], got[i]) for i in range(150)} == {(w, got[w]) for w in set(want)} and len(set(got.values())) == len(set(want))
    assert len(asked) == 2 and asked[1] < most * 150 * 149 / 2


def test_the_shared_part_of_differences():
    """The bound on which the filter rests, on random sets."""
    rng = random.Random(9)
    for _ in range(300):
        r = set(rng.sample(range(60), 40))
        x, y = ({*rng.sample(sorted(r), 40 - k), *rng.sample(range(60, 100), k)} for k in (rng.randint(0, 9), rng.randint(0, 9)))
        if jaccard(x, y) >= 0.8 and jaccard(y, r) < 0.8:
            assert len((x ^ r) & (y ^ r)) >= shingles.least_shared(len(x ^ r), len(x), len(r), 0.8)


def test_awkward_rows(spark):
    docs = frame(spark, documents())
    kept = shingles.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    ids = [r.doc_id for r in got]
    assert 60 in ids and not {61, 62, 63, 64, 70, 71, 72, 73} & set(ids)
    assert sum(not (r.text or "").strip() for r in got) == 1 and {93, 94, 95, 96, 97, 98, 99} <= set(ids)
    assert shingles.keep_one(frame(spark, [])).collect() == []
