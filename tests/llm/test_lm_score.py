import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.corpus import documents, frame
from weirspan.llm import hidden_markov as hm
from weirspan.llm import lm_score


def small_model(seed=1):
    rng = np.random.default_rng(seed)
    part = lambda *s: (x := rng.uniform(0.1, 1, s)) / x.sum(-1, keepdims=True)
    return hm.Model(part(3), part(3, 3), part(3, 4))


def paths(model, seq):
    """Probability of the sequence and of each path of states."""
    return {p: model.start[p[0]] * np.prod([model.move[a, b] for a, b in zip(p, p[1:])]) * np.prod([model.emit[s, x] for s, x in zip(p, seq)]) for p in itertools.product(range(3), repeat=len(seq))}


def test_likelihoods_equal_the_sum_over_all_paths():
    model, rng = small_model(), np.random.default_rng(2)
    seqs = [rng.integers(0, 4, n) for n in (1, 5, 3, 6, 2, 1, 4)] + [np.empty(0, np.int64)]
    want = [np.log10(sum(paths(model, s).values())) if len(s) else 0.0 for s in seqs]
    assert np.allclose(hm.log10_likelihoods(model, seqs), want)


def test_counts_equal_the_expectation_over_all_paths():
    model, rng = small_model(3), np.random.default_rng(4)
    seqs = [rng.integers(0, 4, n) for n in (1, 5, 3, 4)]
    want = np.zeros((3, 8))
    for s in seqs:
        weight = paths(model, s)
        whole = sum(weight.values())
        for p, w in weight.items():
            want[p[0], 0] += w / whole
            for a, b in zip(p, p[1:]):
                want[a, 1 + b] += w / whole
            for a, x in zip(p, s):
                want[a, 4 + x] += w / whole
    assert np.allclose(hm.expected_counts(model, seqs), want)
    assert not hm.expected_counts(model, []).any()


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(5)
    seqs = [np.concatenate([rng.integers(0, 5, 20), rng.integers(5, 10, 20)]) for _ in range(60)]
    model = hm.Model.initial(2, 10)
    before = hm.log10_likelihoods(model, seqs).sum()
    for _ in range(12):
        model = hm.Model.from_counts(sum(hm.expected_counts(model, b) for b in hm.batches_by_length(seqs, most=500)), 10)
        after = hm.log10_likelihoods(model, seqs).sum()
        assert after >= before - 1e-6
        before = after
    assert before / (60 * 40) > np.log10(0.1) + 0.2


def test_batches_hold_every_symbol():
    seqs = [np.arange(n) for n in (0, 3, 1000, 7, 25)]
    parts = [p for b in hm.batches_by_length(seqs, most=50, cut=100) for p in b]
    assert sum(map(len, parts)) == 1035 and max(map(len, parts)) == 100


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


@pytest.mark.parametrize("block_words", [400_000, 30])
def test_scores_of_documents(spark, monkeypatch, block_words):
    rows = documents()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter(t for d, text in rows if not held(d) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    monkeypatch.setattr(lm_score, "BLOCK_WORDS", block_words)
    got = lm_score.score_documents(frame(spark, rows), states=3, classes=64).collect()
    want = [(d, held(d), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, round(sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t)), 6)) for d, t in rows]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=key) == sorted(want, key=key)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_a_class_gives_its_words_all_its_probability(spark):
    """Over the known words and one unknown a class, the word probabilities of a class sum to one."""
    tokens_, words_ = np.array([10.0, 0.0]), np.array([3.0, 0.0])
    whole = tokens_ + lm_score.ADDED * (words_ + 1)
    counts = [5, 3, 2]
    assert np.isclose(sum((c + lm_score.ADDED) / whole[0] for c in counts) + lm_score.ADDED / whole[0], 1)
    assert np.isclose(lm_score.ADDED / whole[1], 1)


def test_empty_table(spark):
    assert lm_score.score_documents(frame(spark, []), states=2, classes=16).collect() == []
