import math

import numpy as np
import pytest

from weirspan.llm import whitening
from weirspan.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, x int, n string, component double"


def made(n=400, d=6, seed=3):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(n, d)) * [4, 2, 1, 0.5, 0.2, 0.05][:d] @ rng.normal(size=(d, d))).astype(np.float32)
    return [(i, row.tolist(), 1, "n", 0.5) for i, row in enumerate(v)]


def expected(rows, components=8):
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    n, total = len(x), [sum(c) for c in zip(*x)]
    centred = np.array(x, float) - np.array(total) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    dev = [sum((n * c - s) ** 2 for c, s in zip(row, total)) for row in x]
    return dev, centred @ v[:, :components] / np.sqrt(e[:components]), e[:components] / e.sum()


def check(got, rows, components):
    dev, white, explained = expected(rows, components)
    place = {i: k for k, (i, _) in enumerate(rows)}
    assert len(got) == len(rows) * components
    signs = {}
    for r in got:
        k, c = place[r.vec_id], r.component - 1
        assert r.n == len(rows) and r.deviation == dev[k]
        assert r.explained == pytest.approx(explained[c], rel=1e-9) and r.identity_error < 1e-9
        if abs(white[k, c]) > 1e-3:
            signs.setdefault(c, set()).add(round(r.whitened / white[k, c], 6))
        else:
            assert abs(r.whitened) < 1.1e-3
    assert all(s in ({1.0}, {-1.0}) for s in signs.values()) and len(signs) == components


def test_equals_dense_eigenvectors(spark):
    rows = made()
    odd = [(900, None, 1, "", 0.0), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "", 0.0), (902, [float("nan")] * 6, 1, "", 0.0), (903, [float("inf")] * 6, 1, "", 0.0), (904, [], 1, "", 0.0), (905, [1.0, 2.0], 1, "", 0.0)]
    got = whitening.whiten(spark.createDataFrame(rows + odd, SCHEMA).repartition(5)).collect()
    check(got, [(i, v) for i, v, *_ in rows], 6)


def test_repeated_rows_ids_and_hot_vector(spark):
    rows = made(200) + [(None, [1.0] * 6, 1, "", 0.0)] * 3 + made(1) * 150
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    dev, white, _ = expected([(i, v) for i, v, *_ in rows], 6)
    assert len(got) == 6 * len(rows) and sum(r.vec_id is None for r in got) == 18
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(dev)
    for c in range(6):
        w = sorted(abs(r.whitened) for r in got if r.component == c + 1)
        assert np.allclose(w, sorted(np.abs(white[:, c])), atol=1e-7)


def test_dependent_and_constant_dimensions(spark):
    rows = [(i, [round(c * 8) / 8 for c in v], *rest) for i, v, *rest in made(300)]
    rows = [(i, [*v[:3], v[0] * 2, 7.0, v[1]], *rest) for i, v, *rest in rows]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    # An offset of 100,000 doubled is another constant, so twice a dimension stays a dependent one.
    check(got, [(i, v) for i, v, *_ in rows], 3)


def test_ill_conditioned_rows_are_orthogonalised(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 5)) * [1e3, 10, 0.1, 0.01, 0.003]
    rows = [(i, r.tolist(), 1, "", 0.0) for i, r in enumerate(v.astype(np.float32))]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3))
    check(got.collect(), [(i, r) for i, r, *_ in rows], 5)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None, 1, "", 0.0)], [(1, [1.0, 2.0], 1, "", 0.0)], [(i, [1.0, 2.0], 1, "", 0.0) for i in range(5)]):
        got = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long(spark):
    rows = [(1, [3e8, 0.0], 1, "", 0.0), (2, [-3e8, 0.0], 1, "", 0.0), (3, [0.0, 1.0], 1, "", 0.0)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] is None and got[2] is None and got[3] == 2048**2


def test_triangular_solve():
    rng = np.random.default_rng(0)
    r = np.triu(rng.normal(size=(5, 5))) + 3 * np.eye(5)
    q = rng.normal(size=(20, 5))
    assert np.allclose(whitening.solve_rows(q @ r, r), q)


def test_given_vectors(spark):
    rows = table(spark, "/root/testdata/sf0.01", "embeddings")
    got = whitening.whiten(rows).collect()
    check(got, [(r.vec_id, r.embedding) for r in rows.collect()], 8)
