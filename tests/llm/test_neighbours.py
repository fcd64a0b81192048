import numpy as np
import pytest

from weirspan.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, node long, h string"


def brute(rows, top=20, every=20):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for q, a in rows:
        if q % every == 0:
            best = sorted((-float(a @ b), i) for i, b in rows if i != q)[:top]
            out[q] = [(i, -s) for s, i in best]
    return out


def collect(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], 1, 2, "h") for i, v in rows], SCHEMA)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).round(2)) for i in range(150)]
    rows += [(200 + i, rows[40][1]) for i in range(30)]  # equal vectors: ties go to the smaller id
    bad = [(300, None), (320, [0.0] * 8), (340, [1.0, None, *[0.0] * 6]), (360, [float("nan")] * 8), (380, [float("inf")] * 8), (400, [1.0, 2.0]), (420, [])]
    got, want = collect(neighbours.nearest(frame(spark, rows + bad + rows[:3]))), brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_fewer_rows_than_asked_for(spark):
    rows = [(i, [1.0, float(i)]) for i in (0, 5, 20)]
    assert {q: [i for i, _ in x] for q, x in collect(neighbours.nearest(frame(spark, rows))).items()} == {0: [5, 20], 20: [5, 0]}


@pytest.mark.parametrize("width", [300])
def test_graph_search_recall(spark, monkeypatch, width):
    """Blocks of 100 make the graph and its rounds work for the result."""
    monkeypatch.setattr(neighbours.build_graph, "__defaults__", (neighbours.DEGREE, neighbours.TABLES, 100, neighbours.ROUNDS))
    rng = np.random.default_rng(2)
    rows = [(i, v / np.linalg.norm(v)) for i, v in enumerate(rng.standard_normal((1500, 24)))]
    got, want = collect(neighbours.nearest(frame(spark, rows), width=width)), brute(rows)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.95
    for q in want:
        assert len(got[q]) == 20 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)


def test_empty_table(spark):
    assert neighbours.nearest(frame(spark, [])).collect() == []
