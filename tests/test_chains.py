"""Line parts in any order against a plain walk: gaps, loops, forks, closed parts, turned parts."""

import math
import random

import pytest

from weirspan.operators import chains

PARTS = "site_id long, part long, seq int, x double, y double"


def plain_chains(parts):
    """Chains of one site, ``parts``: part -> points, as (name, [(part, forwards)])."""
    at = {}
    for p, pts in parts.items():
        if len(pts) > 1:
            at.setdefault(pts[0], []).append((p, True))
            at.setdefault(pts[-1], []).append((p, False))
    mate = {}
    for ends in at.values():
        if len(ends) == 2:
            mate[ends[0]], mate[ends[1]] = ends[1], ends[0]
    left, out = {p for p, pts in parts.items() if len(pts) > 1}, []

    def walk(p, fwd):
        seen = [(p, fwd)]
        while (nxt := mate.get((seen[-1][0], not seen[-1][1]))) is not None:
            step = (nxt[0], nxt[1])
            if step == seen[0]:
                break
            seen.append(step)
        return seen

    while left:
        first = min(left)
        way = walk(first, True)
        if mate.get((way[-1][0], not way[-1][1])) is None:  # open: from the other end
            way = walk(way[-1][0], not way[-1][1])
        ups = sum(f for _, f in way)
        own = dict(way)[first]
        if ups * 2 < len(way) or ups * 2 == len(way) and not own:
            closed = mate.get((way[-1][0], not way[-1][1])) is not None
            way = walk(first, False) if closed else [(p, not f) for p, f in reversed(way)]
        out.append((first, way))
        left -= {p for p, _ in way}
    return out


def points_of(way, parts):
    line = []
    for p, fwd in way:
        pts = parts[p] if fwd else parts[p][::-1]
        line += pts if not line else pts[1:]
    return line


def distance(px, py, line):
    best = math.inf
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        dx, dy = bx - ax, by - ay
        f = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        best = min(best, math.hypot(px - ax - f * dx, py - ay - f * dy))
    return best


def random_site(rng):
    """Lines over a small lattice: gaps, forks and loops come by themselves."""
    parts, used = {}, set()
    names = rng.sample(range(1000), 40)
    for name in names:
        x, y = rng.randrange(7), rng.randrange(7)
        dx, dy = rng.choice([(1, 0), (0, 1)])
        if (x, y, dx) in used:
            continue
        used.add((x, y, dx))
        mid = [(x + dx * 0.5, y + dy * 0.5 + 0.1)] if rng.random() < 0.5 else []
        pts = [(float(x), float(y)), *mid, (float(x + dx), float(y + dy))]
        parts[name] = pts if rng.random() < 0.7 else pts[::-1]
    ring = [(20.0 + math.cos(a), math.sin(a)) for a in range(5)]
    if rng.random() < 0.5:
        parts[2000] = [*ring, ring[0]]  # closed by itself
    if rng.random() < 0.5:
        for i in range(4):  # a loop of four parts
            a, b = ((30.0 + i, 0.0), (30.0 + i + 1, 0.0)) if i < 3 else ((33.0, 0.0), (30.0, 0.0))
            parts[3000 + i] = [a, (a[0] + 0.2, 1.0), b]
    parts[4000] = [(50.0, 50.0)]
    return parts


@pytest.fixture(scope="module")
def built():
    rng = random.Random(11)
    return {s: random_site(rng) for s in range(25)}


def frame(spark, sites):
    rows = [(s, p, 3 * i + 2, x, y) for s, parts in sites.items() for p, pts in parts.items() for i, (x, y) in enumerate(pts)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows + [(0, 5000, 0, None, 1.0), (0, 5000, 1, 1.0, float("nan"))], PARTS)


def test_chains_against_a_walk(spark, built):
    got = {}
    for r in chains.chains(frame(spark, built)).collect():
        got.setdefault((r.site_id, r.chain), {})[r.place] = (r.part, r.fwd)
    want = {(s, name): way for s, parts in built.items() for name, way in plain_chains(parts)}
    assert got.keys() == want.keys()
    for key, way in want.items():
        assert [got[key][i] for i in range(len(got[key]))] == way, key
    lengths = [len(w) for w in want.values()]
    assert max(lengths) > 5 and min(lengths) == 1


def test_nearest_chain_and_direction(spark, built):
    rng = random.Random(2)
    sites = [(s, rng.uniform(-1, 35), rng.uniform(-1, 8), s % 2 == 0) for s in built] + [(77, 0.0, 0.0, False), (78, None, 0.0, True)]
    got = {}
    for r in chains.flow_line(spark.createDataFrame(sites, "site_id long, px double, py double, turned boolean"), frame(spark, built)).collect():
        got.setdefault(r.site_id, {})[r.seq] = (r.x, r.y)
    for s, px, py, turned in sites[: len(built)]:
        lines = [(distance(px, py, points_of(way, built[s])), name, points_of(way, built[s])) for name, way in plain_chains(built[s])]
        line = min(lines)[2]
        assert [got[s][i] for i in range(len(got[s]))] == (line[::-1] if turned else line)
    assert set(got) == set(built)


def test_long_chain_in_few_rounds(spark, monkeypatch):
    """Ten thousand shuffled parts of one site: rounds grow with the logarithm."""
    n, order = 10_000, list(range(10_000))
    random.Random(1).shuffle(order)
    rows = [(1, p, i, float(k + i), 0.0) for k, p in enumerate(order) for i in (0, 1)]
    made, plain = [], chains.cut_lineage
    monkeypatch.setattr(chains, "cut_lineage", lambda df: made.append(1) or plain(df))
    got = {r.part: (r.chain, r.place, r.fwd) for r in chains.chains(spark.createDataFrame(rows, PARTS)).collect()}
    assert got == {p: (0, k, True) for k, p in enumerate(order)} and len(made) < 20


def test_nothing_to_merge(spark):
    none = spark.createDataFrame([], PARTS)
    assert chains.chains(none).collect() == [] and chains.merged_chains(none).collect() == []
