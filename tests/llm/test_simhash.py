import random

import pytest
import xxhash

from tests.llm.corpus import documents, frame
from weirspan.llm import simhash
from weirspan.llm.components import components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_components(prints, distance=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = plain_components(prints)
    least = {}
    for (doc, _), g in zip(rows, groups):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return [(doc, f"{p:016x}", least.get(g)) for (doc, _), p, g in zip(rows, prints, groups)]


key = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("most", [1024, 2])
def test_report_equals_brute_force(spark, most):
    rows = documents()
    got = [tuple(r) for r in simhash.report(frame(spark, rows), most=most).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


@pytest.mark.parametrize("most", [1000, 3])
def test_links_of_dense_and_sparse_fingerprints(spark, most):
    """Chains and clouds around a few centres; with ``most`` 3 nearly every bucket is too large to pair."""
    rng = random.Random(3)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(25):
            prints.add(at ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
            at ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    want = plain_components(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    found = {r.node: r.component for r in components(simhash.links(df, most=most)).collect()}
    got = [found.get(p, p) for p in signed]
    assert {(want.index(w), got.index(g)) for w, g in zip(want, got)} == {(want.index(w), want.index(w)) for w in want}


def test_empty_table_and_graph(spark):
    assert simhash.report(frame(spark, [])).collect() == []
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    names = rng.sample(range(10_000), 400)
    edges = [(names[i], names[i + 1]) for i in range(0, 150)] + [(names[399], names[i]) for i in range(200, 300)] + [(names[350], names[351])]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: min(g) for g in (names[:151], [names[399], *names[200:300]], names[350:352]) for n in g}
    assert got == want
