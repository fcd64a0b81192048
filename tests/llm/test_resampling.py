import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.corpus import documents, frame, prose
from weirspan.llm import resampling


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text):
    w = words(text)
    return [" ".join(w[i : i + n]).encode() for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, targets):
    s, t = (Counter(zlib.crc32(f) % 10_000 for x in side for f in features(x)) for side in ([x for _, x in rows], targets))
    big, small = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * small))) for b in range(10_000)]
    out = []
    for doc, text in rows:
        found = features(text)
        weight = sum(gain[zlib.crc32(f) % 10_000] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def found(docs, target):
    got = resampling.resample(docs, target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_equals_brute_force(spark):
    rows = documents() + [(1000 + i, prose(i, 22)) for i in range(150)] + [(2000, "!! .. ?"), (2001, "A-B_c d9É"), (2002, "x" * 50 + " " + "y" * 70), (2003, " ".join("ab" for _ in range(25)))]
    targets = [prose(500 + i, 25) for i in range(5)] + [None, "", "Stone bridge"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(targets)], "item_id long, text string, weight int")
    assert found(frame(spark, rows).repartition(3), bench) == brute(rows, targets)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(i, prose(i, 30)) for i in range(40)]
    assert found(frame(spark, rows), none) == brute(rows, [])
    assert found(frame(spark, []), none) == []


def test_ties_go_to_the_smaller_id_and_repeated_rows_count(spark):
    rows = [(7, prose(1, 30))] * 60 + [(8, prose(2, 30))] * 40
    got = found(frame(spark, rows), spark.createDataFrame([(1, prose(3, 30))], "item_id long, text string"))
    assert got == brute(rows, [prose(3, 30)]) and sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("block_words", [1, 2, 5, 64, 1 << 14])
def test_blocks_cover_each_run_once(block_words):
    texts = [prose(1, 40), None, "", "one", "one two", prose(2, 7), "x" * 100 + " ab ab ab ab"]
    got = Counter()
    for table, owner in resampling.blocks(texts, block_words):
        for a, b, o in zip(table.starts.tolist(), table.ends.tolist(), owner.tolist()):
            got[o, table.joined[a:b]] += 1
    assert got == Counter((i, f) for i, t in enumerate(texts) for f in features(t))


def single(words):
    at = np.arange(len(words))
    return resampling.Interned(words, at, at)


def test_table_keeps_unequal_runs_apart_and_equal_ones_together():
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 20))).encode() for _ in range(2000)]
    table = single(words)
    names = {}
    for w, slot in zip(words, table.ids.tolist()):
        assert names.setdefault(slot, w) == w
        assert table.bucket[slot] == zlib.crc32(w) % 10_000
    assert len(names) == len(set(words)) and {w: int(table.counts[s]) for s, w in names.items()} == Counter(words)


def test_equal_keys_of_unequal_runs_are_verified(monkeypatch):
    monkeypatch.setattr(resampling, "xxh64_of", lambda joined, eights, starts, sizes: np.full(len(starts), 5, np.uint64))
    table = single(b"abcdefghij abcdefghix abcdefghij ab abc".split())
    assert table.ids[0] == table.ids[2] and len(set(table.ids.tolist())) == 4


def test_hashes_are_xxh64_and_crc32():
    rng = random.Random(5)
    words = [bytes(rng.randrange(97, 123) for _ in range(n)) for n in [*range(1, 70), 200, 1000]] + [rng.randbytes(k).replace(b" ", b"x") for k in range(1, 40)]
    at = np.arange(len(words) - 2)
    for n in range(3):
        table = resampling.Interned(words, at, at + n)
        runs = [b" ".join(words[i : i + n + 1]) for i in at]
        assert table.keys.tolist() == [resampling.xxhash.xxh64_intdigest(r) for r in runs]
        assert table.bucket[table.ids].tolist() == [zlib.crc32(r) % 10_000 for r in runs]


def test_a_text_of_many_blocks(spark):
    rows = [(1, prose(5, 150_000)), (2, prose(6, 25))]
    target = [prose(7, 40)]
    bench = spark.createDataFrame([(1, target[0])], "item_id long, text string")
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), bench) == brute(rows, target)
