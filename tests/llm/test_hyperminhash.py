import itertools
import math
import random

import numpy as np
from tests.llm import cases
from tests.llm.test_shingles import brute_set, given_rows

from tuplewright.llm import hyperminhash as H


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by all pairs of sets."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            parent[root(j)] = root(i)
            links += sets[i] != sets[j]
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    component = [least.get(root(i)) for i in range(len(rows))]
    return sorted(((d, len(s), c, d == c if d is not None else c is None) for (d, _), s, c in zip(rows, sets, component, strict=True)), key=str), links


def test_against_all_pairs(spark, monkeypatch):
    for tile, small in ((4096, 8), (40, 2)):  # whole buckets, and buckets in tiles
        monkeypatch.setattr(H, "TILE", tile)
        monkeypatch.setattr(H, "SMALL", small)
        rows = given_rows(400) + [(r[0], r[1]) for r in cases.rows()] + [(7_000_000 + i, "all of these are one short text") for i in range(50)]
        docs = spark.createDataFrame([(d, t, 1, "h") for d, t in rows], "doc_id long, text string, n int, digest string").repartition(3)
        want, links = brute(rows)
        assert links > 500
        got = H.near_duplicates(docs)
        assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        assert sorted(map(tuple, got.collect()), key=str) == want
        monkeypatch.undo()


def test_small_sets_at_the_threshold(spark):
    """Sets of six to thirteen members of which one is missing."""
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(60):
        n = 10 + i % 8
        text = words[i * 20 : i * 20 + n]
        rows += [(10 * i, " ".join(text)), (10 * i + 1, " ".join(text[1:])), (10 * i + 2, " ".join(text[2:]))]
    want, links = brute(rows)
    assert 0 < links < 180
    assert sorted(map(tuple, H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == want


def test_pairs_below_the_threshold_stay_in_their_bucket(spark, monkeypatch):
    """A group of texts at 0.74 of each other: its pairs pass the registers' tests, and aren't made into rows."""
    rng = random.Random(12)
    rows = []
    for i in range(60):
        text = [f"w{j}" for j in range(204)]
        for at in rng.sample(range(4, 200, 6), 3):
            text[at] = f"own{i}-{at}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, rows[i][1] + " end") for i in range(20)]
    made, likely = [], H.likely

    def counted(pairs, classes):
        made.append(pairs.count())
        return likely(pairs, classes)

    monkeypatch.setattr(H, "likely", counted)
    want, links = brute(rows)
    assert links >= 20
    assert sorted(map(tuple, H.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == want
    assert made[1] < 4 * len(rows)


def test_estimate_and_bounds():
    rng = np.random.default_rng(5)
    unlike = []
    for n in (8, 60, 300, 500, 700, 20_000):  # at 500 and so some sets leave buckets empty and some don't
        off = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 2**64, 2 * n + 50, np.uint64, endpoint=False))
            rng.shuffle(pool)
            both, one = pool[: n * 3 // 4], pool[n * 3 // 4 : n]
            other = pool[n : n + len(one)]
            a, b = (np.sort(np.concatenate([both, x])) for x in (one, other))
            true = len(both) / (len(both) + 2 * len(one))
            regs = [H.registers(x)[None] for x in (a, b)]
            off.append(float(H.estimate(*regs, np.array([len(a)]), np.array([len(b)]))[0]) - true)
            apart = [H.registers(np.sort(x))[None] for x in (pool[:n], pool[n : 2 * n])]
            unlike.append(float((apart[0] == apart[1]).mean()) - float(H.chance(np.array([n * 1.0]), np.array([n * 1.0]))[0]))
        assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.09, n
    assert abs(np.mean(unlike)) < 0.002
    # misses at the threshold: no band, an estimate below the floor, too many differing bits
    s, n = H.NUM / H.DEN, H.BUCKETS
    assert (1 - s**4) ** H.BANDS < 1e-10
    assert sum(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(int(H.FLOOR * n) + 1)) < 1e-9
    differ = {0: s + (1 - s) / 4, 1: (1 - s) / 2, 2: (1 - s) / 4}
    dist = [1.0]
    for _ in range(n):
        dist = [sum(p * (dist[k - d] if 0 <= k - d < len(dist) else 0) for d, p in differ.items()) for k in range(len(dist) + 2)]
    assert sum(dist[H.FAR + 1 :]) < 1e-9


def test_empty_table(spark):
    assert H.near_duplicates(spark.createDataFrame([], cases.SCHEMA)).collect() == []
    none = spark.createDataFrame([(None, None), (3, " "), (4, "")], "doc_id long, text string")
    assert sorted(map(tuple, H.near_duplicates(none).collect()), key=str) == [(3, 0, 3, True), (4, 0, 4, True), (None, 0, None, True)]
