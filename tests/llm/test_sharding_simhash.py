import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from tests.llm import cases

from tuplewright.llm import sharding, simhash


def naive_best_fit(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fit = [(f, i) for i, f in enumerate(free) if f >= s]
        if fit:
            free[min(fit)[1]] -= s
        else:
            free.append(capacity - s)
    return sorted(capacity - f for f in free)


def test_best_fit_equals_the_plain_search():
    rng = random.Random(3)
    for _ in range(40):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 120))]
        runs = sharding.best_fit(sorted(Counter(sizes).items(), reverse=True), 100, 1000)
        load = Counter()
        for s, n, b in runs:
            load[b] += s * n
        assert sorted(load.values()) == naive_best_fit(sizes, 100)


def test_plan_gives_a_giant_its_own_shard():
    runs = sharding.plan([(1000, 1), (10, 50), (7, 20)], 5)
    load = Counter()
    for s, n, b in runs:
        load[b] += s * n
    assert load[0] == 1000 and max(load[b] for b in range(1, 5)) - min(load[b] for b in range(1, 5)) <= 10
    assert sum(n for _, n, _ in runs) == 71 and sharding.plan([], 3) == []


def test_size_classes(spark):
    sizes = [8, 9, 4095, 4096, 4097, 5000, 123_457, 2**40 + 1]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(sharding.size_class(sharding.F.col("s"))).collect()]
    assert got[:4] == sizes[:4] and all(s <= c < s * (1 + 1 / 2048) for s, c in zip(sizes, got, strict=True))


def test_sharding(spark, tmp_path):
    rng = random.Random(4)
    given = [(i, "copy me" if i % 3 == 0 else " ".join(rng.choices("abcdefgh", k=rng.randint(0, 200))), None, None, 0, 0, "", "", 0) for i in range(3000)] + cases.rows()
    got = sharding.op1_sharding(spark, cases.stored(spark, tmp_path, given)).collect()
    assert len(got) == len(given)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in given)
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in got:
        by_shard[r.shard].append(r)
        by_text[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(v) == 1 for v in by_text.values()) and set(by_shard) <= set(range(24))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by_shard.values())
    loads = sorted(sum(r.size for r in v) for v in by_shard.values())
    assert loads[-1] >= loads[-2] and loads[-3] - loads[0] < 2500, loads  # the longest text has a shard, the copies another


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()
    for c in b"\t\n\x0b\x0c\r":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    if not words:
        return 0
    grams = [words[i : i + 3] for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(b" ".join(g), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            parent[root(j)] = root(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def test_simhash_query(spark, tmp_path):
    rng = random.Random(5)
    base = [rng.choices(["alpha", "Beta", "gamma", "délta", "eps"], k=80) for _ in range(4)]
    given = []
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(80)] = "zeta"
        given.append((i + 100, " ".join(words), None, None, 0, 0, "", "", 0))
    given += cases.rows()
    got = simhash.op5_simhash(spark, cases.stored(spark, tmp_path, given)).collect()
    fps = [brute_fingerprint(t or "") for _, t, *_ in given]
    want = Counter(zip([g[0] for g in given], (f"{f:016x}" for f in fps), brute_components([g[0] for g in given], fps), strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert len({r.component_id for r in got}) < len(given) - 20


def test_masks_cover_every_choice_of_three_bits():
    masks = simhash.covering_masks(list(range(64)))
    assert len(masks) == 15 and all(any(not m & (1 << a | 1 << b | 1 << c) for m in masks) for a, b, c in itertools.combinations(range(64), 3))
    few = [3, 9, 20, 21, 40, 41, 63]
    assert all(any(not m & sum(1 << b for b in t) for m in simhash.covering_masks(few)) for t in itertools.combinations(few, 3))


def clusters(rng, n):
    fps = set()
    while len(fps) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    return sorted(fps)


def same_parts(nodes, edges, radius=3):
    ids = {x: i for i, x in enumerate(nodes)}
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        assert (a ^ b).bit_count() <= radius
        parent[max(root(ids[a]), root(ids[b]))] = min(root(ids[a]), root(ids[b]))
    return [root(i) for i in range(len(nodes))]


def test_large_buckets_lose_no_link():
    rng = random.Random(6)
    nodes = clusters(rng, 700)
    plain = [(a, b) for a, b in itertools.combinations(nodes, 2) if (a ^ b).bit_count() <= 3]
    parts = same_parts(nodes, plain)
    for pairwise in (1 << 30, 50, 3):
        assert same_parts(nodes, simhash.forest(np.array(nodes, np.uint64), (1 << 64) - 1, pairwise=pairwise)) == parts


def test_links_and_components_on_clusters(spark):
    nodes = clusters(random.Random(7), 600)
    plain = [(a, b) for a, b in itertools.combinations(nodes, 2) if (a ^ b).bit_count() <= 3]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in nodes], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, pairwise=20)).collect()}
    parts = same_parts(nodes, plain)
    groups = defaultdict(list)
    for x, p in zip(nodes, parts, strict=True):
        groups[p].append(signed(x))
    for members in groups.values():
        assert all(got.get(m, m) == min(members) for m in members)


def test_empty(spark, tmp_path):
    folder = cases.stored(spark, tmp_path, [])
    assert sharding.op1_sharding(spark, folder).count() == 0 and simhash.op5_simhash(spark, folder).count() == 0
