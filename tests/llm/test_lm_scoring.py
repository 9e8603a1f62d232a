import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from tests.llm import cases

from tuplewright.llm import lm_scoring as L


def test_elias_fano_against_plain_arrays():
    rng = np.random.default_rng(3)
    for n, universe in ((0, 1), (1, 1), (5, 10), (1000, 1100), (1000, 10**12), (700, 3_000_000), (300, 2**40)):
        v = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
        ef = L.EliasFano.of(v, universe)
        assert (ef.access(np.arange(n)) == v).all()
        x = np.concatenate([v, rng.integers(0, universe, 200).astype(np.uint64)])
        at, same = ef.successor(x)
        assert (at == np.searchsorted(v, x, "left")).all() and (same == np.isin(x, v)).all()
    dense = np.concatenate([np.arange(5000), [10**9]]).astype(np.uint64)
    assert (L.EliasFano.of(dense, 10**9 + 1).successor(dense)[0] == np.arange(5001)).all()


def test_trie_in_a_mapped_file(tmp_path):
    rng = random.Random(4)
    pairs = Counter((rng.randint(1, 60), rng.randint(1, 5000)) for _ in range(4000))
    rows = [(c, w, n) for (c, w), n in pairs.items()] + [(7, 6000, 0), (99, 1, 0)]
    totals = Counter()
    for c, _, n in rows:
        totals[c] += n
    array = lambda f: np.array([f(r) for r in rows], np.uint64)
    trie = L.build_trie(array(lambda r: r[0]), array(lambda r: r[1]), array(lambda r: r[2]), array(lambda r: totals[r[0]] or 1))
    trie.write(str(tmp_path / "t"))
    trie = trie.mapped(str(tmp_path / "t"))
    place = trie.find_contexts(array(lambda r: r[0]))
    codes = trie.find(place, array(lambda r: r[1]))
    n = Counter(pairs.values())
    d = n[1] / (n[1] + 2 * n[2])
    for (c, w, k), p, code in zip(rows, place.tolist(), codes.tolist(), strict=True):
        assert (code == L.ABSENT) == (k == 0) and (p < 0) == (c == 99)
        if k:
            assert abs(trie.book[code] - math.log10((k - d) / totals[c])) < 0.02
    first = trie.pointers.access(np.arange(trie.contexts.n + 1)).astype(int)
    assert first[0] == 0 and first[-1] == trie.words.n and (np.diff(first) > 0).all()
    assert (trie.find(place[:5], np.array([9999] * 5, np.uint64)) == L.ABSENT).all()


def brute(rows):
    docs = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for i, t in rows]
    learn = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in docs]
    uni, two, ctx = Counter(), Counter(), Counter()
    for (_, ws), y in zip(docs, learn, strict=True):
        if y:
            uni.update(ws)
            two.update(zip(["<s>", *ws[:-1]], ws, strict=True))
    for (v, _), n in two.items():
        ctx[v] += n
    types, n = Counter(v for v, _ in two), Counter(two.values())
    d = n[1] / (n[1] + 2 * n[2])
    total, kinds = sum(uni.values()), len(uni)
    base = lambda w: (uni[w] + 0.1) / (total + 0.1 * (kinds + 1))
    out = []
    for (i, ws), y in zip(docs, learn, strict=True):
        score = 0.0
        for v, w in zip(["<s>", *ws[:-1]], ws, strict=True):
            p = base(w)
            if ctx[v]:
                p = max(two[v, w] - d, 0) / ctx[v] + d * types[v] / ctx[v] * p
            score += math.log10(p)
        out.append((i, not y, len(ws), sum(uni[w] > 0 for w in ws), total, sum(math.log10(base(w)) for w in ws), score))
    return out


def check(spark, folder, given, **sizes):
    got = L.score_documents(spark.read.parquet(f"{folder}/documents.parquet"), **sizes).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(brute([(g[0], g[1]) for g in given]), key=key)
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and abs(g[6] - w[6]) < 0.05 * g[2] + 1e-6


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Éa", "zz", "THE"]
    given = [(i + 50, " ".join(rng.choices(vocabulary, weights=range(1, 44), k=rng.randint(0, 60))), None, None, 0, 0, "", "", 0) for i in range(300)] + cases.rows()
    folder = cases.stored(spark, tmp_path, given)
    check(spark, folder, given, word_shards=3, pair_shards=1)
    check(spark, folder, given, word_shards=5, pair_shards=1, shard_pairs=2**40)


def test_probabilities_after_a_context_sum_to_one(spark, tmp_path):
    """From scores alone: p(w | v) = p(v w end) / p(v | start) / p(end | w), with the ends' shares from texts that open with an unknown word."""
    rng = random.Random(8)
    vocabulary, fold = "abcdefgh", lambda i: zlib.crc32(str(i).encode()) % 10
    learnt = [" ".join(rng.choices(vocabulary, weights=range(1, 9), k=12)) for _ in range(40)]
    asked = ["q", *(f"q {w}" for w in vocabulary), *(f"{v} {w}" for v in vocabulary for w in [*vocabulary, "q"]), *vocabulary]
    ids = {True: iter(i for i in range(10**6) if fold(i)), False: iter(i for i in range(10**6) if not fold(i))}
    given = [(next(ids[y]), t, None, None, 0, 0, "", "", 0) for y, ts in ((True, learnt), (False, asked)) for t in ts]
    docs = spark.read.parquet(f"{cases.stored(spark, tmp_path, given)}/documents.parquet")
    text = {g[0]: g[1] for g in given}
    count = Counter(w for t in learnt for w in t.split())
    total, kinds = sum(count.values()) + len(learnt), len(count) + 1
    base = lambda n: (n + 0.1) / (total + 0.1 * (kinds + 1))
    for sizes in ({"word_shards": 2, "pair_shards": 3}, {"word_shards": 2, "shard_pairs": 30}):
        p = {text[r.doc_id]: 10**r.score for r in L.score_documents(docs, **sizes).collect() if r.held_out}
        q = p["q"] / base(len(learnt))  # after the start
        end = {w: p[f"q {w}"] / q / base(count[w]) for w in vocabulary} | {"q": base(len(learnt))}
        start = {w: p[w] / end[w] for w in vocabulary}
        assert abs(sum(start.values()) + q - 1 + base(len(learnt)) * q / base(0)) < 0.02  # the end after the start: by back-off only
        for v in vocabulary:
            assert abs(sum(p[f"{v} {w}"] / start[v] / end[w] for w in end) + end[v] - 1) < 0.03


def test_hot_contexts_are_dealt_by_pair(spark, tmp_path):
    """With most tokens of a shard at 50, each frequent context spans several shards; the discounts are then a shard's own."""
    rng = random.Random(6)
    given = [(i, " ".join(rng.choices("abcdefghij", k=30)), None, None, 0, 0, "", "", 0) for i in range(1, 120)]
    folder = cases.stored(spark, tmp_path, given)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    hot = {r.doc_id: r for r in L.score_documents(docs, shard_pairs=200, word_shards=2).collect()}
    cold = {r.doc_id: r for r in L.score_documents(docs, shard_pairs=2**40, word_shards=2).collect()}
    assert all(abs(hot[i].score - cold[i].score) < 0.03 * hot[i].n_tokens and hot[i].base_score == cold[i].base_score for i in cold)


def test_without_training_and_empty(spark, tmp_path):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    folder = cases.stored(spark, tmp_path, [(held, "a b", None, None, 0, 0, "", "", 0)])
    (row,) = L.op4_lm_scoring(spark, folder).collect()
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 3) and row.score == row.base_score
    assert L.op4_lm_scoring(spark, cases.stored(spark, tmp_path / "none", [])).count() == 0


def test_scores_do_not_depend_on_shards(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    given = [(i, " ".join(rng.choices(vocabulary, weights=range(1, 61), k=rng.randint(0, 80))), None, None, 0, 0, "", "", 0) for i in range(200)]
    docs = spark.read.parquet(f"{cases.stored(spark, tmp_path, given)}/documents.parquet")
    runs = [{r.doc_id: r.score for r in L.score_documents(docs, **sizes).collect()} for sizes in ({"word_shards": 2, "pair_shards": 4}, {"word_shards": 5, "pair_shards": 16}, {"pair_shards": 3, "shard_pairs": 100})]
    want = {r[0]: r[6] for r in brute([(g[0], g[1]) for g in given])}
    for i, score in want.items():
        n = len(given[i][1].split()) + 1
        assert all(abs(run[i] - score) <= n / L.STEPS / 2 + 1e-9 for run in runs)  # what the codes can be off
        assert abs(runs[0][i] - runs[1][i]) < 1e-9 and abs(runs[0][i] - runs[2][i]) < 1e-9
