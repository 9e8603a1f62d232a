import itertools
import random

import corpus_pipeline
import numpy as np
from tests.llm import cases

from tuplewright.llm import shingles, simhash


def brute_set(text):
    words = [w for w in (text or "").encode().lower().split()]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_parts(rows):
    """Least id of each row's component under 5-word Jaccard >= 0.8."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            parent[root(j)] = root(i)
            links += sets[i] != sets[j]
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(rows))], links


def given_rows(n=500):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("an", "el", "im", "or", "us", "ey")]
    line = rng.choices(words, k=12)
    base = [rng.choices(words, k=rng.choice([12, 40, 90, 300])) + (line if i % 2 else []) for i in range(25)]
    out = []
    for i in range(n):
        text = list(base[0 if i % 3 == 0 else rng.randrange(25)])  # one large group of near copies
        for _ in range(rng.randint(0, max(1, len(text) // 35))):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 2)] = rng.choices(words, k=rng.randint(0, 2))
        out.append((rng.randrange(10**6), " ".join(text)))
    return out


def test_stage_against_brute_jaccard(spark, tmp_path):
    rows = given_rows()
    given = [(i, t, "en", "s", 0, 5, "g", "h", 9) for i, t in rows] + cases.rows()
    folder = cases.stored(spark, tmp_path, given)
    all_rows = [(g[0], g[1]) for g in given]
    parts, links = brute_parts(all_rows)
    assert links > 1000
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted((r.doc_id, r.component_id) for r in shingles.near_duplicates(docs).collect() if r.doc_id is not None)
    assert got == sorted((i, p) for (i, _), p in zip(all_rows, parts, strict=True) if i is not None)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, folder).collect()]
    want = {(i, t) for (i, t), p in zip(all_rows, parts, strict=True) if i is None or i == p}
    assert set(left) == want and len(left) == len(want)


def test_filters_exclude_no_similar_pair():
    for a, b in itertools.combinations([shingles.shingles(t) for _, t in given_rows(120)], 2):
        far = int(np.bitwise_count((shingles.parities(a) ^ shingles.parities(b)).view(np.uint64)).sum())
        assert far <= len(np.setxor1d(a, b))


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{cases.stored(spark, tmp_path, [])}/documents.parquet")
    assert shingles.kept(docs).count() == 0


def test_tiles_and_common_shingles_lose_no_link(spark, monkeypatch):
    rows = given_rows(260)
    monkeypatch.setattr(shingles, "TILE", 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.component_id) for r in shingles.near_duplicates(docs).collect())
    assert got == sorted((i, p) for (i, _), p in zip(rows, brute_parts(rows)[0], strict=True))


def test_a_second_text_of_an_id_is_judged_by_itself(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "iota kappa lambda mu nu xi omicron pi rho", "one two three four five six seven")
    schema = "doc_id long, text string, _id int, _text_hash string, root int, component_id int, cls int"
    rows = [(3, a), (7, a), (7, b), (7, b), (9, b), (1, c), (None, a)]
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], schema)
    for kept in (shingles.kept, simhash.kept):
        got = kept(docs)
        assert got.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, a), (7, b), (1, c), (None, a)], key=str)
