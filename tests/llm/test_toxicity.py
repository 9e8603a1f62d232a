import random
import zlib

import numpy as np
from tests.llm import cases

from tuplewright.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("an", "el", "im", "or", "us")]
    bad = ["nasty", "vile", "rotten"]
    out = []
    for _ in range(n):
        words, toxic = rng.choices(plain, k=rng.randint(20, 120)), rng.random() < 0.3
        for _ in range(rng.randint(2, 4) * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        out.append((" ".join(words), int(toxic)))
    return out


def test_held_out_accuracy_and_the_query(spark, tmp_path):
    docs = corpus(600, 1)
    given = [(i, t, None, None, 0, 0, "", "", 0) for i, (t, _) in enumerate(docs)] + [(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in cases.rows()]
    folder = cases.stored(spark, tmp_path, given)
    labels = [(i, 1, y) for i, (_, y) in enumerate(docs)] + [(None, 1, 1), (5, 1, None), (7_000_000, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = toxicity.op7_toxicity(spark, folder).collect()
    assert len(got) == len(given)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [(r.predicted, docs[r.doc_id][1]) for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) > 0.95
    again = {r.doc_id: r.score for r in toxicity.op7_toxicity(spark, folder).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


def test_word_probabilities_sum_to_one():
    words = [toxicity.word_hashes(t) for t, y in corpus(80, 2) if y]
    counts = np.array([5, 1, 1, 2, 9])
    share, off = toxicity.kneser_ney(counts, np.array([0, 0, 0, 1, 1]), 3, 0.7)
    assert np.allclose(np.bincount([0, 0, 0, 1, 1], share, minlength=3) + np.append(off[:2], 0), [1, 1, 0]) and off[2] == 1
    model = toxicity.ClassModels((words[:10], words[10:]))
    assert len(model.unigram) == len(model.words)


def test_no_labels_and_no_rows(spark, tmp_path):
    folder = cases.stored(spark, tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert all(r.score < 0.01 for r in toxicity.op7_toxicity(spark, folder).collect())
    empty = cases.stored(spark, tmp_path / "none", [])
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert toxicity.op7_toxicity(spark, empty).count() == 0


def test_counts_come_from_all_folds():
    rows = [(i % 3, y, f"{t} onlyhere" if i % 3 == 2 and y else t) for i, (t, y) in enumerate(corpus(300, 3))]
    model = toxicity.train(rows, 0.3)
    assert toxicity.word_hashes("onlyhere")[0] in model.words
    assert model.ratios(toxicity.word_hashes("onlyhere"))[0] > 0.5 and model.fit[1:].any()


def plain_models(by_class):
    """log p_1 - log p_0 of a word after another, from the formulas in dictionaries."""
    from collections import Counter, defaultdict

    vocabulary = {w for docs in by_class for d in docs for w in d}
    models = []
    for docs in by_class:
        before, pairs = defaultdict(set), defaultdict(set)
        for d in docs:
            for i in range(1, len(d)):
                before[d[i]].add(d[i - 1])
                pairs[d[i - 1], d[i]].add(d[i - 2] if i > 1 else None)
        k1, k2 = Counter({w: len(x) for w, x in before.items()}), Counter({p: len(x) for p, x in pairs.items()})
        n = Counter(k1.values())
        d1 = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        off = lambda k, d: min(k, d if k > 1 else 1)
        total = sum(k1.values())
        lowest = sum(off(k, d1) for k in k1.values()) / total / (len(vocabulary) + 1)
        context, taken = Counter(), Counter()
        for (v, _), k in k2.items():
            context[v] += k
            taken[v] += off(k, toxicity.PAIR_DISCOUNT)

        def p(v, w, k1=k1, k2=k2, d1=d1, total=total, lowest=lowest, context=context, taken=taken, off=off):
            one = (k1[w] - off(k1[w], d1)) / total + lowest if w in vocabulary else lowest
            if v is None or v not in vocabulary or not context[v]:
                return one
            return (k2[v, w] - off(k2[v, w], toxicity.PAIR_DISCOUNT)) / context[v] + taken[v] / context[v] * one

        models.append(p)
    return lambda v, w: np.log(models[1](v, w)) - np.log(models[0](v, w))


def test_ratios_against_plain_kneser_ney():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwx"
    by_class = tuple([rng.choices(letters, weights=w, k=rng.randint(0, 90)) for _ in range(120)] for w in (range(24), [abs(i - 15) for i in range(24)]))
    hashed = tuple([toxicity.word_hashes(" ".join(d)) for d in docs] for docs in by_class)
    model, ratio = toxicity.ClassModels(hashed), plain_models(by_class)
    assert len(model.pairs) > 10
    for _ in range(50):
        text = rng.choices(letters + "yz", k=20)
        want = [ratio(text[i - 1] if i else None, text[i]) for i in range(20)]
        assert np.allclose(model.ratios(toxicity.word_hashes(" ".join(text))), want, atol=1e-4)


def test_repeated_rows_are_learnt_from_once(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(corpus(60, 5))] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(corpus(60, 5))] * 2, "doc_id long, toxic int")
    once = toxicity.fitted(docs.distinct(), labels.distinct())
    again = toxicity.fitted(docs, labels)
    assert (once.words == again.words).all() and np.allclose(once.fit, again.fit) and np.allclose(once.unigram, again.unigram)


def test_texts_and_counting_stay_off_the_driver(spark, monkeypatch):
    """The fit from Spark's counts is the plain one, and nothing is counted from texts on the driver."""
    rng = random.Random(7)
    docs = corpus(300, 6) + [("", 0), ("alone", 1), ("two words", 0)]
    docs += [(" ".join(rng.choices("abcdefghijklmnopqrstuvwx", weights=range(24) if i % 2 else None, k=80)), i % 2) for i in range(100)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(docs)], "doc_id long, toxic int")
    folds = spark.sql("select id, pmod(shiftright(xxhash64(cast(id as string)), 7), 3) f from range(403) where crc32(cast(id as string)) % 4 <> 2").collect()
    plain = toxicity.train([(r.f, docs[r.id][1], docs[r.id][0]) for r in folds], sum(docs[r.id][1] for r in folds) / len(folds))

    def refused(*_):
        raise AssertionError("texts on the driver")

    monkeypatch.setattr(toxicity.ClassModels, "__init__", refused)
    got = toxicity.fitted(rows, labels)
    for name in ("words", "unigram", "back", "pairs", "pair_ratio"):
        assert len(getattr(got, name)) and np.array_equal(getattr(got, name), getattr(plain, name)), name
    assert got.unknown == plain.unknown and np.allclose(got.fit, plain.fit) and got.fit[1:].any()
