import random
import zlib

import corpus_pipeline
import numpy as np
from tests.llm import cases
from tests.llm.test_media_packing_quality import brute
from tests.llm.test_sharding_simhash import brute_components, brute_fingerprint

from tuplewright.llm import packing, pii, toxicity


def given_rows():
    rng = random.Random(9)
    plain = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("an", "el", "im", "or", "us")]
    out, labels = [], []
    for i in range(400):
        words, toxic = rng.choices(plain, k=rng.randint(15, 90)), i % 4 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["nasty", "vile", "rotten"])
        labels.append((i, 1, int(toxic)))
        out.append((i, " ".join(words)))
    out += [(1000 + i, out[i * 7][1]) for i in range(20)]
    out += [(2000, "mail to ab.42@mail8.example.com " + " ".join(rng.choices(plain, k=40))), (2001, "junk"), (2002, "a b c d e " * 20), (2003, None)]
    return [(i, t, "en", f"s{i % 5}", len(t or ""), 0, "", "", 0) for i, t in out] + [(*out[1], "en", "s1", 0, 0, "", "", 0)], labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = given_rows()
    folder = cases.stored(spark, tmp_path, rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fitted(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    now = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: (r[0], r[1] or "")

    def step(k, want):
        nonlocal docs, now
        docs = spark.createDataFrame(corpus_pipeline.STAGES[k][1](spark, docs, folder).collect(), cases.SCHEMA)
        now = sorted(((r.doc_id, r.text) for r in docs.collect()), key=key)
        assert now == sorted(want, key=key)

    step(0, [r for r in now if model.score(np.array([model.features(toxicity.word_hashes(r[1] or ""))]))[0] < 0.3])
    assert not {i for i, _, y in labels if y and zlib.crc32(str(i).encode()) % 4 == 2} & {i for i, _ in now}
    assert len(now) > 300
    measured = [(r, brute(r[1] or "")) for r in now]
    step(1, [r for r, m in measured if m[0] >= 10 and 100 * m[4] <= 20 * m[0]])
    groups = brute_components([i for i, _ in now], [brute_fingerprint(t or "") for _, t in now])
    step(2, {r for r, g in zip(now, groups, strict=True) if r[0] == g})
    before = dict(now)
    step(3, [(i, before[i] if i != 2000 else dict(now_pii)[2000]) for now_pii in [[(r.doc_id, r.text) for r in pii.pseudonymise(docs).collect()]] for i in before])
    assert "ab.42@" not in dict(now)[2000] and dict(now)[2000].startswith("mail to ")
    packed = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert sorted({r.doc_id for r in packed}) == sorted(i for i, _ in now)
    again = corpus_pipeline.run(spark, folder).collect()
    piece = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(piece, again)) == sorted(map(piece, packed)) and packing.SEQ_LEN == 1024


def test_nulls_and_empty(spark, tmp_path):
    for k, given in enumerate((cases.rows(), [])):
        folder = cases.stored(spark, tmp_path / str(k), given)
        spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert bool(got) == bool(given)
