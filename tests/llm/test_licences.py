import hashlib
import re

from tests.llm import cases

from tuplewright.llm import licences


def brute(text):
    t = (text or "").lower()
    t = re.sub(licences._COPYRIGHT, "", t)
    t = re.sub(licences._MARKS, "", t)
    t = re.sub(r"[\W_]+", " ", t).strip(" ")
    for old, new in licences.SPELLINGS.items():
        t = re.sub(rf"\b{old}(?=s?\b)", new, t)
    return t


def test_variants_have_the_licence(spark):
    mit, bsd = licences.KNOWN["MIT"], licences.KNOWN["BSD-3-Clause"]
    rows = [
        (1, mit),
        (2, "Copyright (c) 2019 A. Person\n\n" + mit.upper().replace(" ", "  ")),
        (3, "MIT Licence\n\n © 2020-2024, Somebody Ltd\nAll rights reserved.\n" + "\n".join(mit.split(" "))),
        (4, bsd.replace("1. ", "(a) ").replace("2. ", "* ").replace("3. ", "- ") + "\n\n"),
        (5, mit.replace("free of charge", "for a fee")),
        (6, mit + " And more."),
        (7, "released under the MIT licence"),
        (8, None),
        (9, "--- \n"),
    ]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licence for i in range(1, 10)] == ["MIT", "MIT", "MIT (titled)", "BSD-3-Clause", None, None, "MIT (notice)", None, None]
    assert all(got[i].digest == hashlib.sha256(brute(t).encode()).hexdigest() for i, t in rows)


def test_query_bears_the_cases(spark, tmp_path):
    df = licences.op8_licences(spark, cases.stored(spark, tmp_path))
    assert not re.search("Python|Arrow", df._jdf.queryExecution().executedPlan().toString())
    got, texts = df.collect(), {r[0]: r[1] for r in cases.rows()}
    assert len(got) == len(cases.rows())
    assert all(r.digest == hashlib.sha256(brute(texts[r.doc_id]).encode()).hexdigest() and r.licence is None for r in got)


def test_own_list_and_empty(spark, tmp_path):
    own = spark.createDataFrame([("B", "My Terms"), ("A", "my  terms!"), ("C", "")], "licence string, text string")
    docs = spark.createDataFrame([(1, "MY TERMS", "x")], "doc_id long, text string, licence string")
    assert [r.licence for r in licences.scan(docs, own).collect()] == ["A"]
    assert licences.op8_licences(spark, cases.stored(spark, tmp_path, [])).count() == 0


def test_longer_licences_by_their_digests(spark):
    """A text is known by its digest alone; where the system has the published texts, these too."""
    import os

    files = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "MPL-2.0": "MPL-2.0", "LGPL-2.1": "LGPL-2.1"}
    found = {k: f"/usr/share/common-licenses/{f}" for k, f in files.items() if os.path.exists(f"/usr/share/common-licenses/{f}")}
    rows = []
    for i, (name, path) in enumerate(found.items()):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        assert hashlib.sha256(brute(text).encode()).hexdigest() == licences.DIGESTS[name]
        rows += [(2 * i, text.upper().replace("\n", " \r\n")), (2 * i + 1, text + " and more")]
    assert all(re.fullmatch("[0-9a-f]{64}", d) for d in licences.DIGESTS.values()) and not set(licences.DIGESTS) & set(licences.KNOWN)
    if rows:
        got = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: name for k, name in enumerate(found) for i, name in ((2 * k, name), (2 * k + 1, None))}
