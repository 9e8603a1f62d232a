import itertools
import re
from collections import defaultdict

from tests.llm import cases

from tuplewright.llm import filter_audit


def brute(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic). Applies the filters of each order one after another."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    ids = defaultdict(list)
    for d, t, _ in rows:
        if d is not None:
            ids[t or ""].append(d)
    parts = defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and d > min(ids[t]),
        }
        parts[s or ""].append((d, {k for k, v in fails.items() if v}))
    out, shapley = [], defaultdict(int)
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                fails = sum(f in x[1] for x in docs)
                shapley[part, f] += len(removed)
                lost = [sum(x[0] in s for x in removed) for s in (good, toxic)]
                out.append((part, "".join(order), step, len(left), len(removed), fails - len(removed), sum(x[1] == {f} for x in docs), *lost))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_against_orders_applied_one_by_one(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(60))
    more = [long, long + " #", "Z" * 20 + long, long, "a " * 70, "A " * 70 + "%", long + " #", "short", "short"]
    given = cases.rows() + [(100 + i, t, "en", f"s{i % 2}", 0, 5, "g", "h", 9) for i, t in enumerate(more)]
    # other columns with names that the plan uses, and a hot text
    given += [(200 + i, "hot " + long, "en", "s1", 0, 5, "g", "h", 9) for i in range(40)]
    docs = spark.createDataFrame(given, cases.SCHEMA).selectExpr("*", "1 as n", "2 as part", "'x' as A", "3 as first", "4 as docs", "5 as text_").repartition(3)
    marks = [(i, i % 2, (i // 2) % 2) for i in range(0, 240, 3)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1), (103, None, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names
    assert dict(got.dtypes)["step"] == "int" and all(t == "bigint" for c, t in got.dtypes if c not in ("part", "filter_order", "step"))
    want = brute([(g[0], g[1], g[3]) for g in given], marks)
    rows = sorted(map(tuple, got.collect()))
    assert rows == want
    assert {r[0] for r in rows} >= {"", "s0", "s1"} and max(r[6] for r in rows) > 0 and max(r[9] for r in rows) > 0


def test_any_filters(spark):
    counts = spark.createDataFrame([("p", True, False, 5, 1, 0), ("p", True, True, 2, 0, 1), ("p", False, False, 3, 2, 0)], "part string, X boolean, Y boolean, docs long, good long, bad long")
    got = {(r.filter_order, r.step): r for r in filter_audit.interactions(counts, ["X", "Y"]).collect()}
    assert len(got) == 4
    assert [(got[k].kept, got[k].removed, got[k].redundant, got[k].unique_fails, got[k].shapley) for k in (("XY", 1), ("XY", 2), ("YX", 1), ("YX", 2))] == [(3, 7, 0, 5, 12), (3, 0, 2, 0, 2), (8, 2, 0, 0, 2), (3, 5, 2, 5, 12)]
    assert got["XY", 1].good_lost == 1 and got["XY", 1].toxic_lost == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], cases.SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    only = spark.createDataFrame([(None, None, None, None, None, 1, "", "", 1)], cases.SCHEMA)
    rows = filter_audit.audit(only, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows) == 120
