"""Work that grows no faster than the input or the result, on small tables that show the difference."""

import random

import pytest

from tests.test_clients import run
from tuplewright.operators import idioms, recursive
from tuplewright.plans import clients as C
from tuplewright.plans import extensions as X
from tuplewright.plans.engine import BROADCAST_BYTES, Engine, Stored
from tuplewright.plans.language import RuleError


def test_pairs_are_made_once(spark, monkeypatch):
    """Pairs of items with few keys go through no exchange, and are distinct all the same."""
    monkeypatch.setattr(idioms, "MOST_KEYS", 4)
    monkeypatch.setattr(idioms, "SHARE", 3)
    rng = random.Random(5)
    given = [(rng.randint(0, 5), rng.choice("xyz"), rng.randint(1, 40)) for _ in range(300)] + [(None, "x", 1), (1, "x", None)] + [(1, "x", 99)] * 3
    got = [tuple(r) for r in idioms.pairs(spark.createDataFrame(given, "u int, v string, i long"), ["u", "v"], "i").collect()]
    groups = {}
    for u, v, i in given:
        if u is not None and i is not None:
            groups.setdefault((u, v), set()).add(i)
    want = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    keys = {i: sum(i in g for g in groups.values()) for i in range(1, 41)}
    assert min(keys.values()) <= 4 < max(keys.values())
    assert len(got) == len(want) and set(got) == want


def joined(plan) -> int:
    """Rows that the joins of a plan that ran have made."""
    name, inner = plan.nodeName(), None
    if name == "AdaptiveSparkPlan":
        inner = plan.executedPlan()
    elif "QueryStage" in name:
        inner = plan.plan()
    below = [inner] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
    return (plan.metrics().apply("numOutputRows").value() if "Join" in name else 0) + sum(map(joined, below))


def test_no_join_makes_the_pairs(spark, monkeypatch):
    """200 items of one key and some of others, in shares of about 50: 19900 pairs and more, of which joins make none; those of a second key are left out."""
    monkeypatch.setattr(idioms, "SHARE", 50)
    rng = random.Random(6)
    given = [(0, i) for i in range(200)] + [(rng.randint(1, 30), rng.randint(0, 230)) for _ in range(900)]
    df = idioms.pairs(spark.createDataFrame(given, "k int, i long"), ["k"], "i")
    got = [tuple(r) for r in df.collect()]
    groups = [{i for k, i in given if k == g} for g in range(31)]
    want = {(a, b) for g in groups for a in g for b in g if a < b}
    assert len(got) == len(want) > 19900 and set(got) == want
    assert joined(df._jdf.queryExecution().executedPlan()) < 2500


def test_pairs_of_items_with_many_keys(spark, monkeypatch):
    """Up to 60 keys an item, more than a sketch tells apart: a group is cut by the keys that its items bring as well."""
    monkeypatch.setattr(idioms, "SHARE", 20)
    rng = random.Random(7)
    given = [(rng.randint(0, 150), f"i{i}") for i in range(40) for _ in range(rng.choice((1, 5, 60)))]
    got = [tuple(r) for r in idioms.pairs(spark.createDataFrame(given, "k int, i string"), ["k"], "i").collect()]
    groups = {}
    for k, i in given:
        groups.setdefault(k, set()).add(i)
    want = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert len(got) == len(want) and set(got) == want


def test_shadowing_joins_no_fields_by_name_alone(spark):
    """Sixty classes, each with one field of the same name: a join by name alone makes 3600 rows."""
    field = spark.createDataFrame([(f"f{i}", "n", f"T{i}") for i in range(60)], "f string, name string, t string")
    above = spark.createDataFrame([(f"T{i}", f"T{i // 2}") for i in range(1, 60)], "t string, s string")
    engine = Engine(spark, C.SERVER, {"field": field, "above": above})
    rule = next(r for r in engine.program.rules if r.heads[0].relation == "Shadowed")
    assert [x.relation for x in rule.body][1] == "above"
    assert engine.run("Shadowed")["Shadowed"].count() == 59


def test_injection_without_candidates(spark):
    """Points and beans of random types, subtypes, names and qualifiers, beside the definition; candidates are not evaluated."""
    rng = random.Random(8)
    point = {(f"p{rng.randint(0, 25)}", f"t{rng.randint(0, 8)}", f"n{rng.randint(0, 3)}") for _ in range(40)}
    bean = {(f"b{rng.randint(0, 25)}", f"t{rng.randint(0, 8)}", f"n{rng.randint(0, 3)}") for _ in range(22)}
    subtype = {(f"t{i}", f"t{i}") for i in range(9)} | {("t1", "t2"), ("t3", "t4")}
    qualifier, primary = {(f"p{i}", f"n{i % 3}") for i in range(0, 26, 3)}, {(f"b{i}",) for i in range(0, 26, 5)}
    given = {"point": sorted(point), "bean": sorted(bean), "subtype": sorted(subtype), "qualifier": sorted(qualifier), "primary": sorted(primary)}
    want = set()
    for p in {x[0] for x in point}:
        mine = {b for q, t, _ in point if q == p for s, u in subtype if u == t for b, k, _ in bean if k == s}
        asked, names = {q for x, q in qualifier if x == p}, {n for q, _, n in point if q == p}
        main = {b for b in mine if (b,) in primary}
        by = lambda wanted: {b for b in mine if any((b, t, n) in bean for t in {k for _, k, _ in bean} for n in wanted)}  # noqa: E731, B023
        want |= {(p, b) for b in (by(asked) if asked else mine if len(mine) == 1 else main or by(names))}
    assert set(run(spark, C.INJECTION, given, "Injected")[0]) == want
    engine = Engine(spark, C.INJECTION, {n: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in "abc"[: len(rows[0])])) for n, rows in given.items()})
    engine.run("Injected")
    assert "candidate" not in engine.stored


def test_a_forest_finds_each_path_once(spark, monkeypatch):
    """All rounds of a chain of twelve write each path once; other graphs go by rounds that compare."""
    rounds = []
    whole = recursive.saved
    monkeypatch.setattr(recursive, "saved", lambda df: rounds.append(whole(df)) or rounds[-1])
    made = recursive.closure(spark.createDataFrame([(i, i - 1, 1) for i in range(1, 13)] + [(9, 8, 1), (40, 1, 1), (None, 1, 1)], "a long, b long, n long"))
    down = {(a, b, a - b) for a in range(1, 13) for b in range(a)} | {(40, 1, 1), (40, 0, 2)}
    assert sorted(map(tuple, made.collect())) == sorted(down)
    assert not any("anti" in df._jdf.queryExecution().toString().lower() for df in rounds) and len(rounds) == 1 + 5 + 4
    cycle = recursive.closure(spark.createDataFrame([(1, 2), (2, 1), (3, 1), (3, 2)], "a long, b long"))
    assert sorted(map(tuple, cycle.collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
    split = recursive.closure(spark.createDataFrame([(4, 2), (4, 3), (3, 1), (2, 1)], "a long, b long"))
    assert sorted(map(tuple, split.collect())) == [(2, 1), (3, 1), (4, 1), (4, 2), (4, 3)]


def test_values_climb_by_levels(spark, tmp_path):
    """A missing part, a key of nought and values of parts that aren't there; each value of a part is made once."""
    spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 5, 6, 9, 12, 13, 26)] + [(6,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    given = [(26, 1), (26, 1), (12, 1), (12, 2), (9, 3), (4, 4), (100, 5), (0, 6), (1, 1), (5, 7), (-3, 8), (None, 9)]
    spark.createDataFrame(given, "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    there, want = {0, 1, 2, 3, 5, 6, 9, 12, 13, 26}, set()
    for v, h in given:
        want.add((v, h))
        while v in there and v > 0:
            v //= 2
            want.add((v, h))
    got = [tuple(r) for r in recursive.climbing_values(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_keyed_programs_deal_facts_once(spark, monkeypatch):
    """Random flows of 40 methods in several buckets: keyed and other runs agree, and a keyed one's relations are written without an exchange."""
    monkeypatch.setattr(Engine, "_buckets", lambda self: 3)
    rng = random.Random(3)
    lines = [(f"m{m}", i) for m in range(40) for i in range(1, rng.randint(2, 9))]
    given = {
        "instruction": spark.createDataFrame(lines, "m string, i long"),
        "jump": spark.createDataFrame([(m, i, rng.randint(1, 8)) for m, i in lines if rng.random() < 0.4], "m string, i long, to long"),
        "ends": spark.createDataFrame([x for x in lines if rng.random() < 0.1], "m string, i long"),
        "assigns": spark.createDataFrame([(m, i, rng.choice("xyz")) for m, i in lines], "m string, i long, v string"),
    }
    plans = []
    put = Stored._put
    monkeypatch.setattr(Stored, "_put", lambda self, df, path, seen=None: (plans.append((path, df)), put(self, df, path, seen))[1])
    keyed = Engine(spark, X.SSA, given, keyed=True)
    with keyed.running():
        found = keyed.run("Dominates", "PhiArgument", "Phi")
        derived = [df for path, df in plans if not any(f"/{n}-" in path for n in given)]
        assert len(derived) > 20 and not any("Exchange" in df.repartition(3, df.columns[0])._jdf.queryExecution().executedPlan().toString() for df in derived)
    other = Engine(spark, X.SSA, given).run("Dominates", "PhiArgument", "Phi")
    for r in ("Dominates", "PhiArgument", "Phi"):
        assert found[r].count() and sorted(map(tuple, found[r].collect())) == sorted(map(tuple, other[r].collect()))


def test_keyed_deletions(spark, monkeypatch):
    """Ways in 20 groups, some of which are taken away: as a run without them. A program without one key is refused."""
    monkeypatch.setattr(Engine, "_buckets", lambda self, real=Engine._buckets: real(self) and 3)
    rules = """
    .decl way(o: number, x: number, y: number)
    .decl path(o: number, x: number, y: number)
    .decl Ends(o: number, x: number, n: number)
    path(o, x, y) :- way(o, x, y).
    path(o, x, z) :- path(o, x, y), way(o, y, z).
    Ends(o, x, n) :- path(o, x, _), n = count : { path(o, x, _) }.
    """
    rng = random.Random(4)
    ways = sorted({(o, rng.randint(1, 8), rng.randint(1, 8)) for o in range(20) for _ in range(8)})
    frame = lambda rows: spark.createDataFrame(rows, "o long, x long, y long")
    engine = Engine(spark, rules, {"way": frame(ways)}, keyed=True)
    engine.run("Ends")
    engine.delete("way", frame(ways[::3]))
    want = Engine(spark, rules, {"way": frame([w for i, w in enumerate(ways) if i % 3])}).run("path", "Ends")
    for r in ("path", "Ends"):
        assert sorted(map(tuple, engine.relation(r).collect())) == sorted(map(tuple, want[r].collect()))
    with pytest.raises(RuleError):
        Engine(spark, ".decl e(a: number, b: number) .decl p(a: number, b: number) p(x, z) :- e(x, y), e(y, z).", {}, keyed=True)


def test_an_aggregate_of_one_relation_is_one_grouping(spark):
    """count over a whole relation: the relation is read twice (state and groups), not joined with itself before it is grouped."""
    given = {"p": spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 2)], "a long, b long")}
    engine = Engine(spark, ".decl p(a: number, b: number) .decl N(a: number, n: number) N(a, n) :- p(a, _), n = count : { p(a, _) }.", given)
    body = engine._rule(engine.program.rules[0], {"N"}, None, None)
    assert body._jdf.queryExecution().analyzed().toString().count("Join") == 1
    assert sorted(map(tuple, engine.run("N")["N"].collect())) == [(1, 2), (2, 1)]


def test_relations_are_not_broadcast_at_length(spark):
    """While rules run, joins broadcast at most BROADCAST_BYTES, or what the session allows if that is less; afterwards the session is as it was."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    rules = ".decl e(a: number, b: number) .decl p(a: number, b: number) p(x, y) :- e(x, y). p(x, z) :- p(x, y), e(y, z)."
    before, seen = spark.conf.get(key), []
    for allowed, want in ((before, BROADCAST_BYTES), ("-1", -1)):
        spark.conf.set(key, allowed)
        engine = Engine(spark, rules, {"e": spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")})
        engine.on_delta = lambda *_: seen.append(int(spark.conf.get(key)))
        assert engine.run("p")["p"].count() == 3 and set(seen) == {want} and spark.conf.get(key) == allowed
        seen.clear()
    spark.conf.set(key, before)
