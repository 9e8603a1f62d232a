"""Ordinals, equivalences, macros, and facts that are taken away."""

import random

import pytest

from tuplewright.plans.engine import Engine, evaluate
from tuplewright.plans.language import RuleError, parse, preprocess


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ord_is_an_injective_number(spark):
    text = """
    .decl s(x: symbol, t: symbol)
    .decl R(x: symbol, n: number)
    .decl Handed(x: symbol, m: number)
    .decl Joined(x: symbol, y: symbol)
    .decl Least(n: number, t: symbol)
    .decl Named(x: symbol, t: symbol)
    .decl Direct(t: symbol, x: symbol)
    .decl Before(x: symbol, y: symbol)
    .decl Made(x: symbol, n: number)
    R(x, ord(x)) :- s(x, _).
    Handed(x, n % 11) :- s(x, _), n = ord(x), n >= 0.
    Joined(x, y) :- R(x, n), s(y, _), ord(y) = n.
    Least(n, t) :- s(_, t), n = min ord(x) : { s(x, t) }.
    Named(x, t) :- s(x, _), ord(x) = n, Least(n, t).
    Direct(t, x) :- s(_, t), x = min ord(y) : { s(y, t) }.
    Before(x, y) :- s(x, t), s(y, t), ord(x) < ord(y).
    Made(x, ord(cat(x, "!"))) :- s(x, _).
    """
    given = [(f"{a}{b}", a) for a in "pqr" for b in range(40)]
    facts = {"s": spark.createDataFrame(given, "x string, t string").repartition(5)}
    r = evaluate(spark, text, facts)
    numbers = dict(rows(r["R"]))
    assert len(numbers) == 120 and len(set(numbers.values())) == 120
    assert sorted(numbers, key=numbers.get) == sorted(numbers)  # the facts' ordinals follow the text
    assert rows(r["Handed"]) == sorted((x, n % 11) for x, n in numbers.items())
    assert rows(r["Joined"]) == sorted((x, x) for x in numbers)
    least = {t: min(x for x, u in given if u == t) for t in "pqr"}
    assert rows(r["Least"]) == sorted((numbers[x], t) for t, x in least.items())
    assert rows(r["Named"]) == sorted((x, t) for t, x in least.items()) and rows(r["Direct"]) == sorted(least.items())
    assert r["Before"].count() == 3 * 40 * 39 // 2
    made = dict(rows(r["Made"]))
    assert len(made) == 120 and len({*made.values(), *numbers.values()}) == 240


def test_symbols_made_by_rounds_get_ordinals(spark):
    text = """
    .decl start(x: symbol)
    .decl grown(x: symbol, n: number)
    grown(x, ord(x)) :- start(x).
    grown(y, ord(y)) :- grown(x, _), strlen(x) < 6, y = cat(x, "a").
    """
    r = dict(rows(evaluate(spark, text, {"start": spark.createDataFrame([("",), ("b",)], "x string")}, "grown")["grown"]))
    assert set(r) == {"a" * k for k in range(7)} | {"b" + "a" * k for k in range(6)} and len(set(r.values())) == len(r)


def test_equivalence(spark):
    text = """
    .decl s(x: number)
    .decl e(x: number, y: number) eqrel
    e(x, x + 1) :- s(x).
    """
    got = rows(evaluate(spark, text, {"s": spark.createDataFrame([(1,), (2,), (7,)], "x long")}, "e")["e"])
    assert got == sorted((x, y) for part in ((1, 2, 3), (7, 8)) for x in part for y in part)
    with pytest.raises(RuleError):
        parse(".decl e(x: number) eqrel")


def test_macros(spark):
    text = """
    #define TYPED(heap, type) \\
        made(heap, m), \\
        of(m, type)
    #define ENOUGH 2
    #define NEAR(a) side_##a(a)
    #define QUIET
    .decl made(h: symbol, m: symbol)
    .decl of(m: symbol, t: symbol)
    .decl side_x(x: symbol)
    .decl found(h: symbol, t: symbol)
    side_x("TYPED(a, b)").
    #ifdef QUIET
    found(h, t) :- TYPED(h, t), strlen(t) >= ENOUGH.
    found(x, cat(x, "(1, 2)")) :- NEAR(x).
    #else
    nothing.
    #endif
    """
    facts = {"made": spark.createDataFrame([("h1", "m1"), ("h2", "m2")], "h string, m string"), "of": spark.createDataFrame([("m1", "tt"), ("m2", "t")], "m string, t string")}
    assert rows(evaluate(spark, text, facts, "found")["found"]) == [("TYPED(a, b)", "TYPED(a, b)(1, 2)"), ("h1", "tt")]
    for bad in ("#if 1\n#endif", '#include "x.dl"', "#endif", "#ifdef A\n", "#define F(a) a\nF(1, 2)."):
        with pytest.raises(RuleError):
            preprocess(bad, set())


GRAPH = """
.decl edge(x: number, y: number)
.decl shut(x: number)
.decl path(x: number, y: number)
.decl root(x: number)
.decl far(x: number, y: number)
.decl degree(x: number, n: number)
.decl loop(x: number)
.decl apart(x: number, y: number)
path(x, y) :- edge(x, y), !shut(y).
path(x, z) :- path(x, y), edge(y, z), !shut(z).
far(x, z) :- path(x, y), path(y, z), x != z.
degree(x, n) :- edge(x, _), n = count : { edge(x, _) }.
loop(x) :- path(x, x).
root(x) :- edge(x, _).
root(y) :- root(x), far(x, y).
apart(x, y) :- root(x), root(y), !path(x, y).
"""
WANTED = ("path", "far", "degree", "loop", "root", "apart")


def test_updates_equal_the_whole_run(spark):
    rng = random.Random(8)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(14)}
    shut, root = {(3,)}, {(100,)}
    frame = lambda given, schema: spark.createDataFrame(sorted(given), schema)
    schemas = {"edge": "x long, y long", "shut": "x long", "root": "x long"}
    facts = lambda: {"edge": frame(edges, schemas["edge"]), "shut": frame(shut, schemas["shut"]), "root": frame(root, schemas["root"])}
    engine = Engine(spark, GRAPH, facts())
    engine.run(*WANTED)
    old = {r: set(rows(engine.relation(r))) for r in WANTED}
    steps = ["delete edge", "insert edge", "delete edge", "delete shut", "delete root", "delete edge"]
    for step in steps:
        how, name = step.split()
        held = {"edge": edges, "shut": shut, "root": root}[name]
        if how == "delete":
            some = set(rng.sample(sorted(held), min(len(held), 3)))
            held -= some
            lost = engine.delete(name, frame(some | {(77, 77)[: len(next(iter(some)))]}, schemas[name]))
        else:
            some = {(rng.randrange(9), rng.randrange(9)) for _ in range(2)}
            held |= some
            lost = None
            engine.insert(name, frame(some, schemas[name]))
        whole = evaluate(spark, GRAPH, facts(), *WANTED)
        new = {r: set(rows(engine.relation(r))) for r in WANTED}
        for r in WANTED:
            assert new[r] == set(rows(whole[r])), (step, r)
            assert lost is None or lost.get(r, 0) == len(old[r] - new[r]), (step, r)
        old = new
    assert engine.delete("edge", frame({(55, 55)}, schemas["edge"])) == {}
