import pytest

from tuplewright.plans import analyses as A
from tuplewright.plans import clients as C
from tuplewright.plans import example
from tuplewright.plans.engine import strata
from tuplewright.plans.language import parse


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def run(spark, rules, given, *wanted):
    """Facts as lists of tuples, typed by the program's own declarations."""
    program, facts = parse(rules), {}
    for name, data in given.items():
        types = [f"`{n}` {'long' if t == 'number' else 'string'}" for n, t in program.relations[name].columns]
        facts[name] = spark.createDataFrame(data, ", ".join(types))
    for name, relation in program.relations.items():
        if name not in facts and not any(h.relation == name for r in program.rules for h in r.heads):
            facts[name] = spark.createDataFrame([], ", ".join(f"`{n}` {'long' if t == 'number' else 'string'}" for n, t in relation.columns))
    result = C.run(spark, rules, facts, *wanted)
    return [rows(result[w]) for w in wanted]


@pytest.mark.parametrize("name", [n for n in dir(C) if n.isupper() and n not in ("THREADS", "FINALIZERS", "REFLECTION", "LAMBDAS")])
def test_programs_are_stratified(name):
    program = parse(getattr(C, name))
    strata(program, program.relations)


def test_dead_code_and_directives(spark):
    given = {"instruction": [("a1", "a"), ("a2", "a"), ("b1", "b"), ("b2", "b")], "follows": [("a1", "a2"), ("b1", "b2")], "uses_type": [("a1", "T")], "phantom": [("T",)], "invokes": [("b2", "a")]}
    text = C.DEAD_CODE.replace(", n = count : { follows(_, j) }, n = 1", "")
    assert run(spark, text, given, "DeadInstruction", "DeadMethod") == [[("a1",), ("a2",), ("b2",)], [("a",)]]
    given = {"method": [("m",), ("n",), ("k",)], "application": [("m",)], "reachable": [("m",), ("n",)], "call": [("i", "n")], "keep": []}
    assert run(spark, C.DIRECTIVES, given, "Remove", "Inline", "Seed") == [[("k",)], [("i", "n")], [("m",)]]


def test_heap_merging_and_kinds(spark):
    many = [(f"h{i:02}", "T", "m") for i in range(51)]
    given = {"allocation": [*many, ("one", "U", "m"), ("sb", "java.lang.StringBuilder", "m")], "text_constant": [("txt",)], "kept": [("h00",)]}
    (got,) = run(spark, C.HEAP_MERGING, given, "Representative")
    got = dict(got)
    assert got["h05"] == "h01" and got["h00"] == "h00" and got["one"] == "one" and got["sb"] == "<<string-buffer>>" and got["txt"] == "<<string-constant>>"
    given = {"value_of": [("v", "txt"), ("w", "txt"), ("v", "o"), ("v", "<class A>")], "text_constant": [("txt",)], "heap": [("txt", "java.lang.String"), ("o", "T"), ("<class A>", "java.lang.Class")]}
    assert run(spark, C.VALUE_KINDS, given, "KindCount") == [[("class", 1), ("object", 1), ("string constant", 2)]]


def test_strings_and_shadowing(spark):
    given = {"text": [("getParentNode",), ("setChild",), ("my.package.Thing",)], "member": [("m1", "setChild"), ("m2", "getParent"), ("m3", "ParentNode"), ("m4", "arentNode")]}
    assert run(spark, C.STRING_MATCHING, given, "Matches") == [[("getParentNode", "m2", "part"), ("getParentNode", "m3", "part"), ("setChild", "m1", "whole")]]
    given = {"value_of": [("v", str(i)) for i in range(4)] + [("w", "x")], "limit": [(3,)], "field": [("A.f", "f", "A"), ("B.f", "f", "B")], "above": [("B", "A")]}
    assert run(spark, C.SERVER, given, "Shown", "Shadowed") == [[("v", "<<XL-pt-set>>"), ("w", "x")], [("A.f", "B.f")]]


def test_must_alias_and_control_dependence(spark):
    given = {"move": [("b", "a"), ("c", "b"), ("d", "a"), ("d", "x")], "defined": [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("d", "5"), ("x", "6")]}
    (got,) = run(spark, C.MUST_ALIAS, given, "MustAlias")
    assert {(a, b) for a, b in got} == {(x, y) for x in "abc" for y in "abc" if x != y}
    given = {"edge": [(1, 2), (1, 3), (2, 4), (3, 4)], "exit": [(4,)]}
    assert run(spark, C.CONTROL_DEPENDENCE, given, "ControlDependent") == [[(2, 1), (3, 1)]]


def test_mocks_shapes_loops_injection_and_tests(spark):
    given = {"wanted": [("I",)], "concrete_type": [("A",), ("B",), ("F",)], "subtype": [("A", "I"), ("B", "I"), ("F", "F")], "field_of": [("A", "F")]}
    assert run(spark, C.MOCKS, given, "Stand") == [[("F", "F"), ("I", "A")]]
    shape = lambda name, ns: [(name, i, n) for i, n in enumerate(ns)]
    given = {"item": shape("a", [2, 3, 4]) + shape("b", [6, -1]) + shape("c", [5, -1]) + shape("d", [24]) + shape("e", [7]), "reshape": [("ok", "a", "b"), ("bad", "a", "c"), ("flat", "a", "d"), ("off", "a", "e")]}
    reshaped, errors = run(spark, C.SHAPES, given, "Reshaped", "ShapeError")
    assert reshaped == [("flat", 0, 24), ("ok", 0, 6), ("ok", 1, 4)] and errors == [("bad",), ("off",)]
    given = {"dominates": [(1, 1), (1, 2), (1, 3), (2, 3), (2, 2)], "edge": [(1, 2), (2, 3), (3, 2), (2, 4)], "adds": [("i", 3, 1), ("j", 3, 2)], "assigns": [("i", 3), ("j", 3), ("j", 2), ("i", 1)]}
    loop, induction = run(spark, C.LOOPS, given, "Loop", "Induction")
    assert loop == [(2, 2), (2, 3)] and induction == [("i", 2, 1)]
    given = {"point": [("p1", "S", "x"), ("p2", "T", "t2"), ("p3", "T", "y"), ("p4", "S", "z")], "bean": [("b", "S", "s"), ("t1", "T", "t1"), ("t2", "T", "t2")], "subtype": [("S", "S"), ("T", "T")], "qualifier": [("p3", "t1"), ("p4", "none")], "primary": []}
    assert run(spark, C.INJECTION, given, "Injected") == [[("p1", "b"), ("p2", "t2"), ("p3", "t1")]]
    given = {"method": [("A.t", "testX", "void()", "A"), ("B.k", "k", "void()", "B")], "annotated": [("B.k", "org.junit.Test")], "above": [("A", "junit.framework.TestCase")], "public": [("A.t",)]}
    assert run(spark, C.TESTS, given, "TestMethod", "TestClass") == [[("A.t",), ("B.k",)], [("A",), ("B",)]]


def test_lambdas_and_threads_in_points_to(spark):
    """main makes a lambda over a captured value and calls it; the implementing method gets capture and argument."""
    out = {n: [] for n in A.NORMAL}
    out["is_class"] = [("java.lang.Object",), ("M",), ("X",)]
    out["is_interface"] = [("Fn",)]
    out["main_class"] = [("M",)]
    out["method"] = [("main", "main", "()", "M"), ("impl", "lambda$0", "(X,X)", "M"), ("Fn.apply", "apply", "(X)", "Fn")]
    out["modifier"] = [("main", "static"), ("impl", "static"), ("Fn.apply", "abstract")]
    out["alloc"], out["heap"] = [("a", "X1", "main"), ("b", "X2", "main")], [("X1", "X"), ("X2", "X")]
    out["actual"] = [("indy", 0, "a"), ("call", 0, "b")]
    out["assigned"] = [("indy", "f")]
    out["virtual_call"] = [("call", "f", "main", "Fn.apply")]
    out["formal"] = [("impl", 0, "p"), ("impl", 1, "q")]
    facts = example.normal(spark, out) | {"lambda_site": spark.createDataFrame([("indy", "main", "impl", "Fn", "apply")], "inv string, m string, implementation string, interface string, name string")}
    r = A.analyse(spark, facts, "micro", "VarPointsTo", "Reachable", extra=C.LAMBDAS)
    values = {(v, x) for _, v, _, x in rows(r["VarPointsTo"])}
    assert {("X1", "p"), ("X2", "q"), ("indy::lambda", "f")} <= values and ("X2", "p") not in values and ("impl",) in rows(r["Reachable"])
    for extra in (C.THREADS, C.FINALIZERS, C.REFLECTION):
        program = parse(A.DECLS + A.HIERARCHY + A.LOOKUP + A.points_to(A.policy("micro"), False, False) + extra)
        strata(program, program.relations)


def test_shipped_dead_code(spark):
    given = {"instruction": [("a1", "a"), ("a2", "a"), ("b1", "b"), ("b2", "b"), ("b3", "b"), ("b4", "b")], "follows": [("a1", "a2"), ("b1", "b2"), ("b2", "b3"), ("b1", "b4"), ("b3", "b4")], "uses_type": [("a1", "T")], "phantom": [("T",)], "invokes": [("b2", "a")]}
    assert run(spark, C.DEAD_CODE, given, "DeadInstruction", "DeadMethod") == [[("a1",), ("a2",), ("b2",), ("b3",)], [("a",)]]


def test_nested_loops(spark):
    edge = [(1, 2), (2, 3), (3, 4), (4, 3), (4, 5), (5, 2), (5, 6), (6, 6)]
    dominates = [(a, b) for a in range(1, 7) for b in range(a, 7)]
    given = {"dominates": dominates, "edge": edge, "adds": [("i", 4, 2)], "assigns": [("i", 4), ("i", 1)]}
    loop, induction = run(spark, C.LOOPS, given, "Loop", "Induction")
    assert loop == [(2, 2), (2, 3), (2, 4), (2, 5), (3, 3), (3, 4), (6, 6)] and induction == [("i", 2, 2), ("i", 3, 2)]


def test_threads_finalizers_and_reflection_run(spark):
    out = {n: [] for n in A.NORMAL}
    out["is_class"] = [("java.lang.Object",), ("java.lang.Thread",), ("M",), ("W",), ("java.lang.Class",)]
    out["extends"] = [("W", "java.lang.Thread"), ("java.lang.Thread", "java.lang.Object")]
    out["main_class"] = [("M",)]
    out["method"] = [("main", "main", "()", "M"), ("start", "start", "void()", "java.lang.Thread"), ("W.run", "run", "void()", "W"), ("W.finalize", "finalize", "void()", "W"), ("forName", "forName", "(S)", "java.lang.Class"), ("newInstance", "newInstance", "()", "java.lang.Class")]
    out["modifier"] = [("main", "static"), ("forName", "static"), ("start", "abstract"), ("newInstance", "abstract")]
    out["alloc"], out["heap"] = [("a", "W1", "main"), ("s", "text", "main")], [("W1", "W"), ("text", "java.lang.String")]
    out["this"] = [("W.run", "W.run/this"), ("W.finalize", "W.finalize/this")]
    out["virtual_call"] = [("i1", "a", "main", "start"), ("i3", "c", "main", "newInstance")]
    out["static_call"] = [("i2", "main", "forName")]
    out["actual"] = [("i2", 0, "s")]
    out["assigned"] = [("i2", "c"), ("i3", "o")]
    facts = example.normal(spark, out) | {"string_value": spark.createDataFrame([("text", "W")], "h string, text string")}
    r = A.analyse(spark, facts, "micro", "VarPointsTo", "Reachable", extra=C.THREADS + C.FINALIZERS + C.REFLECTION)
    values = {(x, h) for _, h, _, x in rows(r["VarPointsTo"])}
    assert {("W.run/this", "W1"), ("W.finalize/this", "W1"), ("c", "<class W>"), ("o", "i3/new W")} <= values
    assert {("W.run",), ("W.finalize",)} <= set(rows(r["Reachable"]))
