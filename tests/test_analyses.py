import os

import pytest

from tuplewright.plans import analyses as A
from tuplewright.plans import example
from tuplewright.plans.engine import Engine, strata
from tuplewright.plans.language import parse


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def short(text):
    return text.rsplit("/", 2)[-2:] if "/new " in text else text


@pytest.fixture(scope="module")
def normal(spark):
    return example.normal(spark)


GOLDEN = {
    ("test", "@this"): {"new Example/0"}, ("test", "l0"): {"new Example/0"}, ("test", "$stack8"): {"new Cat/0"}, ("test", "l2"): {"new Cat/0"},
    ("test", "$stack5"): {"new Dog/0"}, ("test", "l2A1"): {"new Dog/0"}, ("test", "l2A2"): {"new Cat/0", "new Dog/0"},
    ("test", "$stack6"): {"new Cat/1"}, ("test", "l3"): {"new Cat/1"}, ("test", "$stack7"): {"new Cat/2"}, ("test", "l4"): {"new Cat/2"},
    ("morePlay", "@this"): {"new Example/0"}, ("morePlay", "l0"): {"new Example/0"}, ("morePlay", "@param0"): {"new Cat/1"}, ("morePlay", "c"): {"new Cat/1"},
    ("morePlay", "p"): {"new Cat/2"}, ("morePlay", "a1"): {"new Cat/1", "new Cat/2"}, ("morePlay", "a2"): {"new Cat/1", "new Cat/2"},
}


@pytest.mark.parametrize("name", ["context-insensitive"])
def test_tutorial_golden_rows(spark, normal, name):
    r = A.analyse(spark, normal, name, "VarPointsTo", "CallGraphEdge", "Reachable", "InstanceFieldPointsTo", "PolymorphicCallSite", "MethodCallsClosure", "Insane", "Metric", "MayFailCast")
    vpt = rows(r["VarPointsTo"])
    assert len(vpt) == 37 and len(rows(r["CallGraphEdge"])) == 10 and len(rows(r["Reachable"])) == 8
    assert len(rows(r["InstanceFieldPointsTo"])) == 1 and len(rows(r["PolymorphicCallSite"])) == 1
    assert ("<Animal: void play()>",) not in rows(r["Reachable"])
    for (method, var), want in GOLDEN.items():
        assert {v.rsplit("/new ", 1)[1] for _, v, _, x in vpt if x == example._v(method, var)} == {w.removeprefix("new ") for w in want}, (method, var)
    name_of = lambda m: m.split("(")[0].split(" ")[-1] if "play()" not in m else m.split(":")[0][1:] + ".play"
    closure = {(name_of(a), name_of(b)) for a, b in rows(r["MethodCallsClosure"])}
    want = {"main": "test morePlay setParent getParent Cat.play Dog.play playWith", "test": "morePlay setParent getParent Cat.play Dog.play playWith", "morePlay": "getParent Cat.play playWith", "playWith": "Cat.play"}
    assert closure == {(a, b) for a, text in want.items() for b in text.split()} and len(closure) == 17
    assert all(n == 0 for _, n in rows(r["Insane"])) and dict(rows(r["Metric"]))["call graph edges (ins)"] == 10 and rows(r["MayFailCast"]) == []


def identity_program():
    """id(x) returns x; it is called on two receivers with two values: only contexts keep the results apart."""
    out = {n: [] for n in A.NORMAL}
    out["is_class"] = [("java.lang.Object",), ("M",), ("I",), ("X",)]
    out["extends"] = [("M", "java.lang.Object"), ("I", "java.lang.Object"), ("X", "java.lang.Object")]
    out["main_class"] = [("M",)]
    out["method"] = [("M.main", "main", "void()", "M"), ("I.id", "id", "X(X)", "I")]
    out["modifier"] = [("M.main", "static")]
    for i in ("1", "2"):
        out["alloc"] += [(f"r{i}", f"I{i}", "M.main"), (f"x{i}", f"X{i}", "M.main")]
        out["heap"] += [(f"I{i}", "I"), (f"X{i}", "X")]
        out["virtual_call"].append((f"call{i}", f"r{i}", "M.main", "I.id"))
        out["actual"].append((f"call{i}", 0, f"x{i}"))
        out["assigned"].append((f"call{i}", f"y{i}"))
    out["this"], out["formal"], out["result"] = [("I.id", "this")], [("I.id", 0, "p")], [("I.id", "p")]
    names = {"r1": "I", "r2": "I", "this": "I"}
    for v in ("r1", "r2", "x1", "x2", "y1", "y2", "this", "p"):
        out["local"].append((v, "I.id" if v in ("this", "p") else "M.main"))
        out["local_type"].append((v, names.get(v, "X")))
    return out


#: the others differ in depth alone; ALL_POLICIES=1 runs each
FEW = ("micro", "context-insensitive-plusplus", "1-call-site-sensitive+heap", "2-object-sensitive+heap", "3-type-sensitive+2-heap")


@pytest.mark.parametrize("name", [n for n in A.ANALYSES if n not in ("types-only", "basic-only") and (n in FEW or os.environ.get("ALL_POLICIES"))])
def test_policies_separate_or_merge(spark, name):
    r = A.analyse(spark, example.normal(spark, identity_program()), name, "VarPointsTo", "CallGraphEdge")
    y1 = {v for _, v, _, x in rows(r["VarPointsTo"]) if x == "y1"}
    # one type allocates both receivers, so its context can't tell them apart
    merges = name in ("micro", "context-insensitive") or "type" in name
    assert y1 == ({"X1", "X2"} if merges else {"X1"})
    assert {(i, m) for i, _, m, _ in rows(r["CallGraphEdge"])} == {("call1", "I.id"), ("call2", "I.id")}


def test_types_only_and_basic(spark, normal):
    r = A.analyse(spark, normal, "types-only", "Reachable", "call_target")
    assert len(rows(r["Reachable"])) == 8
    assert {t for t, s in rows(A.analyse(spark, normal, "basic-only", "SubtypeOf")["SubtypeOf"]) if s == "Animal"} == {"Animal", "Cat", "Dog", "null_type"}
    assert len(A.ANALYSES) == 22
    for n in A.ANALYSES:
        program = parse(A.DECLS + A.HIERARCHY + A.LOOKUP + A.points_to(A.policy(n)) + A.CLIENTS)
        assert any("VarPointsTo" in g and "CallGraphEdge" in g for g in strata(program, program.relations))


def test_hierarchy_and_lookup(spark):
    out = {n: [] for n in A.NORMAL}
    out["is_class"] = [(c,) for c in ("java.lang.Object", "A", "B", "C")]
    out["is_interface"] = [("I1",), ("I2",), ("java.lang.Cloneable",)]
    out["is_array"], out["element"] = [("A[]",), ("B[]",), ("int[]",)], [("A[]", "A"), ("B[]", "B"), ("int[]", "int")]
    out["extends"] = [("A", "java.lang.Object"), ("B", "A"), ("C", "java.lang.Object")]
    out["implements"] = [("I2", "I1"), ("C", "I2"), ("C", "I1"), ("B", "I1")]
    out["method"] = [("I1.m", "m", "()", "I1"), ("I2.m", "m", "()", "I2"), ("A.m", "m", "()", "A"), ("A.k", "k", "()", "A"), ("O.h", "h", "()", "java.lang.Object")]
    out["modifier"] = [("A.k", "abstract")]
    r = A.analyse(spark, example.normal(spark, out), "basic-only", "SubtypeOf", "MethodLookup", "MethodOverrides")
    sub, look = set(rows(r["SubtypeOf"])), {(n, t): m for n, _, t, m in rows(r["MethodLookup"])}
    assert {("B[]", "A[]"), ("B[]", "java.lang.Object"), ("int[]", "java.lang.Cloneable"), ("C", "I1"), ("byte", "short"), ("null_type", "C")} <= sub
    assert ("int[]", "A[]") not in sub and ("A[]", "B[]") not in sub and ("byte", "long") not in sub
    assert look["m", "C"] == "I2.m" and look["m", "B"] == "A.m" and look["h", "B[]"] == "O.h" and ("k", "B") not in look
    assert ("I2.m", "I1.m") in rows(r["MethodOverrides"])


def test_exceptions(spark):
    """thrower raises; the caller's inner handler has another type, the outer one fits; the last call is outside of both."""
    out = {n: [] for n in A.NORMAL}
    out["is_class"] = [(c,) for c in ("java.lang.Object", "M", "E", "F")]
    out["extends"] = [("M", "java.lang.Object"), ("E", "java.lang.Object"), ("F", "java.lang.Object")]
    out["main_class"] = [("M",)]
    out["method"] = [("main", "main", "()", "M"), ("t", "t", "()", "M")]
    out["modifier"] = [("main", "static"), ("t", "static")]
    out["alloc"], out["heap"] = [("e", "newE", "t")], [("newE", "E")]
    out["raise"] = [("throw", 5, "e", "t")]
    out["static_call"] = [("c25", "main", "t"), ("c50", "main", "t")]
    out["call_at"] = [("c25", 25, "main"), ("c50", 50, "main")]
    out["handler"] = [("inner", "main", "F", 20, 30, "vf"), ("outer", "main", "E", 10, 40, "ve")]
    out["local"] = [("e", "t"), ("vf", "main"), ("ve", "main")]
    out["local_type"] = [("e", "E"), ("vf", "F"), ("ve", "E")]
    r = A.analyse(spark, example.normal(spark, out), "context-insensitive", "VarPointsTo", "ThrowPointsTo")
    assert {x for _, _, _, x in rows(r["VarPointsTo"])} == {"e", "ve"}
    assert {m for _, _, _, m in rows(r["ThrowPointsTo"])} == {"t", "main"}


@pytest.mark.parametrize(("sanitized", "leaks"), [(False, 1), (True, 0)])
def test_taint(spark, sanitized, leaks):
    out = {n: [] for n in A.NORMAL}
    out["is_class"] = [("java.lang.Object",), ("M",)]
    out["method"] = [(m, m, "()", "M") for m in ("main", "source", "sink", "clean")]
    out["modifier"] = [(m, "static") for m in ("main", "source", "sink", "clean")]
    out["static_call"] = [("i1", "main", "source"), ("i2", "main", "clean"), ("i3", "main", "sink")]
    out["assigned"] = [("i1", "a"), ("i2", "c")]
    out["store"], out["load"] = [("o", "f", "a", "main")], [("b", "o", "f", "main")]
    out["actual"] = [("i2", 0, "b"), ("i3", 0, "c")]
    out["formal"], out["result"] = [("clean", 0, "p")], [("clean", "p")]
    facts = example.normal(spark, out)
    one = lambda x: spark.createDataFrame([(v,) for v in x], "m string")
    facts |= {"source_method": one(["source"]), "sink_method": one(["sink"]), "sanitizer_method": one(["clean"] if sanitized else [])}
    r = A.run(spark, A.TAINT, facts, "LeakingTaintedInformation")
    assert len(rows(r["LeakingTaintedInformation"])) == leaks
    assert ("a", "c") in rows(A.run(spark, A.DATA_FLOW, facts, "Flows")["Flows"]) if not sanitized else True


def test_dominators_folding_and_components(spark):
    df = lambda data, schema: spark.createDataFrame(data, schema)
    flow = {
        "instruction": df([("m", i) for i in range(1, 8)], "m string, i long"),
        "jump": df([("m", 2, 5), ("m", 4, 6), ("m", 7, 1)], "m string, i long, t long"),
        "ends": df([("m", 4)], "m string, i long"),
    }
    r = A.run(spark, A.CONTROL_FLOW, flow, "Dominates", "BlockSuccessor")
    edges = {(a, b) for _, a, b in rows(r["BlockSuccessor"])}
    assert edges == {(1, 3), (1, 5), (3, 6), (5, 6), (6, 1)}
    assert {(a, b) for _, a, b in rows(r["Dominates"])} == {(x, x) for x in (1, 3, 5, 6)} | {(1, 3), (1, 5), (1, 6)}
    chain = {"const": df([("v0", 7), ("k", 3)], "v string, n long"), "copy": df([(f"v{i + 1}", f"v{i}") for i in range(6)], "a string, b string"), "binary": df([("q", "/", "v0", "k"), ("w", "+", "v1", "k")], "a string, o string, b string, c string")}
    folded = dict(rows(A.run(spark, A.CONSTANTS, chain, "Folded")["Folded"]))
    assert folded["v5"] == 7 and "v6" not in folded and folded["q"] == 2 and folded["w"] == 10
    refs = {"refers": df([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "a string, b string")}
    r = A.run(spark, A.COMPONENTS, refs, "SCC", "Condensed", "SCCSize")
    assert dict(rows(r["SCC"])) == {"a": "a", "b": "a", "c": "a", "d": "d"} and rows(r["Condensed"]) == [("a", "d")] and rows(r["SCCSize"]) == [("a", 3), ("d", 1)]


def test_extra_rules_and_increment(spark, normal):
    extra = '.decl mine(v: symbol)  mine(v) :- VarPointsTo(_, o, _, v), contains("Dog", o).'
    got = rows(A.analyse(spark, normal, "micro", "mine", extra=extra)["mine"])
    assert len(got) == 4 and all("l2A" in v or "stack5" in v or "@this" in v for (v,) in got)


def test_increment_of_points_to(spark):
    """A new assignment after the run reaches the variables behind it."""
    facts = example.normal(spark, identity_program())
    engine = Engine(spark, A.DECLS + A.HIERARCHY + A.LOOKUP + A.points_to(A.policy("micro"), False, False), facts)
    engine.run("VarPointsTo")
    engine.insert("move", spark.createDataFrame([("z", "y1")], "to string, `from` string"))
    assert {v for _, v, _, x in rows(engine.relation("VarPointsTo")) if x == "z"} == {"X1", "X2"}
