"""Extensions of points-to on small programs, whose results are written out by hand."""

import pytest

from tests.test_clients import rows, run
from tuplewright.plans import analyses as A
from tuplewright.plans import clients as C
from tuplewright.plans import example
from tuplewright.plans import extensions as X
from tuplewright.plans.engine import strata
from tuplewright.plans.language import parse

MICRO = A.policy("micro")

def base(**more):
    out = {n: [] for n in A.NORMAL}
    out["is_class"] = [("java.lang.Object",), ("M",)]
    out["main_class"] = [("M",)]
    out["method"] = [("main", "main", "()", "M")]
    out["modifier"] = [("main", "static")]
    for k, v in more.items():
        out[k] = out[k] + v
    return out


def analyse(spark, out, name, extra, given, *wanted, **options):
    program, facts = parse(A.DECLS + A.HIERARCHY + A.LOOKUP + A.points_to(A.policy(name), **options) + A.CLIENTS + extra), example.normal(spark, out)
    for relation, data in given.items():
        facts[relation] = spark.createDataFrame(data, ", ".join(f"`{n}` {'long' if t == 'number' else 'string'}" for n, t in program.relations[relation].columns))
    r = A.analyse(spark, facts, name, *wanted, extra=extra, **options)
    return [rows(r[w]) for w in wanted]


def values(vpt):
    return {(v, o) for _, o, _, v in vpt}


@pytest.mark.parametrize("name", A.ANALYSES)
def test_extensions_fit_every_policy(name):
    if name in ("types-only", "basic-only"):
        return
    p = A.policy(name)
    text = A.DECLS + A.HIERARCHY + A.LOOKUP + A.points_to(p) + A.CLIENTS
    for extra in (X.information_flow(p), X.nulls(p), X.STAND_INS + X.mocked_results(p), X.STAND_INS + X.open_program(p), X.mobile(p), X.NATIVE_CALLBACKS, X.recorded(p)):
        program = parse(text + extra)
        strata(program, program.relations)
    if p.kind == "none":
        program = parse(A.DECLS + A.HIERARCHY + A.LOOKUP + A.points_to(p, exceptions=False) + A.CLIENTS + C.REFLECTION + X.method_handles(p) + X.proxies(p))
        strata(program, program.relations)


def flow_program():
    """main: s = make(); t = new T; a = id(s); b = id(t); use(a); use(b); d = shift(s); use(d). id is static and returns what it is given."""
    out = base(is_class=[("T",)], method=[("make", "make", "()", "M"), ("use", "use", "(T)", "M"), ("id", "id", "(T)", "M"), ("shift", "shift", "(T)", "M")], modifier=[("id", "static")])
    out["static_call"] = [("c0", "main", "make"), ("c1", "main", "id"), ("c2", "main", "id"), ("u1", "main", "use"), ("u2", "main", "use"), ("c3", "main", "shift"), ("u3", "main", "use")]
    out["actual"] = [("c1", 0, "s"), ("c2", 0, "t"), ("u1", 0, "a"), ("u2", 0, "b"), ("c3", 0, "s"), ("u3", 0, "d")]
    out["assigned"] = [("c0", "s"), ("c1", "a"), ("c2", "b"), ("c3", "d")]
    out["alloc"], out["heap"] = [("t", "T1", "main")], [("T1", "T")]
    out["formal"], out["result"] = [("id", 0, "x")], [("id", "x")]
    out["local_type"] = [(v, "T") for v in "statbdx"]
    return out


@pytest.mark.parametrize("name, leaks", [("micro", {"u1", "u2", "u3"}), ("1-call-site-sensitive+heap", {"u1", "u3"})])
def test_information_flow_keeps_contexts_apart(spark, name, leaks):
    given = {"source": [("make", "T")], "sink": [("use", 0)], "transfer": [("shift", "argument", "result")]}
    leak, tainted = analyse(spark, flow_program(), name, X.information_flow(A.policy(name)), given, "Leak", "TaintedVariable", filtered=False, exceptions=False)
    assert leak == sorted(("c0", i, "use") for i in leaks)
    assert {v for v, _ in tainted} >= {"s", "a", "d", "x"} and (("b", "c0") in tainted) == ("u2" in leaks)


def test_nulls_mocked_results_and_native_callbacks(spark):
    out = base(is_class=[("T",), ("B",)], is_interface=[("I",)], implements=[("B", "I")], method=[("far", "far", "()", "M"), ("T.f", "f", "()", "T"), ("back", "onEvent", "void(int)", "M")])
    out["modifier"] += [("far", "native"), ("far", "static"), ("back", "static")]
    out["static_call"] = [("c0", "main", "far")]
    out["assigned"] = [("c0", "r")]
    out["alloc"], out["heap"] = [("t", "T1", "main")], [("T1", "T")]
    out["virtual_call"] = [("v1", "n", "main", "T.f"), ("v2", "both", "main", "T.f"), ("v3", "t", "main", "T.f")]
    out["move"] = [("both", "n"), ("both", "t")]
    given = {"assign_null": [("n", "main")], "returns": [("far", "I")], "abstract_type": [("I",)], "native_name": [("lib", "onEvent"), ("lib", "main")], "native_descriptor": [("lib", "void(int)")]}
    extra = X.nulls(MICRO) + X.STAND_INS + X.mocked_results(MICRO) + X.NATIVE_CALLBACKS
    may, always, vpt, back, reachable = analyse(spark, out, "micro", extra, given, "MayBeNull", "AlwaysNull", "VarPointsTo", "NativeCallback", "Reachable", filtered=False, exceptions=False)
    assert may == [("v1",), ("v2",)] and always == [("v1",)]
    assert ("r", "<mock of B>") in values(vpt) and back == [("back", "lib")] and ("back",) in reachable


def test_open_program_and_mobile_components(spark):
    out = base(is_class=[("L",), ("P",), ("Act",)], app_type=[("L",)], method=[("L.run", "run", "(P)", "L"), ("L.hid", "hid", "()", "L"), ("Act.c", "onCreate", "void()", "Act"), ("Act.go", "go", "void(android.view.View)", "Act"), ("Act.no", "other", "void()", "Act")])
    out["modifier"] += [("L.run", "public")]
    out["this"] = [("L.run", "L.this"), ("Act.c", "c.this"), ("Act.go", "go.this")]
    out["formal"], out["local_type"] = [("L.run", 0, "p")], [("p", "P"), ("L.this", "L")]
    given = {"component": [("activity", "Act")], "on_click": [("go",)], "abstract_type": []}
    vpt, reachable = analyse(spark, out, "micro", X.STAND_INS + X.open_program(MICRO) + X.mobile(MICRO), given, "VarPointsTo", "Reachable", filtered=False, exceptions=False)
    assert values(vpt) == {("L.this", "<mock of L>"), ("p", "<mock of P>"), ("c.this", "<component Act>"), ("go.this", "<component Act>")}
    assert {m for (m,) in reachable} == {"main", "L.run", "Act.c", "Act.go"}


def test_recorded_calls_handles_and_proxies(spark):
    out = base(is_class=[("T",), ("H",), ("java.lang.Class",)], is_interface=[("I",)], is_array=[("C[]",)], element=[("C[]", "java.lang.Class")])
    out["method"] += [("T.f", "f", "R(T)", "T"), ("I.g", "g", "()", "I"), ("H.invoke", "invoke", "(P,M,A)", "H"), ("findV", "findVirtual", "(C,S)", "java.lang.invoke.MethodHandles$Lookup")]
    out["method"] += [("exact", "invokeExact", "(A)", "java.lang.invoke.MethodHandle"), ("newProxy", "newProxyInstance", "(L,C,H)", "java.lang.reflect.Proxy"), ("newI", "newInstance", "()", "java.lang.Class"), ("inv", "invoke", "()", "java.lang.reflect.Method"), ("forName", "forName", "(S)", "java.lang.Class")]
    out["modifier"] += [("newProxy", "static"), ("forName", "static"), ("I.g", "abstract")]
    out["this"] = [("T.f", "f.this"), ("H.invoke", "h.this")]
    out["formal"], out["result"] = [("T.f", 0, "f.p")], [("T.f", "f.p"), ("H.invoke", "h.r")]
    out["alloc"] = [("t", "T1", "main"), ("h", "H1", "main"), ("k", "list", "main"), ("nf", "text f", "main"), ("nt", "text T", "main"), ("ni", "text I", "main"), ("h.r", "H.out", "H.invoke")]
    out["heap"] = [("T1", "T"), ("H1", "H"), ("list", "C[]"), ("text f", "java.lang.String"), ("text T", "java.lang.String"), ("text I", "java.lang.String"), ("H.out", "T")]
    out["static_call"] = [("n1", "main", "forName"), ("n2", "main", "forName"), ("px", "main", "newProxy")]
    out["actual"] = [("n1", 0, "nt"), ("n2", 0, "ni"), ("fv", 0, "ct"), ("fv", 1, "nf"), ("ex", 0, "t"), ("ex", 1, "t"), ("px", 1, "k"), ("px", 2, "h")]
    out["assigned"] = [("n1", "ct"), ("n2", "ci"), ("fv", "mh"), ("ex", "er"), ("px", "p"), ("call", "pr"), ("lg", "lr")]
    out["store_array"] = [("k", "ci", "main")]
    out["virtual_call"] = [("fv", "lookup", "main", "findV"), ("ex", "mh", "main", "exact"), ("call", "p", "main", "I.g"), ("lg", "unknown", "main", "newI"), ("li", "unknown", "main", "inv")]
    given = {"string_value": [("text f", "f"), ("text T", "T"), ("text I", "I")], "log": [("Class.newInstance", "T", "main", 7), ("Class.newInstance", "H", "main", 8), ("Method.invoke", "H.invoke", "main", 9)], "line_of": [("lg", 7)]}
    more = 'class_value(cat("<class ", cat(t, ">")), t) :- is_interface(t).\n'
    extra = C.REFLECTION + more + X.method_handles(MICRO) + X.proxies(MICRO) + X.recorded(MICRO)
    vpt, handles, proxy, calls = analyse(spark, out, "micro", extra, given, "VarPointsTo", "HandleCall", "ProxyCall", "RecordedCall", filtered=False, exceptions=False)
    got = values(vpt)
    assert [(i, m) for i, _, m in handles] == [("ex", "T.f")] and {("f.this", "T1"), ("f.p", "T1"), ("er", "T1")} <= got
    assert [(i, m, x) for i, _, m, x, _ in proxy] == [("call", "H.invoke", "H1")] and {("h.this", "H1"), ("pr", "H.out"), ("p", "px/proxy I")} <= got
    assert ("lr", "lg/recorded T") in got and ("lr", "lg/recorded H") not in got and calls == [("li", "main", "H.invoke")]


def test_members_and_covariant_results(spark):
    given = {n: [] for n in A.NORMAL} | {"is_class": [("A",), ("B",), ("R",), ("S",)], "extends": [("B", "A"), ("S", "R")], "abstract_type": [("A",)]}
    given["method"] = [("A.f", "f", "R()", "A"), ("A.p", "p", "()", "A"), ("A.i", "<init>", "()", "A"), ("B.f", "f", "S()", "B"), ("A.g", "g", "()", "A")]
    given |= {"modifier": [("A.p", "private")], "parameters": [("A.f", "()"), ("B.f", "()")], "returns": [("A.f", "R"), ("B.f", "S")]}
    members, makes, can, covariant = run(spark, A.DECLS + A.HIERARCHY + X.MEMBERS, given, "DeclaredOrInherited", "Constructor", "Instantiable", "Covariant")
    assert set(members) == {("A.f", "A"), ("A.p", "A"), ("A.i", "A"), ("A.g", "A"), ("B.f", "B"), ("A.f", "B"), ("A.g", "B")}
    assert makes == [("A.i", "A")] and can == [("B",), ("R",), ("S",)] and covariant == [("B.f", "A.f")]


def test_ssa_of_a_loop_and_a_branch(spark):
    """1: x = ..; 2: loop head, to 6 or on; 3: branch to 5; 4: x = ..; 5: back to 2; 6: end."""
    given = {"instruction": [("m", i) for i in range(1, 7)], "jump": [("m", 2, 6), ("m", 3, 5), ("m", 5, 2)], "ends": [("m", 5), ("m", 6)], "assigns": [("m", 1, "x"), ("m", 4, "x"), ("m", 4, "y")]}
    phi, args = run(spark, X.SSA, given, "Phi", "PhiArgument")
    assert phi == [("m", "x", 2), ("m", "x", 5), ("m", "y", 2), ("m", "y", 5)]
    assert [a for a in args if a[1] == "x"] == [("m", "x", 2, 1, 1), ("m", "x", 2, 5, 5), ("m", "x", 5, 3, 2), ("m", "x", 5, 4, 4)]
