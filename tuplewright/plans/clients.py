"""Smaller analyses as rule programs. Each stands alone over the relations that it declares as facts.

Extensions of points-to are texts to add to it (``analyse(..., extra=THREADS)``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tuplewright.plans.engine import Engine, Result

#: starting a thread calls its run method; added to a points-to program of any policy without context records
THREADS = """
.decl starts(inv: symbol, ctx: Ctx, x: symbol, hc: HCtx, m: symbol)
starts(i, c, x, hc, m) :- virtual_call(i, b, _, sig), method(sig, "start", "void()", "java.lang.Thread"), VarPointsTo(hc, x, c, b), heap(x, t), SubtypeOf(t, "java.lang.Thread"), MethodLookup("run", "void()", t, m).
target(i, c, m, x, hc) :- starts(i, c, x, hc, m).
"""

#: an object whose class has its own finalizer makes that method reachable
FINALIZERS = """
.decl finalizer(h: symbol, m: symbol)
finalizer(h, m) :- heap(h, t), MethodLookup("finalize", "void()", t, m), method(m, _, _, owner), owner != "java.lang.Object".
VarPointsTo(hc, h, c, this_var) :- VarPointsTo(hc, h, c, _), finalizer(h, m), this(m, this_var).
ReachableContext(c, m) :- VarPointsTo(_, h, c, _), finalizer(h, m).
"""

#: a class found by a constant name, and its instances
REFLECTION = """
.decl string_value(h: symbol, text: symbol)
.decl for_name(inv: symbol, m: symbol)
.decl new_instance(inv: symbol, m: symbol)
.decl class_value(o: symbol, t: symbol)
.decl reflective(o: symbol, t: symbol)
for_name(i, m) :- static_call(i, m, sig), method(sig, "forName", _, "java.lang.Class").
new_instance(i, m) :- virtual_call(i, _, m, sig), method(sig, "newInstance", _, "java.lang.Class").
class_value(cat("<class ", cat(t, ">")), t) :- is_class(t).
heap(o, "java.lang.Class") :- class_value(o, _).
VarPointsTo("<<immutable-hcontext>>", o, c, r) :- for_name(i, _), actual(i, 0, a), VarPointsTo(_, h, c, a), string_value(h, t), class_value(o, t), assigned(i, r).
reflective(cat(i, cat("/new ", t)), t) :- new_instance(i, _), class_value(_, t).
heap(o, t) :- reflective(o, t).
VarPointsTo("<<immutable-hcontext>>", cat(i, cat("/new ", t)), c, r) :- new_instance(i, _), virtual_call(i, b, _, _), VarPointsTo(_, o, c, b), class_value(o, t), assigned(i, r).
"""

#: a lambda object remembers the method that it stands for and the values that it captured
LAMBDAS = """
.decl lambda_site(inv: symbol, m: symbol, implementation: symbol, interface: symbol, name: symbol)
.decl lambda_object(o: symbol, inv: symbol, implementation: symbol, name: symbol)
.decl captured(inv: symbol, n: number)
.decl LambdaCall(inv: symbol, ctx: Ctx, m: symbol, site: symbol)
captured(i, n) :- lambda_site(i, _, _, _, _), n = count : { actual(i, _, _) }.
lambda_object(cat(i, "::lambda"), i, f, name) :- lambda_site(i, _, f, _, name).
heap(cat(i, "::lambda"), t) :- lambda_site(i, _, _, t, _).
VarPointsTo("<<immutable-hcontext>>", cat(i, "::lambda"), c, r) :- lambda_site(i, m, _, _, _), ReachableContext(c, m), assigned(i, r).
LambdaCall(i, c, f, s) :- virtual_call(i, b, _, sig), method(sig, name, _, _), VarPointsTo(_, o, c, b), lambda_object(o, s, f, name).
ReachableContext(c, f) :- LambdaCall(_, c, f, _).
VarPointsTo(hc, o, c, r) :- LambdaCall(i, c, f, _), result(f, v), assigned(i, r), VarPointsTo(hc, o, c, v).
VarPointsTo(hc, o, c, p) :- LambdaCall(_, c, f, s), actual(s, k, a), formal(f, k, p), VarPointsTo(hc, o, c, a).
VarPointsTo(hc, o, c, p) :- LambdaCall(i, c, f, s), captured(s, n), actual(i, k, a), formal(f, k + n, p), VarPointsTo(hc, o, c, a).
"""

#: what can't run because its type is missing, and what only that calls
DEAD_CODE = """
.decl instruction(i: symbol, m: symbol)
.decl follows(i: symbol, j: symbol)
.decl uses_type(i: symbol, t: symbol)
.decl phantom(t: symbol)
.decl invokes(i: symbol, m: symbol)
.decl root(m: symbol)
.decl DeadInstruction(i: symbol)
.decl has_live_entry(m: symbol)
.decl before(i: symbol)
.decl DeadMethod(m: symbol)
.decl first(i: symbol, m: symbol)
before(j) :- follows(_, j).
first(i, m) :- instruction(i, m), !before(i).
DeadInstruction(i) :- uses_type(i, t), phantom(t).
DeadInstruction(i) :- invokes(i, m), DeadMethod(m).
DeadInstruction(j) :- DeadInstruction(i), follows(i, j), n = count : { follows(_, j) }, n = 1.
DeadMethod(m) :- first(i, m), DeadInstruction(i).
"""

#: values of variables, cut off above a threshold
SERVER = """
.decl value_of(v: symbol, o: symbol)
.decl limit(n: number)
.decl Shown(v: symbol, o: symbol)
.decl field(f: symbol, name: symbol, t: symbol)
.decl above(t: symbol, s: symbol)
.decl Shadowed(f: symbol, by: symbol)
Shown(v, "<<XL-pt-set>>") :- value_of(v, _), limit(k), n = count : { value_of(v, _) }, n > k.
Shown(v, o) :- value_of(v, o), limit(k), n = count : { value_of(v, _) }, n <= k.
Shadowed(g, f) :- field(f, name, t), above(t, s), field(g, name, s).
"""

#: many allocations of a type in a method, or of string buffers anywhere, share a representative
HEAP_MERGING = """
.decl allocation(h: symbol, t: symbol, m: symbol)
.decl text_constant(h: symbol)
.decl kept(h: symbol)
.decl merges_in(m: symbol, t: symbol)
.decl Representative(h: symbol, r: symbol)
merges_in(m, t) :- allocation(_, t, m), n = count : { allocation(_, t, m) }, n > 50.
Representative(h, "<<string-constant>>") :- text_constant(h), !kept(h).
Representative(h, "<<string-buffer>>") :- allocation(h, t, _), (t = "java.lang.StringBuffer"; t = "java.lang.StringBuilder"), !kept(h).
Representative(h, r) :- allocation(h, t, m), merges_in(m, t), !kept(h), t != "java.lang.StringBuffer", t != "java.lang.StringBuilder", r = min ord(x) : { allocation(x, t, m), !kept(x) }.
Representative(h, h) :- kept(h).
Representative(h, h) :- allocation(h, t, m), !merges_in(m, t), !kept(h), t != "java.lang.StringBuffer", t != "java.lang.StringBuilder".
"""

#: fixed values: the least and the greatest length of a part of a text constant that may name a member
part_lengths = (7, 90)

#: text constants that name a member: whole, or by what stands before or behind a boundary of case or sign
STRING_MATCHING = f"""
.decl text(s: symbol)
.decl member(m: symbol, name: symbol)
.decl pair(s: symbol, n: number, two: symbol)
.decl starts_word(s: symbol, n: number)
.decl ends_word(s: symbol, n: number)
.decl part(s: symbol, p: symbol)
.decl Matches(s: symbol, m: symbol, how: symbol)
pair(s, n, substr(s, n - 1, 2)) :- text(s), n = range(1, strlen(s)).
starts_word(s, n) :- pair(s, n, two), match("[a-z0-9][A-Z]|[_.$].", two).
ends_word(s, n) :- starts_word(s, n).
ends_word(s, n) :- pair(s, n, two), match("[a-z0-9][_.$]", two).
part(s, substr(s, 0, n)) :- ends_word(s, n), n >= {part_lengths[0]}, n <= {part_lengths[1]}.
part(s, substr(s, n, k)) :- starts_word(s, n), k = strlen(s) - n, k >= {part_lengths[0]}, k <= {part_lengths[1]}.
Matches(s, m, "whole") :- text(s), member(m, s).
Matches(s, m, "part") :- part(s, p), member(m, p).
"""

#: calls to make, to remove, and to put in line
DIRECTIVES = """
.decl method(m: symbol)
.decl application(m: symbol)
.decl reachable(m: symbol)
.decl call(i: symbol, m: symbol)
.decl call_in(i: symbol, m: symbol)
.decl keep(m: symbol)
.decl Remove(m: symbol)
.decl Inline(i: symbol, m: symbol)
.decl Seed(m: symbol)
Remove(m) :- method(m), !reachable(m), !keep(m).
Inline(i, m) :- call(i, m), reachable(m), n = count : { call(i, _) }, n = 1, k = count : { call(_, m) }, k = 1, !keep(m).
Seed(m) :- application(m), reachable(m), !call(_, m).
Seed(m) :- keep(m), reachable(m).
"""

#: variables that hold the same object wherever both are set: chains of single assignments
MUST_ALIAS = """
.decl move(to: symbol, from: symbol)
.decl defined(v: symbol, i: symbol)
.decl single(v: symbol)
.decl origin(v: symbol, o: symbol)
.decl MustAlias(a: symbol, b: symbol)
single(v) :- defined(v, _), n = count : { defined(v, _) }, n = 1.
origin(v, v) :- single(v), !move(v, _).
origin(to, o) :- move(to, from), single(to), origin(from, o).
MustAlias(a, b) :- origin(a, o), origin(b, o), a != b.
"""

#: what a block's execution depends on: it follows a branch, and not on all ways to the end
CONTROL_DEPENDENCE = """
.decl edge(a: number, b: number)
.decl exit(b: number)
.decl node(b: number)
.decl avoids(a: number, b: number)
.decl ends(b: number)
.decl PostDominates(a: number, b: number)
.decl ControlDependent(b: number, on: number)
node(a), node(b) :- edge(a, b).
ends(b) :- exit(b).
ends(a) :- ends(b), edge(a, b).
avoids(a, e) :- node(a), exit(e), a != e.
avoids(a, b) :- avoids(a, c), edge(b, c), a != b.
PostDominates(a, b) :- ends(a), ends(b), !avoids(a, b).
ControlDependent(b, a) :- edge(a, s), PostDominates(b, s), !PostDominates(b, a).
ControlDependent(a, a) :- edge(a, s), PostDominates(a, s), n = count : { edge(a, _) }, n > 1.
"""

#: a stand-in for each abstract type: the least concrete subtype, or all
MOCKS = """
.decl wanted(t: symbol)
.decl concrete_type(t: symbol)
.decl subtype(t: symbol, s: symbol)
.decl field_of(t: symbol, ft: symbol)
.decl Mocked(t: symbol)
.decl least(s: symbol, t: symbol)
.decl Stand(s: symbol, t: symbol)
least(s, t) :- subtype(_, s), t = min ord(x) : { subtype(x, s), concrete_type(x) }.
Stand(s, s) :- Mocked(s), concrete_type(s).
Stand(s, t) :- Mocked(s), !concrete_type(s), least(s, t).
Mocked(t) :- wanted(t).
Mocked(ft) :- Stand(_, t), field_of(t, ft).
"""

#: whole values of variables by the kind of value
VALUE_KINDS = """
.decl value_of(v: symbol, o: symbol)
.decl text_constant(o: symbol)
.decl heap(o: symbol, t: symbol)
.decl Kind(o: symbol, k: symbol)
.decl KindCount(k: symbol, n: number)
Kind(o, "null") :- value_of(_, o), contains("null pseudo", o).
Kind(o, "string constant") :- value_of(_, o), text_constant(o).
Kind(o, "string buffer") :- value_of(_, o), heap(o, t), match("java[.]lang[.]StringBu(ffer|ilder)", t).
Kind(o, "class") :- value_of(_, o), substr(o, 0, 7) = "<class ".
Kind(o, "mock") :- value_of(_, o), contains("::mock", o).
Kind(o, "object") :- value_of(_, o), !text_constant(o), heap(o, t), !match("java[.]lang[.]StringBu(ffer|ilder)", t), !contains("null pseudo", o), substr(o, 0, 7) != "<class ", !contains("::mock", o).
KindCount(k, n) :- Kind(_, k), n = count : { value_of(_, o), Kind(o, k) }.
"""

#: methods that a test runner would call
TESTS = """
.decl method(m: symbol, name: symbol, desc: symbol, t: symbol)
.decl annotated(m: symbol, a: symbol)
.decl above(t: symbol, s: symbol)
.decl public(m: symbol)
.decl TestMethod(m: symbol)
.decl TestClass(t: symbol)
TestMethod(m) :- annotated(m, a), match("(org[.]junit|org[.]testng).*[.](Test|Before|After|BeforeEach|AfterEach|BeforeClass|AfterClass|ParameterizedTest)", a).
TestMethod(m) :- method(m, name, "void()", t), match("test.*", name), public(m), above(t, "junit.framework.TestCase").
TestClass(t) :- TestMethod(m), method(m, _, _, t).
"""

#: lengths, products and reshapes of lists of whole numbers; -1 stands for what is left
SHAPES = """
.decl item(l: symbol, i: number, n: number)
.decl reshape(op: symbol, from: symbol, to: symbol)
.decl Length(l: symbol, n: number)
.decl upto(l: symbol, i: number, p: number)
.decl Product(l: symbol, p: number)
.decl open_at(l: symbol, i: number)
.decl Reshaped(op: symbol, i: number, n: number)
.decl ShapeError(op: symbol)
Length(l, n + 1) :- item(l, _, _), n = max i : { item(l, i, _) }.
open_at(l, i) :- item(l, i, -1).
upto(l, 0, n) :- item(l, 0, n), n != -1.
upto(l, 0, 1) :- item(l, 0, -1).
upto(l, i + 1, p * n) :- upto(l, i, p), item(l, i + 1, n), n != -1.
upto(l, i + 1, p) :- upto(l, i, p), item(l, i + 1, -1).
Product(l, p) :- Length(l, n), upto(l, n - 1, p).
Reshaped(o, i, n) :- reshape(o, a, b), Product(a, p), Product(b, p), !open_at(b, _), item(b, i, n).
Reshaped(o, i, n) :- reshape(o, a, b), Product(a, p), Product(b, q), open_at(b, _), q > 0, p % q = 0, item(b, i, n), n != -1.
Reshaped(o, i, p / q) :- reshape(o, a, b), Product(a, p), Product(b, q), q > 0, p % q = 0, open_at(b, i).
ShapeError(o) :- reshape(o, a, b), Product(a, p), Product(b, q), !open_at(b, _), p != q.
ShapeError(o) :- reshape(o, a, b), Product(a, p), Product(b, q), open_at(b, _), q > 0, p % q != 0.
ShapeError(o) :- reshape(o, _, b), n = count : { open_at(b, _) }, n > 1.
"""

#: natural loops: of an edge to a node that dominates its source, all nodes with a path to the source that avoids the
#: header; and variables that change by a constant in one
LOOPS = """
.decl dominates(a: number, b: number)
.decl edge(a: number, b: number)
.decl adds(v: symbol, block: number, by: number)
.decl assigns(v: symbol, block: number)
.decl latch(header: number, source: number)
.decl avoiding(header: number, a: number, b: number)
.decl Loop(head: number, b: number)
.decl Induction(v: symbol, head: number, by: number)
latch(h, s) :- dominates(h, s), edge(s, h).
avoiding(h, s, s) :- latch(h, s), s != h.
avoiding(h, a, s) :- avoiding(h, b, s), edge(a, b), a != h.
Loop(h, h) :- latch(h, _).
Loop(h, a) :- latch(h, s), avoiding(h, a, s).
Induction(v, h, n) :- adds(v, b, n), Loop(h, b), k = count : { assigns(v, c), Loop(h, c) }, k = 1.
"""

#: candidates for an injection point: by qualifier, else the only one, else the primary one, else by name. What is asked of a
#: point's candidates is told from their types, so that Injected needs no product of points and beans
INJECTION = """
.decl point(p: symbol, t: symbol, name: symbol)
.decl bean(b: symbol, t: symbol, name: symbol)
.decl subtype(t: symbol, s: symbol)
.decl qualifier(p: symbol, q: symbol)
.decl primary(b: symbol)
.decl candidate(p: symbol, b: symbol)
.decl by_qualifier(p: symbol, b: symbol)
.decl only(p: symbol, b: symbol)
.decl by_primary(p: symbol, b: symbol)
.decl Injected(p: symbol, b: symbol)
.decl offer(t: symbol, b: symbol)
.decl named(b: symbol, t: symbol, name: symbol)
.decl sole(t: symbol, b: symbol)
.decl crowded(t: symbol)
.decl several(p: symbol)
.decl main(t: symbol, b: symbol)
.decl has_main(t: symbol)
.decl open(p: symbol)
.decl settled(p: symbol)
.decl unsettled(p: symbol)
candidate(p, b) :- point(p, t, _), subtype(s, t), bean(b, s, _).
offer(t, b) :- subtype(s, t), bean(b, s, _).
named(b, s, q) :- bean(b, s, _), bean(b, _, q).
sole(t, b) :- offer(t, b), n = count : { offer(t, _) }, n = 1.
crowded(t) :- offer(t, _), n = count : { offer(t, _) }, n > 1.
several(p) :- point(p, t, _), crowded(t).
several(p) :- point(p, t, _), sole(t, b), point(p, u, _), sole(u, c), b != c.
main(t, b) :- offer(t, b), primary(b).
has_main(t) :- main(t, _).
only(p, b) :- point(p, t, _), sole(t, b), !qualifier(p, _), !several(p).
open(p) :- point(p, _, _), !qualifier(p, _), !only(p, _).
by_qualifier(p, b) :- qualifier(p, q), point(p, t, _), subtype(s, t), named(b, s, q).
by_primary(p, b) :- open(p), point(p, t, _), main(t, b).
unsettled(p) :- open(p), !settled(p).
settled(p) :- open(p), point(p, t, _), has_main(t).
Injected(p, b) :- qualifier(p, q), point(p, t, _), subtype(s, t), named(b, s, q).
Injected(p, b) :- only(p, b).
Injected(p, b) :- open(p), point(p, t, _), main(t, b).
Injected(p, b) :- unsettled(p), point(p, t, _), point(p, _, name), subtype(s, t), named(b, s, name).
"""


def run(spark: SparkSession, rules: str, facts: dict[str, DataFrame], *wanted: str) -> Result:
    return Engine(spark, rules, facts).run(*wanted)
