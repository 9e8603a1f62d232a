"""Program analyses as rule programs over normalised facts.

``normalise`` brings fact files to a small instruction set (alloc, move, cast, load, store, ...) by plain
projections; the rule texts below work on that. Points-to is one generic program whose contexts a
``ContextPolicy`` describes: kind (call site, receiver object, receiver's type or none), depth, heap depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewright.plans.engine import Engine, Result
from tuplewright.sources import facts as S

NO_CONTEXT = "<<immutable-context>>"
NO_HEAP_CONTEXT = "<<immutable-hcontext>>"
ROOT = "java.lang.Object"

#: name: columns of the normalised facts
NORMAL = {
    "is_class": "t",
    "is_interface": "t",
    "is_array": "t",
    "element": "a t",
    "extends": "t up",
    "implements": "t up",
    "app_type": "t",
    "method": "m name desc t",
    "modifier": "m mod",
    "field": "f t ft",
    "static_field": "f",
    "local": "v m",
    "local_type": "v t",
    "this": "m v",
    "formal": "m i:number v",
    "actual": "inv i:number v",
    "result": "m v",
    "assigned": "inv v",
    "heap": "h t",
    "alloc": "v h m",
    "move": "to from",
    "cast": "ins to from t m",
    "load": "to base f m",
    "store": "base f from m",
    "load_static": "to f m",
    "store_static": "f from m",
    "load_array": "to base m",
    "store_array": "base from m",
    "virtual_call": "inv base m sig",
    "direct_call": "inv base m sig",
    "static_call": "inv m sig",
    "raise": "ins i:number v m",
    "handler": "x m t begin:number end:number v",
    "call_at": "inv i:number m",
    "main_class": "t",
    "entry": "m",
}

DECLS = "\n".join(f".decl {n}({', '.join(c if ':' in c else c + ':symbol' for c in cs.split())})" for n, cs in NORMAL.items()) + "\n"

#: fixed values: what each primitive converts to in one step
WIDENS = (("byte", "short"), ("byte", "int"), ("short", "int"), ("char", "int"), ("int", "long"), ("long", "float"), ("float", "double"))

HIERARCHY = f"""
.decl type(t: symbol)
.decl primitive(t: symbol)
.decl up(t: symbol, s: symbol)
.decl above(t: symbol, s: symbol)
.decl Subclass(up: symbol, t: symbol)
.decl Superinterface(s: symbol, t: symbol)
.decl SubtypeOf(t: symbol, s: symbol)
.decl SubtypeOfDifferent(t: symbol, s: symbol)
type(t) :- is_class(t); is_interface(t); is_array(t); primitive(t).
{" ".join(f'primitive("{p}").' for p in ("boolean", "byte", "char", "short", "int", "long", "float", "double"))}
up(t, s) :- extends(t, s); implements(t, s).
above(t, s) :- up(t, s).
above(t, s) :- above(t, r), up(r, s).
Subclass(s, t) :- above(t, s), is_class(s), is_class(t).
Superinterface(s, t) :- above(t, s), is_interface(s).
SubtypeOf(t, t) :- type(t).
SubtypeOf(t, s) :- above(t, s).
SubtypeOf(t, "{ROOT}") :- is_interface(t); is_array(t); is_class(t).
SubtypeOf(t, s) :- is_array(t), (s = "java.lang.Cloneable"; s = "java.io.Serializable"), is_interface(s).
SubtypeOf(a, b) :- element(a, t), element(b, s), SubtypeOf(t, s), !primitive(t), !primitive(s).
SubtypeOf("null_type", t) :- is_class(t); is_interface(t); is_array(t).
{" ".join(f'SubtypeOf("{a}", "{b}").' for a, b in WIDENS)}
SubtypeOfDifferent(t, s) :- SubtypeOf(t, s), t != s.
"""

LOOKUP = f"""
.decl concrete(m: symbol, name: symbol, desc: symbol, t: symbol)
.decl found(name: symbol, desc: symbol, t: symbol, m: symbol, n: number)
.decl own(name: symbol, desc: symbol, t: symbol)
.decl of_class(name: symbol, desc: symbol, t: symbol, m: symbol)
.decl of_interface(name: symbol, desc: symbol, t: symbol, m: symbol, owner: symbol)
.decl hidden(name: symbol, desc: symbol, t: symbol, owner: symbol)
.decl MethodLookup(name: symbol, desc: symbol, t: symbol, m: symbol)
.decl MethodOverrides(m: symbol, other: symbol)
.decl CHA(inv: symbol, m: symbol)
concrete(m, name, desc, t) :- method(m, name, desc, t), !modifier(m, "abstract").
own(name, desc, t) :- concrete(_, name, desc, t).
of_class(name, desc, t, m) :- concrete(m, name, desc, t), !modifier(m, "static").
of_class(name, desc, t, m) :- extends(t, s), of_class(name, desc, s, m), !own(name, desc, t).
of_interface(name, desc, t, m, s) :- concrete(m, name, desc, s), is_interface(s), above(t, s).
hidden(name, desc, t, s) :- of_interface(name, desc, t, _, s), of_interface(name, desc, t, _, r), above(r, s).
found(name, desc, t, m, 0) :- of_class(name, desc, t, m).
found(name, desc, t, m, 1) :- of_interface(name, desc, t, m, s), !hidden(name, desc, t, s), !of_class(name, desc, t, _).
MethodLookup(name, desc, t, m) :- found(name, desc, t, m, _).
MethodLookup(name, desc, a, m) :- is_array(a), found(name, desc, "{ROOT}", m, _).
MethodOverrides(m, o) :- concrete(m, name, desc, t), above(t, s), method(o, name, desc, s).
CHA(inv, m) :- virtual_call(inv, _, _, sig), method(sig, name, desc, t), SubtypeOf(s, t), MethodLookup(name, desc, s, m).
CHA(inv, sig) :- direct_call(inv, _, _, sig); static_call(inv, _, sig).
"""


@dataclass(frozen=True)
class ContextPolicy:
    """How contexts are made: the callee's from the call, and the heap's from the allocating method's.

    kind "call": the call site joins the caller's last depth-1 elements; "object" and "type": the receiver
    (or the type that allocated it) joins the last depth-1 elements of its heap context; static calls keep
    the caller's context but for kind "call". "none": one context for all. selective: contexts only for
    methods that return what they are given, one element deep, and none elsewhere.
    """

    kind: str = "none"
    depth: int = 0
    heap: int = 0
    selective: bool = False

    def context(self, prefix: str) -> list[str]:
        return [f"{prefix}{i}" for i in range(1, self.depth + 1)]

    def record(self, elements: list[str]) -> str:
        return f"[{', '.join(elements)}]" if elements else f'"{NO_CONTEXT}"'


def policy(name: str) -> ContextPolicy:
    """The policy of an analysis's name, such as 2-object-sensitive+heap or context-insensitive."""
    special = {
        "context-insensitive": ContextPolicy(),
        "micro": ContextPolicy(),
        "types-only": ContextPolicy(),
        "basic-only": ContextPolicy(),
        "context-insensitive-plus": ContextPolicy("call", 1, 0, True),
        "context-insensitive-plusplus": ContextPolicy("object", 1, 0, True),
    }
    if name in special:
        return special[name]
    head, _, heap = name.partition("+")
    depth, _, kind = head.partition("-")
    kinds = {"call-site-sensitive": "call", "object-sensitive": "object", "type-sensitive": "type"}
    if kind not in kinds or not depth.isdigit():
        raise ValueError(f"unknown analysis {name}")
    return ContextPolicy(kinds[kind], int(depth), {"": 0, "heap": 1}.get(heap) if heap in ("", "heap") else int(heap.split("-")[0]))


#: the analyses with contexts that users name
ANALYSES = (
    "context-insensitive",
    "context-insensitive-plus",
    "context-insensitive-plusplus",
    "1-call-site-sensitive",
    "1-call-site-sensitive+heap",
    "2-call-site-sensitive+heap",
    "2-call-site-sensitive+2-heap",
    "1-object-sensitive",
    "1-object-sensitive+heap",
    "2-object-sensitive+heap",
    "2-object-sensitive+2-heap",
    "3-object-sensitive+2-heap",
    "3-object-sensitive+3-heap",
    "4-object-sensitive+4-heap",
    "1-type-sensitive",
    "1-type-sensitive+heap",
    "2-type-sensitive+heap",
    "3-type-sensitive+2-heap",
    "3-type-sensitive+3-heap",
    "types-only",
    "basic-only",
    "micro",
)


def _last(items: list[str], n: int, fill: str) -> list[str]:
    return ([f'"{fill}"'] * n + items)[len(items) :] if len(items) < n else items[len(items) - n :]


def points_to(p: ContextPolicy, filtered: bool = True, exceptions: bool = True) -> str:
    """The points-to program of a policy. filtered: values pass to a parameter or result only if its type admits them."""
    c, h = p.context("?c"), [f"?h{i}" for i in range(1, p.heap + 1)]
    ctx = "[" + ", ".join(f"e{i}: symbol" for i in range(1, p.depth + 1)) + "]" if c else None
    hctx = "[" + ", ".join(f"e{i}: symbol" for i in range(1, p.heap + 1)) + "]" if h else None
    types = (f".type Ctx = {ctx}\n" if ctx else ".type Ctx = symbol\n") + (f".type HCtx = {hctx}\n" if hctx else ".type HCtx = symbol\n")
    heap_record = f"[{', '.join(h)}]" if h else f'"{NO_HEAP_CONTEXT}"'
    first = p.record([f'"{NO_CONTEXT}"'] * p.depth)
    caller = p.record(c)
    alloc_heap = f"[{', '.join(_last(c, p.heap, NO_HEAP_CONTEXT))}]" if h else heap_record
    if p.kind == "call":
        of_receiver = of_site = p.record(_last([*c, "?inv"], p.depth, NO_CONTEXT))
    elif p.kind in ("object", "type"):
        of_receiver = p.record(_last([*h, "?x" if p.kind == "object" else "?xt"], p.depth, NO_CONTEXT))
        of_site = caller
    else:
        of_receiver = of_site = caller
    owner = ", allocated_in(?x, ?xt)" if p.kind == "type" else ""
    admits = lambda var: f", local_type({var}, ?pt), heap(?o, ?ot), SubtypeOf(?ot, ?pt)" if filtered else ""
    if p.selective:
        # the element of a selective context: the site, or for plusplus the receiver; methods without flow keep one context
        element = "?inv" if p.kind == "call" else "?x"
        call_contexts = f"""
CallGraphEdge(?inv, {caller}, ?m, [{element}]) :- target(?inv, {caller}, ?m, ?x, _), passes_through(?m), ?x != "".
CallGraphEdge(?inv, {caller}, ?m, [?inv]) :- target(?inv, {caller}, ?m, "", _), passes_through(?m).
CallGraphEdge(?inv, {caller}, ?m, {first}) :- target(?inv, {caller}, ?m, _, _), !passes_through(?m)."""
    else:
        call_contexts = f"""
CallGraphEdge(?inv, {caller}, ?m, {of_receiver}) :- target(?inv, {caller}, ?m, ?x, {heap_record}), ?x != ""{owner}.
CallGraphEdge(?inv, {caller}, ?m, {of_site}) :- target(?inv, {caller}, ?m, "", _)."""
    text = (
        types
        + f"""
.decl VarPointsTo(hctx: HCtx, value: symbol, ctx: Ctx, var: symbol)
.decl InstanceFieldPointsTo(hctx: HCtx, value: symbol, field: symbol, base_hctx: HCtx, base: symbol)
.decl StaticFieldPointsTo(hctx: HCtx, value: symbol, field: symbol)
.decl ArrayIndexPointsTo(base_hctx: HCtx, base: symbol, hctx: HCtx, value: symbol)
.decl CallGraphEdge(inv: symbol, ctx: Ctx, method: symbol, callee_ctx: Ctx)
.decl ReachableContext(ctx: Ctx, method: symbol)
.decl Reachable(method: symbol)
.decl InitializedClass(t: symbol)
.decl target(inv: symbol, ctx: Ctx, method: symbol, receiver: symbol, hctx: HCtx)
.decl allocated_in(h: symbol, t: symbol)
.decl in_method(v: symbol, m: symbol)
.decl passes_through(m: symbol)
.decl flows_from(v: symbol, m: symbol)
.decl initializer(t: symbol, m: symbol)
allocated_in(h, t) :- alloc(_, h, m), method(m, _, _, t).
flows_from(v, m) :- formal(m, _, v); this(m, v).
flows_from(to, m) :- move(to, from), flows_from(from, m).
flows_from(to, m) :- cast(_, to, from, _, _), flows_from(from, m).
passes_through(m) :- result(m, v), flows_from(v, m).
initializer(t, m) :- method(m, "<clinit>", _, t).

ReachableContext({first}, m) :- entry(m).
ReachableContext({first}, m) :- main_class(t), method(m, "main", _, t).
ReachableContext(c, m) :- CallGraphEdge(_, _, m, c).
ReachableContext({first}, m) :- InitializedClass(t), initializer(t, m).
Reachable(m) :- ReachableContext(_, m).
InitializedClass(t) :- main_class(t).
InitializedClass(s) :- InitializedClass(t), extends(t, s).
InitializedClass(t) :- Reachable(m), static_call(_, m, sig), method(sig, _, _, t).
InitializedClass(t) :- Reachable(m), (load_static(_, f, m); store_static(f, _, m)), field(f, t, _).
InitializedClass(t) :- Reachable(m), alloc(_, h, m), heap(h, t), is_class(t).

VarPointsTo({alloc_heap}, o, {caller}, v) :- ReachableContext({caller}, m), alloc(v, o, m).
VarPointsTo(hc, o, c, to) :- move(to, from), VarPointsTo(hc, o, c, from).
VarPointsTo(hc, o, c, to) :- cast(_, to, from, t, _), VarPointsTo(hc, o, c, from), heap(o, ot), SubtypeOf(ot, t).
InstanceFieldPointsTo(hc, o, f, bc, b) :- store(base, f, from, _), VarPointsTo(hc, o, c, from), VarPointsTo(bc, b, c, base).
VarPointsTo(hc, o, c, to) :- load(to, base, f, _), VarPointsTo(bc, b, c, base), InstanceFieldPointsTo(hc, o, f, bc, b).
StaticFieldPointsTo(hc, o, f) :- store_static(f, from, _), VarPointsTo(hc, o, _, from).
VarPointsTo(hc, o, c, to) :- load_static(to, f, m), ReachableContext(c, m), StaticFieldPointsTo(hc, o, f).
ArrayIndexPointsTo(bc, b, hc, o) :- store_array(base, from, _), VarPointsTo(bc, b, c, base), VarPointsTo(hc, o, c, from), heap(b, bt), element(bt, et), heap(o, ot), SubtypeOf(ot, et).
VarPointsTo(hc, o, c, to) :- load_array(to, base, _), VarPointsTo(bc, b, c, base), ArrayIndexPointsTo(bc, b, hc, o).

target(?inv, ?ctx, ?m, ?x, ?hc) :- virtual_call(?inv, ?base, _, ?sig), VarPointsTo(?hc, ?x, ?ctx, ?base), heap(?x, ?t), method(?sig, ?name, ?desc, _), MethodLookup(?name, ?desc, ?t, ?m).
target(?inv, ?ctx, ?m, ?x, ?hc) :- direct_call(?inv, ?base, _, ?m), VarPointsTo(?hc, ?x, ?ctx, ?base).
target(?inv, ?ctx, ?m, "", {f'[{", ".join([chr(34) + NO_HEAP_CONTEXT + chr(34)] * p.heap)}]' if h else heap_record}) :- static_call(?inv, ?from, ?m), ReachableContext(?ctx, ?from).
{call_contexts}
.decl this_binding(inv: symbol, ctx: Ctx, m: symbol, cc: Ctx, x: symbol, hc: HCtx)
"""
    )
    if p.kind == "call" and not p.selective or p.kind == "none":
        text += "VarPointsTo(hc, x, cc, v) :- target(inv, c, m, x, hc), CallGraphEdge(inv, c, m, cc), this(m, v), x != \"\".\n"
    elif p.selective:
        element = "?inv" if p.kind == "call" else "?x"
        text += f"""VarPointsTo(?hc, ?x, [{element}], ?v) :- target(?inv, ?c, ?m, ?x, ?hc), passes_through(?m), this(?m, ?v), ?x != "".
VarPointsTo(?hc, ?x, {first}, ?v) :- target(_, _, ?m, ?x, ?hc), !passes_through(?m), this(?m, ?v), ?x != "".
"""
    else:
        text += f"VarPointsTo({heap_record}, ?x, {of_receiver}, ?v) :- target(_, _, ?m, ?x, {heap_record}), this(?m, ?v), ?x != \"\"{owner}.\n"
    text += f"""
VarPointsTo(?hc, ?o, ?cc, ?p) :- CallGraphEdge(?inv, ?c, ?m, ?cc), actual(?inv, ?i, ?a), formal(?m, ?i, ?p), VarPointsTo(?hc, ?o, ?c, ?a){admits("?p")}.
VarPointsTo(?hc, ?o, ?c, ?r) :- CallGraphEdge(?inv, ?c, ?m, ?cc), result(?m, ?v), assigned(?inv, ?r), VarPointsTo(?hc, ?o, ?cc, ?v){admits("?r")}.
"""
    if exceptions:
        text += """
.decl catches(m: symbol, i: number, t: symbol, v: symbol)
.decl thrown_at(m: symbol, i: number, ctx: Ctx, value: symbol, hctx: HCtx)
.decl ThrowPointsTo(hctx: HCtx, value: symbol, ctx: Ctx, method: symbol)
.decl handled(m: symbol, i: number, value: symbol)
.decl position(m: symbol, i: number)
position(m, i) :- raise(_, i, _, m); call_at(_, i, m).
catches(m, i, t, v) :- handler(_, m, t, begin, end, v), position(m, i), begin <= i, i < end.
handled(m, i, o) :- catches(m, i, t, _), heap(o, ot), SubtypeOf(ot, t).
thrown_at(m, i, c, o, hc) :- raise(_, i, v, m), VarPointsTo(hc, o, c, v).
thrown_at(m, i, c, o, hc) :- call_at(inv, i, m), CallGraphEdge(inv, c, callee, cc), ThrowPointsTo(hc, o, cc, callee).
VarPointsTo(hc, o, c, v) :- thrown_at(m, i, c, o, hc), catches(m, i, t, v), heap(o, ot), SubtypeOf(ot, t).
ThrowPointsTo(hc, o, c, m) :- thrown_at(m, i, c, o, hc), !handled(m, i, o).
"""
    return text


CLIENTS = """
.decl call_target(inv: symbol, m: symbol)
.decl value_of(v: symbol, o: symbol)
.decl AnyCallGraphEdge(inv: symbol, m: symbol)
.decl MethodCalls(m: symbol, n: symbol)
.decl MethodCallsClosure(m: symbol, n: symbol)
.decl PolymorphicCallSite(inv: symbol)
.decl MayFailCast(ins: symbol)
.decl EmptyCallSite(inv: symbol)
.decl ReachableCast(ins: symbol)
.decl NeverPointsTo(v: symbol)
.decl UnreachableMethod(m: symbol)
.decl Metric(name: symbol, n: number)
.decl Insane(id: symbol, n: number)
.decl call_site(inv: symbol, m: symbol)
call_target(i, m) :- CallGraphEdge(i, _, m, _).
value_of(v, o) :- VarPointsTo(_, o, _, v).
AnyCallGraphEdge(i, m) :- call_target(i, m).
call_site(i, m) :- virtual_call(i, _, m, _); direct_call(i, _, m, _); static_call(i, m, _).
MethodCalls(m, n) :- call_site(i, m), call_target(i, n).
MethodCallsClosure(m, n) :- MethodCalls(m, n).
MethodCallsClosure(m, k) :- MethodCallsClosure(m, n), MethodCalls(n, k).
PolymorphicCallSite(i) :- virtual_call(i, _, _, _), n = count : { call_target(i, _) }, n > 1.
ReachableCast(i) :- cast(i, _, _, _, m), Reachable(m).
MayFailCast(i) :- ReachableCast(i), cast(i, _, v, t, _), value_of(v, o), heap(o, ot), !SubtypeOf(ot, t).
EmptyCallSite(i) :- virtual_call(i, b, m, _), Reachable(m), !value_of(b, _).
NeverPointsTo(v) :- local(v, m), Reachable(m), !value_of(v, _).
UnreachableMethod(m) :- concrete(m, _, _, _), !Reachable(m).
Metric("var points-to (ins)", n) :- n = count : { value_of(_, _) }.
Metric("var points-to (sens)", n) :- n = count : { VarPointsTo(_, _, _, _) }.
Metric("instance field points-to (sens)", n) :- n = count : { InstanceFieldPointsTo(_, _, _, _, _) }.
Metric("static field points-to", n) :- n = count : { StaticFieldPointsTo(_, _, _) }.
Metric("array index points-to", n) :- n = count : { ArrayIndexPointsTo(_, _, _, _) }.
Metric("call graph edges (ins)", n) :- n = count : { call_target(_, _) }.
Metric("call graph edges (sens)", n) :- n = count : { CallGraphEdge(_, _, _, _) }.
Metric("reachable methods (ins)", n) :- n = count : { Reachable(_) }.
Metric("reachable methods (sens)", n) :- n = count : { ReachableContext(_, _) }.
Metric("polymorphic virtual call sites", n) :- n = count : { PolymorphicCallSite(_) }.
Metric("reachable casts", n) :- n = count : { ReachableCast(_) }.
Metric("reachable casts that may fail", n) :- n = count : { MayFailCast(_) }.
Metric("virtual call sites without target", n) :- n = count : { EmptyCallSite(_) }.
Metric("reachable variables that are never assigned an object", n) :- n = count : { NeverPointsTo(_) }.
Metric("unreachable concrete methods", n) :- n = count : { UnreachableMethod(_) }.
Metric("initialized classes", n) :- n = count : { InitializedClass(_) }.
Insane("variable without type", n) :- n = count : { local(v, _), !local_type(v, _) }.
Insane("value without type", n) :- n = count : { value_of(_, o), !heap(o, _) }.
Insane("type neither class, interface, array nor primitive", n) :- n = count : { heap(_, t), !type(t) }.
Insane("edge to an unreachable method", n) :- n = count : { call_target(_, m), !Reachable(m) }.
Insane("value in a variable of an unreachable method", n) :- n = count : { value_of(v, _), local(v, m), !Reachable(m) }.
Insane("method of an unknown type", n) :- n = count : { method(_, _, _, t), !type(t) }.
Insane("class with two superclasses", n) :- n = count : { extends(t, a), extends(t, b), a != b }.
Insane("call site in two methods", n) :- n = count : { call_site(i, a), call_site(i, b), a != b }.
Insane("array without element type", n) :- n = count : { is_array(t), !element(t, _) }.
"""

TAINT = """
.decl source_method(m: symbol)
.decl sink_method(m: symbol)
.decl sanitizer_method(m: symbol)
.decl transfer_method(m: symbol, how: symbol)
.decl ResolvedCall(inv: symbol, m: symbol)
.decl Tainted(v: symbol, source: symbol)
.decl TaintedField(f: symbol, source: symbol)
.decl TaintedElement(base: symbol, source: symbol)
.decl LeakingTaintedInformation(source: symbol, sink: symbol, inv: symbol)
ResolvedCall(i, m) :- CHA(i, m).
Tainted(v, i) :- ResolvedCall(i, m), source_method(m), assigned(i, v).
Tainted(to, s) :- move(to, from), Tainted(from, s).
Tainted(to, s) :- cast(_, to, from, _, _), Tainted(from, s).
TaintedField(f, s) :- store(_, f, from, _), Tainted(from, s).
TaintedField(f, s) :- store_static(f, from, _), Tainted(from, s).
Tainted(to, s) :- load(to, _, f, _), TaintedField(f, s).
Tainted(to, s) :- load_static(to, f, _), TaintedField(f, s).
TaintedElement(b, s) :- store_array(b, from, _), Tainted(from, s).
TaintedElement(b, s) :- TaintedElement(a, s), (move(b, a); move(a, b)).
Tainted(to, s) :- load_array(to, b, _), TaintedElement(b, s).
Tainted(p, s) :- ResolvedCall(i, m), !sanitizer_method(m), actual(i, k, a), formal(m, k, p), Tainted(a, s).
Tainted(r, s) :- ResolvedCall(i, m), !sanitizer_method(m), result(m, v), Tainted(v, s), assigned(i, r).
Tainted(r, s) :- ResolvedCall(i, m), transfer_method(m, "param-to-return"), actual(i, _, a), Tainted(a, s), assigned(i, r).
Tainted(r, s) :- ResolvedCall(i, m), transfer_method(m, "base-to-return"), (virtual_call(i, b, _, _); direct_call(i, b, _, _)), Tainted(b, s), assigned(i, r).
Tainted(b, s) :- ResolvedCall(i, m), transfer_method(m, "param-to-base"), (virtual_call(i, b, _, _); direct_call(i, b, _, _)), actual(i, _, a), Tainted(a, s).
LeakingTaintedInformation(s, m, i) :- ResolvedCall(i, m), sink_method(m), actual(i, _, a), Tainted(a, s).
"""

DATA_FLOW = """
.decl step(a: symbol, b: symbol)
.decl Flows(a: symbol, b: symbol)
.decl SelfFlows(v: symbol)
step(a, b) :- move(b, a); cast(_, b, a, _, _).
step(a, b) :- CHA(i, m), actual(i, k, a), formal(m, k, b).
step(a, b) :- CHA(i, m), result(m, a), assigned(i, b).
step(a, b) :- store(_, f, a, _), load(b, _, f, _).
step(a, b) :- store_static(f, a, _), load_static(b, f, _).
Flows(a, b) :- step(a, b).
Flows(a, c) :- Flows(a, b), step(b, c).
SelfFlows(v) :- Flows(v, v).
"""

CONTROL_FLOW = """
.decl instruction(m: symbol, i: number)
.decl jump(m: symbol, i: number, to: number)
.decl ends(m: symbol, i: number)
.decl next_at(m: symbol, i: number, j: number)
.decl Successor(m: symbol, i: number, j: number)
.decl leader(m: symbol, i: number)
.decl BlockOf(m: symbol, i: number, head: number)
.decl BlockSuccessor(m: symbol, a: number, b: number)
.decl entry_block(m: symbol, b: number)
.decl block(m: symbol, b: number)
.decl reaches(m: symbol, b: number)
.decl avoids(m: symbol, a: number, b: number)
.decl Dominates(m: symbol, a: number, b: number)
next_at(m, i, j) :- instruction(m, i), j = min k : { instruction(m, k), k > i }.
Successor(m, i, j) :- next_at(m, i, j), !ends(m, i).
Successor(m, i, j) :- jump(m, i, j), instruction(m, j).
leader(m, i) :- instruction(m, _), i = min k : { instruction(m, k) }.
leader(m, j) :- jump(m, _, j), instruction(m, j).
leader(m, j) :- jump(m, i, _), next_at(m, i, j).
leader(m, j) :- ends(m, i), next_at(m, i, j).
BlockOf(m, i, h) :- instruction(m, i), h = max k : { leader(m, k), k <= i }.
block(m, h) :- BlockOf(m, _, h).
entry_block(m, b) :- block(m, _), b = min k : { block(m, k) }.
BlockSuccessor(m, a, b) :- Successor(m, i, j), BlockOf(m, i, a), leader(m, j), BlockOf(m, j, b).
reaches(m, b) :- entry_block(m, b).
reaches(m, b) :- reaches(m, a), BlockSuccessor(m, a, b).
avoids(m, a, b) :- block(m, a), entry_block(m, b), a != b.
avoids(m, a, c) :- avoids(m, a, b), BlockSuccessor(m, b, c), a != c.
Dominates(m, a, b) :- reaches(m, a), reaches(m, b), !avoids(m, a, b).
"""

#: fixed value: how deep an expression is folded
FOLD_DEPTH = 5

#: a variable is constant if every value that its definitions give is one number
CONSTANTS = f"""
.decl const(v: symbol, n: number)
.decl copy(to: symbol, from: symbol)
.decl binary(to: symbol, op: symbol, a: symbol, b: symbol)
.decl Value(v: symbol, n: number, depth: number)
.decl spread(v: symbol, low: number, high: number)
.decl Folded(v: symbol, n: number)
Value(v, n, 0) :- const(v, n).
Value(to, n, d + 1) :- copy(to, from), Value(from, n, d), d < {FOLD_DEPTH}.
Value(to, @calculate(op, x, y), max(d, e) + 1) :- binary(to, op, a, b), Value(a, x, d), Value(b, y, e), max(d, e) < {FOLD_DEPTH}.
spread(v, l, h) :- Value(v, _, _), l = min n : {{ Value(v, n, _) }}, h = max n : {{ Value(v, n, _) }}.
Folded(v, n) :- spread(v, n, n).
"""

COMPONENTS = """
.decl refers(a: symbol, b: symbol)
.decl reach(a: symbol, b: symbol)
.decl node(a: symbol)
.decl same(a: symbol, b: symbol)
.decl SCC(a: symbol, rep: symbol)
.decl Condensed(a: symbol, b: symbol)
.decl SCCSize(rep: symbol, n: number)
node(a), node(b) :- refers(a, b).
reach(a, b) :- refers(a, b).
reach(a, c) :- reach(a, b), refers(b, c).
same(a, a) :- node(a).
same(a, b) :- reach(a, b), reach(b, a).
SCC(a, r) :- node(a), r = min ord(b) : { same(a, b) }.
Condensed(x, y) :- refers(a, b), SCC(a, x), SCC(b, y), x != y.
SCCSize(r, n) :- SCC(_, r), n = count : { SCC(a, r) }.
"""


def normalise(spark: SparkSession, given: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Normalised facts of the relations that ``facts.read_all`` gives. Missing relations count as empty."""

    def get(file: str) -> DataFrame:
        name = S.relation_name(file)
        return given[name] if name in given else S.empty(spark, file)

    def pick(file: str, **columns: str) -> DataFrame:
        return get(file).select(*(F.col(c).alias(n) for n, c in columns.items()))

    lit = F.lit
    out = {
        "is_class": pick("ClassType", t="class"),
        "is_interface": pick("InterfaceType", t="interface"),
        "is_array": pick("ArrayType", t="arrayType"),
        "element": pick("ComponentType", a="arrayType", t="componentType"),
        "extends": pick("DirectSuperclass", t="class", up="superclass"),
        "implements": pick("DirectSuperinterface", t="class", up="interface"),
        "app_type": pick("ApplicationClass", t="type"),
        "method": pick("Method", m="method", name="simplename", desc="descriptor", t="declaringType"),
        "modifier": pick("Method-Modifier", m="method", mod="mod"),
        "field": pick("Field", f="signature", t="declaringClass", ft="type"),
        "static_field": get("Field-Modifier").where("modifier = 'static'").select(F.col("field").alias("f")),
        "local": pick("Var-DeclaringMethod", v="var", m="method"),
        "local_type": pick("Var-Type", v="var", t="type"),
        "this": pick("ThisVar", m="method", v="var"),
        "formal": pick("FormalParam", m="method", i="index", v="var"),
        "actual": pick("ActualParam", inv="invocation", i="index", v="var"),
        "result": pick("Return", m="method", v="var"),
        "assigned": pick("AssignReturnValue", inv="invocation", v="to"),
        "heap": pick("NormalHeap", h="id", t="type").unionByName(get("StringConstant").select(F.col("id").alias("h"), lit("java.lang.String").alias("t"))),
        "alloc": pick("AssignHeapAllocation", v="to", h="heap", m="inmethod"),
        "move": pick("AssignLocal", to="to", **{"from": "from"}),
        "cast": pick("AssignCast", ins="instruction", to="to", t="type", m="inmethod", **{"from": "from"}).select("ins", "to", "from", "t", "m"),
        "load": pick("LoadInstanceField", to="to", base="base", f="signature", m="method"),
        "store": get("StoreInstanceField").select("base", F.col("signature").alias("f"), "from", F.col("method").alias("m")),
        "load_static": pick("LoadStaticField", to="to", f="signature", m="method"),
        "store_static": get("StoreStaticField").select(F.col("signature").alias("f"), "from", F.col("method").alias("m")),
        "load_array": pick("LoadArrayIndex", to="to", base="base", m="method"),
        "store_array": get("StoreArrayIndex").select("base", "from", F.col("method").alias("m")),
        "virtual_call": pick("VirtualMethodInvocation", inv="instruction", base="base", m="method", sig="signature"),
        "direct_call": pick("SpecialMethodInvocation", inv="instruction", base="base", m="method", sig="signature").unionByName(pick("SuperMethodInvocation", inv="instruction", base="base", m="method", sig="signature")),
        "static_call": pick("StaticMethodInvocation", inv="instruction", m="method", sig="signature"),
        "raise": pick("Throw", ins="instruction", i="index", v="var", m="method"),
        "handler": get("ExceptionHandler").join(get("ExceptionHandler-FormalParam"), "handler").select(F.col("handler").alias("x"), F.col("method").alias("m"), F.col("type").alias("t"), "begin", "end", F.col("var").alias("v")),
        "main_class": pick("MainClass", t="class"),
        "entry": pick("EntryPointMethod", m="meth"),
    }
    calls = [get(f).select(F.col("instruction").alias("inv"), F.col("index").alias("i"), F.col("method").alias("m")) for f in ("VirtualMethodInvocation", "SpecialMethodInvocation", "SuperMethodInvocation", "StaticMethodInvocation")]
    out["call_at"] = calls[0].unionByName(calls[1]).unionByName(calls[2]).unionByName(calls[3])
    return out


def analyse(spark: SparkSession, normal: dict[str, DataFrame], name: str, *wanted: str, extra: str = "", facts: dict[str, DataFrame] | None = None, **options) -> Result:
    """Runs the analysis of that name with the clients, and what extra rules a user adds."""
    text = DECLS + HIERARCHY + LOOKUP
    if name == "types-only":
        text += TYPES_ONLY
    elif name != "basic-only":
        text += points_to(policy(name), **({"filtered": False, "exceptions": False} if name == "micro" else {}) | options) + CLIENTS
    return Engine(spark, text + extra, normal | (facts or {})).run(*wanted)


#: the call graph by the types that reachable code allocates, without points-to
TYPES_ONLY = """
.decl Reachable(m: symbol)
.decl ReachableType(t: symbol)
.decl call_target(inv: symbol, m: symbol)
Reachable(m) :- entry(m).
Reachable(m) :- main_class(t), method(m, "main", _, t).
Reachable(m) :- call_target(_, m).
ReachableType(t) :- Reachable(m), alloc(_, h, m), heap(h, t).
call_target(i, m) :- Reachable(k), virtual_call(i, _, k, sig), method(sig, name, desc, t), ReachableType(s), SubtypeOf(s, t), MethodLookup(name, desc, s, m).
call_target(i, m) :- Reachable(k), (direct_call(i, _, k, m); static_call(i, k, m)).
"""


def run(spark: SparkSession, rules: str, facts: dict[str, DataFrame], *wanted: str) -> Result:
    """Other programs of this module (TAINT, DATA_FLOW need HIERARCHY and LOOKUP; the rest stand alone)."""
    base = DECLS + HIERARCHY + LOOKUP if rules in (TAINT, DATA_FLOW) else ""
    return Engine(spark, base + rules, facts, keyed=rules == CONTROL_FLOW).run(*wanted)
