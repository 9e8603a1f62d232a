"""Extensions of points-to, and programs over control flow and members.

Those that make values take the policy, so that their values have heap contexts of its form; their texts are added by
``analyse(..., extra=...)``. The ones that say so make objects out of what the fixpoint finds, and go with
``exceptions=False``: which handler takes an object must be known before what is thrown.
"""

from __future__ import annotations

from tuplewright.plans import analyses as A


def blank_heap(p: A.ContextPolicy) -> str:
    """The heap context of an object that no code allocates."""
    return f"[{', '.join([chr(34) + A.NO_HEAP_CONTEXT + chr(34)] * p.heap)}]" if p.heap else f'"{A.NO_HEAP_CONTEXT}"'


def blank_context(p: A.ContextPolicy) -> str:
    return p.record([f'"{A.NO_CONTEXT}"'] * p.depth)


def information_flow(p: A.ContextPolicy) -> str:
    """Taint as values: each call of a source gives an object of its own, which goes wherever points-to takes it, context by context.

    transfer: a method that hands taint on, between "argument", "base" and "result". sink: a method and a position.
    """
    h = blank_heap(p)
    return f"""
.decl source(m: symbol, t: symbol)
.decl sink(m: symbol, i: number)
.decl transfer(m: symbol, from: symbol, to: symbol)
.decl base_of(inv: symbol, v: symbol)
.decl taint_of(o: symbol, inv: symbol, m: symbol)
.decl Leak(source: symbol, inv: symbol, m: symbol)
.decl TaintedVariable(v: symbol, source: symbol)
base_of(i, b) :- virtual_call(i, b, _, _); direct_call(i, b, _, _).
taint_of(cat("<tainted at ", cat(i, ">")), i, m) :- CHA(i, m), source(m, _).
heap(o, t) :- taint_of(o, _, m), source(m, t).
VarPointsTo({h}, o, c, r) :- taint_of(o, i, m), CallGraphEdge(i, c, m, _), assigned(i, r).
VarPointsTo(hc, o, c, r) :- transfer(m, "argument", "result"), CallGraphEdge(i, c, m, _), actual(i, _, a), VarPointsTo(hc, o, c, a), taint_of(o, _, _), assigned(i, r).
VarPointsTo(hc, o, c, b) :- transfer(m, "argument", "base"), CallGraphEdge(i, c, m, _), actual(i, _, a), VarPointsTo(hc, o, c, a), taint_of(o, _, _), base_of(i, b).
VarPointsTo(hc, o, c, r) :- transfer(m, "base", "result"), CallGraphEdge(i, c, m, _), base_of(i, b), VarPointsTo(hc, o, c, b), taint_of(o, _, _), assigned(i, r).
Leak(s, i, m) :- sink(m, k), CallGraphEdge(i, c, m, _), actual(i, k, a), VarPointsTo(_, o, c, a), taint_of(o, s, _).
TaintedVariable(v, s) :- VarPointsTo(_, o, _, v), taint_of(o, s, _).
"""


def nulls(p: A.ContextPolicy) -> str:
    """null as a value: what is set to it, and calls whose receiver may be, or is nothing but, null."""
    return f"""
.decl assign_null(v: symbol, m: symbol)
.decl MayBeNull(inv: symbol)
.decl AlwaysNull(inv: symbol)
heap("<<null pseudo heap>>", "null_type").
VarPointsTo({blank_heap(p)}, "<<null pseudo heap>>", c, v) :- assign_null(v, m), ReachableContext(c, m).
MayBeNull(i) :- virtual_call(i, b, _, _), value_of(b, "<<null pseudo heap>>").
AlwaysNull(i) :- MayBeNull(i), virtual_call(i, b, _, _), n = count : {{ value_of(b, _) }}, n = 1.
"""


#: the class whose object stands for a type: itself, or the least class below it that isn't abstract
STAND_INS = """
.decl abstract_type(t: symbol)
.decl made(t: symbol)
.decl stand_in(s: symbol, t: symbol)
.decl mock(t: symbol, o: symbol)
.decl wanted(s: symbol)
made(t) :- is_class(t), !abstract_type(t).
stand_in(t, t) :- wanted(t), made(t).
stand_in(s, t) :- wanted(s), !made(s), SubtypeOfDifferent(_, s), t = min ord(x) : { SubtypeOfDifferent(x, s), made(x) }.
mock(t, cat("<mock of ", cat(t, ">"))) :- stand_in(_, t).
heap(o, t) :- mock(t, o).
"""


def mocked_results(p: A.ContextPolicy) -> str:
    """A call that no known body answers gives an object that stands for the result's type. Needs STAND_INS."""
    return f"""
.decl returns(m: symbol, t: symbol)
.decl opaque(inv: symbol, m: symbol, s: symbol)
opaque(i, k, s) :- virtual_call(i, _, k, sig), !CHA(i, _), returns(sig, s).
opaque(i, k, s) :- (static_call(i, k, sig); direct_call(i, _, k, sig)), modifier(sig, "native"), returns(sig, s).
wanted(s) :- opaque(_, _, s).
VarPointsTo({blank_heap(p)}, o, c, r) :- opaque(i, k, s), ReachableContext(c, k), assigned(i, r), stand_in(s, t), mock(t, o).
"""


def open_program(p: A.ContextPolicy) -> str:
    """A library: anyone may call what its application types make public, on and with objects that stand for the types. Needs STAND_INS."""
    h, c = blank_heap(p), blank_context(p)
    return f"""
entry(m) :- app_type(t), concrete(m, _, _, t), modifier(m, "public").
wanted(t) :- app_type(t), concrete(m, _, _, t), modifier(m, "public"), this(m, _).
wanted(s) :- app_type(t), concrete(m, _, _, t), modifier(m, "public"), formal(m, _, v), local_type(v, s).
VarPointsTo({h}, o, {c}, v) :- entry(m), app_type(s), method(m, _, _, s), this(m, v), stand_in(s, t), mock(t, o).
VarPointsTo({h}, o, {c}, v) :- entry(m), app_type(a), method(m, _, _, a), formal(m, _, v), local_type(v, s), stand_in(s, t), mock(t, o).
"""


#: fixed values: what a mobile platform calls on each kind of component
CALLBACKS = {
    "activity": ("onCreate", "onStart", "onResume", "onPause", "onStop", "onRestart", "onDestroy"),
    "service": ("onCreate", "onStartCommand", "onBind", "onUnbind", "onDestroy"),
    "receiver": ("onReceive",),
    "provider": ("onCreate", "query", "insert", "update", "delete", "getType"),
}


def mobile(p: A.ContextPolicy) -> str:
    """Components of a manifest are objects on which the platform calls; a layout names methods that take a view."""
    h, c = blank_heap(p), blank_context(p)
    named = " ".join(f'callback("{kind}", "{name}").' for kind, names in CALLBACKS.items() for name in names)
    return f"""
.decl component(kind: symbol, t: symbol)
.decl on_click(name: symbol)
.decl callback(kind: symbol, name: symbol)
.decl called_on(m: symbol, t: symbol)
.decl component_object(t: symbol, o: symbol)
{named}
called_on(m, t) :- component(k, t), callback(k, name), MethodLookup(name, _, t, m).
called_on(m, t) :- on_click(name), component("activity", t), MethodLookup(name, "void(android.view.View)", t, m).
component_object(t, cat("<component ", cat(t, ">"))) :- component(_, t).
heap(o, t) :- component_object(t, o).
entry(m) :- called_on(m, _).
VarPointsTo({h}, o, {c}, v) :- called_on(m, t), this(m, v), component_object(t, o).
"""


#: code that isn't there may call a method whose name and descriptor are both texts of one of its libraries
NATIVE_CALLBACKS = """
.decl native_name(lib: symbol, name: symbol)
.decl native_descriptor(lib: symbol, desc: symbol)
.decl NativeCallback(m: symbol, lib: symbol)
NativeCallback(m, l) :- native_name(l, name), method(m, name, desc, _), native_descriptor(l, desc).
entry(m) :- NativeCallback(m, _).
"""


def recorded(p: A.ContextPolicy) -> str:
    """What a run's log of reflective calls says: by the line where the site's line is known, else of any such site in the method."""
    return f"""
.decl log(what: symbol, target: symbol, caller: symbol, line: number)
.decl line_of(inv: symbol, line: number)
.decl log_site(inv: symbol, m: symbol, what: symbol)
.decl has_line(inv: symbol)
.decl RecordedCall(inv: symbol, m: symbol, target: symbol)
.decl RecordedInstance(inv: symbol, m: symbol, t: symbol, o: symbol)
.decl at(inv: symbol, m: symbol, what: symbol, target: symbol)
log_site(i, k, "Method.invoke") :- virtual_call(i, _, k, sig), method(sig, "invoke", _, "java.lang.reflect.Method").
log_site(i, k, "Class.newInstance") :- virtual_call(i, _, k, sig), method(sig, "newInstance", _, "java.lang.Class").
has_line(i) :- line_of(i, _).
at(i, k, what, x) :- log_site(i, k, what), log(what, x, k, n), line_of(i, n).
at(i, k, what, x) :- log_site(i, k, what), log(what, x, k, _), !has_line(i).
RecordedCall(i, k, x) :- at(i, k, "Method.invoke", x), method(x, _, _, _).
RecordedInstance(i, k, t, cat(i, cat("/recorded ", t))) :- at(i, k, "Class.newInstance", t).
heap(o, t) :- RecordedInstance(_, _, t, o).
VarPointsTo({blank_heap(p)}, o, c, r) :- RecordedInstance(i, k, _, o), ReachableContext(c, k), assigned(i, r).
ReachableContext(c, x) :- RecordedCall(_, k, x), ReachableContext(c, k).
"""


def method_handles(p: A.ContextPolicy) -> str:
    """A handle is looked up by a class constant and a name, and invoked with the receiver first. Needs clients.REFLECTION; without exceptions."""
    return f"""
.decl find(inv: symbol)
.decl handle_made(inv: symbol, ctx: Ctx, m: symbol)
.decl handle(o: symbol, m: symbol)
.decl has_this(m: symbol)
.decl HandleCall(inv: symbol, ctx: Ctx, m: symbol)
has_this(m) :- this(m, _).
find(i) :- virtual_call(i, _, _, sig), method(sig, name, _, "java.lang.invoke.MethodHandles$Lookup"), match("find(Virtual|Static|Special)", name).
handle_made(i, c, m) :- find(i), actual(i, 0, a), VarPointsTo(_, o, c, a), class_value(o, t), actual(i, 1, b), VarPointsTo(_, s, c, b), string_value(s, name), method(m, name, _, t).
handle(cat(i, cat("/handle ", m)), m) :- handle_made(i, _, m).
heap(o, "java.lang.invoke.MethodHandle") :- handle(o, _).
VarPointsTo({blank_heap(p)}, cat(i, cat("/handle ", m)), c, r) :- handle_made(i, c, m), assigned(i, r).
HandleCall(i, c, m) :- virtual_call(i, b, _, sig), method(sig, name, _, "java.lang.invoke.MethodHandle"), match("invoke(Exact)?", name), VarPointsTo(_, o, c, b), handle(o, m).
ReachableContext(c, m) :- HandleCall(_, c, m).
VarPointsTo(hc, o, c, v) :- HandleCall(i, c, m), this(m, v), method(m, _, _, t), actual(i, 0, a), VarPointsTo(hc, o, c, a), heap(o, s), SubtypeOf(s, t).
VarPointsTo(hc, o, c, v) :- HandleCall(i, c, m), has_this(m), formal(m, k, v), actual(i, k + 1, a), VarPointsTo(hc, o, c, a).
VarPointsTo(hc, o, c, v) :- HandleCall(i, c, m), !has_this(m), formal(m, k, v), actual(i, k, a), VarPointsTo(hc, o, c, a).
VarPointsTo(hc, o, c, r) :- HandleCall(i, c, m), result(m, v), VarPointsTo(hc, o, c, v), assigned(i, r).
"""


def proxies(p: A.ContextPolicy) -> str:
    """An object that passes every call of its interfaces to a handler's invoke. Needs clients.REFLECTION; without exceptions."""
    return f"""
.decl proxy_site(inv: symbol)
.decl proxy(o: symbol, inv: symbol, t: symbol)
.decl ProxyCall(inv: symbol, ctx: Ctx, m: symbol, handler: symbol, hctx: HCtx)
proxy_site(i) :- static_call(i, _, sig), method(sig, "newProxyInstance", _, "java.lang.reflect.Proxy").
proxy(cat(i, cat("/proxy ", t)), i, t) :- proxy_site(i), actual(i, 1, a), VarPointsTo(_, list, _, a), ArrayIndexPointsTo(_, list, _, o), class_value(o, t), is_interface(t).
heap(o, t) :- proxy(o, _, t).
VarPointsTo({blank_heap(p)}, o, c, r) :- proxy(o, i, _), static_call(i, k, _), ReachableContext(c, k), assigned(i, r).
ProxyCall(i, c, m, x, hc) :- virtual_call(i, b, _, _), VarPointsTo(_, o, c, b), proxy(o, s, _), actual(s, 2, a), VarPointsTo(hc, x, _, a), heap(x, t), MethodLookup("invoke", _, t, m).
ReachableContext(c, m) :- ProxyCall(_, c, m, _, _).
VarPointsTo(hc, x, c, v) :- ProxyCall(_, c, m, x, hc), this(m, v).
VarPointsTo(hc, o, c, r) :- ProxyCall(i, c, m, _, _), result(m, v), VarPointsTo(hc, o, c, v), assigned(i, r).
"""


#: what a type's own and inherited members are, what can be made, and overriding with a narrower result; needs HIERARCHY
MEMBERS = """
.decl abstract_type(t: symbol)
.decl parameters(m: symbol, p: symbol)
.decl returns(m: symbol, t: symbol)
.decl declares(name: symbol, desc: symbol, t: symbol)
.decl hands_down(m: symbol, name: symbol, desc: symbol)
.decl DeclaredOrInherited(m: symbol, t: symbol)
.decl Constructor(m: symbol, t: symbol)
.decl Instantiable(t: symbol)
.decl Covariant(m: symbol, over: symbol)
declares(name, desc, t) :- method(_, name, desc, t).
hands_down(m, name, desc) :- method(m, name, desc, _), name != "<init>", name != "<clinit>", !modifier(m, "private").
DeclaredOrInherited(m, t) :- method(m, _, _, t).
DeclaredOrInherited(m, t) :- DeclaredOrInherited(m, s), up(t, s), hands_down(m, name, desc), !declares(name, desc, t).
Constructor(m, t) :- method(m, "<init>", _, t).
Instantiable(t) :- is_class(t), !abstract_type(t).
Covariant(m, o) :- hands_down(m, name, _), method(m, name, _, t), above(t, s), method(o, name, _, s), parameters(m, p), parameters(o, p), returns(m, a), returns(o, b), SubtypeOfDifferent(a, b).
"""

#: static single assignment: where definitions meet (iterated dominance frontiers), and which definition each meeting takes from each side
SSA = (
    A.CONTROL_FLOW
    + """
.decl assigns(m: symbol, i: number, v: symbol)
.decl strictly(m: symbol, a: number, b: number)
.decl between(m: symbol, a: number, b: number)
.decl Parent(m: symbol, b: number, a: number)
.decl Frontier(m: symbol, a: number, b: number)
.decl defines(m: symbol, b: number, v: symbol)
.decl Phi(m: symbol, v: symbol, b: number)
.decl gives(m: symbol, v: symbol, b: number)
.decl Leaving(m: symbol, v: symbol, b: number, at: number)
.decl PhiArgument(m: symbol, v: symbol, b: number, from: number, at: number)
strictly(m, a, b) :- Dominates(m, a, b), a != b.
between(m, a, b) :- strictly(m, a, c), strictly(m, c, b).
Parent(m, b, a) :- strictly(m, a, b), !between(m, a, b).
Frontier(m, a, b) :- BlockSuccessor(m, p, b), Dominates(m, a, p), !strictly(m, a, b).
defines(m, b, v) :- assigns(m, i, v), BlockOf(m, i, b), reaches(m, b).
Phi(m, v, b) :- defines(m, a, v), Frontier(m, a, b).
Phi(m, v, b) :- Phi(m, v, a), Frontier(m, a, b).
gives(m, v, b) :- defines(m, b, v); Phi(m, v, b).
Leaving(m, v, b, b) :- gives(m, v, b).
Leaving(m, v, b, at) :- Leaving(m, v, a, at), Parent(m, b, a), !gives(m, v, b).
PhiArgument(m, v, b, from, at) :- Phi(m, v, b), BlockSuccessor(m, from, b), Leaving(m, v, from, at).
"""
)
