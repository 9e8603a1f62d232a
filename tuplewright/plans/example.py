"""The facts of a small program of animals: a class hierarchy, field access, polymorphic and merged calls.

    main: test() on a new Example
    test: l2 = new Cat; l2A1 = new Dog; l2A2 = l2 or l2A1; l2A2.play(); l3 = new Cat; l4 = new Cat;
          l3.setParent(l4); morePlay(l3)
    morePlay(c): p = c.getParent(); p.play(); a1 = p.playWith(c); a2 = c.playWith(p)
    Animal.playWith(other): other.play(); return other
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tuplewright.plans.analyses import NORMAL

_M = {
    "main": "<Example: void main(java.lang.String[])>",
    "test": "<Example: void test(int)>",
    "morePlay": "<Example: void morePlay(Cat)>",
    "play": "<Animal: void play()>",
    "playWith": "<Animal: Animal playWith(Animal)>",
    "setParent": "<Cat: void setParent(Cat)>",
    "getParent": "<Cat: Cat getParent()>",
    "Cat.play": "<Cat: void play()>",
    "Dog.play": "<Dog: void play()>",
}
_FIELD = "<Cat: Cat parent>"


def _v(method: str, name: str) -> str:
    return f"{_M[method]}/{name}"


def rows() -> dict[str, list[tuple]]:
    """Normalised facts by relation."""
    at = lambda m, n: _v(m, n)
    out: dict[str, list[tuple]] = {n: [] for n in NORMAL}
    out["is_class"] = [(t,) for t in ("java.lang.Object", "Example", "Animal", "Cat", "Dog")]
    out["extends"] = [("Example", "java.lang.Object"), ("Animal", "java.lang.Object"), ("Cat", "Animal"), ("Dog", "Animal")]
    out["main_class"] = [("Example",)]
    out["field"] = [(_FIELD, "Cat", "Cat")]
    for key, m in _M.items():
        owner, rest = m[1:-1].split(": ")
        result, call = rest.split(" ", 1)
        name, params = call.rstrip(")").split("(")
        out["method"].append((m, name, f"{result}({params})", owner))
        if key == "main":
            out["modifier"].append((m, "static"))
        else:
            out["this"].append((m, at(key, "@this")))
    for method, allocations in {"main": [("$s0", "Example", 0)], "test": [("$stack8", "Cat", 0), ("$stack5", "Dog", 0), ("$stack6", "Cat", 1), ("$stack7", "Cat", 2)]}.items():
        for var, kind, n in allocations:
            heap = f"{_M[method]}/new {kind}/{n}"
            out["alloc"].append((at(method, var), heap, _M[method]))
            out["heap"].append((heap, kind))
    moves = {"test": "@this>l0 $stack8>l2 $stack5>l2A1 l2>l2A2 l2A1>l2A2 $stack6>l3 $stack7>l4", "morePlay": "@param0>c @this>l0", "setParent": "@param0>c", "playWith": "@param0>other"}
    for method, text in moves.items():
        out["move"] += [(at(method, to), at(method, source)) for source, to in (x.split(">") for x in text.split())]
    out["store"] = [(at("setParent", "@this"), _FIELD, at("setParent", "c"), _M["setParent"])]
    out["load"] = [(at("getParent", "r"), at("getParent", "@this"), _FIELD, _M["getParent"])]
    out["result"] = [(_M["getParent"], at("getParent", "r")), (_M["playWith"], at("playWith", "other"))]
    out["formal"] = [(_M[m], 0, at(m, "@param0")) for m in ("morePlay", "setParent", "playWith")]
    calls = {
        "main": [("$s0", "test", None, None)],
        "test": [("l2A2", "play", None, None), ("l3", "setParent", "l4", None), ("l0", "morePlay", "l3", None)],
        "morePlay": [("c", "getParent", None, "p"), ("p", "play", None, None), ("p", "playWith", "c", "a1"), ("c", "playWith", "p", "a2")],
        "playWith": [("other", "play", None, None)],
    }
    for method, text in calls.items():
        for n, (base, callee, argument, to) in enumerate(text):
            inv = f"{_M[method]}/{callee}/{n}"
            out["virtual_call"].append((inv, at(method, base), _M[method], _M[callee]))
            out["call_at"].append((inv, n, _M[method]))
            if argument:
                out["actual"].append((inv, 0, at(method, argument)))
            if to:
                out["assigned"].append((inv, at(method, to)))
    kinds = {"Example": "main.$s0 test.@this test.l0 morePlay.@this morePlay.l0", "Dog": "test.$stack5 test.l2A1 Dog.play.@this", "Animal": "test.l2A2 playWith.@this playWith.@param0 playWith.other morePlay.a1 morePlay.a2 play.@this"}
    typed = {at(*x.rsplit(".", 1)): t for t, text in kinds.items() for x in text.split()}
    variables = {v for r in ("alloc", "this", "assigned", "result") for row in out[r] for v in row if "/" in v and "/new " not in v and v.rsplit("/", 1)[0] in _M.values()}
    variables |= {v for row in out["move"] for v in row} | {row[2] for row in out["formal"]}
    out["local"] = [(v, v.rsplit("/", 1)[0]) for v in sorted(variables)]
    out["local_type"] = [(v, typed.get(v, "Cat")) for v in sorted(variables)]
    return out


def normal(spark: SparkSession, given: dict[str, list[tuple]] | None = None) -> dict[str, DataFrame]:
    schema = lambda n: ", ".join(f"`{c.split(':')[0]}` {'long' if c.endswith(':number') else 'string'}" for c in NORMAL[n].split())
    return {n: spark.createDataFrame(r, schema(n)) for n, r in (given or rows()).items()}
