"""The analyses' rule programs over facts that are derived from whole tables of the driver, beside recursive SQL.

Parts are classes in a forest (a part extends the part of half its key), variables that are copied to their parent's,
and allocation sites whose type is the brand. An order is a method, its lines the instructions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplewright.operators.idioms import table
from tuplewright.operators.recursive import saved
from tuplewright.plans import analyses as A
from tuplewright.plans import clients as C
from tuplewright.plans import extensions as X
from tuplewright.plans import ssa
from tuplewright.plans.engine import Engine, evaluate, shared_dir
from tuplewright.plans.language import parse
from tuplewright.sources import facts as S
from tuplewright.sources import sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def parts(spark, d) -> DataFrame:
    """One row for each part: k, its parent up (null at a root), size and brand."""
    p = table(spark, d, "part").groupBy(F.col("p_partkey").alias("k")).agg(F.min("p_size").alias("size"), F.min("p_brand").alias("brand"))
    return p.join(p.select(F.col("k").alias("up")), (F.expr("k div 2") == F.col("up")) & (F.col("k") > 0), "left")


def lines(spark, d) -> DataFrame:
    """One row for each line of an order: o, n, the part x, quantity q and flag f."""
    least = [F.min(c).alias(a) for c, a in (("l_partkey", "x"), ("l_quantity", "q"), ("l_returnflag", "f"))]
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("n")).agg(*least)


def named(prefix: str, *columns: str):
    return F.concat(F.lit(prefix), *(x for i, c in enumerate(columns) for x in ([F.lit(".")] if i else []) + [F.col(c).cast("string")]))


def hierarchy(spark, d) -> dict[str, DataFrame]:
    p = parts(spark, d)
    return {
        "is_class": p.select(named("P", "k").alias("t")),
        "extends": p.where("up is not null").select(named("P", "k").alias("t"), named("P", "up").alias("s")),
        "method": p.select(named("m", "k").alias("m"), F.concat(F.lit("n"), (F.col("size") % 4).cast("string")).alias("name"), F.lit("()").alias("desc"), named("P", "k").alias("t")),
    }


PARTS = "p as (select p_partkey as k, min(p_size) as size, min(p_brand) as brand from part group by 1), up as (select x.k as c, y.k as p from p x join p y on x.k // 2 = y.k and x.k > 0) "
ABOVE = f"with recursive {PARTS}, above as (select c, p from up union select above.c, up.p from above join up on above.p = up.c)"
WIDER = ", ".join(f"('{a}', '{b}')" for a, b in A.WIDENS)
PRIMITIVE = ", ".join(f"('{p}')" for p in ("boolean", "byte", "char", "short", "int", "long", "float", "double"))


@query(
    f"{ABOVE} select 'P' || c as t, 'P' || p as s from above union select 'P' || k, 'P' || k from p union select 'P' || k, '{A.ROOT}' from p union select 'null_type', 'P' || k from p "
    f"union select * from (values {WIDER}) union select a, a from (values {PRIMITIVE}) q(a)"
)
def subtypes_of_parts(spark, d):
    """SubtypeOf: the forest's closure, the root class, the null type and the primitive types."""
    return Engine(spark, A.DECLS + A.HIERARCHY, hierarchy(spark, d)).run("SubtypeOf")["SubtypeOf"]


@query(
    f"with recursive {PARTS}, own as (select k, 'n' || (size % 4) as name from p), look as (select name, k, k as m from own union all select look.name, up.c, look.m from look join up on up.p = look.k "
    "where not exists (select 1 from own where own.k = up.c and own.name = look.name)) select name, '()' as \"desc\", 'P' || k as t, 'm' || m as m from look"
)
def method_lookup_of_parts(spark, d):
    """MethodLookup: each class declares one of four methods and inherits the others from the nearest class that has them."""
    return Engine(spark, A.DECLS + A.HIERARCHY + A.LOOKUP, hierarchy(spark, d)).run("MethodLookup")["MethodLookup"]


LINES = "i as (select l_orderkey as o, l_linenumber as n, min(l_partkey) as x, min(l_quantity) as q, min(l_returnflag) as f from lineitem group by 1, 2)"


@query(
    f"with recursive {LINES}, s as (select o, n, cast(q as bigint) as v from i where n = 1 union all select i.o, i.n, case when i.f = 'R' then s.v - cast(i.q as bigint) else s.v + cast(i.q as bigint) end from s join i on i.o = s.o and i.n = s.n + 1 where s.n < {A.FOLD_DEPTH}) "
    "select 'q' || o || '.' || n as v, cast(q as bigint) as n from i union all select 's' || o || '.' || n, v from s"
)
def folded_order_sums(spark, d):
    """Folded: each line's quantity is a constant; running sums of an order (less what was returned) fold up to the depth."""
    i = lines(spark, d)
    facts = {
        "const": i.select(named("q", "o", "n").alias("v"), F.col("q").cast("long").alias("n")),
        "copy": i.where("n = 1").select(named("s", "o", "n").alias("to"), named("q", "o", "n").alias("from")),
        "binary": i.where("n > 1").withColumn("m", F.col("n") - 1).select(named("s", "o", "n").alias("to"), F.when(F.col("f") == "R", "-").otherwise("+").alias("op"), named("s", "o", "m").alias("a"), named("q", "o", "n").alias("b")),
    }
    return A.run(spark, A.CONSTANTS, facts, "Folded")["Folded"]


def flow_facts(spark, d) -> dict[str, DataFrame]:
    i = saved(lines(spark, d)).withColumn("m", F.col("o").cast("string"))  # each relation reads them
    back = i.where("f = 'A' and n > 2").select("m", F.col("n").alias("i"), F.lit(1).cast("long").alias("to"))
    return {
        "instruction": i.select("m", F.col("n").alias("i")),
        "jump": i.where("f = 'R'").select("m", F.col("n").alias("i"), (F.col("n") + 2).alias("to")).unionByName(back),
        "ends": i.where("f = 'R' and q > 40").select("m", F.col("n").alias("i")),
    }


FLOW = (
    f"with recursive {LINES}, jump as (select o, n as i, n + 2 as t from i where f = 'R' union select o, n, 1 from i where f = 'A' and n > 2), stop as (select o, n from i where f = 'R' and q > 40), "
    "nxt as (select o, n, lead(n) over (partition by o order by n) as m from i), ok as (select jump.* from jump join i on i.o = jump.o and i.n = jump.t), "
    "suc as (select o, n as a, m as b from nxt where m is not null and not exists (select 1 from stop where stop.o = nxt.o and stop.n = nxt.n) union select o, i, t from ok), "
    "lead_ as (select o, min(n) as n from i group by o union select o, t from ok union select nxt.o, m from nxt join jump on jump.o = nxt.o and jump.i = nxt.n where m is not null union select nxt.o, m from nxt join stop on stop.o = nxt.o and stop.n = nxt.n where m is not null), "
    "blk as (select i.o, i.n, max(l.n) as h from i join lead_ l on l.o = i.o and l.n <= i.n group by 1, 2), "
    "edge as (select distinct suc.o, x.h as a, y.h as b from suc join lead_ l on l.o = suc.o and l.n = suc.b join blk x on x.o = suc.o and x.n = suc.a join blk y on y.o = suc.o and y.n = suc.b), "
    "start as (select o, min(h) as s from blk group by o), reach as (select o, s as b from start union select reach.o, edge.b from reach join edge on edge.o = reach.o and edge.a = reach.b), "
    "avoid as (select distinct blk.o, h as a, s as b from blk join start on start.o = blk.o where h <> s union select avoid.o, avoid.a, edge.b from avoid join edge on edge.o = avoid.o and edge.a = avoid.b where avoid.a <> edge.b) "
)


@query(
    f"{FLOW}"
    "select cast(x.o as varchar) as m, x.b as a, y.b as b from reach x join reach y on x.o = y.o where not exists (select 1 from avoid v where v.o = x.o and v.a = x.b and v.b = y.b)"
)
def dominators_by_order(spark, d):
    """Dominates: a returned line skips the next one, or ends the order above a quantity of 40; an accepted one from the third on goes back to the first."""
    return A.run(spark, A.CONTROL_FLOW, flow_facts(spark, d), "Dominates")["Dominates"]


@query(
    f"{FLOW}, dom as (select x.o, x.b as a, y.b as b from reach x join reach y on x.o = y.o where not exists (select 1 from avoid v where v.o = x.o and v.a = x.b and v.b = y.b)), "
    "fr as (select distinct e.o, d.a, e.b from edge e join dom d on d.o = e.o and d.b = e.a where not exists (select 1 from dom s where s.o = e.o and s.a = d.a and s.b = e.b and s.a <> s.b)), "
    "def as (select distinct i.o, i.f as v, blk.h as b from i join blk on blk.o = i.o and blk.n = i.n join reach on reach.o = i.o and reach.b = blk.h), "
    "phi as (select def.o, def.v, fr.b from def join fr on fr.o = def.o and fr.a = def.b union select phi.o, phi.v, fr.b from phi join fr on fr.o = phi.o and fr.a = phi.b) "
    "select cast(o as varchar) as m, v, b from phi"
)
def phi_placement_by_order(spark, d):
    """Phi: each line of an order's flow sets the variable of its flag; where definitions meet."""
    assigns = lines(spark, d).select(F.col("o").cast("string").alias("m"), F.col("n").alias("i"), F.col("f").alias("v"))
    return Engine(spark, X.SSA, flow_facts(spark, d) | {"assigns": assigns}, keyed=True).run("Phi")["Phi"]


@query(
    f"with recursive {PARTS}, own as (select k, 'n' || (size % 4) as name, size from p), mem as (select k as m, k as t from p union all select mem.m, up.c from mem join up on up.p = mem.t join own x on x.k = mem.m "
    "where x.size <= 40 and not exists (select 1 from own y where y.k = up.c and y.name = x.name)) select 'm' || m as m, 'P' || t as t from mem"
)
def members_of_parts(spark, d):
    """DeclaredOrInherited: a class has its own method and those above it that aren't private (of size above 40) or declared anew on the way."""
    private = parts(spark, d).where("size > 40").select(named("m", "k").alias("m"), F.lit("private").alias("mod"))
    return Engine(spark, A.DECLS + A.HIERARCHY + X.MEMBERS, hierarchy(spark, d) | {"modifier": private}).run("DeclaredOrInherited")["DeclaredOrInherited"]


@query(f"{ABOVE}, t as (select k as s, k as v from p where size > 40 union select a.c, a.p from above a join p on a.c = p.k where p.size > 40) select 'source' || s as source, 'sink' || v as inv, 'use' as m from t")
def leaks_of_parts(spark, d):
    """Leak (information flow on points-to): what a source gives parts of size above 40 is copied to the parents, and each part is used."""
    p = parts(spark, d)
    main = F.lit("main")
    taken = p.where("size > 40")
    calls = taken.select(named("source", "k").alias("inv"), main.alias("m"), F.lit("make").alias("sig")).unionByName(p.select(named("sink", "k").alias("inv"), main.alias("m"), F.lit("use").alias("sig")))
    facts = {
        "is_class": spark.createDataFrame([("M",), ("T",)], "t string"),
        "main_class": spark.createDataFrame([("M",)], "t string"),
        "method": spark.createDataFrame([("main", "main", "()", "M"), ("make", "make", "()", "M"), ("use", "use", "(T)", "M")], "m string, name string, desc string, t string"),
        "static_call": calls,
        "assigned": taken.select(named("source", "k").alias("inv"), named("v", "k").alias("v")),
        "actual": p.select(named("sink", "k").alias("inv"), F.lit(0).cast("long").alias("i"), named("v", "k").alias("v")),
        "move": p.where("up is not null").select(named("v", "up").alias("to"), named("v", "k").alias("from")),
        "source": spark.createDataFrame([("make", "T")], "m string, t string"),
        "sink": spark.createDataFrame([("use", 0)], "m string, i long"),
    }
    return A.analyse(spark, facts, "micro", "Leak", extra=X.information_flow(A.policy("micro")))["Leak"]


@query(f"{ABOVE} select 'v' || k as v, 'source' || k as source from p where size > 40 union select 'v' || a.p, 'source' || a.c from above a join p on a.c = p.k where p.size > 40")
def taint_of_parts(spark, d):
    """Tainted: a part of size above 40 gets what a source returns, and variables are copied to the parent's."""
    p = parts(spark, d)
    main = F.lit("main")
    sources = p.where("size > 40")
    facts = {
        "static_call": sources.select(named("source", "k").alias("inv"), main.alias("m"), F.lit("make").alias("sig")),
        "assigned": sources.select(named("source", "k").alias("inv"), named("v", "k").alias("v")),
        "source_method": spark.createDataFrame([("make",)], "m string"),
        "move": p.where("up is not null").select(named("v", "up").alias("to"), named("v", "k").alias("from")),
    }
    return A.run(spark, A.TAINT, facts, "Tainted")["Tainted"]


@query(
    f"{ABOVE}, vpt as (select k as v, k as h from p union select p, c from above) select 'v' || v as v, 'h' || h as h, q.brand <> p.brand as fails from vpt join p on p.k = v join p q on q.k = h"
)
def points_to_of_parts(spark, d):
    """VarPointsTo (policy micro) of a method in which each part's variable gets an object of its brand and its children's
    values; fails: whether a cast to the part's own brand may fail on the value, from MayFailCast's condition."""
    p = parts(spark, d)
    main = spark.createDataFrame([("M",)], "t string")
    facts = {
        "is_class": p.select(F.col("brand").alias("t")).distinct().unionByName(main),
        "main_class": main,
        "method": spark.createDataFrame([("main", "main", "()", "M")], "m string, name string, desc string, t string"),
        "modifier": spark.createDataFrame([("main", "static")], "m string, mod string"),
        "heap": p.select(named("h", "k").alias("h"), F.col("brand").alias("t")),
        "alloc": p.select(named("v", "k").alias("v"), named("h", "k").alias("h"), F.lit("main").alias("m")),
        "move": p.where("up is not null").select(named("v", "up").alias("to"), named("v", "k").alias("from")),
        "cast_to": p.select(named("v", "k").alias("v"), F.col("brand").alias("t")),
    }
    extra = """
    .decl cast_to(v: symbol, t: symbol)
    .decl Value(v: symbol, h: symbol, t: symbol, want: symbol)
    .decl Fits(v: symbol, h: symbol)
    .decl Fails(v: symbol, h: symbol)
    Value(v, h, t, want) :- VarPointsTo(_, h, _, v), heap(h, t), cast_to(v, want).
    Fits(v, h) :- Value(v, h, t, want), SubtypeOf(t, want).
    Fails(v, h) :- Value(v, h, _, _), !Fits(v, h).
    """
    r = A.analyse(spark, facts, "micro", "Fits", "Fails", extra=extra)
    fails = lambda name, x: r[name].select("v", "h", F.lit(x).alias("fails"))
    return fails("Fits", False).unionByName(fails("Fails", True))


LISTS = """
.type L = [head: number, tail: L]
.decl line(o: number, n: number, x: number)
.decl list(o: number, n: number, l: L)
.decl longest(o: number, n: number)
.decl rest(o: number, t: string, l: L)
.decl Text(o: number, t: symbol)
list(o, 0, nil) :- line(o, 1, _).
list(o, n, [x, l]) :- list(o, m, l), n = m + 1, line(o, n, x).
longest(o, n) :- list(o, _, _), n = max m : { list(o, m, _) }.
rest(o, "", l) :- longest(o, n), list(o, n, l).
rest(o, cat(t, cat("/", to_string(x))), l) :- rest(o, t, [x, l]).
Text(o, t) :- rest(o, t, nil).
""".replace("t: string", "t: symbol")


@query(f"with recursive {LINES}, c as (select o, n, '/' || x as t from i where n = 1 union all select i.o, i.n, '/' || i.x || c.t from c join i on i.o = c.o and i.n = c.n + 1) select o, t from c where not exists (select 1 from c e where e.o = c.o and e.n = c.n + 1)")
def lists_by_records(spark, d):
    """A recursive record type: each order's parts are put into a list from the first line on, which is then read off from its head."""
    return evaluate(spark, LISTS, {"line": lines(spark, d).select("o", "n", "x")}, "Text")["Text"]


@query(f"{ABOVE} select distinct 'cast' || a.p as ins from above a join p x on x.k = a.p join p y on y.k = a.c where x.brand <> y.brand")
def may_fail_casts_of_parts(spark, d):
    """MayFailCast: each part's variable is cast to the part's brand."""
    p = parts(spark, d)
    main = spark.createDataFrame([("M",)], "t string")
    facts = {
        "is_class": p.select(F.col("brand").alias("t")).distinct().unionByName(main),
        "main_class": main,
        "method": spark.createDataFrame([("main", "main", "()", "M")], "m string, name string, desc string, t string"),
        "modifier": spark.createDataFrame([("main", "static")], "m string, mod string"),
        "heap": p.select(named("h", "k").alias("h"), F.col("brand").alias("t")),
        "alloc": p.select(named("v", "k").alias("v"), named("h", "k").alias("h"), F.lit("main").alias("m")),
        "move": p.where("up is not null").select(named("v", "up").alias("to"), named("v", "k").alias("from")),
        "cast": p.select(named("cast", "k").alias("ins"), named("c", "k").alias("to"), named("v", "k").alias("from"), F.col("brand").alias("t"), F.lit("main").alias("m")),
    }
    return A.analyse(spark, facts, "micro", "MayFailCast")["MayFailCast"]


@query(f"{ABOVE} select 'v' || c as a, 'v' || p as b from above")
def data_flow_of_parts(spark, d):
    """Flows: a part's variable flows to those of all parts above it."""
    move = parts(spark, d).where("up is not null").select(named("v", "up").alias("to"), named("v", "k").alias("from"))
    return A.run(spark, A.DATA_FLOW, {"move": move}, "Flows")["Flows"]


@query(
    f"with {LINES}, a as (select 'h' || o || '.' || n as h, brand, o % 25 as m from i join (select p_partkey as k, min(p_brand) as brand from part group by 1) on x = k), "
    "c as (select brand, m, count(*) as n, min(h) as r from a group by 1, 2) select a.h as h, case when c.n > 50 then c.r else a.h end as r from a join c on a.brand = c.brand and a.m = c.m"
)
def merged_allocations_of_orders(spark, d):
    """Representative: lines are allocations of the part's brand in one of 25 methods; more than fifty of a type in a method are one."""
    brand = table(spark, d, "part").groupBy(F.col("p_partkey").alias("x")).agg(F.min("p_brand").alias("brand"))
    i = lines(spark, d).join(brand, "x")
    facts = {"allocation": i.select(named("h", "o", "n").alias("h"), F.col("brand").alias("t"), (F.col("o") % 25).cast("string").alias("m"))}
    facts |= {n: spark.createDataFrame([], "h string") for n in ("text_constant", "kept")}
    return Engine(spark, C.HEAP_MERGING, facts).run("Representative")["Representative"]


REQUESTS = """
.comp Policy { .decl request(site: number, at: number) .decl response(site: number, at: number, got: number) }
.comp Parent : Policy { .decl up(c: number, p: number)  response(s, x, p) :- request(s, x), up(x, p). }
.init policy = Parent
.decl up(c: number, p: number)
.decl seed(x: number)
.decl Climbs(s: number, x: number)
policy.up(c, p) :- up(c, p).
policy.request(x, x) :- seed(x).
Climbs(s, x) :- policy.response(s, _, x).
policy.request(s, x) :- Climbs(s, x).
"""


@query(f"{ABOVE} select a.c as s, a.p as x from above a join p on a.c = p.k where p.size > 40")
def requests_and_responses(spark, d):
    """A rule set asks a component and is asked back: only for parts of size above 40 are the parts above them found."""
    p = parts(spark, d)
    facts = {"up": p.where("up is not null").select("k", "up"), "seed": p.where("size > 40").select("k")}
    return evaluate(spark, REQUESTS, facts, "Climbs")["Climbs"]


REWRITES = """
.type Sum = [left: number, rest: Sum]
.decl line(o: number, n: number, q: number)
.decl built(o: number, n: number, t: Sum)
.decl length(o: number, n: number)
.decl Equals(o: number, t: Sum)
.decl Total(o: number, q: number)
built(o, 0, nil) :- line(o, 1, _).
built(o, n, [q, t]) :- built(o, m, t), n = m + 1, line(o, n, q).
length(o, n) :- built(o, _, _), n = max m : { built(o, m, _) }.
Equals(o, t) :- length(o, n), built(o, n, t).
Equals(o, [a + b, t]) :- Equals(o, [a, [b, t]]).
Total(o, q) :- Equals(o, [q, nil]).
"""


@query(f"with recursive {LINES}, c as (select o, n, cast(q as bigint) as v from i where n = 1 union all select i.o, i.n, c.v + cast(i.q as bigint) from c join i on i.o = c.o and i.n = c.n + 1) select o, v as q from c where not exists (select 1 from c e where e.o = c.o and e.n = c.n + 1)")
def rewritten_sums(spark, d):
    """Terms and what they equal by a rewriting rule, until one number is left: an order's quantities as a nested sum."""
    return evaluate(spark, REWRITES, {"line": lines(spark, d).select("o", "n", F.col("q").cast("long"))}, "Total")["Total"]


@query(f"with {LINES} select x, min(o * 10 + n) as first, max(o * 10 + n) as last, count(*) as n from i group by x")
def first_last_predecessors(spark, d):
    """Of all lines that lead to a part, the first and the last ordinal."""
    rules = """
    .decl leads(at: number, x: number)
    .decl Ordinals(x: number, first: number, last: number, n: number)
    Ordinals(x, f, l, n) :- leads(_, x), f = min a : { leads(a, x) }, l = max a : { leads(a, x) }, n = count : { leads(_, x) }.
    """
    return evaluate(spark, rules, {"leads": lines(spark, d).select((F.col("o") * 10 + F.col("n")).alias("at"), "x")}, "Ordinals")["Ordinals"]


@query(
    f"with {PARTS} select k, cast(k as varchar) as text, k & size as both_, k | size as either_, xor(k, cast(size as bigint)) as one, greatest(k, size) as most, least(k, size) as least from p"
)
def scalar_functors(spark, d):
    """to_string, bitwise operators, and max and min of two numbers, by rules."""
    rules = """
    .decl part(k: number, size: number)
    .decl Out(k: number, text: symbol, both_: number, either_: number, one: number, most: number, least: number)
    Out(k, to_string(k), band(k, s), bor(k, s), bxor(k, s), max(k, s), min(k, s)) :- part(k, s).
    """
    return evaluate(spark, rules, {"part": parts(spark, d).select("k", F.col("size").cast("long"))}, "Out")["Out"]


@query("select distinct a.n_nationkey as k, b.n_name as nation from nation a, nation b where regexp_full_match(b.n_name, '.*[' || a.n_nationkey || ']')")
def patterns_from_a_relation(spark, d):
    """match with a pattern that is a column: names that end with a digit of a nation's key."""
    rules = """
    .decl key(k: number)
    .decl nation(n: symbol)
    .decl Ends(k: number, nation: symbol)
    Ends(k, n) :- key(k), nation(n), match(cat(".*[", cat(to_string(k), "]")), n).
    """
    nation = table(spark, d, "nation")
    return evaluate(spark, rules, {"key": nation.select("n_nationkey"), "nation": nation.select("n_name")}, "Ends")["Ends"]


@query(f"with {PARTS}, m as (select brand, avg(size) as mean, sum(size) as total from p group by brand) select brand, mean, total, (select count(*) from p) as parts, mean > 25 as big from m")
def means_by_rules(spark, d):
    """mean, sum and count over tuples, a relation of no columns, and one rule with two heads."""
    rules = """
    .decl part(k: number, brand: symbol, size: number)
    .decl any()
    .decl Mean(brand: symbol, mean: float, total: number, parts: number)
    .decl Big(brand: symbol)
    .decl Listed(brand: symbol)
    any() :- part(_, _, _).
    Mean(b, m, t, n) :- any(), part(_, b, _), m = mean s : { part(_, b, s) }, t = sum s : { part(_, b, s), s > 0 }, n = count : { part(_, _, _) }.
    Big(b), Listed(b) :- Mean(b, m, _, _), m > 25.
    """
    sizes = parts(spark, d).select("k", "brand", F.col("size").cast("long"))
    r = Engine(spark, rules, {"part": sizes}).run("Mean", "Big", "Listed")
    return r["Mean"].join(r["Big"].withColumn("big", F.lit(True)), "brand", "left").withColumn("big", F.coalesce("big", F.lit(False)))


FILES = """
.decl part(k: number, brand: symbol, size: number)
.input part(IO=file, filename="parts.txt", delimiter="|")
.decl gone(k: number)
.input gone
.decl Brand(brand: symbol, n: number, most: number)
.output Brand(filename="brands.txt", delimiter=";", headers=true)
Brand(b, n, m) :- part(_, b, _), n = count : { part(k, b, _), !gone(k) }, m = max s : { part(_, b, s) }.
"""


@query(f"with {PARTS} select brand, count(*) as n, max(size) as most from p group by brand")
def relations_through_files(spark, d):
    """Facts from a delimited file, a missing file as an empty relation, an output file, and that read back as an input."""
    folder = f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"
    parts(spark, d).select("k", "brand", "size").write.csv(f"{folder}/parts.txt", sep="|")
    program = parse(FILES)
    sinks.write_outputs(Engine(spark, program, S.read_inputs(spark, program, folder)).run("Brand"), program, folder)
    again = parse('.decl Brand(brand: symbol, n: number, most: number) .input Brand(filename="brands.txt", delimiter=";", headers=true)')
    return S.read_inputs(spark, again, folder)["Brand"]


@query("select 'part' as relation, count(distinct p_partkey) as tuples from part union all select 'line', count(*) from (select distinct l_orderkey, l_linenumber from lineitem)")
def relation_sizes(spark, d):
    """What .printsize tells of relations."""
    p, i = parts(spark, d).select("k"), lines(spark, d).select("o", "n")
    r = evaluate(spark, ".decl part(k: number) .decl line(o: number, n: number)", {"part": p, "line": i}, "part", "line")
    return sinks.sizes(spark, r.relations)


@query("select c_mktsegment as s, min(c_name) as least, count(distinct c_name) as n from customer group by c_mktsegment")
def least_by_ordinal(spark, d):
    """Each segment's customer of least ordinal, found by a join on the number, and how many ordinals its customers have."""
    rules = """
    .decl of(c: symbol, s: symbol)
    .decl Ordinal(c: symbol, n: number)
    .decl Least(s: symbol, n: number)
    .decl Numbers(s: symbol, n: number)
    .decl Named(s: symbol, least: symbol, n: number)
    Ordinal(c, ord(c)) :- of(c, _).
    Least(s, n) :- of(_, s), n = min ord(c) : { of(c, s) }.
    Numbers(s, n) :- of(c, s), Ordinal(c, n).
    Named(s, c, k) :- Least(s, n), Ordinal(c, n), k = count : { Numbers(s, _) }.
    """
    of = table(spark, d, "customer").select("c_name", "c_mktsegment")
    return evaluate(spark, rules, {"of": of}, "Named")["Named"]


@query(
    f"with recursive {LINES}, e as (select a.o, a.n as x, b.n as y from i a join i b on a.o = b.o and b.n = a.n + 1 where b.f <> 'R'), "
    "p as (select o, x, y from e union select p.o, p.x, e.y from p join e on e.o = p.o and e.x = p.y) "
    "select o, x, y, (select count(*) from p q where q.o = p.o and q.x = p.x) as n from p"
)
def closure_after_deletions(spark, d):
    """Which lines of an order lead to which, after the ways to returned lines are taken away from a finished run."""
    rules = """
    .decl way(o: number, x: number, y: number)
    .decl path(o: number, x: number, y: number)
    .decl reach(o: number, x: number, n: number)
    .decl Path(o: number, x: number, y: number, n: number)
    path(o, x, y) :- way(o, x, y).
    path(o, x, z) :- path(o, x, y), way(o, y, z).
    reach(o, x, n) :- path(o, x, _), n = count : { path(o, x, _) }.
    Path(o, x, y, n) :- path(o, x, y), reach(o, x, n).
    """
    of = lines(spark, d)
    after = of.select("o", (F.col("n") - 1).alias("n"), F.col("n").alias("y"), F.col("f").alias("g"))
    ways = of.select("o", "n").join(after, ["o", "n"])
    engine = Engine(spark, rules, {"way": ways.select("o", "n", "y")}, keyed=True)
    engine.run("Path")
    engine.delete("way", ways.where("g = 'R'").select("o", "n", "y"))
    return engine.relation("Path")


@query(
    f"{FLOW}, dom as (select x.o, x.b as a, y.b as b from reach x join reach y on x.o = y.o where not exists (select 1 from avoid v where v.o = x.o and v.a = x.b and v.b = y.b)), "
    "deep as (select o, b, count(*) as depth from dom group by o, b), "
    "fr as (select distinct e.o, d.a, e.b from edge e join dom d on d.o = e.o and d.b = e.a where not exists (select 1 from dom s where s.o = e.o and s.a = d.a and s.b = e.b and s.a <> s.b)), "
    "def as (select distinct i.o, i.f as v, blk.h as b, i.n as pl from i join blk on blk.o = i.o and blk.n = i.n join reach on reach.o = i.o and reach.b = blk.h), "
    "phi as (select def.o, def.v, fr.b from def join fr on fr.o = def.o and fr.a = def.b union select phi.o, phi.v, fr.b from phi join fr on fr.o = phi.o and fr.a = phi.b), "
    "defs as (select o, v, b, pl, v || '_' || pl as name from def union all select o, v, b, -1, v || '_phi_' || b from phi), "
    "used as (select i.o, i.n, blk.h as b, case when x % 3 = 0 then 'A' when x % 3 = 1 then 'N' else 'R' end as v from i join blk on blk.o = i.o and blk.n = i.n join reach on reach.o = i.o and reach.b = blk.h), "
    "hit as (select used.o, used.n, used.v, name, row_number() over (partition by used.o, used.n order by depth desc, pl desc) as k from used join defs e on e.o = used.o and e.v = used.v "
    "join dom on dom.o = used.o and dom.a = e.b and dom.b = used.b join deep on deep.o = e.o and deep.b = e.b where e.b <> used.b or e.pl < used.n) "
    "select cast(used.o as varchar) as m, used.n as i, used.v, coalesce(hit.name, used.v || '_0') as name from used left join hit on hit.o = used.o and hit.n = used.n and hit.k = 1"
)
def reaching_definitions_by_order(spark, d):
    """Use: each line of an order's flow sets the variable of its flag and reads one that its part names; the definition that it reads."""
    i = lines(spark, d).withColumn("m", F.col("o").cast("string"))
    assigns = i.select("m", F.col("n").alias("i"), F.col("f").alias("v"))
    uses = i.select("m", F.col("n").alias("i"), F.when(F.col("x") % 3 == 0, "A").when(F.col("x") % 3 == 1, "N").otherwise("R").alias("v"))
    return ssa.renamed(spark, flow_facts(spark, d) | {"assigns": assigns}, uses, ("Use",))["Use"]
