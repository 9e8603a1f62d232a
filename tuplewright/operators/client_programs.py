"""The smaller analyses of plans/clients.py over facts that are derived from whole tables, beside SQL.

As in programs.py, parts are a forest, an order is a method and its lines the instructions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tuplewright.operators.programs import LINES, PARTS, lines, named, parts
from tuplewright.operators.recursive import closure
from tuplewright.plans import clients as C

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def text(column: str):
    return F.col(column).cast("string")


@query(
    f"with recursive {PARTS}, single as (select k from p where size <= 45), mv as (select up.* from up join p a on a.k = up.p join p b on b.k = up.c where a.size >= b.size), "
    "o as (select k as v, k as o from single where k not in (select c from mv) union select mv.c, o.o from o join mv on mv.p = o.v join single s on s.k = mv.c) "
    "select 'v' || a.v as a, 'v' || b.v as b from o a join o b on a.o = b.o where a.v <> b.v"
)
def must_alias_of_parts(spark, d):
    """MustAlias: a part's variable is copied from its parent's if that is no smaller; those of size above 45 are set twice."""
    p = parts(spark, d)
    larger = p.select(F.col("k").alias("up"), F.col("size").alias("up_size"))
    facts = {
        "move": p.join(larger, "up").where("up_size >= size").select(named("v", "k").alias("to"), named("v", "up").alias("from")),
        "defined": p.select(named("v", "k").alias("v"), F.lit("first").alias("i")).unionByName(p.where("size > 45").select(named("v", "k").alias("v"), F.lit("second").alias("i"))),
    }
    return C.run(spark, C.MUST_ALIAS, facts, "MustAlias")["MustAlias"]


@query(
    f"with recursive {LINES}, node as (select o, n, o * 10 + n as id, f from i), nxt as (select id as a, lead(id) over (partition by o order by n) as b from node), "
    "back as (select x.id as a, y.id as b from node x join node y on x.o = y.o and y.n = x.n - 2 where x.f = 'A'), edge as (select a, b from nxt where b is not null union select a, b from back), "
    "latch as (select b as h, a as s from back), av as (select h, s as a, s from latch union select av.h, e.a, av.s from av join edge e on e.b = av.a where e.a <> av.h and av.a <> av.h) "
    "select h as head, h as b from latch union select h, a from av"
)
def loops_of_orders(spark, d):
    """Loop: the lines of an order run on, and an accepted one goes back to the second before it."""
    i = lines(spark, d).select("o", "n", "f", (F.col("o") * 10 + F.col("n")).alias("id"))
    earlier = i.select("o", F.col("n").alias("m"), F.col("id").alias("first"))
    before = i.join(earlier, "o").where("m < n")
    back = before.where("f = 'A' and m = n - 2").select(F.col("id").alias("a"), F.col("first").alias("b"))
    onward = before.groupBy("id").agg(F.max("first").alias("a")).select("a", F.col("id").alias("b"))
    dominates = before.select(F.col("first").alias("a"), F.col("id").alias("b")).unionByName(i.select(F.col("id").alias("a"), F.col("id").alias("b")))
    return C.run(spark, C.LOOPS, {"dominates": dominates, "edge": onward.unionByName(back)}, "Loop")["Loop"]


@query(
    f"with recursive {LINES}, step as (select o as a, n as b, o as c, n + 1 as e from i union select x.o, 1, y.o, y.n from i x join i y on x.n = 1 and y.n > 2 and y.x % 50 = 0 and y.o // 2 = x.o), "
    f"{PARTS}, dead as (select i.o, i.n from i join p on p.k = i.x where p.size > 48 union select i.o, i.n from dead d join step s on s.a = d.o and s.b = d.n join i on i.o = s.c and i.n = s.e) "
    "select 'm' || o || '.' || n as i from dead"
)
def dead_instructions_of_orders(spark, d):
    """DeadInstruction: a line whose part is of size above 48 has no type, and all after it are dead; some lines call the order of half their number."""
    i, big = lines(spark, d), parts(spark, d).where("size > 48").select(F.col("k").alias("x"))
    at = named("m", "o", "n")
    after = i.select("o", (F.col("n") - 1).alias("n"), at.alias("j"))
    facts = {
        "instruction": i.select(at.alias("i"), text("o").alias("m")),
        "follows": i.join(after, ["o", "n"]).select(at.alias("i"), "j"),
        "uses_type": i.select(at.alias("i"), named("P", "x").alias("t")),
        "phantom": big.select(named("P", "x").alias("t")),
        "invokes": i.where("n > 2 and x % 50 = 0").join(i.where("n = 1").select(F.col("o").alias("half")), F.expr("o div 2") == F.col("half")).select(at.alias("i"), text("half").alias("m")),
    }
    gap = i.where("n > 1").select(F.lit("nowhere").alias("i"), at.alias("j")).join(facts["follows"].select("j"), "j", "left_anti")
    facts["follows"] = facts["follows"].unionByName(gap.select("i", "j"))  # a line behind a gap is no first line
    return C.run(spark, C.DEAD_CODE, facts, "DeadInstruction")["DeadInstruction"]


@query(
    f"with {PARTS}, {LINES}, c as (select o, n, x from i), met as (select k from p where size % 2 = 0), keep as (select k from p where size % 10 = 0), once as (select x from c group by x having count(*) = 1) "
    "select 'remove' as what, 'm' || k as m, '' as i from p where k not in (select k from met) and k not in (select k from keep) "
    "union select 'inline', 'm' || c.x, 'c' || o || '.' || n from c join once on once.x = c.x where c.x in (select k from met) and c.x not in (select k from keep) "
    "union select 'seed', 'm' || k, '' from p where k in (select k from met) and ((size > 40 and k not in (select x from c)) or k in (select k from keep))"
)
def directives_of_parts(spark, d):
    """Remove, Inline and Seed: parts of even size are reachable, each line calls its part, each tenth size is kept."""
    p, i = parts(spark, d), lines(spark, d)
    m = p.select(named("m", "k").alias("m"), "size")
    facts = {
        "method": m.select("m"),
        "application": m.where("size > 40").select("m"),
        "reachable": m.where("size % 2 = 0").select("m"),
        "keep": m.where("size % 10 = 0").select("m"),
        "call": i.select(named("c", "o", "n").alias("i"), named("m", "x").alias("m")),
    }
    r = C.run(spark, C.DIRECTIVES, facts, "Remove", "Inline", "Seed")
    alone = lambda name, what: r[name].select(F.lit(what).alias("what"), "m", F.lit("").alias("i"))
    return alone("Remove", "remove").unionByName(r["Inline"].select(F.lit("inline").alias("what"), "m", "i")).unionByName(alone("Seed", "seed"))


@query(f"with {LINES}, c as (select x, count(*) as n from i group by x) select 'v' || i.x as v, case when c.n > 30 then '<<XL-pt-set>>' else 'o' || o || '.' || i.n end as o from i join c on c.x = i.x group by 1, 2")
def shown_values_of_parts(spark, d):
    """Shown: a part's values are its lines, or one mark for more than thirty."""
    facts = {"value_of": lines(spark, d).select(named("v", "x").alias("v"), named("o", "o", "n").alias("o")), "limit": spark.createDataFrame([(30,)], "n long")}
    return C.run(spark, C.SERVER, facts, "Shown")["Shown"]


@query(f"with {PARTS} select 'f' || up.p as f, 'f' || up.c as \"by\" from up join p a on a.k = up.p join p b on b.k = up.c where a.size % 4 = b.size % 4")
def shadowed_fields_of_parts(spark, d):
    """Shadowed: each part has one of four fields, which hides its parent's of that name."""
    p = parts(spark, d)
    facts = {
        "field": p.select(named("f", "k").alias("f"), F.concat(F.lit("n"), (F.col("size") % 4).cast("string")).alias("name"), named("P", "k").alias("t")),
        "above": p.where("up is not null").select(named("P", "k").alias("t"), named("P", "up").alias("s")),
    }
    return C.run(spark, C.SERVER, facts, "Shadowed")["Shadowed"]


@query(
    f"with {PARTS}, s as (select s_suppkey as s, min(s_nationkey) as n from supplier group by 1), b as (select k, brand || '/' || (size % 10) as t, 'n' || (size % 7) as name, size > 45 as main from p), "
    "pt as (select s, 'Brand#' || (s % 5 + 1) || (n % 5 + 1) || '/' || (s % 10) as t, 'n' || (n % 7) as name, case when s % 4 = 0 then 'n' || (s % 7) end as q from s), c as (select pt.s, pt.name as want, pt.q, b.* from pt join b on b.t = pt.t), "
    "g as (select *, count(*) over (partition by s) as many, count(*) filter (where main) over (partition by s) as mains from c) "
    "select 's' || s as p, 'b' || k as b from g where case when q is not null then name = q when many = 1 then true when mains > 0 then main else name = want end"
)
def injected_parts(spark, d):
    """Injected: suppliers ask for parts of a brand and a kind of size; by a qualifier, the only one, the main ones, or by name."""
    s = spark.read.parquet(f"{d}/supplier.parquet").groupBy(F.col("s_suppkey").alias("s")).agg(F.min("s_nationkey").alias("n"))
    p = parts(spark, d)
    numbered = lambda prefix, column, n: F.concat(F.lit(prefix), (F.col(column) % n).cast("string"))
    kind = F.concat("brand", F.lit("/"), (F.col("size") % 10).cast("string"))
    wanted = F.concat(F.lit("Brand#"), (F.col("s") % 5 + 1).cast("string"), (F.col("n") % 5 + 1).cast("string"), F.lit("/"), (F.col("s") % 10).cast("string"))
    facts = {
        "point": s.select(named("s", "s").alias("p"), wanted.alias("t"), numbered("n", "n", 7).alias("name")),
        "bean": p.select(named("b", "k").alias("b"), kind.alias("t"), numbered("n", "size", 7).alias("name")),
        "subtype": p.select(kind.alias("t"), kind.alias("s")).distinct(),
        "qualifier": s.where("s % 4 = 0").select(named("s", "s").alias("p"), numbered("n", "s", 7).alias("q")),
        "primary": p.where("size > 45").select(named("b", "k").alias("b")),
    }
    return C.run(spark, C.INJECTION, facts, "Injected")["Injected"]


@query(
    f"with recursive {LINES}, c as (select o, n, cast(q as bigint) % 3 + 1 as v from i where n = 1 union all select i.o, i.n, c.v * (cast(i.q as bigint) % 3 + 1) from c join i on i.o = c.o and i.n = c.n + 1), "
    "top as (select o, max(n) as n from i group by o) select 'l' || c.o as l, c.v as p from c join top on top.o = c.o and top.n = c.n"
)
def products_of_orders(spark, d):
    """Product: an order's lines from the first on are a list of small numbers; one with a gap has no product."""
    i = lines(spark, d).select(named("l", "o").alias("l"), (F.col("n") - 1).alias("i"), (F.col("q").cast("long") % 3 + 1).alias("n"))
    return C.run(spark, C.SHAPES, {"item": i}, "Product")["Product"]


@query(
    f"with recursive {PARTS}, down as (select k as s, k as t from p union select down.s, up.c from down join up on up.p = down.t), real as (select k from p where size % 2 = 0), "
    "least as (select s, min('T' || t) as t from down where t in (select k from real) group by s) "
    "select 'T' || k as s, 'T' || k as t from p where size > 45 and k in (select k from real) union select 'T' || p.k, l.t from p join least l on l.s = p.k where p.size > 45 and p.k not in (select k from real)"
)
def stand_ins_of_parts(spark, d):
    """Stand: parts of size above 45 are asked for; those of odd size are abstract and get the least part below them that isn't."""
    p = parts(spark, d)
    above = p.where("up is not null").select(F.col("k").alias("a"), F.col("up").alias("b"))
    below = closure(above).select(named("T", "a").alias("t"), named("T", "b").alias("s")).unionByName(p.select(named("T", "k").alias("t"), named("T", "k").alias("s")))
    facts = {
        "wanted": p.where("size > 45").select(named("T", "k").alias("t")),
        "concrete_type": p.where("size % 2 = 0").select(named("T", "k").alias("t")),
        "subtype": below,
    }
    return C.run(spark, C.MOCKS, facts, "Stand")["Stand"]
