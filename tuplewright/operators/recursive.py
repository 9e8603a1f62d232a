"""Recursion over whole tables of the driver, by doubling and by the engine's rules.

``closure`` doubles paths: logarithmically many rounds in the longest path, of which each joins only what the
last one found, written to the shared folder; in a forest each path is made once. The rule programs are semi-naive fixpoints of the engine.
The analyses' own programs are registered in programs.py.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuplewright.operators.idioms import table
from tuplewright.plans import analyses as A
from tuplewright.plans import example
from tuplewright.plans.engine import evaluate, shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def saved(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: paths that a task joins in a forest's closure
TASK_PATHS = 500_000


def joined(left: DataFrame, right: DataFrame, sums: list[str]) -> DataFrame:
    """Paths of left that go on in right."""
    l, r = (df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns)) for side, df in (("l", left), ("r", right)))
    both = l.join(r, F.col("l_b") == F.col("r_a"))
    return both.select(F.col("l_a").alias("a"), F.col("r_b").alias("b"), *((F.col(f"l_{c}") + F.col(f"r_{c}")).alias(c) for c in sums))


def forest_paths(edges: DataFrame, n: int, sums: list[str]) -> DataFrame:
    """The closure of n edges of which no two start at one node and none goes up: a pair has one path, so nothing is compared with what was found.

    Paths of up to 2**k edges follow on those of exactly 2**k. Tasks, and not what a task holds, grow with the paths.
    """
    jump = paths = edges
    while True:
        tasks = -(-n // TASK_PATHS)
        found = saved(joined(jump.repartition(tasks, "b"), paths.repartition(tasks, "a"), sums))
        if found.isEmpty():
            return paths
        jump = saved(joined(jump.repartition(tasks, "b"), jump.repartition(tasks, "a"), sums))
        paths = paths.unionByName(found)
        n *= 2


def closure(edges: DataFrame) -> DataFrame:
    """The transitive closure of edges (a, b), further columns added up along a path: each round joins what the last found with all."""
    sums = [c for c in edges.columns if c not in ("a", "b")]
    delta = saved(edges.dropna(subset=["a", "b"]).distinct())
    paths = delta
    n, nodes, up = delta.agg(F.count("*"), F.count_distinct("a"), F.count_if(F.col("a") <= F.col("b"))).first()
    if n == nodes and not up:
        return forest_paths(delta, n, sums) if n else delta
    while True:
        delta = saved(joined(delta, paths, sums).unionByName(joined(paths, delta, sums)).distinct().join(paths, paths.columns, "left_anti"))
        if delta.isEmpty():
            return paths
        paths = paths.unionByName(delta)


FOREST = "sub as (select p_partkey as c, p_partkey // 2 as p from part where p_partkey > 0)"


def forest(spark, d) -> DataFrame:
    return table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("c"), F.expr("p_partkey div 2").alias("p"))


PATHS = f"with recursive {FOREST}, path as (select c as a, p as b from sub union select path.a, sub.p from path join sub on path.b = sub.c) "


def edges(spark, d) -> DataFrame:
    return forest(spark, d).select(F.col("c").alias("a"), F.col("p").alias("b"))


@query(PATHS + "select a, b from path")
def ancestors_doubling(spark, d):
    return closure(edges(spark, d))


@query(PATHS + "select a, b from path")
def ancestors_linear(spark, d):
    rules = ".decl edge(a: number, b: number) .decl path(a: number, b: number) path(x, y) :- edge(x, y). path(x, z) :- path(x, y), edge(y, z)."
    return evaluate(spark, rules, {"edge": edges(spark, d)}, "path")["path"]


@query(PATHS + "select a, b from path")
def ancestors_nonlinear(spark, d):
    rules = ".decl edge(a: number, b: number) .decl path(a: number, b: number) path(x, y) :- edge(x, y). path(x, z) :- path(x, y), path(y, z)."
    return evaluate(spark, rules, {"edge": edges(spark, d)}, "path")["path"]


@query(f"with recursive {FOREST}, path as (select c as a, p as b, 1 as n from sub union select path.a, sub.p, n + 1 from path join sub on path.b = sub.c where n < 3) select a, b, n from path")
def ancestors_bounded(spark, d):
    rules = ".decl edge(a: number, b: number) .decl path(a: number, b: number, n: number) path(x, y, 1) :- edge(x, y). path(x, z, n + 1) :- path(x, y, n), edge(y, z), n < 3."
    return evaluate(spark, rules, {"edge": edges(spark, d)}, "path")["path"]


#: parts refer to their parent in the forest, and a parent to a child that is smaller
_REFERS = f"{FOREST}, refers as (select c as a, p as b from sub union select p, c from sub join part x on x.p_partkey = c join part y on y.p_partkey = p where y.p_size > x.p_size)"
_SCC = f"with recursive {_REFERS}, path as (select a, b from refers union select path.a, refers.b from path join refers on path.b = refers.a), node as (select a as x from refers union select b from refers), same as (select x as a, x as b from node union select p.a, p.b from path p join path q on p.a = q.b and p.b = q.a) "


def _components(spark, d, *wanted):
    size = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size").distinct()
    up = forest(spark, d)
    of = lambda c: size.select(F.col("k").alias(c), F.col("p_size").alias(f"{c}_size"))
    down = up.join(of("c"), "c").join(of("p"), "p").where("p_size > c_size")
    text = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    refers = up.select(text("c").alias("a"), text("p").alias("b")).unionByName(down.select(text("p").alias("a"), text("c").alias("b")))
    return A.run(spark, A.COMPONENTS, {"refers": refers}, *wanted)


@query(_SCC + "select lpad(cast(a as varchar), 12, '0') as a, lpad(cast(min(b) as varchar), 12, '0') as rep from same group by a")
def component_min_rep(spark, d):
    return _components(spark, d, "SCC")["SCC"]


@query(_SCC + "select lpad(cast(r as varchar), 12, '0') as rep, count(*) as n from (select a, min(b) as r from same group by a) group by r")
def component_counts(spark, d):
    return _components(spark, d, "SCCSize")["SCCSize"]


@query(f"with recursive {FOREST}, up as (select c, p, 1 as n from sub union select up.c, sub.p, n + 1 from up join sub on up.p = sub.c) select c, p, n from up")
def counter_recursion(spark, d):
    """Ancestors with their distance: reach doubles each round, distances add."""
    return closure(edges(spark, d).withColumn("n", F.lit(1))).select(F.col("a").alias("c"), F.col("b").alias("p"), "n")


@query(
    f"with recursive {FOREST}, own as (select distinct p_partkey as t, p_size % 4 as name from part), look as (select name, t, t as m from own "
    "union select look.name, sub.c, look.m from look join sub on sub.p = look.t where not exists (select 1 from own where own.t = sub.c and own.name = look.name)) select name, t, m from look"
)
def nearest_declared(spark, d):
    """Parts are types in a forest; each declares one of four methods and inherits the others from the nearest ancestor that has them."""
    own = table(spark, d, "part").select(F.col("p_partkey").alias("t"), (F.col("p_size") % 4).alias("name")).distinct()
    up = counter_recursion(spark, d).unionByName(own.select(F.col("t").alias("c"), F.col("t").alias("p"), F.lit(0).alias("n")))
    near = up.join(own, up.p == own.t).groupBy("name", "c").agg(F.min(F.struct("n", "p"))["p"].alias("m"))
    return near.select("name", F.col("c").alias("t"), "m")


@query(f"with recursive {FOREST}, a as (select c, p from sub union select a.c, sub.p from a join sub on a.p = sub.c) select c, p from a union select p_partkey, p_partkey from part")
def forest_closure(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("a")).distinct()  # no path of the forest leads back
    return closure(edges(spark, d)).unionByName(part.withColumn("b", F.col("a"))).select(F.col("a").alias("c"), F.col("b").alias("p"))


@query(
    f"with recursive {FOREST}, alloc as (select distinct l_partkey as v, l_suppkey as h from lineitem), "
    "vpt as (select v, h from alloc union select sub.p, vpt.h from vpt join sub on vpt.v = sub.c) select v, h from vpt"
)
def climbing_values(spark, d):
    """Each part is assigned to its parent in the forest; suppliers are the objects. A parent's key has one binary digit less, so values climb by levels, each once."""
    level = lambda v: F.when(F.col(v) > 0, F.length(F.bin(v))).otherwise(0).alias("level")
    alloc = table(spark, d, "lineitem").select(F.col("l_partkey").alias("v"), F.col("l_suppkey").alias("h")).distinct().select("v", "h", level("v"))
    path = f"{shared_dir(spark)}/rounds/{uuid.uuid4().hex}"
    alloc.write.partitionBy("level").parquet(path)
    alloc = spark.read.schema(alloc.schema).parquet(path)
    up = forest(spark, d).distinct().select("c", "p", level("c"))
    out = climbed = alloc.select("v", "h").limit(0)
    for at in range(alloc.agg(F.max("level")).first()[0] or 0, -1, -1):
        here = alloc.where(F.col("level") == at).select("v", "h").unionByName(climbed).repartition("v").distinct()
        here = saved(here.join(up.where(F.col("level") == at), F.col("v") == F.col("c"), "left").select("v", "h", "p"))
        climbed = here.where("p is not null").select(F.col("p").alias("v"), "h")
        out = out.unionByName(here.select("v", "h"))
    return out


@query(
    "with recursive t as (select distinct user_id as u, event_id as e, ts from events where event_type = 'error'), nxt as (select event_id as a, lead(event_id) over (partition by user_id order by ts, event_id) as b, event_type as k from events), "
    "taint as (select e from t union select n.b from taint join nxt n on n.a = taint.e join nxt m on m.a = n.b where m.k <> 'signup') select e from taint where e is not null"
)
def runs_after_error(spark, d):
    """Errors taint what the user does next until a signup cleans: a window finds the last source or sanitizer before each event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    mark = F.when(F.col("event_type").isin("error", "signup"), F.col("event_type"))
    last = F.last(mark, ignorenulls=True).over(w)
    return table(spark, d, "events").withColumn("last", last).where("last = 'error'").select(F.col("event_id").alias("e"))


@query(
    "with recursive item as (select distinct l_orderkey as o, l_linenumber as n, l_returnflag as f from lineitem), one as (select o, n, min(f) as f from item group by o, n), "
    "dead as (select o, n from one where f = 'R' union select one.o, one.n from dead join one on one.o = dead.o and one.n = dead.n + 1 where one.f <> 'A') select o, n from dead"
)
def runs_after_return(spark, d):
    """A returned line is dead, and so is the line after a dead one unless it was accepted: runs by windows."""
    one = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.min("l_returnflag").alias("f"))
    order = Window.partitionBy("o").orderBy("n")
    breaks = F.when((F.col("n") - F.lag("n").over(order) == 1) & (F.col("f") != "A"), 0).otherwise(1)
    runs = one.withColumn("b", breaks).withColumn("run", F.sum("b").over(order))
    seen = F.max(F.when(F.col("f") == "R", 1)).over(Window.partitionBy("o", "run").orderBy("n"))
    return runs.withColumn("d", seen).where("d = 1").select("o", "n")


@query("with r as (select p_partkey as a, p_type as t from part), c as (select t, count(*) as n from r group by t) select t as package, n as size, case when n * n > (select count(*) from part) then 'own' else 'rest' end as partition_ from c")
def own_or_rest(spark, d):
    part = table(spark, d, "part")
    total = part.agg(F.count("*").alias("total"))
    sizes = part.groupBy(F.col("p_type").alias("package")).agg(F.count("*").alias("size"))
    return sizes.join(F.broadcast(total), F.lit(True)).select("package", "size", F.when(F.col("size") * F.col("size") > F.col("total"), "own").otherwise("rest").alias("partition_"))


@query("with h as (select distinct l_suppkey as m, l_partkey as h, p_type as t from lineitem join part on l_partkey = p_partkey), c as (select m, t, count(*) as n, min(h) as rep from h group by m, t) select h.m as m, h.h as h, case when n > 50 then rep else h.h end as merged from h join c on h.m = c.m and h.t = c.t")
def merge_above_threshold(spark, d):
    """More than fifty allocations of a type in one method share the least as their representative."""
    h = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("m"), F.col("l_partkey").alias("h"), F.col("p_type").alias("t")).distinct()
    c = h.groupBy("m", "t").agg(F.count("*").alias("n"), F.min("h").alias("rep"))
    return h.join(c, ["m", "t"]).select("m", "h", F.when(F.col("n") > 50, F.col("rep")).otherwise(F.col("h")).alias("merged"))


@query("with c as (select l_orderkey as site, p_brand as target from lineitem join part on l_partkey = p_partkey) select site, count(distinct target) as n from c group by site having count(distinct target) > 1")
def sites_of_many(spark, d):
    c = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("site"), F.col("p_brand").alias("target")).distinct()
    return c.groupBy("site").agg(F.count("*").alias("n")).where("n > 1")


@query("with e as (select distinct l_orderkey as o, l_partkey as p from lineitem), k as (select distinct o_orderkey as o, o_orderpriority as t from orders) select distinct e.o as site from e join k on e.o = k.o join part on p = p_partkey where not (t = '1-URGENT' or p_type = 'ECONOMY')")
def mismatched_pairs(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("site"), "l_partkey").distinct()
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("site"), F.col("o_orderpriority").alias("t"))
    return e.join(k, "site").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).where("not (t = '1-URGENT' or p_type = 'ECONOMY')").select("site").distinct()


@query("select 'orders' as metric, count(*) as n from orders union all select 'parts never ordered', count(*) from part where p_partkey not in (select l_partkey from lineitem) union all select 'customers without order', count(*) from customer where c_custkey not in (select o_custkey from orders) union all select 'returned percent', 100 * (select count(*) from lineitem where l_returnflag = 'R') // (select count(*) from lineitem)")
def counts_table(spark, d):
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
    o, i, c, p = (table(spark, d, t) for t in ("orders", "lineitem", "customer", "part"))
    out = count("orders", o).unionByName(count("parts never ordered", p.join(i, p.p_partkey == i.l_partkey, "left_anti")))
    out = out.unionByName(count("customers without order", c.join(o, c.c_custkey == o.o_custkey, "left_anti")))
    returned = F.call_function("div", 100 * F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("long"), F.count("*"))
    return out.unionByName(i.agg(returned.alias("n")).select(F.lit("returned percent").alias("metric"), "n"))


@query("select 'order line without order' as id, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'order without customer', count(*) from orders where o_custkey not in (select c_custkey from customer) union all select 'two regions', count(*) from (select n_nationkey from nation group by n_nationkey having count(distinct n_regionkey) > 1)")
def violations_table(spark, d):
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("id"), "n")
    o, i, c, n = (table(spark, d, t) for t in ("orders", "lineitem", "customer", "nation"))
    out = count("order line without order", i.join(o, i.l_orderkey == o.o_orderkey, "left_anti"))
    out = out.unionByName(count("order without customer", o.join(c, o.o_custkey == c.c_custkey, "left_anti")))
    return out.unionByName(count("two regions", n.groupBy("n_nationkey").agg(F.countDistinct("n_regionkey").alias("k")).where("k > 1")))


@query()
def points_to_tutorial(spark, d):
    """The points-to relation of the bundled example program."""
    return A.analyse(spark, example.normal(spark), "context-insensitive", "VarPointsTo")["VarPointsTo"]


@query()
def points_to_2_object(spark, d):
    """As above with contexts of two receiver objects and a heap context, the records as text."""
    out = A.analyse(spark, example.normal(spark), "2-object-sensitive+heap", "VarPointsTo")["VarPointsTo"]
    return out.select(F.to_json("hctx").alias("hctx"), "value", F.to_json("ctx").alias("ctx"), "var")


@query()
def reachable_methods(spark, d):
    return A.analyse(spark, example.normal(spark), "types-only", "Reachable")["Reachable"]
