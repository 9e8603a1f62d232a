"""Relational idioms of rule bodies, each on the driver's tables and beside the SQL that says the same.

Every relation is a set: a projection ends in ``distinct``. Negation is an anti-join, an existential a
semi-join, "for all" a pair of negations, an aggregate over a set counts distinct bindings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tuplewright.functions import functors as fn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: keys that an item of a pair brings along; items of a group that a row pairs with others, and keys for each of these that they bring on
#: average; items whose pairs are made between two looks at whether the rows made are wanted, which hold them till then
MOST_KEYS, SHARE, KEYS_EACH, TILE = 64, 2000, 8, 128


def pairs(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """The distinct pairs a < b of items that have equal keys in some rows.

    A pair is made once, at the least of the keys that both have, so pairs are neither moved nor compared with one another. Items
    of more than MOST_KEYS keys don't bring them along: their pairs are made distinct. A large group is paired in shares.
    """
    given = rows.dropna(subset=[*keys, item]).select(F.struct(*keys).alias("k"), F.col(item).alias("x"))
    own = given.groupBy("x").agg(F.sort_array(F.collect_set("k")).alias("of"))
    own = own.select("x", "of", (F.size("of") > MOST_KEYS).alias("heavy"), F.posexplode("of").alias("at", "k"))
    own = own.select("k", "x", "heavy", F.when(F.col("heavy"), F.slice("of", 1, 0)).otherwise(F.slice("of", 1, F.col("at"))).alias("before"))
    load = F.greatest(F.count("*"), F.sum(F.size("before")) / KEYS_EACH)
    own = own.join(own.groupBy("k").agg(F.ceil(load / SHARE).alias("shares")), "k").withColumn("share", F.pmod(F.xxhash64("x"), "shares"))
    own = own.withColumn("all", F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))
    left = own.where("heavy").select("k", "share", F.col("x").alias("a"))
    right = own.select("k", F.explode("all").alias("share"), F.col("x").alias("b"))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    heavy = left.join(right, ["k", "share"]).where("a <> b").select(*ordered).distinct()
    return light_pairs(own.where("not heavy").select("k", "x", "before", "share", F.explode("all").alias("other"))).unionByName(heavy)


def light_pairs(own: DataFrame) -> DataFrame:
    """Of items that bring the keys before k, the pairs that share k and none of these.

    Each two shares, and each one with itself, meet in one row, which is cut into tiles, and loops over a tile's arrays make the pairs: a
    join would make each from two rows. A tile is a row of its own since generated code holds all that it makes of a row. The keys before
    k are compared only where their sketches, a bit for each of them, have a bit in common.
    """
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(k), F.lit(64)).cast("int"))
    bits = F.aggregate("before", F.lit(0).cast("long"), lambda bits, k: bits.bitwiseOR(bit(k)))
    unit = [F.col("k"), F.least("share", "other").alias("i"), F.greatest("share", "other").alias("j")]
    units = own.select(*unit, F.struct((F.col("share") > F.col("other")).alias("second"), "x", bits.alias("bits"), "before").alias("one"))
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, as rows that are few and short here make many pairs
    units = units.repartition(parts, "k", "i", "j").groupBy("k", "i", "j").agg(F.sort_array(F.collect_list("one")).alias("m"))
    second, same = F.filter("m", lambda one: one["second"]), F.col("i") == F.col("j")
    units = units.select(same.alias("same"), F.filter("m", lambda one: ~one["second"]).alias("m"), F.when(same, F.col("m")).otherwise(second).alias("n"))
    cut = lambda c: F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(F.size(c) / TILE - 1, F.lit(0))).cast("int")), lambda t: F.slice(c, t * TILE + 1, TILE)))
    units = units.select("same", "n", cut("m").alias("row", "ms")).select("same", "ms", "row", cut("n").alias("column", "ns"))
    only = lambda f, c: F.transform(c, lambda one: one[f]).alias(f"{f}_{c}")
    fields = [only(f, c) for c in ("ms", "ns") for f in ("x", "bits", "before")]
    units = units.where("not same or row <= column").select((F.col("same") & (F.col("row") == F.col("column"))).alias("same"), *fields)
    upto = lambda low, high: F.explode(F.when(low < high, F.sequence(low, high - 1)))
    at = lambda c, i: F.get(F.col(c), F.col(i))
    units = units.withColumn("p", upto(F.lit(0), F.size("x_ms"))).withColumn("low", F.when(F.col("same"), F.col("p") + 1).otherwise(0))
    units = units.select("x_ns", "bits_ns", "before_ns", "low", *(at(f"{f}_ms", "p").alias(f) for f in ("x", "bits", "before")))
    units = units.withColumn("q", upto(F.col("low"), F.size("x_ns")))
    apart = (F.col("bits").bitwiseAND(at("bits_ns", "q")) == 0) | ~F.arrays_overlap("before", at("before_ns", "q"))
    return units.where(apart).select(F.least("x", at("x_ns", "q")).alias("a"), F.greatest("x", at("x_ns", "q")).alias("b"))


# -- projections and filters


@query("select distinct c_mktsegment as segment, c_nationkey as nation from customer")
def scan_project_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).distinct()


@query("select distinct o_custkey as cust from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
def const_filter(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("cust")).distinct()


@query("select distinct p_brand as brand, p_size as size from part where p_size < 5 or p_type = 'ECONOMY' or p_name like '%ring'")
def disjunction(spark, d):
    part = table(spark, d, "part")
    return part.where((F.col("p_size") < 5) | (F.col("p_type") == "ECONOMY") | F.col("p_name").endswith("ring")).select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).distinct()


@query("select distinct l_orderkey as o, l_linenumber as n from lineitem where l_orderkey % 7 = l_linenumber")
def repeated_variable(spark, d):
    item = table(spark, d, "lineitem")
    return item.where(F.col("l_orderkey") % 7 == F.col("l_linenumber")).select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).distinct()


@query(
    "select distinct l_orderkey as o, c_nationkey as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey "
    "join supplier on l_suppkey = s_suppkey where c_nationkey = s_nationkey"
)
def repeated_variable_columns(spark, d):
    """sale(o, x, x) over the joined rows: an order that a supplier of the customer's own nation served."""
    sale = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sale = sale.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return sale.where("c_nationkey = s_nationkey").select(F.col("l_orderkey").alias("o"), F.col("c_nationkey").alias("n")).distinct()


@query("select distinct n_regionkey as a, n_nationkey as b from nation")
def column_permutation(spark, d):
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b")).distinct()


@query("select distinct a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey")
def theta_neq_pair(spark, d):
    return pairs(table(spark, d, "supplier"), ["s_nationkey"], "s_suppkey")


@query("select distinct concat('<', p_brand, ': ', p_type, '>') as id, length(p_brand) as len from part")
def computed_concat(spark, d):
    part = table(spark, d, "part")
    return part.select(fn.cat(F.lit("<"), F.col("p_brand"), F.lit(": "), F.col("p_type"), F.lit(">")).alias("id"), fn.strlen(F.col("p_brand")).alias("len")).distinct()


# -- joins


@query("select distinct c_custkey as cust, n_name as nation from customer join nation on c_nationkey = n_nationkey")
def join2(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("cust"), F.col("n_name").alias("nation")).distinct()


@query("select distinct a.l_orderkey as o, a.l_linenumber as n, a.l_partkey as p, b.l_partkey as q from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber where a.l_partkey < b.l_partkey")
def join_multikey(spark, d):
    i = table(spark, d, "lineitem")
    a = i.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")).distinct()
    return a.join(a.withColumnRenamed("p", "q"), ["o", "n"]).where("p < q").distinct()


@query(
    "select distinct c_custkey as cust, s_suppkey as supp, p_brand as brand from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey "
    "join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey where c_nationkey = s_nationkey"
)
def join4_chain(spark, d):
    c, o, i, s, p = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier", "part"))
    j = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("c_custkey").alias("cust"), F.col("s_suppkey").alias("supp"), F.col("p_brand").alias("brand")).distinct()


@query("select distinct a.o_custkey as a, b.o_custkey as b from orders a join orders b on a.o_orderdate = b.o_orderdate and a.o_orderpriority = b.o_orderpriority and a.o_custkey < b.o_custkey where a.o_orderstatus = 'P' and b.o_orderstatus = 'P'")
def self_join_pairs(spark, d):
    return pairs(table(spark, d, "orders").where("o_orderstatus = 'P'"), ["o_orderdate", "o_orderpriority"], "o_custkey")


@query("select c_custkey as cust from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def semi_exists(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("cust"))


@query("select p_partkey as part from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R' and l_quantity > 45)")
def anti_not_exists(spark, d):
    i = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45")
    return table(spark, d, "part").join(i, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select(F.col("p_partkey").alias("part"))


@query("select distinct o_custkey as cust, o_orderpriority as prio from orders a where not exists (select 1 from orders b where b.o_custkey = a.o_custkey and b.o_orderstatus = 'O')")
def anti_wildcard(spark, d):
    o = table(spark, d, "orders")
    blocked = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("cust")).distinct()
    return o.select(F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("prio")).distinct().join(blocked, "cust", "left_anti")


@query(
    "with r as (select l_orderkey as o, min(l_linenumber) as lo, max(l_linenumber) as hi from lineitem where l_returnflag = 'R' group by l_orderkey) "
    "select distinct l_orderkey as o, l_linenumber as n from lineitem join r on l_orderkey = r.o where l_returnflag = 'A' and lo <= l_linenumber and l_linenumber < hi"
)
def range_containment(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), "l_returnflag")
    ranges = i.where("l_returnflag = 'R'").groupBy("o").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return i.where("l_returnflag = 'A'").join(ranges, "o").where("lo <= n and n < hi").select("o", "n").distinct()


@query(
    "with e as (select distinct l_orderkey as o, l_linenumber as n from lineitem) select a.o as o, a.n as n, b.n as next from e a join e b on a.o = b.o and b.n = a.n + 1"
)
def offset_next_prev(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).distinct()
    after = Window.partitionBy("o").orderBy("n")
    return e.withColumn("next", F.lead("n").over(after)).where("next = n + 1")


@query("select distinct p_name as name, p_brand as brand, b.p as prefix from part join (select distinct substr(p_brand, 1, 7) as p from part) b on starts_with(p_brand, b.p)")
def prefix_join(spark, d):
    """A prefix test against a fixed length is an equi-join on the cut; other lengths join once a length."""
    part = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    prefixes = part.select(fn.substr(F.col("brand"), 0, 7).alias("prefix")).distinct()
    out = None
    for n in range(1, 8):
        one = part.where(F.length("brand") >= n).withColumn("prefix", fn.substr(F.col("brand"), 0, n)).join(prefixes.where(F.length("prefix") == n), "prefix")
        out = one if out is None else out.unionByName(one)
    return out.select("name", "brand", "prefix").distinct()


@query("select r_name as region, seg as segment from region cross join (select distinct c_mktsegment as seg from customer)")
def cross_small(spark, d):
    """The rule asks for a product of two domains of fixed size."""
    region = table(spark, d, "region").select(F.col("r_name").alias("region"))
    return region.join(table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct(), F.lit(True))


@query("select p_partkey as part, coalesce(n, -1) as best from part left join (select l_partkey, max(l_linenumber) as n from lineitem where l_returnflag = 'R' and l_quantity >= 49 group by l_partkey) on p_partkey = l_partkey")
def outer_default(spark, d):
    best = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").groupBy("l_partkey").agg(F.max("l_linenumber").alias("n"))
    return table(spark, d, "part").join(best, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").alias("part"), F.coalesce("n", F.lit(-1)).alias("best"))


@query("select distinct o_custkey as cust from orders a where not exists (select 1 from orders b where b.o_custkey = a.o_custkey and b.o_totalprice <= 50000)")
def forall_double_negation(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("cust"), "o_totalprice")
    return o.select("cust").distinct().join(o.where("o_totalprice <= 50000").select("cust").distinct(), "cust", "left_anti")


# -- sets


@query("select c_nationkey as n from customer union select s_nationkey from supplier union select n_regionkey from nation")
def union_set(spark, d):
    one = lambda t, c: table(spark, d, t).select(F.col(c).alias("n"))
    return one("customer", "c_nationkey").union(one("supplier", "s_nationkey")).union(one("nation", "n_regionkey")).distinct()


@query("select l_partkey as p, l_suppkey as s from lineitem where l_returnflag = 'R' intersect select l_partkey, l_suppkey from lineitem where l_returnflag = 'A'")
def intersect_set(spark, d):
    i = table(spark, d, "lineitem")
    one = lambda f: i.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    return one("R").intersect(one("A"))


@query("select l_partkey as p from lineitem where l_returnflag = 'R' and l_linestatus = 'F' except select l_partkey from lineitem where l_quantity > 48")
def difference_set(spark, d):
    i = table(spark, d, "lineitem")
    return i.where("l_returnflag = 'R' and l_linestatus = 'F'").select(F.col("l_partkey").alias("p")).subtract(i.where("l_quantity > 48").select("l_partkey"))


@query("select a as x, case when n = 1 then 'first' else 'second' end as side from (select distinct l_suppkey as a, 1 as n from lineitem where l_returnflag = 'R' except select l_suppkey, 1 from lineitem where l_quantity = 50) union select a, 'second' from (select l_suppkey as a from lineitem where l_quantity = 50 except select l_suppkey from lineitem where l_returnflag = 'R')")
def difference_of_runs(spark, d):
    """What one relation has and the other lacks, both ways."""
    i = table(spark, d, "lineitem")
    a, b = (i.where(c).select(F.col("l_suppkey").alias("x")).distinct() for c in ("l_returnflag = 'R'", "l_quantity = 50"))
    return a.subtract(b).withColumn("side", F.lit("first")).union(b.subtract(a).withColumn("side", F.lit("second")))


# -- aggregates: over sets


@query("select count(*) as n from (select distinct l_partkey, l_suppkey from lineitem)")
def count_global(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().agg(F.count("*").alias("n"))


@query("select l_suppkey as s, count(distinct l_partkey) as n from lineitem group by l_suppkey")
def count_group(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), "l_partkey").distinct()
    return pairs.groupBy("s").agg(F.count("*").alias("n"))


@query("select c_custkey as cust, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'P' group by c_custkey")
def count_zero_groups(spark, d):
    n = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("cust"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("select o_custkey as cust, count(*) as n from orders group by o_custkey having count(*) > 12")
def count_having(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(F.count("*").alias("n")).where("n > 12")


@query("select l_suppkey as s, cast(sum(n) as bigint) as total from (select distinct l_suppkey, l_linenumber as n, l_returnflag from lineitem) group by l_suppkey")
def sum_set_semantics(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), "l_returnflag").distinct()
    return rows.groupBy("s").agg(F.sum("n").alias("total"))


@query("select o_custkey as cust, min(o_orderkey) as ord from orders o where o_orderdate = (select min(o_orderdate) from orders i where i.o_custkey = o.o_custkey) group by o_custkey")
def min_argmin(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("cust")).agg(F.min(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("ord"))


@query("select p_brand as brand, max(length(p_name)) as len from part group by p_brand")
def max_len(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.max(fn.strlen(F.col("p_name"))).alias("len"))


@query("select l_suppkey as s, cast(100 * count(*) filter (where l_returnflag = 'R') as bigint) // count(*) as percent from lineitem group by l_suppkey")
def ratio_metric(spark, d):
    r = F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("long")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(fn.div(100 * r, F.count("*")).alias("percent"))


@query(
    "with v as (select distinct l_suppkey as s, l_linenumber as n, l_returnflag as f from lineitem), c as (select s, count(*) as k from v group by s) "
    "select distinct v.s as s, case when k > 20 then '<<many>>' else concat(f, n) end as val from v join c on v.s = c.s"
)
def threshold_xl(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f")).distinct()
    sizes = v.groupBy("s").agg(F.count("*").alias("k"))
    return v.join(sizes, "s").select("s", F.when(F.col("k") > 20, F.lit("<<many>>")).otherwise(F.concat("f", F.col("n").cast("string"))).alias("val")).distinct()


@query("select p_type as type, p_size as size, cast(sum(c) as bigint) as running from (select p_type, p_size, count(*) as c from part group by p_type, p_size) group by p_type, p_size")
def histogram(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("type"), F.col("p_size").alias("size")).agg(F.count("*").alias("running"))


# -- choice, order, next


@query("select k, v from (select o_custkey as k, o_orderpriority as v, row_number() over (partition by o_custkey order by o_orderpriority) as r from (select distinct o_custkey, o_orderpriority from orders)) where r = 1")
def choice_first_per_key(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"))
    return o.groupBy("k").agg(F.min("v").alias("v"))


@query("select b, min(p) as p from (select (l_partkey * l_suppkey) % 11 as b, l_partkey as p from lineitem) group by b")
def bucket_choice(spark, d):
    """One tuple for each of eleven buckets of a fixed hash."""
    i = table(spark, d, "lineitem")
    return i.groupBy(((F.col("l_partkey") * F.col("l_suppkey")) % 11).alias("b")).agg(F.min("l_partkey").alias("p"))


@query("with e as (select distinct l_suppkey as s, l_partkey as p from lineitem) select s, p, next from (select s, p, lead(p) over (partition by s order by p) as next from e) where next is not null")
def next_larger(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    return e.withColumn("next", F.lead("p").over(Window.partitionBy("s").orderBy("p"))).where("next is not null")


@query("with f as (select event_id, user_id, lead(event_id) over (partition by user_id order by ts, event_id) as nxt from events) select user_id as u, event_id as a, nxt as b from f where nxt is not null")
def event_successor(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("u"), F.col("event_id").alias("a"), F.lead("event_id").over(w).alias("b")).where("b is not null")


@query("select doc, list from (select conv_id as doc, string_agg(role, '>' order by turn) as list from conversations group by conv_id)")
def list_by_index(spark, d):
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("doc", F.array_join(F.transform("t", lambda x: x["role"]), ">").alias("list"))


@query("select k, n from (select o_custkey as k, count(*) as n from orders group by o_custkey) order by n desc, k limit 10")
def top_k(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(10)


# -- strings and numbers


@query("select distinct p_name as name from part where regexp_full_match(p_name, '[a-r].* (ring|widget)')")
def match_anchored(spark, d):
    part = table(spark, d, "part")
    return part.where(fn.match("[a-r].* (ring|widget)", F.col("p_name"))).select(F.col("p_name").alias("name")).distinct()


@query("select distinct p_name as name from part where contains(p_name, 'mall')")
def contains_needle_first(spark, d):
    return table(spark, d, "part").where(fn.contains("mall", F.col("p_name"))).select(F.col("p_name").alias("name")).distinct()


@query("select distinct substr(c_name, 1, 8) as head, substr(c_name, 10, 9) as tail from customer")
def substr_zero_based(spark, d):
    c = F.col("c_name")
    return table(spark, d, "customer").select(fn.substr(c, 0, 8).alias("head"), fn.substr(c, 9, 9).alias("tail")).distinct()


@query("select doc_id as d, length(text) as n from documents where length(text) > 2000")
def strlen_filter(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("d"), fn.strlen(F.col("text")).alias("n")).where("n > 2000")


@query("select distinct p_brand as brand, try_cast(substr(p_brand, 7, 5) as bigint) as n from part where try_cast(substr(p_brand, 7, 5) as bigint) is not null")
def to_number_guarded(spark, d):
    n = fn.to_number(fn.substr(F.col("p_brand"), 6, 5))
    return table(spark, d, "part").select(F.col("p_brand").alias("brand"), n.alias("n")).where("n is not null").distinct()


@query("select distinct l_linenumber as n, (l_linenumber - 5) // 2 as half, (l_linenumber - 5) % 2 as rest from lineitem")
def int_arith_trunc(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(n.alias("n"), fn.div(n - 5, F.lit(2)).cast("int").alias("half"), fn.mod(n - 5, F.lit(2)).cast("int").alias("rest")).distinct()


@query("select distinct upper(p_name) as up, regexp_matches(p_name, '[a-z] [a-z]') as two, replace(p_type, 'EC', 'ec') as mixed, regexp_matches(replace(p_type, 'EC', 'ec'), '[a-z][A-Z]') as camel from part")
def case_boundary(spark, d):
    p = table(spark, d, "part")
    mixed = F.replace(F.col("p_type"), F.lit("EC"), F.lit("ec"))
    return p.select(F.upper("p_name").alias("up"), F.col("p_name").rlike("[a-z] [a-z]").alias("two"), mixed.alias("mixed"), mixed.rlike("[a-z][A-Z]").alias("camel")).distinct()


@query("select distinct s.suffix as suffix from (select p_name, substr(p_name, i) as suffix from part, range(2, 40) t(i) where i <= length(p_name)) s where length(s.suffix) >= 7")
def suffixes(spark, d):
    """Suffixes of seven characters or more of each distinct name."""
    names = table(spark, d, "part").select("p_name").distinct()
    at = names.where(F.length("p_name") >= 8).select("p_name", F.explode(F.sequence(F.lit(1), F.length("p_name") - 7)).alias("i"))
    return at.select(F.expr("substring(p_name, i + 1)").alias("suffix")).distinct()


@query("select a.user_id as u, a.event_id as e, max(b.event_id) as last_click from events a join events b on a.user_id = b.user_id and b.ts <= a.ts where a.event_type = 'purchase' and b.event_type = 'click' group by a.user_id, a.event_id")
def as_of_last(spark, d):
    """The latest click before each purchase: one window instead of a range join. Event ids follow time."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    e = table(spark, d, "events").where("event_type in ('click', 'purchase')")
    last = e.withColumn("last_click", F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(w))
    return last.where("event_type = 'purchase' and last_click is not null").select(F.col("user_id").alias("u"), F.col("event_id").alias("e"), "last_click")


@query("select json_extract_string(props, '$.k') as k, count(*) as n from events group by 1")
def json_field(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))
