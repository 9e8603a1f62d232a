"""Static single assignment: every use finds the one definition that reaches it, and facts are rewritten by the new names.

Blocks that a block dominates form a subtree of the dominator tree. A block's entry number is its place in the tree's
pre-order and its exit number the greatest entry below it, so one block dominates another exactly if its interval
holds the other's entry. The numbers come from sums, without a walk: a node's offset from its parent is one more than
the subtrees of its lesser siblings, and its entry is the sum of the offsets from the root down to it.

Where phis stand for the meeting of definitions, the definition that reaches a use is the last one of the nearest
dominating block that has one. So a use is joined to the definitions of its variable whose interval holds its block's entry, and
takes the one of greatest entry and place: one range join, keyed by method and variable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tuplewright.plans import extensions as X
from tuplewright.plans.engine import Engine, Stored

#: where a phi stands in its block, and a use by a phi behind its predecessor
FIRST, LAST = -1, 2**62


def intervals(dominates: DataFrame, parents: DataFrame) -> DataFrame:
    """m, b, enter, leave from Dominates (m, a, b: each block itself included) and Parent (m, b, a: the nearest other)."""
    sizes = dominates.groupBy("m", F.col("a").alias("b")).agg(F.count("*").alias("size"))
    before = Window.partitionBy("m", "a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parents.join(sizes, ["m", "b"]).select("m", F.col("b").alias("c"), (F.coalesce(F.sum("size").over(before), F.lit(0)) + 1).alias("offset"))
    path = dominates.select("m", F.col("a").alias("c"), "b").join(offsets, ["m", "c"], "left")
    enter = path.groupBy("m", "b").agg(F.coalesce(F.sum("offset"), F.lit(0)).alias("enter"))  # the root has no offset
    return enter.join(sizes, ["m", "b"]).select("m", "b", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))


def reaching(uses: DataFrame, definitions: DataFrame, spans: DataFrame) -> DataFrame:
    """uses (m, v, b, i and more) with at and of: place and block of the definition that reaches, null without one. definitions: m, v, b, at."""
    inside = spans.select("m", "b", F.col("enter").alias("e"))
    wide = definitions.join(spans, ["m", "b"]).select("m", "v", F.col("b").alias("of"), "at", "enter", "leave")
    placed = uses.join(inside, ["m", "b"])
    holds = F.col("e").between(F.col("enter"), F.col("leave")) & ((F.col("enter") < F.col("e")) | (F.col("at") < F.col("i")))
    found = placed.alias("u").join(wide.alias("d"), (F.col("u.m") == F.col("d.m")) & (F.col("u.v") == F.col("d.v")) & holds, "left")
    keys = [F.col(f"u.{c}").alias(c) for c in uses.columns]
    best = found.select(*keys, F.when(F.col("d.at").isNotNull(), F.struct("enter", "at", "of")).alias("d")).groupBy(*uses.columns).agg(F.max("d").alias("d"))
    return best.select(*uses.columns, F.col("d.at").alias("at"), F.col("d.of").alias("of"))


def name(v: str = "v"):
    """A definition's name: v_place, v_phi_block, and v_0 for what is set before the method starts."""
    at = F.col("at")
    return F.concat(F.col(v), F.when(at.isNull(), F.lit("_0")).when(at == FIRST, F.concat(F.lit("_phi_"), F.col("of").cast("string"))).otherwise(F.concat(F.lit("_"), at.cast("string"))))


def renamed(spark: SparkSession, facts: dict[str, DataFrame], uses: DataFrame, wanted: tuple[str, ...] = ("Definition", "Use", "Phi", "PhiArgument")) -> dict[str, DataFrame]:
    """From the facts of control flow with assigns (m, i, v), and uses (m, i, v): Definition and Use (m, i, v, name), Phi (m, b, v, name) and PhiArgument (m, b, v, p, name).

    Code that can't be reached has no names. A method's instructions have numbers from 0 on. Only the wanted ones are made, where
    their methods are.
    """
    engine = Engine(spark, X.SSA, facts, keyed=True)
    run = engine.run("Dominates", "Parent", "Phi", "BlockOf", "BlockSuccessor", "reaches", "assigns")
    block = run["BlockOf"].withColumnRenamed("head", "b").join(run["reaches"], ["m", "b"])
    spans = intervals(run["Dominates"].join(run["reaches"], ["m", "b"]), run["Parent"])
    own = run["assigns"].join(block, ["m", "i"]).select("m", "v", "b", F.col("i").alias("at"))
    phis = run["Phi"].select("m", "v", "b", F.lit(FIRST).cast("long").alias("at"))
    every = own.unionByName(phis)
    used = reaching(uses.join(block, ["m", "i"]).select("m", "v", "b", "i").distinct(), every, spans)
    edges = run["BlockSuccessor"].select("m", F.col("a").alias("p"), "b").join(run["reaches"].withColumnRenamed("b", "p"), ["m", "p"])
    ends = phis.select("m", "v", F.col("b").alias("to")).join(edges.withColumnRenamed("b", "to"), ["m", "to"])
    ends = reaching(ends.select("m", "v", F.col("p").alias("b"), F.lit(LAST).cast("long").alias("i"), "to"), every, spans)
    made = {
        "Definition": own.select("m", F.col("at").alias("i"), "v", F.concat("v", F.lit("_"), F.col("at").cast("string")).alias("name")),
        "Use": used.select("m", "i", "v", name().alias("name")),
        "Phi": phis.select("m", "b", "v", F.concat("v", F.lit("_phi_"), F.col("b").cast("string")).alias("name")),
        "PhiArgument": ends.select("m", F.col("to").alias("b"), "v", F.col("b").alias("p"), name().alias("name")),
    }
    with engine.running():
        return {n: Stored(spark, n, made[n].schema).write(made[n])[0] for n in wanted}


def rewritten(facts: DataFrame, names: dict[str, DataFrame], method: str, place: str, defines: str | None = None, uses: tuple[str, ...] = ()) -> DataFrame:
    """A fact table whose columns that define or use a variable have the new names. Rows whose code can't be reached go."""
    out = facts
    for column, kind in [(defines, "Definition")] * (defines is not None) + [(u, "Use") for u in uses]:
        of = names[kind].select(F.col("m").alias("_m"), F.col("i").alias("_i"), F.col("v").alias("_v"), F.col("name").alias("_name"))
        same = (F.col(method) == F.col("_m")) & (F.col(place) == F.col("_i")) & (F.col(column) == F.col("_v"))
        out = out.join(of, same).select(*(F.col("_name").alias(c) if c == column else F.col(c) for c in out.columns))
    return out
