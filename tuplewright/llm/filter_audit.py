"""Interactions of filters: what each one removes in every order in which they can be applied.

Method: each document fails some of the filters. An SQL CUBE over the failure flags, for each part of the corpus, has a
grouping set for every subset of the filters; its row in which all flags of the subset are false counts the documents
that survive the subset. A step of an order goes from one subset to the next with one more filter, so what it removes
is the difference of a pair of such rows, and all n! orders need n * 2**(n-1) pairs for each part.

* redundant (fails the filter, removed earlier): what the filter alone removes, less what this step removes.
* unique_fails: what the filter removes when all others went before.
* shapley: what it removes at its step, summed over all orders: a pair whose smaller subset has k filters is the
  filter's step in k! (n - 1 - k)! orders.

How it is distributed. One map over the texts gives a narrow row each, saved once. Equal rows collapse before the
labels are joined. Texts are compared by two 64-bit hashes; the least id of each text that several rows have comes
back by a join that broadcasts texts of many copies. Flags are counted by partial aggregate, 2**n rows a part and task at
most, so the cube, the pairs and the orders work on counts alone, whatever the size of a part. Broadcast are the
subsets' steps (n * 2**(n-1) rows) and the orders' (n * n! rows).

Nulls and edge cases: a null text is the empty text; a null source is the part ''; a row without doc_id has no labels,
repeats no other row's text and no row repeats its; rows with one id and text are each counted and don't repeat one
another; a label that repeats counts by its greatest value; no documents, no rows; columns other than doc_id, text
and source are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewright.llm.common import documents, join_hot, saved

SPACES = r"[\x20\x09-\x0D]+"
REPEATS = "E"


def text_filters(text: Column) -> Column:
    """A struct of what a text fails: A few words, B repeated words, C capitals, D symbols."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")

    def of(w: Column) -> Column:
        n = F.size(w)
        capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        return F.struct((n < 50).alias("A"), (100 * F.size(F.array_distinct(w)).cast("long") < 65 * n).alias("B"), (100 * capitals.cast("long") > 5 * F.length(text)).alias("C"), text.rlike(r"[#$%&*|]").alias("D"))

    return F.transform(F.array(words), of)[0]  # the words are made once and bound to a variable


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, the text's hashes and its failures A to D, for each row, rows that are equal in all of these as one with their number n."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"), text_filters(text).alias("f"))
    keys = ["doc_id", "part", "h", "h2", "A", "B", "C", "D"]
    return narrow.select("doc_id", "part", "h", "h2", "f.*").groupBy(*keys).agg(F.count("*").alias("n"))


def with_repeats(rows: DataFrame, name: str = REPEATS) -> DataFrame:
    """rows with the flag name: a smaller doc_id has the same text."""
    key = F.struct("h", "h2")
    known, none = rows.where("doc_id is not null"), rows.where("doc_id is null").withColumn(name, F.lit(False))
    same = known.groupBy("h", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("copies"))
    several = saved(same.where("first < last").select(key.alias("text"), "first", "copies"), "texts")
    total = several.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    again = join_hot(known.withColumn("text", key), several, "text", "copies", total).where(F.col("doc_id") > F.col("first"))
    again = saved(again.select("doc_id", "h", "h2").distinct().withColumn(name, F.lit(True)), "repeats")
    return known.join(again, ["doc_id", "h", "h2"], "left").withColumn(name, F.coalesce(name, F.lit(False))).unionByName(none)


def counted(rows: DataFrame, filters: list[str], labels: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones for each part and each combination of failures."""
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known, none = rows.where("doc_id is not null"), rows.where("doc_id is null")
    joined = known.join(of, "doc_id", "left").unionByName(none, allowMissingColumns=True)
    sums = [F.sum("n").alias("docs"), F.sum(F.when(F.col("quality") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad")]
    return joined.groupBy("part", *filters).agg(*sums)


def survivors(counts: DataFrame, filters: list[str]) -> DataFrame:
    """part, subset (bit i: the filter in place i) and docs, good, bad that no filter of the subset removes; subsets without survivors have zeros."""
    flags, subset = ", ".join(filters), " + ".join(f"{1 << i} * (1 - grouping({f}))" for i, f in enumerate(filters))
    fails = " or ".join(f"coalesce({f}, false)" for f in filters)  # a flag that the grouping set leaves out is null
    cube = counts.sparkSession.sql(
        f"""select part, subset, docs, good, bad from (
              select part, cast({subset} as int) as subset, {fails} as fails, sum(docs) as docs, sum(good) as good, sum(bad) as bad from {{counts}} group by part, cube ({flags}))
            where not fails""",
        counts=counts,
    )
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(cube, ["part", "subset"], "left").select("part", "subset", *map(zero, ("docs", "good", "bad")))


def interactions(counts: DataFrame, filters: list[str]) -> DataFrame:
    """The operator: for each part, order of the filters and step, what is kept, removed and lost. filters: boolean columns of counts, one-letter names, six at most."""
    spark, n = counts.sparkSession, len(filters)
    place = {f: i for i, f in enumerate(filters)}
    moves = [(f, s, s | 1 << i, math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())) for f, i in place.items() for s in range(1 << n) if not s >> i & 1]
    orders = [("".join(o), k + 1, f, sum(1 << place[x] for x in o[:k])) for o in itertools.permutations(filters) for k, f in enumerate(o)]
    moves = F.broadcast(spark.createDataFrame(moves, "filter string, before int, after int, weight long"))
    orders = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, filter string, before int"))
    alive = saved(survivors(counts, filters), "survivors")
    start = alive.select("part", F.col("subset").alias("before"), *(F.col(c).alias(f"{c}_before") for c in ("docs", "good", "bad")))
    end = alive.withColumnRenamed("subset", "after")
    gone = lambda c: F.col(f"{c}_before") - F.col(c)
    pairs = start.join(moves, "before").join(end, ["part", "after"])
    pairs = saved(pairs.select("part", "filter", "before", "weight", F.col("docs").alias("kept"), gone("docs").alias("removed"), gone("good").alias("good_lost"), gone("bad").alias("toxic_lost")), "pairs")
    others = F.lit((1 << n) - 1) - F.element_at(F.create_map(*(F.lit(x) for f, i in place.items() for x in (f, 1 << i))), F.col("filter"))
    alone = pairs.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.col("weight")).alias("shapley"),
    )
    whole = pairs.join(alone, ["part", "filter"]).join(orders, ["filter", "before"])
    return whole.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions of the filters A to D and of repeated texts (E)."""
    filters = ["A", "B", "C", "D", REPEATS]
    rows = with_repeats(saved(measured(docs), "filter-flags"))
    return interactions(saved(counted(rows, filters, labels), "filter-counts"), filters)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLES = {
    "op11_filter_audit": r"""
with recursive d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
firsts as (select t, min(doc_id) as least from d group by t),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad from labels group by doc_id),
f as (select part, cast(len(ws) < 50 as int) as a, cast(100 * len(list_distinct(ws)) < 65 * len(ws) as int) as b,
  cast(100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 5 * length(d.t) as int) as c, cast(regexp_matches(d.t, '[#$%&*|]') as int) as dd,
  cast(coalesce(d.doc_id > least, false) as int) as e, coalesce(good, 0) as good, coalesce(bad, 0) as bad
  from d join firsts on firsts.t = d.t left join l on l.doc_id = d.doc_id),
g as (select part, a + 2 * b + 4 * c + 8 * dd + 16 * e as fails, count(*) as n, sum(good) as good, sum(bad) as bad from f group by all),
letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o(filter_order, step, letter, bit, before) as (select letter, 1, letter, bit, 0 from letters
  union all select o.filter_order || l.letter, o.step + 1, l.letter, l.bit, o.before + o.bit from o, letters l where o.step < 5 and (o.before + o.bit) & l.bit = 0),
steps as (select w.filter_order, s.step, s.bit, s.before from o w join o s on s.step <= 5 and starts_with(w.filter_order, s.filter_order) where w.step = 5),
r as (select part, filter_order, step, bit,
  sum(case when fails & (before | bit) = 0 then n else 0 end) as kept, sum(case when fails & before = 0 and fails & bit <> 0 then n else 0 end) as removed,
  sum(case when fails & before <> 0 and fails & bit <> 0 then n else 0 end) as redundant, sum(case when fails = bit then n else 0 end) as unique_fails,
  sum(case when fails & before = 0 and fails & bit <> 0 then g.good else 0 end) as good_lost, sum(case when fails & before = 0 and fails & bit <> 0 then g.bad else 0 end) as toxic_lost
  from g, steps group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, bit) as bigint) as shapley from r"""
}
