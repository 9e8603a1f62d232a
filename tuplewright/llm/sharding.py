"""Sharding under the law ``bytes``: shards of near equal size, groups of equal texts kept whole.

Method: best-fit decreasing bin packing. Groups, sorted by falling size, each enter the bin with the
tightest remaining capacity that still holds them, found in a balanced tree of bins. The capacity is the
least, by bisection, at which the groups need no more bins than there are shards.

How it is distributed. Groups of one size are interchangeable, so the packing is a function of the
histogram of group sizes, and a run of equal groups fills the tightest bin until that one no longer
fits. Sizes are rounded up to ``STEPS`` classes an octave (exact up to 2 * STEPS, within 1/STEPS above),
at most ``STEPS * 54`` classes, so what the driver reads and plans with has a fixed bound at any input
size. The plan says which ranks of a class go to which bin; ranks are made by salted windows, so that a
class with a third of all groups is spread, and a group's bin is joined to its documents by text hash
(AQE splits a large group). A hash clash would only join two groups; it cannot split one.

A group that is larger than an equal share of what is left gets a shard of its own; no packing without
splitting it is more even.

Slots number a shard's documents without gaps, by salted windows as well.

Nulls and edge cases: a null text counts as empty (size 8) and is one group with the empty text; a null
doc_id is kept; repeated rows get slots of their own; an empty table gives no rows; fewer groups than
shards leave shards empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tuplewright.llm.common import documents, saved

SHARDS = 24
STEPS = 2048
SALT_ROWS = 2000


class BinTree:
    """Bins by remaining capacity in a treap: a search tree on (remaining, bin) kept balanced by a hash of the bin."""

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _split(node, key):
        """Nodes below the key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = BinTree._split(node[3], key)
            node[3] = a
            return node, b
        a, b = BinTree._split(node[2], key)
        node[2] = b
        return a, node

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = BinTree._merge(a[3], b)
            return a
        b[2] = BinTree._merge(a, b[2])
        return b

    def add(self, remaining: int, bin_: int) -> None:
        key = (remaining, bin_)
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, (bin_ * 0x9E3779B97F4A7C15) & 0xFFFFFFFF, None, None]), b)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin of least remaining capacity that holds size."""
        below, rest = self._split(self.root, (size, -1))
        if rest is None:
            self.root = below
            return None
        if rest[2] is None:
            found, rest = rest[0], rest[3]
        else:
            node = rest
            while node[2][2] is not None:
                node = node[2]
            found, node[2] = node[2][0], node[2][3]
        self.root = self._merge(below, rest)
        return found


def best_fit(histogram: list[tuple[int, int]], capacity: int, most: int) -> list[tuple[int, int, int]] | None:
    """(size, count) by falling size to runs (size, count, bin); None if over ``most`` bins are needed."""
    tree, bins, runs = BinTree(), 0, []
    for size, count in histogram:
        while count:
            found = tree.take_tightest(size)
            if found is None:
                if bins == most:
                    return None
                found = (capacity, bins)
                bins += 1
            remaining, bin_ = found
            n = min(count, remaining // size)
            runs.append((size, n, bin_))
            count -= n
            tree.add(remaining - n * size, bin_)
    return runs


def plan(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs (size, count, shard) at the least capacity found; sizes over an equal share get their own shards first."""
    left = sorted(((s, c) for s, c in histogram if c), reverse=True)
    total, runs, first = sum(s * c for s, c in left), [], 0
    while left and first < shards - 1 and left[0][0] * (shards - first) > total:
        size, count = left[0]
        runs.append((size, 1, first))
        total -= size
        first += 1
        left = ([(size, count - 1)] if count > 1 else []) + left[1:]
    if not left:
        return runs
    bins = shards - first
    low = max(left[0][0], -(-total // bins))
    high = 2 * low
    best = best_fit(left, low, bins)
    if best is None:
        best = best_fit(left, high, bins)
        while high - low > 1:
            middle = (low + high) // 2
            found = best_fit(left, middle, bins)
            if found is None:
                low = middle
            else:
                high, best = middle, found
    return runs + [(s, n, first + b) for s, n, b in best]


def size_class(size: Column) -> Column:
    """The size rounded up to STEPS classes an octave."""
    k = F.greatest(F.lit(0), F.length(F.bin(size - 1)) - F.lit((2 * STEPS).bit_length() - 1))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), k)
    return F.call_function("shiftleft", F.call_function("shiftright", size + unit - 1, k), k)


def salted_rank(df: DataFrame, keys: list[str], salt: Column, salts: int, order: list, name: str) -> DataFrame:
    """df with a gapless rank from 0 within keys. Windows cover one salt of a key, and a window of at most ``salts`` rows adds up the salts."""
    df = df.withColumn("_salt", F.pmod(salt, F.lit(salts)))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys, "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
    return ranked.join(offsets, [*keys, "_salt"]).withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_before", "_row", "_salt")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The operator: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digests = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    digests = saved(digests, "digests")
    groups = saved(digests.groupBy("h").agg(size_class(F.sum("size")).alias("class"), F.count("*").alias("n")), "groups")
    histogram = [(r[0], r[1], r[2]) for r in groups.groupBy("class").agg(F.count("*"), F.sum("n")).collect()]  # STEPS * 54 rows at most
    n_groups, n_docs = sum(r[1] for r in histogram), sum(r[2] for r in histogram)
    ranges: dict[int, list[tuple[int, int]]] = {}
    for size, n, shard_ in plan([r[:2] for r in histogram], shards):
        mine = ranges.setdefault(size, [])
        mine.append(((mine[-1][0] if mine else 0) + n, shard_))
    planned = spark.createDataFrame(list(ranges.items()), "class long, ranges array<struct<hi:long,shard:int>>")
    salts = lambda n: max(1, min(1 << 16, -(-n // SALT_ROWS)))
    ranked = salted_rank(groups.select("h", "class"), ["class"], F.xxhash64("h"), salts(n_groups), ["h"], "rank")
    placed = ranked.join(F.broadcast(planned), "class").select("h", F.filter("ranges", lambda r: F.col("rank") < r["hi"])[0]["shard"].alias("shard"))
    assigned = saved(digests.join(placed, "h").select("doc_id", "size", "text_crc32", "shard"), "assigned")
    out = salted_rank(assigned, ["shard"], F.xxhash64("doc_id", "text_crc32"), salts(n_docs // shards), ["doc_id", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


QUERIES = {"op1_sharding": op1_sharding}
ORACLES: dict[str, str] = {}
