"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint holds the bits set in over half of the XXH64 (seed 42) of a text's 3-word shingles. Texts
link at RADIUS or fewer differing bits, and components are what links reach.

Method: bit i gets a non-zero vector p(i) of RADIUS + 1 bits. For each of the 2**(RADIUS+1) - 1 non-zero
vectors v there is a table; its mask keeps the bits with odd <p(i), v>, its key is fingerprint & mask.
RADIUS differing bits span at most RADIUS dimensions, so some v is orthogonal to all of their vectors;
that table's mask drops them all and the pair shares its key. No pair within the radius is missed, and
each pair found is compared exactly.

How it is distributed.

* Equal fingerprints collapse first (partial aggregate), so exact copies cost one row however many.
* Each distinct fingerprint goes to 15 buckets of about 34 fixed bits. Partitions sorted by bucket are
  streamed; a bucket's fingerprints are distinct, so it is bounded by how many differ in the ~30 free
  bits only.
* A bucket over ``PAIRWISE`` is dealt anew by covering masks over its free bits, which keeps the
  guarantee; only then, or when nothing is left to deal by, is it compared pair by pair, in blocks.
* A bucket yields a spanning forest of its links (fewer rows than members), never its pairs.
* Components: large-star and small-star rounds on the forest, each saved, by minimum and join; no
  adjacency list is gathered.
* Rows get their class's component by a join in which classes of many copies are broadcast (``join_hot``).

Nulls and edge cases: a null text is the empty text; texts without words have fingerprint zero and link
like any other; fewer than three words are one shingle; a null doc_id never names a component unless
all of the component's are null; repeated rows share a component; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewright.llm.common import bounded, by_bytes, documents, free_name, join_hot, saved, texts

RADIUS = 3
SHINGLE = 3
PAIRWISE = 2048
CHUNK = 1 << 16


def fingerprint(text: str, k: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < k:
        return xxh64_intdigest(b" ".join(words), 42)
    hashes = []
    for a in range(0, len(words) - k + 1, CHUNK):
        part = words[a : a + CHUNK + k - 1]
        hashes.append(np.array([xxh64_intdigest(b" ".join(s), 42) for s in zip(*(part[i:] for i in range(k)), strict=False)], "<u8"))
    return folded_bits(np.concatenate(hashes))


def folded_bits(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[a : a + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp: the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            fps = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def text_hash(column: str):
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit positions of which one drops any ``radius`` of them."""
    top = 1 << (radius + 1)
    vectors = [i % (top - 1) + 1 for i in range(len(bits))]
    return [sum(1 << b for b, p in zip(bits, vectors, strict=True) if (p & v).bit_count() % 2) for v in range(1, top)]


def forest(fps: np.ndarray, free: int = 0, radius: int = RADIUS, pairwise: int = PAIRWISE) -> list[tuple[int, int]]:
    """Links that connect the distinct fps (uint64) exactly as all links within the radius do. free: the bits in which they may differ."""
    parent: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def link(a: int, b: int) -> None:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))

    def compare(x: np.ndarray) -> None:
        for a in range(0, len(x), 512):
            for b in range(a, len(x), 4096):
                near = np.bitwise_count(x[a : a + 512, None] ^ x[None, b : b + 4096]) <= radius
                left, right = np.nonzero(near)
                keep = left + a < right + b
                for i, j in zip((left[keep] + a).tolist(), (right[keep] + b).tolist(), strict=True):
                    link(int(x[i]), int(x[j]))

    def deal(x: np.ndarray, free: int) -> None:
        bits = [i for i in range(64) if free >> i & 1]
        if len(x) <= pairwise or len(bits) < (2 << radius) - 1:  # below, a mask can be empty
            compare(x)
            return
        for mask in covering_masks(bits, radius):
            keys = x & np.uint64(mask)
            order = np.argsort(keys, kind="stable")
            edges = np.flatnonzero(np.diff(keys[order])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(x)], strict=True):
                if b - a > 1:
                    deal(x[order[a:b]], free & ~mask)

    deal(fps, free)
    return out


def links(classes: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """Spanning links a, b between the distinct column fp."""
    masks = covering_masks(list(range(64)), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: int, fps: np.ndarray) -> list[tuple[int, int]]:
            return forest(np.unique(fps).view(np.uint64), ~masks[table] & (1 << 64) - 1, radius, pairwise)

        held: list[np.ndarray] = []  # of the bucket at the end of the last batch
        at = None
        for batch in batches:
            t, key, fp = (batch.column(i).to_numpy() for i in range(3))
            if not len(t):
                continue
            starts = np.concatenate([[0], np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1])
            ends = np.append(starts[1:], len(t))
            out: list[tuple[int, int]] = []
            if at == (int(t[0]), int(key[0])):
                held.append(fp[: ends[0]])
                starts, ends = starts[1:], ends[1:]
            if len(starts):
                if at is not None and sum(map(len, held)) > 1:
                    out += found(at[0], np.concatenate(held))
                last = int(starts[-1])
                at, held = (int(t[last]), int(key[last])), [fp[last:]]
                many = np.flatnonzero(ends[:-1] - starts[:-1] > 1)
                for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                    out += found(int(t[a]), fp[a:b])
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        if at is not None and sum(map(len, held)) > 1:
            pairs = np.array(found(at[0], np.concatenate(held)), np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    keys = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))
    rows = classes.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for each node with an edge, by alternating large-star and small-star rounds."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = saved(small, "small-star")
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def named(rows: DataFrame, classes: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """rows with root (the class that stands for the component) and component_id. classes: key, rep (least id), copies. parts: node, root."""
    least = parts.join(classes, parts.node == classes[key]).groupBy("root").agg(F.min("rep").alias("component"))
    joined = parts.join(least, "root").select(F.col("node").alias(key), "root", "component")
    component = classes.join(joined, key, "left").select(key, "copies", F.coalesce("root", key).alias("root"), F.coalesce("component", "rep").alias("component_id"))
    component = saved(component, "components")
    total = component.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    return join_hot(rows, component, key, "copies", total)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """The operator: doc_id, text_hash, fp, root, component_id for each row."""
    marked = saved(fingerprints(docs), "fingerprints")
    classes = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    parts = saved(components(links(classes, radius, pairwise)), "parts")
    return named(marked, classes, parts, "fp")


def kept(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of each group of near-duplicates the row of least doc_id, with all its columns. Of rows with one id and text one stays; rows without id stay."""
    return firsts(docs, near_duplicates(docs, radius))


def firsts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """kept, for groups (doc_id, text_hash, root) found in docs. A row goes by its id and text: another text under its id is judged by its own group."""
    marked = saved(groups.where("doc_id is not null").select("doc_id", "text_hash", "root"), "groups")
    first = saved(marked.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("copies")), "firsts")
    total = first.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    other = join_hot(marked, first.where("copies > 1"), "root", "copies", total).where(F.struct("doc_id", "text_hash") != F.col("first"))
    names = [free_name(docs, n) for n in ("_id", "_text_hash")]
    of = lambda df: saved(df.select("doc_id", "text_hash").distinct().toDF(*names), "gone")
    same = (F.col("doc_id").cast("long") == F.col(names[0])) & (text_hash("text") == F.col(names[1]))
    out = docs.join(bounded(of(other)), same, "left_anti")
    again = of(marked.groupBy("doc_id", "text_hash").count().where("count > 1"))
    if again.isEmpty():
        return out
    again = bounded(again)
    return out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLES: dict[str, str] = {}
