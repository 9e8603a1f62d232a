"""Near-duplicates by HyperMinHash: banded registers propose pairs, a corrected estimate thins them, whole sets confirm them.

A document's set are its distinct 5-word shingles (of ``bytes.lower().split()`` words, hashed by XXH64); texts with fewer words
are one shingle, texts without words have none and link with nothing. Sets link at a Jaccard similarity of NUM/DEN or more;
components are what links reach.

Method. The top seven bits of a shingle's hash name one of 128 buckets. Of the least remainder in a bucket its register
keeps the number of leading zeros (6 bits) and the ten bits behind the leading one (the mantissa). A bucket that
no shingle meets takes the register of the first bucket that has one, in an order of its own, so registers of small
sets agree as often as those of large ones. Four registers are 64 bits, the key of a band; sets that share one of the
32 keys are candidates. At the least similarity four registers agree with probability 0.52, so a pair misses all
bands once in 10**10. A candidate's similarity is estimated from the registers that agree, less those that agree by
chance: the probability that registers of two unlike sets of these sizes hold one value, summed over the values. Pairs
whose estimate reaches FLOOR (seven standard errors below the threshold) are compared by their whole sets.

How it is distributed.

* Equal sets collapse to one class first (a 128-bit digest), so exact copies cost a row however many.
* A band's key with one class is dropped. Before registers are joined, members of a bucket are compared by two bits of
  each register, 32 bytes a set, which unlike sets differ in too often: FAR bits or fewer pass.
* First round: buckets of up to SMALL members give all pairs, of a larger one each member its nearest within tiles of TILE
  members; confirmed links make components. Second round: of larger buckets all pairs between different components, in pairs of tiles,
  but for those that the sets' parity sketches (shingles.py) exclude for certain, which most of the pairs below the threshold are.
  So a group of near copies does not give its square of pairs, and no bucket is gathered in one task; no candidate is left out.
* Whole sets are built from the texts of candidates that pass, and compared by joins.

Nulls and edge cases: a null text is the empty text; a null doc_id never names a component unless all of the
component's are null, and is kept only then; repeated rows share a component; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewright.llm.common import bounded, by_bytes, documents, join_hot, saved, texts
from tuplewright.llm.shingles import SKETCH_BYTES, folded, hashed, sketch, within
from tuplewright.llm.simhash import components

NUM, DEN = 17, 20
BUCKET_BITS, MANTISSA = 7, 10
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // 4
FLOOR = 0.6
FAR = 62
SMALL = 8
TILE = 4096
BITS = ("b0", "b1", "b2", "b3")

#: for each bucket the order in which an empty one looks for a register
PROBES = np.argsort(np.random.default_rng(BUCKETS).random((BUCKETS, BUCKETS)), axis=1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 128 registers (uint16) of the ascending distinct hashes (uint64, one at least)."""
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
    least = hashes[first] << np.uint64(BUCKET_BITS)
    zeros = np.minimum(53 - np.frexp((least >> np.uint64(11)).astype(np.float64))[1], 64 - BUCKET_BITS)
    mantissa = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out, has = np.zeros(BUCKETS, np.uint16), np.zeros(BUCKETS, bool)
    at = bucket[first]
    out[at], has[at] = (zeros << MANTISSA) | mantissa.astype(np.int64), True
    return np.where(has, out, out[PROBES[np.arange(BUCKETS), has[PROBES].argmax(1)]])


def short(register: np.ndarray) -> np.ndarray:
    """Two bits of each register: four longs."""
    mixed = (register.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(30)
    return np.packbits(np.stack([mixed & 1, mixed >> 1]).astype(np.uint8).ravel(), bitorder="little").view("<i8")


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that a register of a set of n and one of an unlike set of m members agree.

    A bucket's least remainder is exponential at the bucket's load; a cell of the value (zeros, mantissa) has width 2**-(zeros + 1 + MANTISSA).
    """
    x, y = n / BUCKETS, m / BUCKETS
    k = np.arange(64 - BUCKET_BITS)[:, None]
    inside = np.exp(-(x + y) * 2.0 ** -(k + 1)) - np.exp(-(x + y) * 2.0**-k)
    return (inside * 2.0 ** -(k + 1 + MANTISSA)).sum(0) * x * y / (x + y) / (np.expm1(-x) * np.expm1(-y))


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarities of sets of n and m members by their registers (rows of a and b)."""
    by_chance = chance(n.astype(float), m.astype(float))
    return ((a == b).mean(1) - by_chance) / (1 - by_chance)


MARKED = "doc_id long, h long, h2 long, digest binary, n long, regs binary, sketch binary"


def marked(docs: DataFrame) -> DataFrame:
    """For each row doc_id, the text's hashes, its set's digest and size, and, with the first of a task's equal sets only, registers and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        seen: set[bytes] = set()
        for batch in by_bytes(batches):
            digests, sizes, regs, sketches = [], [], [], []
            for t in texts(batch):
                h = np.unique(hashed(t))
                digest = xxh3_128_digest(h.tobytes())
                digests.append(digest)
                sizes.append(len(h))
                new = len(h) > 0 and digest not in seen
                seen.add(digest)
                regs.append(registers(h).tobytes() if new else None)
                bitmap = sketch(h.view(np.int64)) if new else None
                sketches.append(folded(bitmap, min(len(bitmap), SKETCH_BYTES)).tobytes() if new else None)
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in MARKED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *text_hashes("text")).mapInArrow(run, MARKED)


def text_hashes(column: str) -> list:
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2")]


def classes_of(rows: DataFrame) -> DataFrame:
    """One row for each set that isn't empty: its number cls, digest, least doc_id, copies, size, one text's hashes, registers and their short form, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            bits = np.array([short(r) for r in regs], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(bits[:, i].copy()) for i in range(4))], [*batch.schema.names, *BITS])

    one = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.min(F.struct("h", "h2")).alias("t"), F.max("regs").alias("regs"), F.max("sketch").alias("sketch"))
    one = one.select("digest", "rep", "copies", "n", "t.h", "t.h2", "regs", "sketch")
    schema = "digest binary, rep long, copies long, n long, h long, h2 long, regs binary, sketch binary, " + ", ".join(f"{b} long" for b in BITS)
    return saved(one.mapInArrow(run, schema).withColumn("cls", F.monotonically_increasing_id()), "hmh-classes")


def live_bands(classes: DataFrame) -> DataFrame:
    """key, cls, of: the bands' keys that several classes have, and how many."""
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("regs", 8 * i + 1, 8)) for i in range(BANDS)))
    bands = saved(classes.select("cls", F.explode(F.array_distinct(keys)).alias("key")), "hmh-bands")
    several = saved(bands.groupBy("key").agg(F.count("*").alias("of")).where("of > 1").withColumn("copies", F.col("of")), "hmh-keys")
    total = several.agg(F.coalesce(F.sum("of"), F.lit(0))).first()[0]
    return saved(join_hot(bands, several, "key", "copies", total).select("key", "cls", "of"), "hmh-live")


def fits(far: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (far <= FAR) & (NUM * n <= DEN * m) & (NUM * m <= DEN * n)


def bucket(cls: np.ndarray, n: np.ndarray, bits: np.ndarray, part: np.ndarray, sketches: list[bytes] | None) -> np.ndarray:
    """Pairs of a bucket's members (n ascending) in different parts that may be similar; without sketches: for each member its nearest only."""
    m, out = len(cls), [np.zeros((0, 2), np.int64)]
    if part.min() == part.max():
        return out[0]
    best, of = np.full(m, 1 << 30), np.full(m, -1)
    for a in range(0, m, 256):
        rows = slice(a, min(m, a + 256))
        end = int(np.searchsorted(n, DEN * n[rows][-1] // NUM, "right"))
        for b in range(a, end, 4096):
            cols = slice(b, min(end, b + 4096))
            ok = (part[rows, None] != part[None, cols]) & (np.arange(a, rows.stop)[:, None] < np.arange(b, cols.stop)[None])
            if not ok.any():
                continue
            far = sum(np.bitwise_count(bits[rows, None, k] ^ bits[None, cols, k]).astype(np.int32) for k in range(4))
            ok &= fits(far, n[rows, None], n[None, cols])
            if sketches is not None:
                i, j = np.nonzero(ok)
                i, j = i + a, j + b
                found = within(i, j, n, sketches, NUM, DEN)
                out.append(np.stack([cls[i[found]], cls[j[found]]], 1))
                continue
            far = np.where(ok, far, 1 << 30)
            for ids, other, d in ((rows, b, far), (cols, a, far.T)):
                at = d.argmin(1)
                low = d[np.arange(len(at)), at]
                better = low < best[ids]
                of[ids] = np.where(better, at + other, of[ids])
                best[ids] = np.where(better, low, best[ids])
    if sketches is None:
        i = np.flatnonzero(of >= 0)
        out.append(np.stack([cls[i], cls[of[i]]], 1))
    return np.concatenate(out)


def proposed(live: DataFrame, sets: DataFrame, nearest: bool) -> DataFrame:
    """Distinct pairs a < b in one bucket and tile that may be similar and are in different parts. live: key, tile, cls; sets: cls, n, bits, part, and sketch unless nearest."""
    names = ["key", "tile", "cls", "n", *BITS, "part"] + ["sketch"] * (not nearest)

    def pairs(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, tile, cls, n, part = (cols[i] for i in (0, 1, 2, 3, 8))
        bits = np.stack(cols[4:8], 1).view(np.uint64)
        key = np.cumsum(np.append(True, (np.diff(key) != 0) | (np.diff(tile) != 0)))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        sizes = np.diff(np.append(starts, len(key)))
        of = np.repeat(sizes, sizes)
        out = [np.zeros((0, 2), np.int64)]
        for s in range(1, SMALL):  # all pairs of small buckets at once
            i = np.flatnonzero((key[:-s] == key[s:]) & (of[:-s] <= SMALL)) if s < len(key) else np.zeros(0, np.int64)
            j = i + s
            ok = fits(np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64), n[i], n[j]) & (part[i] != part[j])
            out.append(np.stack([cls[i[ok]], cls[j[ok]]], 1))
        for a, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            out.append(bucket(cls[a : a + size], n[a : a + size], bits[a : a + size], part[a : a + size], None if nearest else cols[9][a : a + size].tolist()))
        both = np.unique(np.sort(np.concatenate(out), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the tile at the end of the last batch
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy(zero_copy_only=names[i] != "sketch") for i in range(len(names))])
            if held[0][0][0] == held[-1][0][-1] and held[0][1][0] == held[-1][1][-1]:
                continue  # one tile so far
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1]) + 1
            yield pairs([c[:last] for c in cols])
            held = [[c[last:] for c in cols]]
        if held:
            yield pairs([np.concatenate(c) for c in zip(*held, strict=True)])

    rows = live.join(sets, "cls").select(*names)
    return rows.repartition("key", "tile").sortWithinPartitions("key", "tile", "n", "cls").mapInArrow(run, "a long, b long").distinct()


def dealt(live: DataFrame) -> DataFrame:
    """Each bucket's members in tiles of about TILE."""
    return live.select("key", F.pmod(F.xxhash64("cls", "key"), F.ceil(F.col("of") / TILE)).alias("tile"), "cls")


def crossed(live: DataFrame, sets: DataFrame) -> DataFrame:
    """The larger buckets whose members are in different parts, those of more than TILE in tiles for each two of their shares."""
    large = live.where(F.col("of") > SMALL)
    mixed = large.join(sets.select("cls", "part"), "cls").groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("key")
    large = large.join(bounded(saved(mixed, "hmh-mixed")), "key")
    tiles = F.ceil(F.col("of") / TILE)
    split = large.select("key", "cls", tiles.alias("tiles"), F.pmod(F.xxhash64("cls"), tiles).alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("j"))
    return split.select("key", (F.least("share", "j") * F.col("tiles") + F.greatest("share", "j")).alias("tile"), "cls")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs whose estimated similarity reaches FLOOR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("regs_a", "regs_b"))
            yield batch.select(["a", "b"]).filter(pa.array(estimate(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) >= FLOOR))

    of = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a long, b long")


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs whose whole sets, built from one text each, have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(hashed(t)).view(np.int64) for t in texts(batch)], pa.list_(pa.int64()))], ["cls", "set"])

    nodes = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = saved(classes.join(nodes, "cls").select("cls", F.col("h").alias("wanted_h"), F.col("h2").alias("wanted_h2")), "hmh-wanted")
    text = docs.select(F.col("text").cast("string").alias("text"), *text_hashes("text"))
    found = text.join(bounded(wanted), (F.col("h") == F.col("wanted_h")) & (F.col("h2") == F.col("wanted_h2"))).select("cls", "text").dropDuplicates(["cls"])
    sets = saved(found.mapInArrow(run, "cls long, set array<long>"), "hmh-sets")
    of = lambda c: sets.select(F.col("cls").alias(c), F.col("set").alias(f"set_{c}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where((NUM + DEN) * both >= NUM * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def linked(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, root of every class with a link to another."""
    live = live_bands(classes)
    sets = classes.select("cls", "n", *BITS)
    first = saved(likely(proposed(dealt(live), sets.withColumn("part", F.col("cls")), True), classes), "hmh-nearest")
    links = saved(confirmed(docs, classes, first), "hmh-links")
    parts = saved(components(links), "hmh-parts")
    joined = saved(classes.join(parts, classes.cls == parts.node, "left").select("cls", "n", *BITS, "sketch", F.coalesce("root", "cls").alias("part")), "hmh-sets-parts")
    second = saved(likely(proposed(crossed(live, joined), joined, False).join(first, ["a", "b"], "left_anti"), classes), "hmh-others")
    if second.isEmpty():
        return parts
    more = saved(confirmed(docs, classes, second), "hmh-links")
    return parts if more.isEmpty() else saved(components(links.unionByName(more)), "hmh-parts")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The operator: doc_id, n_shingles, component_id, kept for each row."""
    rows = saved(marked(docs), "hmh-rows")
    classes = classes_of(rows)
    parts = linked(docs, classes)
    least = parts.join(classes.select("cls", "rep"), parts.node == F.col("cls")).groupBy("root").agg(F.min("rep").alias("least"))
    named = classes.select("cls", "digest", "rep", "copies").join(parts.join(least, "root"), F.col("cls") == F.col("node"), "left")
    named = saved(named.select("digest", "copies", F.coalesce("least", "rep").alias("component_id")), "hmh-components")
    total = named.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    some = join_hot(rows.where("n > 0").select("doc_id", "n", "digest"), named, "digest", "copies", total)
    out = some.select("doc_id", "n", "component_id").unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op12_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op12_hyperminhash": op12_hyperminhash}
ORACLES: dict[str, str] = {}
