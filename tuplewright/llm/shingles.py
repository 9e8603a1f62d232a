"""Near-duplicates by Jaccard similarity of word shingles: SimHash by covering masks, then a join that misses none.

Texts link when their sets of SHINGLE-word shingles (of ``bytes.lower().split()`` words, hashed by XXH64) have a
Jaccard similarity of NUM/DEN or more; components are what links reach. At that similarity 64-bit SimHash fingerprints
differ in about ten bits, and covering masks for r bits need 2**(r+1) - 1 tables, so the masks of simhash.py propose the
nearest pairs only (RADIUS bits, fingerprints of these shingles) and a set-similarity join proposes the rest.

Method of the join. Shingles get one global order. Two sets of similarity t share a shingle among the first
n - ceil(t n) + 1 of each (prefix filter), so pairs that share such a shingle are all pairs there can be. A pair
is dropped before its sets are compared only by what excludes it for certain: sizes n < t m, or parity bitmaps
(bit i: parity of the set's hashes with low bits i) that differ in more bits than the sets may in members: first
bitmaps of 256 bits, then sketches of two to four bits a member.

The order puts shingles first that are rare in a sample. Any order finds the same pairs; this one keeps
common lines out of the prefixes.

How it is distributed.

* Equal sets collapse first, so exact copies cost one row however many; a task sends a set's prefix once.
* Prefix shingles with a single set are dropped before the sets' sizes and bitmaps are joined on. Shingles that the
  sample shows to be common (``COMMON`` at most) are counted by partial aggregate instead of being gathered by key.
* First round: SimHash's links, and of each bucket each member's nearest only, within tiles of ``TILE`` members, are
  compared and joined to components. Second round: all pairs of a bucket between different components, in
  pairs of tiles, that pass the sketches too; buckets of one component are left out. So neither a large group of near
  copies nor a passage that many texts share gives its square of pairs, and no bucket is gathered into one task.
  Sketches go to buckets of more than ``SMALL`` members, folded to ``SKETCH_BYTES`` at most.
* Sets are built from the texts of pairs that the sketches leave only, and compared by a join.

A bucket's second round is bounded by its members in different components. A shingle that is common among unlike texts
of common shingles only makes a large bucket: its work grows with the square, a task's doesn't.

Nulls and edge cases: a null text is the empty text; texts without words are equal to each other and like no
other; fewer than SHINGLE words are one shingle; a null doc_id never names a component unless all of the component's
are null; repeated rows share a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuplewright.llm import simhash
from tuplewright.llm.common import bounded, by_bytes, saved, texts

SHINGLE = 5
NUM, DEN = 4, 5
SAMPLE = 20_000
COMMON = 200_000
SMALL = 8
TILE = 4096
SKETCH_BYTES = 1024
CHUNK = 1 << 16
BITS = ("b0", "b1", "b2", "b3")


def hashed(text: str, k: int = SHINGLE) -> np.ndarray:
    """The hashes of the text's shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if len(words) < k:
        return np.array([xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    out = []
    for a in range(0, len(words) - k + 1, CHUNK):
        part = words[a : a + CHUNK + k - 1]
        out.append(np.array([xxh64_intdigest(b" ".join(s), 42) for s in zip(*(part[i:] for i in range(k)), strict=False)], np.uint64))
    return np.concatenate(out)


def shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending (signed)."""
    return np.unique(hashed(text, k).view(np.int64))


def sketch(hashes: np.ndarray) -> bytes:
    """A parity bitmap of two to four bits a hash, 256 at least."""
    size = 1 << max(8, (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount(hashes & (size - 1), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(bitmap: bytes | np.ndarray, size: int) -> np.ndarray:
    """A sketch at a smaller power of two of bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(bitmap, np.uint8).reshape(-1, size), axis=0)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Four longs. Two sets' differ in no more bits than the sets differ in members."""
    return folded(sketch(hashes), 32).view("<i8")


def apart(a: bytes, b: bytes) -> int:
    """In how many members two sets differ at least, by their sketches."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum(dtype=np.int64))


def common(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are in three or more texts of a sample, ascending, and in how many: for the order only."""
    share = min(1 << 30, max(1, (sample << 30) // max(1, docs.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            for t in texts(batch):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t))], ["h"])

    text = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share).dropDuplicates(["text"])
    found = text.mapInArrow(run, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, n = (found.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(h)
    return h[order], n[order]


MARKED = "doc_id long, text_hash long, cls long, n long, fp long, b0 long, b1 long, b2 long, b3 long, sketch binary, short binary, prefix array<long>, often array<long>"


def marked(docs: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """For each row doc_id, text_hash, and of its set: a digest cls, the size n, fingerprint, parity bitmaps, and the prefix's
    rare and often shingles; bitmaps and prefix with the first of a task's equal sets only."""
    shared = docs.sparkSession.sparkContext.broadcast(often)
    names = [c.split()[0] for c in MARKED.split(", ")]

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        known, counts = shared.value
        none, seen = np.zeros(0, np.int64), set()
        for batch in by_bytes(batches):
            rows, bits, sketches, short, rare, frequent = [], [], [], [], [], []
            for t in texts(batch):
                every = hashed(t)
                h = np.unique(every.view(np.int64))
                cls = xxh3_64_intdigest(h.tobytes())
                new = cls not in seen
                seen.add(cls)
                rows.append((cls, len(h), simhash.folded_bits(every)))
                bitmap = sketch(h) if new else None
                sketches.append(bitmap)
                short.append(folded(bitmap, min(len(bitmap), SKETCH_BYTES)).tobytes() if new else None)
                bits.append(folded(bitmap, 32).view("<i8") if new else np.zeros(4, np.int64))
                if not new:
                    rare.append(none)
                    frequent.append(none)
                    continue
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                weight = np.where(known[at] == h, counts[at], 0) if len(known) else np.zeros(len(h), np.int64)
                first = np.lexsort((h, weight))[: len(h) - -(-NUM * len(h) // DEN) + 1 if len(h) else 0]
                rare.append(h[first[weight[first] == 0]])
                frequent.append(h[first[weight[first] > 0]])
            b = np.array(bits, np.int64).reshape(-1, 4)
            whole = [pa.array(np.array([r[i] for r in rows], np.uint64).view(np.int64)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *whole, *(pa.array(b[:, i].copy()) for i in range(4)), pa.array(sketches, pa.binary()), pa.array(short, pa.binary()), lists(rare), lists(frequent)], names)

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), simhash.text_hash("text").alias("text_hash"))
    return given.mapInArrow(run, MARKED)


def buckets(rows: DataFrame) -> DataFrame:
    """key, cls, of: the prefixes' shingles that more than one set has, and how many rows have each."""
    rare = rows.select("cls", F.explode("prefix").alias("key"))
    by_key = Window.partitionBy("key")
    rare = rare.withColumns({"of": F.count("*").over(by_key), "least": F.min("cls").over(by_key), "most": F.max("cls").over(by_key)})
    often = rows.select("cls", F.explode("often").alias("key"))
    counts = F.broadcast(often.groupBy("key").agg(F.count("*").alias("of"), F.min("cls").alias("least"), F.max("cls").alias("most")))  # COMMON rows at most
    return rare.unionByName(often.join(counts, "key")).where("least <> most").select("key", "cls", "of")


def within(i: np.ndarray, j: np.ndarray, n: np.ndarray, sketches: list[bytes], num: int = NUM, den: int = DEN) -> np.ndarray:
    """Which of the pairs i, j the members' sketches don't exclude at a similarity of num/den."""
    ok, sizes = np.ones(len(i), bool), np.array([len(s) for s in sketches])
    size = np.minimum(sizes[i], sizes[j])
    for k in np.unique(size).tolist():
        at, rows = np.flatnonzero(size == k), np.flatnonzero(sizes >= k)
        place = np.zeros(len(sketches), np.int64)
        place[rows] = np.arange(len(rows))
        flat = np.stack([folded(sketches[r], k) for r in rows.tolist()]).view(np.uint64)
        for a in range(0, len(at), 4096):
            x, y = i[at[a : a + 4096]], j[at[a : a + 4096]]
            far = np.bitwise_count(flat[place[x]] ^ flat[place[y]]).sum(1, dtype=np.int64)
            ok[at[a : a + 4096]] = (den + num) * far <= (den - num) * (n[x] + n[y])
    return ok


def bucket(cls: np.ndarray, n: np.ndarray, bits: np.ndarray, part: np.ndarray, sketches: list[bytes] | None) -> list[np.ndarray]:
    """Pairs of a bucket's members (n ascending) in different parts that may be similar; without sketches: for each member its nearest only."""
    m, out = len(cls), []
    if part.min() == part.max():
        return out
    best, of = np.full(m, 1 << 30), np.full(m, -1)
    for a in range(0, m, 256):
        rows = slice(a, min(m, a + 256))
        end = int(np.searchsorted(n, DEN * n[rows][-1] // NUM, "right"))
        for b in range(a, end, 4096):
            cols = slice(b, min(end, b + 4096))
            far = np.bitwise_count(bits[rows, None, :] ^ bits[None, cols, :]).sum(2, dtype=np.int32)
            x, y = n[rows, None], n[None, cols]
            ok = ((DEN + NUM) * far <= (DEN - NUM) * (x + y)) & (NUM * y <= DEN * x) & (part[rows, None] != part[None, cols])
            ok &= np.arange(a, rows.stop)[:, None] < np.arange(b, cols.stop)[None]
            if sketches is not None:
                i, j = np.nonzero(ok)
                i, j = i + a, j + b
                found = within(i, j, n, sketches)
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
    return out


def proposed(live: DataFrame, sets: DataFrame, nearest: bool) -> DataFrame:
    """Distinct pairs a < b that share a bucket and tile, may be similar and are in different parts. live: key, tile, cls; sets: cls, n, bitmap, part."""
    names = ["key", "tile", "cls", "n", *BITS, "part"] + ["sketch"] * (not nearest)

    def pairs(cols: list[np.ndarray]) -> pa.RecordBatch:
        new = np.append(True, (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0))
        key, tile, cls, n, part = (cols[i][new] for i in (0, 1, 2, 3, 8))  # a set that tasks sent anew is there once
        bits = np.stack(cols[4:8], 1).view(np.uint64)[new]
        key = np.cumsum(np.append(True, (np.diff(key) != 0) | (np.diff(tile) != 0)))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        sizes = np.diff(np.append(starts, len(key)))
        of = np.repeat(sizes, sizes)
        out = [np.zeros((0, 2), np.int64)]
        for s in range(1, SMALL):  # all pairs of small buckets at once
            i = np.flatnonzero((key[:-s] == key[s:]) & (of[:-s] <= SMALL)) if s < len(key) else np.zeros(0, np.int64)
            j = i + s
            far = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
            ok = ((DEN + NUM) * far <= (DEN - NUM) * (n[i] + n[j])) & (NUM * n[j] <= DEN * n[i]) & (part[i] != part[j])
            out.append(np.stack([cls[i[ok]], cls[j[ok]]], 1))
        for a, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            sketches = None if nearest else cols[9][new][a : a + size].tolist()
            out += bucket(cls[a : a + size], n[a : a + size], bits[a : a + size], part[a : a + size], sketches)
        both = np.unique(np.sort(np.concatenate(out), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the tile at the end of the last batch
        same = lambda x, i, y, j: x[0][i] == y[0][j] and x[1][i] == y[1][j]
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=names[i] != "sketch") for i in range(len(names))]
            if not held or same(held[-1], -1, cols, -1):
                held.append(cols)
                continue
            cols = [np.concatenate(c) for c in zip(*held, cols, strict=True)]
            last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1]) + 1
            yield pairs([c[:last] for c in cols])
            held = [[c[last:] for c in cols]]
        if held:
            yield pairs([np.concatenate(c) for c in zip(*held, strict=True)])

    rows = live.join(sets, "cls")
    if not nearest:  # a small bucket's pairs are few
        rows = rows.withColumn("sketch", F.when(F.col("of") > SMALL, F.col("sketch")).otherwise(F.lit(b"")))
    rows = rows.select(*names).repartition("key", "tile").sortWithinPartitions("key", "tile", "n", "cls")
    return rows.mapInArrow(run, "a long, b long").distinct()


def dealt(live: DataFrame) -> DataFrame:
    """Each bucket's members in tiles of about TILE."""
    tiles = F.ceil(F.col("of") / TILE)
    return live.select("key", F.pmod(F.xxhash64("cls", "key"), tiles).alias("tile"), "cls", "of")


def crossed(live: DataFrame, parts: DataFrame) -> DataFrame:
    """Buckets whose members are in different parts, those of more than TILE in tiles for each two of their shares. parts: cls, part."""
    small = live.where(F.col("of") <= SMALL).select("key", F.lit(0).cast("long").alias("tile"), "cls", "of")
    large = live.where(F.col("of") > SMALL)
    mixed = large.join(parts, "cls").groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("key")
    large = large.join(bounded(saved(mixed, "mixed")), "key")
    tiles = F.ceil(F.col("of") / TILE)
    shares = F.sequence(F.lit(0).cast("long"), tiles - 1)
    dealt = large.select("key", "cls", "of", tiles.alias("tiles"), F.pmod(F.xxhash64("cls"), tiles).alias("share"), F.explode(shares).alias("j"))
    return small.unionByName(dealt.select("key", (F.least("share", "j") * F.col("tiles") + F.greatest("share", "j")).alias("tile"), "cls", "of"))


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs that sizes and sketches don't exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            far = np.array([apart(a, b) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((DEN + NUM) * far <= (DEN - NUM) * n))

    of = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(F.greatest("n_a", "n_b") * NUM <= F.least("n_a", "n_b") * DEN)
    return both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def hash_links(classes: DataFrame) -> DataFrame:
    """Pairs a < b of sets that SimHash's covering masks link, the sets of one fingerprint through the least of them."""
    heads = saved(classes.groupBy("fp").agg(F.min("cls").alias("head")), "heads")
    of = lambda c, x: heads.select(F.col("fp").alias(c), F.col("head").alias(x))
    linked = simhash.links(heads.select("fp")).join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    equal = classes.join(heads, "fp").select(F.col("head").alias("x"), F.col("cls").alias("y"))
    return linked.unionByName(equal).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs whose sets, built from their texts, have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            sets = [shingles(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["cls", "set"])

    nodes = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = saved(classes.join(nodes, "cls").select("cls", F.col("text_hash").alias("_hash")), "wanted")
    text = docs.select(F.col("text").cast("string").alias("text"))
    found = text.join(bounded(wanted), simhash.text_hash("text") == F.col("_hash")).select("cls", "text").dropDuplicates(["cls"])
    sets = saved(found.mapInArrow(run, "cls long, set array<long>"), "sets")
    of = lambda c: sets.select(F.col("cls").alias(c), F.col("set").alias(f"set_{c}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where((NUM + DEN) * both >= NUM * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, cls, root, component_id for each row."""
    rows = saved(marked(docs, common(docs)), "shingles")
    one = lambda c: F.min(c).alias(c)
    narrow = saved(rows.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *map(one, ("text_hash", "n", "fp"))), "sets-of")
    bitmaps = rows.where("sketch is not null").select("cls", *BITS, "sketch", "short").dropDuplicates(["cls"])
    classes = saved(narrow.join(bitmaps, "cls"), "classes")
    live = saved(buckets(rows), "live")
    sets = classes.select("cls", "n", *BITS)
    every = hash_links(classes).unionByName(proposed(dealt(live), sets.withColumn("part", F.col("cls")), True)).distinct()
    first = saved(near(every, classes), "nearest")
    links = saved(similar(docs, classes, first), "links")
    parts = saved(simhash.components(links), "parts")
    joined = saved(classes.join(parts, classes.cls == parts.node, "left").select("cls", "n", *BITS, "short", F.coalesce("root", "cls").alias("part")).withColumnRenamed("short", "sketch"), "sets-parts")
    others = proposed(crossed(live, joined.select("cls", "part")), joined, False).join(first, ["a", "b"], "left_anti")
    second = saved(near(others, classes), "others")
    if not second.isEmpty():
        more = saved(similar(docs, classes, second), "links")
        parts = saved(simhash.components(links.unionByName(more)), "parts") if not more.isEmpty() else parts
    return simhash.named(rows.select("doc_id", "text_hash", "cls"), classes.select("cls", "rep", "copies"), parts, "cls")


def kept(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates the row of least doc_id, as simhash.kept."""
    return simhash.firsts(docs, near_duplicates(docs))
