"""Byte-level BPE encoding and decoding.

Method: the distinct words (matches of the splitting pattern) are encoded by Spark higher-order functions.
A word's bytes are characters U+0000 to U+00FF; a fold over at most its length merges the leftmost pair
of least rank until none has a rank, holding the boundaries between pieces and the ranks of their pairs,
of which a merge changes two. Ranks come from a literal map of the vocabulary: ``BUCKETS`` small maps in a
literal array, addressed by the key's hash, since a lookup in one large map literal is a scan.
Decoding takes the binary pieces of ids from a literal array and concatenates them, for each distinct word as well.
A word of more than ``LONG`` bytes, for which the fold's square would be long, is merged by a heap of its pairs in
Python instead, to the same ids in n log n steps.

Plan. A word is encoded once for the whole corpus, not once a text. Documents become blocks with a
dictionary each (blocks.py); the dictionaries' words meet by shard, are made distinct and folded; the ids
return to the blocks, with the decoded bytes where these aren't the word's own, and the documents read theirs off. Moved are dictionaries and blocks' numbers, never
rows of words: about the size of the compressed input in all. No table of all words is ever broadcast.

Bounds: a block's bytes and a shard's words (see blocks.py); a hot text or word has no effect on them.

Nulls and edge cases: a null text is the empty text: no tokens, digests of nothing; a null doc_id is kept;
repeated rows get equal results; an empty table gives no rows; other columns are ignored. Strings of
special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewright.llm import blocks as B
from tuplewright.llm.common import by_bytes, documents, saved, saved_by

BUCKETS = 1 << 15
LONG = 1024
NO_RANK = 2**31 - 1
SHIFT = 2**32
ABSENT = NO_RANK * SHIFT


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[bytes]:
    """The pieces of a rank file by rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def rank_map(pieces: list[bytes]) -> Column:
    """The literal array of maps from a piece to its rank."""
    from xxhash import xxh64_intdigest

    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for rank, piece in enumerate(pieces):
        text = piece.decode("latin-1")
        maps[xxh64_intdigest(text.encode(), 42) % BUCKETS][text] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def encode_word(word: Column, rank_maps: Column) -> Column:
    """Ids of one word, a binary column. The plan holds the literal once: the rest refers to it through a lambda's variable.

    The fold's state are the boundaries b between pieces (byte offsets, both ends among them) and for each
    inner one the entry rank * 2**32 + offset of the pair that it parts; the least entry is the leftmost
    pair of least rank. A merge drops its boundary and entry and renews the entries of the two beside it.
    """
    return _let(rank_maps, lambda ranks: _let(F.decode(word, "ISO-8859-1"), lambda text: _encoded(text, ranks)))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _encoded(text: Column, ranks: Column) -> Column:
    rank = lambda piece: F.coalesce(F.try_element_at(F.get(ranks, F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")), piece), F.lit(NO_RANK))
    none = F.array().cast("array<int>")
    piece = lambda a, b: F.substring(text, a + 1, b - a)
    entry = lambda a, at, b: rank(piece(a, b)).cast("long") * SHIFT + at

    def merged(s: Column, least: Column) -> Column:
        at = (least % SHIFT).cast("int")

        def beside(p: Column) -> Column:
            """p: the boundary's place in b, from 1; its entry's place in e is one less."""
            b, e = s["b"], s["e"]
            left, right = F.get(b, p - 2), F.get(b, p)
            some = lambda there, x: F.when(there, F.array(x)).otherwise(F.array().cast("array<bigint>"))
            renewed = F.concat(
                F.slice(e, F.lit(1), F.greatest(p - 3, F.lit(0))),
                some(p > 2, entry(F.get(b, p - 3), left, right)),
                some(p + 1 < F.size(b), entry(left, right, F.get(b, p + 1))),
                F.slice(e, p + 1, F.greatest(F.size(e) - p, F.lit(0))),
            )
            return F.struct(F.array_remove(b, at).alias("b"), renewed.alias("e"))

        return _let(F.array_position(s["b"], at).cast("int"), beside)

    def step(s: Column, _: Column) -> Column:
        return _let(F.array_min(s["e"]), lambda m: F.when(m < NO_RANK * SHIFT, merged(s, m)).otherwise(s))

    def fold(n: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: entry(i - 1, i, i + 1))
        start = F.struct(F.sequence(F.lit(0), n).alias("b"), pairs.alias("e"))
        pieces = lambda b: F.zip_with(F.slice(b, F.lit(1), F.size(b) - 1), F.slice(b, F.lit(2), F.size(b) - 1), lambda x, y: rank(piece(x, y)))
        return _let(F.aggregate(F.sequence(F.lit(2), n), start, step)["b"], pieces)

    # a word that is a piece itself needs no fold
    n = F.length(text)
    whole = _let(rank(text), lambda r: F.when((r < NO_RANK) | (n == 1), F.array(r)).otherwise(fold(n)))
    return F.when(n == 0, none).otherwise(whole)


def piece_array(pieces: list[bytes]) -> Column:
    """The literal array of pieces by rank."""
    return F.from_json(F.lit(json.dumps([p.decode("latin-1") for p in pieces])), "array<string>")


def decode_ids(ids: Column, pieces: Column) -> Column:
    """The bytes of an array of ids; null with an id that isn't in the vocabulary."""
    joined = lambda parts: F.when(F.forall(parts, lambda p: p.isNotNull()), F.encode(F.array_join(parts, ""), "ISO-8859-1"))
    return _let(F.transform(ids, lambda i: F.get(pieces, i)), joined)


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """words with the column ids: arrays of int for the binary column word."""
    return words.withColumn("ids", encode_word(F.col("word"), rank_map(vocabulary(path))))


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    return {piece: rank for rank, piece in enumerate(vocabulary(path)) if piece}


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: a heap of (rank, offset, end) of neighbouring pieces, in which outdated pairs are passed over."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # of the piece that starts at each offset; 0: merged away

    def pair(a: int) -> tuple[int, int, int] | None:
        b = end[a]
        rank = ranks.get(word[a : end[b]]) if b < n else None
        return None if rank is None else (rank, a, end[b])

    heap = [p for p in map(pair, range(n)) if p]
    heapq.heapify(heap)
    while heap:
        _, a, c = heapq.heappop(heap)
        b = end[a]
        if not b or b >= n or end[b] != c:
            continue
        end[a], end[b] = c, 0
        if c < n:
            before[c] = a
        for start in (before[a], a):
            if start >= 0 and (p := pair(start)):
                heapq.heappush(heap, p)
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a : end[a]]])
        a = end[a]
    return out


def splitter(pattern: str):
    """A function from a text to its matches.

    With the public pattern the standard module splits faster, to the same words, texts of Latin letters
    whose numbers are decimal digits (its classes can't tell other numbers from letters).
    """
    import re

    import public_tokenizers as P
    import regex

    find = regex.compile(pattern).findall
    if pattern != P.PATTERN:
        return find
    short = "'s|'t|'re|'ve|'m|'ll|'d"
    ascii_find = re.compile(rf"{short}| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+").findall
    space = r"\t-\r \x85\xa0"  # of the characters up to U+024F
    wide_find = re.compile(rf"{short}| ?[^\W\d_]+| ?\d+| ?(?:_|[^\w{space}])+|[{space}]+(?![^{space}])|[{space}]+").findall
    other = re.compile("[\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]").search
    return lambda text: ascii_find(text) if text.isascii() else find(text) if other(text) else wide_find(text)


def _block_rows(docs: DataFrame, pattern: str, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from B.blocks(by_bytes(batches), splitter(pattern), shards)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, B.SCHEMA)


def _distinct(path: str):
    def run(table: pa.Table) -> pa.Table:
        """A shard's distinct words, and the ids of the long ones."""
        words: set[bytes] = set()
        for data in table.column("data").to_pylist():
            words.update(B.parted(B.expand(data)))
        ids = [merge_by_heap(w, ranks_of(path)) if len(w) > LONG else None for w in words]
        shard = pa.array([table.column("shard")[0].as_py()] * len(words), pa.int32())
        return pa.table({"shard": shard, "word": pa.array(list(words), pa.binary()), "long_ids": pa.array(ids, pa.list_(pa.int32()))})

    return run


def encoded_words(distinct: DataFrame, path: str) -> DataFrame:
    """shard, word, ids as decimal numbers with commas, and plain: what the ids decode to, null if that is the word."""
    pieces = vocabulary(path)
    ids = F.coalesce("long_ids", encode_word(F.when(F.col("long_ids").isNull(), F.col("word")), rank_map(pieces)))
    decoded = distinct.select("shard", "word", ids.alias("ids")).select("shard", "word", "ids", _let(piece_array(pieces), lambda p: decode_ids(F.col("ids"), p)).alias("plain"))
    return decoded.select("shard", "word", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.when(~F.col("plain").eqNullSafe(F.col("word")), F.coalesce("plain", F.lit(b""))).alias("plain"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of words and their ids to compressed lists of both, some for each shard. A decoded value follows its ids after a colon."""
    for batch in batches:
        shards = batch.column(0).to_numpy()
        for shard in np.unique(shards).tolist():
            part = batch.filter(pa.array(shards == shard))
            found = [i if p is None else i + ":" + p.hex() for i, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            data = B.squeeze(B.joined([*part.column(1).to_pylist(), *(x.encode() for x in found)]))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([data], pa.binary())], ["shard", "data"])


def _look_up(shares: pa.Table, encoded: pa.Table) -> pa.Table:
    """Each block's share of words to a share of their ids, as decimal numbers with commas."""
    ids: dict[bytes, str] = {}
    for data in encoded.column("data").to_pylist():
        both = B.parted(B.expand(data))
        half = len(both) // 2
        ids.update(zip(both[:half], (x.decode() for x in both[half:]), strict=True))
    out = [B.squeeze("\n".join([ids[w] for w in B.parted(B.expand(data))]).encode()) for data in shares.column("data").to_pylist()]
    return pa.table({"block": shares.column("block"), "shard": shares.column("shard"), "data": pa.array(out, pa.binary())})


def encoded_documents(docs: DataFrame, path: str, pattern: str, finish, schema: str, shards: int | None = None) -> DataFrame:
    """The operator: finish(doc_id, list of each word's ids as decimal strings, list of each word's decoded bytes) gives a row of the schema for each document."""
    spark = docs.sparkSession
    if shards is None:  # one for about each block's worth of words, at least two a core
        shards = max(2 * spark.sparkContext.defaultParallelism, docs.select("doc_id").rdd.getNumPartitions())
    rows = saved_by(_block_rows(docs, pattern, shards), "bpe-blocks", "block", shards)
    shares = rows.where("shard >= 0")
    distinct = shares.select("shard", "data").groupBy("shard").applyInArrow(_distinct(path), "shard int, word binary, long_ids array<int>")
    encoded = saved(encoded_words(distinct, path), "bpe-words")
    gathered = encoded.mapInArrow(_gathered, "shard int, data binary")
    found = shares.groupBy("shard").cogroup(gathered.groupBy("shard")).applyInArrow(_look_up, B.SCHEMA)
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def read_off(own: pa.Table, found: pa.Table) -> pa.Table:
        """own: a block and its shares of words; found: the shares' ids."""
        parts = list(zip(own.column("shard").to_pylist(), own.column("data").to_pylist(), strict=True))
        block = next(B.Block.of(d) for s, d in parts if s < 0)
        words = B.answers(block, [(s, B.parted(B.expand(d)) or [b""]) for s, d in parts if s >= 0])
        ids = B.answers(block, [(s, B.expand(d).decode().split("\n")) for s, d in zip(found.column("shard").to_pylist(), found.column("data").to_pylist(), strict=True)])
        for i in (i for i, x in enumerate(ids) if ":" in x):
            ids[i], plain = ids[i].split(":")
            words[i] = bytes.fromhex(plain)
        plain, ids, at, out = np.array([*words, None], object)[:-1], np.array(ids, object), 0, []
        for doc, n in zip(block.ids, block.lengths.tolist(), strict=True):
            mine = block.tokens[at : at + n]
            at += n
            out.append(finish(doc, ids[mine].tolist(), plain[mine].tolist()))
        return pa.table({name: [r[k] for r in out] for k, name in enumerate(names)}, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(read_off, schema)


def _digests(doc: int | None, ids: list[str], plain: list[bytes]) -> tuple:
    all_ids = ",".join(ids)
    return doc, all_ids.count(",") + 1 if ids else 0, hashlib.sha256(all_ids.encode()).hexdigest(), hashlib.sha256(b"".join(plain)).hexdigest()


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encoded_documents(documents(spark, sf_dir), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, _digests, schema)


QUERIES = {"op10_bpe": op10_bpe}
ORACLES: dict[str, str] = {}
