"""Packing of documents into token sequences of one length.

Method: first-fit decreasing with a tournament tree over the bins' free capacities, run
independently in randomised groups of documents.

1. Map side, no shuffle: each text is tokenised whole, as the tokenizers library does by default (an added token's string
   is that token), the separator id is appended, and the ids are
   cut at every ``SEQ_LEN`` from the document's start. A piece is 40 bytes: ids, start, length and a
   checksum. Only these are moved, never text or tokens.
2. A document's last piece joins one of ``ceil(rows / GROUP_DOCS)`` groups by a hash of its row's place in the table of
   pieces, so that equal rows spread and a group has about as many documents at any input size. The pieces before
   it, which fill a sequence by themselves, are spread over the groups by row and start: a long document is no large group.
3. In a group, pieces are sorted by falling length (ties: doc_id, start, checksum) and each enters the
   leftmost bin with room. The tree holds the largest free capacity under each node, so that a search
   takes log2(bins) steps. Sequences never span groups; their id is group * 2**32 + bin.

Nulls and edge cases: a null text counts as empty and packs as the separator alone; a null doc_id is
kept; repeated rows are packed each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewright.llm.common import by_bytes, documents, saved, texts

SEQ_LEN = 1024
GROUP_DOCS = 4096
SEPARATOR = 0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
CUTS = f"{PIECES}, row long"
PACKED = f"{PIECES}, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """A byte-level BPE encoder with the vocabulary of a tokenizers file.

    The file's ids from 256 on follow the order of its merges, so the vocabulary alone gives the ranks. Same ids as the file
    gives with the tokenizers library (tests compare them) for a quarter of its CPU time: by ``encode_ordinary`` those where
    the strings of the file's added tokens are ordinary text, by ``encode(text, allowed_special="all")`` the library's default, where
    they are these tokens.
    """
    import tiktoken

    # fixed values: the 188 bytes that byte-level vocabularies write as themselves; the others follow from U+0100
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"]: x["id"] for x in model["added_tokens"]}
    ranks = {bytes(names[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def cut(text: str, enc, length: int = SEQ_LEN) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A text's ids with the separator, and (start, length, crc32) of each piece."""
    ids = np.array([*enc.encode(text, allowed_special="all"), SEPARATOR], dtype="<u4")
    return ids, [(a, len(p), zlib.crc32(p.tobytes())) for a in range(0, len(ids), length) for p in (ids[a : a + length],)]


def pieces(docs: DataFrame, path: str, pattern: str, length: int = SEQ_LEN) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoder(path, pattern), TaskContext.get().partitionId() << 40
        for batch in by_bytes(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                ids, parts = cut(text, enc, length)
                for part in parts:
                    for column, value in zip(out, (doc, *part, len(ids), at), strict=True):
                        column.append(value)
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [c.split()[0] for c in CUTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, CUTS)


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the order given: the leftmost bin with room takes it.

    The tournament tree has a leaf for each bin and in each inner node the largest free capacity below;
    it doubles when all leaves are in use.
    """
    size, used = 1, 0
    tree = [0, 0]
    bins, offsets = [], []
    for n in lengths:
        if tree[1] < n:  # no open bin has room
            if used == size:
                old = tree[size:]
                size *= 2
                tree = [0] * size + old + [0] * (size - len(old))
                for i in range(size - 1, 0, -1):
                    tree[i] = max(tree[2 * i], tree[2 * i + 1])
            leaf, free = size + used, capacity
            used += 1
        else:
            leaf = 1
            while leaf < size:
                leaf *= 2
                if tree[leaf] < n:
                    leaf += 1
            free = tree[leaf]
        bins.append(leaf - size)
        offsets.append(capacity - free)
        tree[leaf] = free - n
        node = leaf // 2
        while node:
            top = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == top and node != leaf // 2:
                break
            tree[node] = top
            node //= 2
    return bins, offsets


def pack(cuts: DataFrame, length: int = SEQ_LEN, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces to pieces with their sequence and offset there."""
    groups = max(1, -(-cuts.where("start = 0").count() // group_docs))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        group = table.column("grp")[0].as_py()
        bins, offsets = first_fit(table.column("length").to_pylist(), length)
        return table.drop_columns(["grp", "row"]).append_column("sequence_id", pa.array(np.array(bins, "i8") + (group << 32))).append_column("offset", pa.array(offsets, pa.int64()))

    grp = F.pmod(F.xxhash64("row", F.when(F.col("length") == length, F.col("start")).otherwise(-1)), F.lit(groups)).cast("long")
    return cuts.withColumn("grp", grp).groupBy("grp").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, length: int = SEQ_LEN, group_docs: int = GROUP_DOCS) -> DataFrame:
    """The operator: documents (doc_id, text) to packed pieces."""
    import public_tokenizers as P

    cuts = saved(pieces(docs, path or P.path("byte_bpe_50k.json"), pattern or P.PATTERN, length), "pieces")
    return pack(cuts, length, group_docs)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
