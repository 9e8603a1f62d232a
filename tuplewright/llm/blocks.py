"""Blocks of documents as tokens of a block's own dictionary, and exchanges that look its words up.

A statistic of words over the corpus, needed back at every document, would move each word of each text
twice if it were a join of rows. Here a map task turns its documents into blocks of about
``BLOCK_BYTES`` of text; a block has a dictionary of its distinct words and, for each document, the
numbers of its words there, compressed. Only the dictionaries are exchanged: each word goes, once for
each block that has it, to the shard that its hash names, in one compressed piece a shard; answers come
back the same way and are set beside the block's documents.

Sizes: a block is bounded by its bytes (a longer document is a block of its own); the caller chooses the
number of shards, each of which sends every block a row; a frequent word costs no more than a rare one.

Rows are (block, shard, data): shard -1 has the documents, 0 and on the words of that shard in order.
A block's number is its task's partition and its place there, so a task that runs again makes the same
rows; they are saved before use.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

from tuplewright.llm.common import texts

BLOCK_BYTES = 20 << 20
SCHEMA = "block long, shard int, data binary"

_NAMES = ["block", "shard", "data"]


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def to_planes(numbers: np.ndarray, width: int = 4) -> bytes:
    """Unsigned numbers by byte planes: the high ones are nearly all zero."""
    return np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def from_planes(data: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def joined(words: list[bytes]) -> bytes:
    """Words in one string; byte 255 is in no UTF-8 text."""
    return b"\xff".join(words)


def parted(data: bytes) -> list[bytes]:
    return data.split(b"\xff") if data else []


def shard_of(words: list[bytes], shards: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) % shards for w in words], np.int64)


class Block:
    """ids: document numbers (with a flag for null), lengths: tokens a document, tokens: their words' places in the dictionary."""

    def __init__(self, ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray, order: np.ndarray) -> None:
        self.ids, self.lengths, self.tokens, self.order = ids, lengths, tokens, order

    def data(self) -> bytes:
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        head = np.array([len(self.ids), len(self.tokens), len(self.order)], "<i8").tobytes()
        return squeeze(head + known.tobytes() + ids.astype("<i8").tobytes() + self.lengths.astype("<i8").tobytes() + to_planes(self.tokens) + to_planes(self.order))

    @classmethod
    def of(cls, data: bytes) -> Block:
        data = expand(data)
        n, t, d = np.frombuffer(data, "<i8", 3).tolist()
        at = 24
        known = np.frombuffer(data, np.uint8, n, at).tolist()
        ids = np.frombuffer(data, "<i8", n, at + n).tolist()
        lengths = np.frombuffer(data, "<i8", n, at + 9 * n)
        at += 17 * n
        return cls([i if k else None for i, k in zip(ids, known, strict=True)], lengths, from_planes(data[at : at + 4 * t]), from_planes(data[at + 4 * t : at + 4 * (t + d)]))


def dictionary(lists: Iterator[list]) -> tuple[list, np.ndarray, np.ndarray]:
    """Distinct words by falling count, the lengths of the lists, and all words as places in the dictionary."""
    places = defaultdict(count().__next__)
    parts = [np.fromiter(map(places.__getitem__, words), np.uint32, len(words)) for words in lists]
    tokens = np.concatenate([np.zeros(0, np.uint32), *parts])
    order = np.argsort(-np.bincount(tokens, minlength=len(places)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    words = list(places)
    return [words[i] for i in order.tolist()], np.array([len(p) for p in parts], np.int64), rank[tokens]


def blocks(batches: Iterator[pa.RecordBatch], split: Callable[[str], list], shards: int, most: int = BLOCK_BYTES, extra: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and text to rows of blocks. extra(block, words) gives a bytes value for each shard's share beside the words, from their places."""
    base, made = TaskContext.get().partitionId() << 32, 0
    ids: list[int | None] = []
    held: list[str] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal made, ids, held, size
        words, lengths, tokens = dictionary(split(t) for t in held)
        words = [w.encode() if isinstance(w, str) else w for w in words]
        shard = shard_of(words, shards)
        by_word = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = by_word[np.argsort(shard[by_word], kind="stable")]
        block = Block(ids, lengths, tokens, order)
        rows = [(-1, block.data())]
        edges = np.searchsorted(shard[order], np.arange(shards + 1)).tolist() if len(order) else [0] * (shards + 1)
        for s in range(shards):
            mine = order[edges[s] : edges[s + 1]]
            if len(mine):
                share = joined([words[i] for i in mine.tolist()])
                rows.append((s, squeeze(share if extra is None else extra(block, mine) + share)))
        out = pa.RecordBatch.from_arrays([pa.array([base + made] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], _NAMES)
        made, ids, held, size = made + 1, [], [], 0
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            n = len(text) if text.isascii() else len(text.encode())
            if held and size + n > most:
                yield flush()
            ids.append(doc)
            held.append(text)
            size += n
    if held:
        yield flush()


def answers(block: Block, shares: list[tuple[int, list]]) -> list:
    """What each word of the block's dictionary got, from (shard, answers in the share's order)."""
    found = [x for _, share in sorted(shares, key=lambda s: s[0]) for x in share]
    out: list = [None] * len(block.order)
    for i, x in zip(block.order.tolist(), found, strict=True):
        out[i] = x
    return out
