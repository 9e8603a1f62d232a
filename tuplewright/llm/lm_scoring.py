"""Language-model scoring by an Elias-Fano n-gram trie.

The model is a bigram model with absolute discounting over the given unigram base:

    p(w | v) = max(c(v, w) - D, 0) / c(v) + D * T(v) / c(v) * p(w),   p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

T(v): distinct words after v, D = n1 / (n1 + 2 n2) of the counts of all pairs of the corpus. A text starts in a
start context and ends with the end token. A word not in training has c(v, w) = 0, so the back-off weight's share of the
base, which keeps a part for such words: after each context the words of training and the unknown one sum to one. As
a context it gives the base alone. Scores don't depend on blocks or shards.

Method: pairs are kept in tries of two levels. Level one has the contexts, level two each context's
successors beside one another, as numbers relative to the context's place; both and the pointers between
them are monotone sequences in Elias-Fano form (low bits packed, high bits unary). Discounted probabilities and
back-off weights are 16-bit codes of their logarithms in steps of 1/STEPS decade, one grid for all shards. The levels are written to one file and memory-mapped; a query finds its context by successor
search, then its word by successor search relative to the context's place, by select on the high bits
and bisection of the low bits, for arrays of queries at a time.

How it is distributed. One trie of a corpus has no bound, so there is one for each shard of the pairs:

1. Texts become blocks with a dictionary each (blocks.py), saved. Words with their training counts meet by
   shard, are summed, get dense numbers, and go back to the blocks.
2. Each block sends its distinct pairs with their training counts to shards of about ``SHARD_PAIRS``
   pairs, kept in a table bucketed by shard. A context goes to one shard whole, but one of more than
   ``SHARD_PAIRS`` tokens is dealt by pair; the distinct words after it are summed apart and joined to the
   blocks that have it. A first pass over the shards counts the pairs seen once and twice; the second
   sums the counts, builds its trie with the discount and answers every block.
3. Blocks add up their texts' scores.

Memory: a task holds one block (``BLOCK_BYTES`` of text) or one shard, in 32-bit arrays where places suffice.

All counts are of all training texts. A word or pair moves once a block, however frequent it is there.

Nulls and edge cases: a null text is the empty text (one end token); a null doc_id is scored, counts as held
out and is not learnt from; repeated rows each count and get equal scores; without training texts every
token has the base's value; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewright.llm import blocks as B
from tuplewright.llm.common import by_bytes, documents, saved, saved_by

BLOCK_BYTES = 12 << 20
SHARD_PAIRS = 2_500_000
FOLDS, HELD_OUT = 10, 0
ADDED = 0.1
SCHEMA = "block long, shard int, data binary, a long, b long, x double"
NAMES = ["block", "shard", "data", "a", "b", "x"]
#: numbers of the tokens: unknown, the end, the start context, then words
UNKNOWN, END, START, FIRST = 0, 1, 2, 3
STEPS = 256
ABSENT = 65535
#: pseudo-shard of a block's hot contexts
ASKS = -2


#: the place of the k-th one of each byte
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


class EliasFano:
    """A monotone sequence below ``universe`` (uint64 arrays). Parts are plain arrays, so they can be memory-mapped."""

    PARTS = ("low", "high", "ones", "zeros", "shape")

    def __init__(self, **parts: np.ndarray) -> None:
        self.__dict__.update(parts)
        self.n, self.bits = int(self.shape[0]), int(self.shape[1])

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        words = (int(universe >> bits) + n) // 64 + 2
        flags = np.zeros(words * 64, np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        low = np.zeros(n * bits // 64 + 2, "<u8")
        if bits and n:
            rest = v & np.uint64((1 << bits) - 1)
            place = np.arange(n, dtype=np.int64) * bits
            shift = (place & 63).astype(np.uint64)
            np.bitwise_or.at(low, place >> 6, rest << shift)
            over = (place & 63) + bits > 64
            np.bitwise_or.at(low, (place[over] >> 6) + 1, rest[over] >> (np.uint64(64) - shift[over]))
        return cls(low=low, high=high, ones=ones, zeros=np.arange(len(ones)) * 64 - ones, shape=np.array([n, bits], np.int64))

    def _select(self, k: np.ndarray, directory: np.ndarray, flip: int) -> np.ndarray:
        """Positions of the k-th (from 0) one or zero of the high bits."""
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), 1 << 15):
            part = k[a : a + (1 << 15)]
            word = np.searchsorted(directory, part, "right") - 1
            eight = np.ascontiguousarray(self.high[word]).view(np.uint8).reshape(-1, 8) ^ np.uint8(255 * flip)
            sums = np.cumsum(np.bitwise_count(eight), axis=1, dtype=np.int64)
            rank = part - directory[word]
            byte = (sums <= rank[:, None]).sum(1)
            row = np.arange(len(part))
            rank -= np.where(byte > 0, sums[row, byte - 1], 0)
            out[a : a + len(part)] = word * 64 + byte * 8 + _IN_BYTE[eight[row, byte], rank]
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        place = i * self.bits
        shift = (place & 63).astype(np.uint64)
        out = self.low[place >> 6] >> shift
        over = (place & 63) + self.bits > 64
        out[over] |= self.low[(place[over] >> 6) + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, self.ones, 0) - i
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place whose value is x or more (n if there is none), and whether it is x."""
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        rest = x & np.uint64((1 << self.bits) - 1)
        end = self._select(h, self.zeros, 1) - h  # values with high part h or less
        begin = np.zeros(len(x), np.int64)
        some = h > 0
        begin[some] = self._select(h[some] - 1, self.zeros, 1) - (h[some] - 1)
        left, right = begin, end
        for _ in range(int((end - begin).max(initial=0)).bit_length()):
            open_ = left < right
            middle = (left + right) >> 1
            less = np.zeros(len(x), bool)
            less[open_] = self._low(middle[open_]) < rest[open_]
            left = np.where(open_ & less, middle + 1, left)
            right = np.where(open_ & ~less, middle, right)
        same = left < end
        same[same] = self._low(left[same]) == rest[same]
        return left, same


def quantised(values: np.ndarray) -> np.ndarray:
    """Codes of probabilities or weights of at most one: their negative logarithms in steps of 1/STEPS decade."""
    return np.minimum(np.rint(np.log10(values) * -STEPS), ABSENT - 1).astype(np.uint16)


def codebook(codes: np.ndarray) -> np.ndarray:
    """The logarithms of the codes up to the largest that occurs."""
    return np.arange(int(codes.max(initial=0)) + 1) / -STEPS


class Trie:
    """Contexts, pointers to successors, and the codes of both levels."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, words: EliasFano, universe: int, arrays: dict[str, np.ndarray]) -> None:
        self.contexts, self.pointers, self.words, self.universe = contexts, pointers, words, universe
        self.__dict__.update(arrays)

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, probability: np.ndarray, backoff: np.ndarray) -> Trie:
        """Pairs in order, the probability of each, and the back-off weight of each distinct context."""
        distinct, first = np.unique(context, return_index=True)
        universe = int(word.max(initial=0)) + 1
        place = np.repeat(np.arange(len(distinct)), np.diff(np.append(first, len(context)))).astype(np.uint64)
        codes, back_codes = quantised(probability), quantised(backoff)
        return cls(
            EliasFano.of(distinct, int(distinct.max(initial=0)) + 1),
            EliasFano.of(np.append(first, len(context)), len(context) + 1),
            EliasFano.of(place * np.uint64(universe) + word, max(1, len(distinct)) * universe),
            universe,
            {"codes": codes, "book": codebook(codes), "back_codes": back_codes},
        )

    def write(self, path: str) -> None:
        with open(path, "wb") as f:
            for part in self._parts():
                f.write(np.ascontiguousarray(part).tobytes())
                f.write(b"\0" * (-part.nbytes % 8))

    def _parts(self) -> list[np.ndarray]:
        levels = [getattr(ef, name) for ef in (self.contexts, self.pointers, self.words) for name in EliasFano.PARTS]
        return [*levels, self.codes, self.book, self.back_codes]

    def mapped(self, path: str) -> Trie:
        """This trie over the file's pages."""
        raw, at, parts = np.memmap(path, np.uint8, "r"), 0, []
        for part in self._parts():
            parts.append(raw[at : at + part.nbytes].view(part.dtype))
            at += part.nbytes + -part.nbytes % 8
        n = len(EliasFano.PARTS)
        levels = [EliasFano(**dict(zip(EliasFano.PARTS, parts[i * n : (i + 1) * n], strict=True))) for i in range(3)]
        return Trie(*levels, self.universe, dict(zip(("codes", "book", "back_codes"), parts[3 * n :], strict=True)))

    def find_contexts(self, contexts: np.ndarray) -> np.ndarray:
        """Places of contexts; -1 where there is none."""
        if not self.contexts.n:
            return np.full(len(contexts), -1)
        inside = contexts <= self.contexts.access(np.array([self.contexts.n - 1]))[0]
        out = np.full(len(contexts), -1)
        at, same = self.contexts.successor(contexts[inside])
        out[inside] = np.where(same, at, -1)
        return out

    def find(self, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of the words after the contexts at the places; ABSENT where there is none."""
        out = np.full(len(place), ABSENT, np.uint16)
        ask = np.flatnonzero((place >= 0) & (word < self.universe))
        if len(ask):
            at, same = self.words.successor(place[ask].astype(np.uint64) * np.uint64(self.universe) + word[ask])
            out[ask[same]] = self.codes[at[same]]
        return out


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def learns(doc: int | None) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % FOLDS != HELD_OUT


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.float64()]
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(NAMES, kinds, strict=True))})


def _numbers(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as one compressed string."""
    head = np.array([len(arrays), *map(len, arrays)], "<i8").tobytes()
    return B.squeeze(head + b"".join(B.to_planes(a, 8) for a in arrays))


def _read_numbers(data: bytes) -> list[np.ndarray]:
    data = B.expand(data)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    out, at = [], 8 * (n + 1)
    for size in np.frombuffer(data, "<i8", n, 8).tolist():
        out.append(B.from_planes(data[at : at + 8 * size], 8))
        at += 8 * size
    return out


def _learning(block: B.Block) -> np.ndarray:
    return np.array([learns(d) for d in block.ids], bool)


def _block_rows(docs: DataFrame, shards: int) -> DataFrame:
    """Blocks (a: training texts, b: tokens) and shares of words with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: list = [None, None]  # the block at hand and its counts

        def counts(block: B.Block, mine: np.ndarray) -> bytes:
            if memo[0] is not block:
                memo[:] = block, np.bincount(block.tokens[np.repeat(_learning(block), block.lengths)], minlength=len(block.order))
            n = memo[1][mine]
            return len(n).to_bytes(8, "little") + B.to_planes(n, 4)

        for out in B.blocks(by_bytes(batches), words_of, shards, BLOCK_BYTES, counts):
            rows = []
            for block, shard, data in zip(*(c.to_pylist() for c in out.columns), strict=True):
                if shard < 0:
                    x = B.Block.of(data)
                    rows.append((block, shard, data, int(_learning(x).sum()), len(x.tokens) + len(x.ids), None))
                else:
                    rows.append((block, shard, data, None, None, None))
            yield from _rows(rows).to_batches()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def _sum_words(shards: int):
    def run(table: pa.Table) -> pa.Table:
        """Answers (number and count of each word); and a row for block -1 with the shard's tokens and distinct words."""
        shard, shares, total = table.column("shard")[0].as_py(), [], {}
        for data in map(B.expand, table.column("data").to_pylist()):
            n = int.from_bytes(data[:8], "little")
            words, counts = B.parted(data[8 + 4 * n :]) if n else [], B.from_planes(data[8 : 8 + 4 * n])
            words = words or [b""] * n
            shares.append(words)
            for w, c in zip(words, counts.tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        known = sorted(w for w, c in total.items() if c)
        number = {w: FIRST + shard + i * shards for i, w in enumerate(known)}
        rows = [(-1, shard, None, sum(total.values()), len(known), None)]
        for block, words in zip(table.column("block").to_pylist(), shares, strict=True):
            ids = np.array([number.get(w, UNKNOWN) for w in words], np.uint64)
            rows.append((block, shard, _numbers(ids, np.array([total[w] for w in words], np.uint64)), None, None, None))
        return _rows(rows)

    return run


class Pairs:
    """A block's tokens as places in its dictionary, and its distinct pairs with a known context; all unknown words are one there."""

    def __init__(self, block: B.Block, shares: list[tuple[int, bytes]], texts: int) -> None:
        """shares: what _sum_words answered. texts: of training in all."""
        size = len(block.order)
        number, count = np.zeros(size + 3, np.uint64), np.zeros(size + 3, np.uint64)
        got = [_read_numbers(d) for _, d in sorted(shares)]
        if got:
            number[block.order], count[block.order] = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        number[size:], count[size : size + 2] = (END, START, UNKNOWN), texts
        self.lengths = block.lengths + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        ends = self.starts + block.lengths
        total = int(self.lengths.sum())
        word = np.full(total, size, np.int32)
        inner = np.ones(total, bool)
        inner[ends] = False
        word[inner] = block.tokens
        del inner
        context = np.empty(total, np.int32)
        context[1:] = word[:-1]
        context[self.starts] = size + 1
        self.word, self.context, self.number, self.count = word, context, number, count
        self.known = count[context] > 0
        code = context[self.known].astype(np.int64) * (size + 3)
        second = word[self.known]
        code += np.where(count[second] > 0, second, np.int32(size + 2))
        del second
        order = np.argsort(code)
        code = code[order]
        new = np.append(np.ones(min(1, len(code)), bool), code[1:] != code[:-1])
        self.at = np.empty(len(code), np.int32)
        self.at[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        code = code[new]
        self.first, self.second = (code // (size + 3)).astype(np.int32), (code % (size + 3)).astype(np.int32)
        learn = np.repeat(_learning(block), self.lengths)[self.known]
        self.times = np.bincount(self.at[learn], minlength=len(code)).astype(np.uint32)

    def dealt(self, shards: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """An order of the distinct pairs by shard, context and word, and each pair's shard in that order."""
        mix = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) ^ (x >> np.uint64(31))
        context, word = self.number[self.first], self.number[self.second]
        hot = self.count[self.first] > most
        hashed = mix(mix(context) + np.where(hot, mix(word + np.uint64(1)), np.uint64(0)))
        shard = ((hashed >> np.uint64(17)) % np.uint64(shards)).astype(np.int32)
        del hashed, hot
        order = np.lexsort((word, context, shard))
        return order, shard[order]


def _pairs(table: pa.Table, texts: int) -> tuple[B.Block, Pairs]:
    rows = list(zip(table.column("kind").to_pylist(), table.column("shard").to_pylist(), table.column("data").to_pylist(), strict=True))
    block = next(B.Block.of(d) for k, _, d in rows if k == 0)
    return block, Pairs(block, [(s, d) for k, s, d in rows if k == 1], texts)


def _send_pairs(texts: int, shards: int, most: int):
    def run(table: pa.Table) -> pa.Table:
        """A row for each shard, and one of pseudo-shard ASKS for each hot context (a)."""
        block, (_, pairs) = table.column("block")[0].as_py(), _pairs(table, texts)
        order, shard = pairs.dealt(shards, most)
        edges, rows = np.searchsorted(shard, np.arange(shards + 1)).tolist(), []
        for s in range(shards):
            mine = order[edges[s] : edges[s + 1]]
            if len(mine):
                first = pairs.first[mine]
                new = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
                contexts = pairs.number[first[new]]
                rows.append((block, s, _numbers(np.diff(contexts, prepend=np.uint64(0)), np.diff(np.append(new, len(mine))), pairs.count[first[new]], pairs.number[pairs.second[mine]], pairs.times[mine]), None, None, None))
        rows += [(block, ASKS, None, int(pairs.number[v]), None, None) for v in np.flatnonzero(pairs.count > most).tolist()]
        return _rows(rows)

    return run


def merged(context: np.ndarray, word: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct pair seen in training, in order, and its summed count."""
    wide = int(word.max(initial=0)) + 1
    one_key = int(context.max(initial=0)) * wide < 1 << 63
    order = np.argsort(context * np.uint64(wide) + word) if one_key else np.lexsort((word, context))
    if not len(order):
        return order, np.zeros(0, np.int64)
    c, w = context[order], word[order]
    new = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])))
    del c, w
    times = np.add.reduceat(times[order].astype(np.int64), new)
    return order[new][times > 0], times[times > 0]


def discount(n1: int, n2: int) -> float:
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def build_trie(context: np.ndarray, word: np.ndarray, times: np.ndarray, total: np.ndarray, d: float | None = None) -> Trie:
    """The trie of pairs seen in training. total: c(v) of each row's context. d: the discount (None: of these pairs). Rows of one pair are summed."""
    chosen, times = merged(context, word, times)
    context, word, total = context[chosen], word[chosen], total[chosen].astype(float)
    d = discount(int((times == 1).sum()), int((times == 2).sum())) if d is None else d
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
    types = np.diff(np.append(first, len(context)))
    return Trie.of(context, word, (times - d) / total, d * types / total[first])


def _sent(table: pa.Table) -> list[list[np.ndarray]]:
    """Of each block's row: contexts, their numbers of pairs, their counts, and the pairs' words and training counts."""
    out = []
    for data in table.column("data").to_pylist():
        gaps, lengths, total, word, times = _read_numbers(data)
        out.append([np.cumsum(gaps, dtype=np.uint64), lengths.astype(np.int32), total, word, times.astype(np.uint32)])
    return out


def _wide(shares: list[list[np.ndarray]], k: int) -> np.ndarray:
    return np.concatenate([np.repeat(s[k], s[1]) if k < 3 else s[k] for s in shares])


def _count_pairs(table: pa.Table) -> pa.Table:
    """How many of a shard's pairs were seen once (a) and twice (b)."""
    shares = _sent(table)
    times = merged(_wide(shares, 0), _wide(shares, 3), _wide(shares, 4))[1]
    return _rows([(-1, table.column("shard")[0].as_py(), None, int((times == 1).sum()), int((times == 2).sum()), None)])


def _answer_pairs(most: int, d: float):
    def run(table: pa.Table) -> pa.Table:
        """Codes of each block's pairs and back-off codes of its contexts; for block -1 a row for each hot context (a) with how many words follow it here (b)."""
        shard, shares = table.column("shard")[0].as_py(), _sent(table)
        trie = build_trie(_wide(shares, 0), _wide(shares, 3), _wide(shares, 4), _wide(shares, 2), d)
        handle, path = tempfile.mkstemp(suffix=".trie")
        os.close(handle)
        try:
            trie.write(path)
            trie = trie.mapped(path)
            rows, hot = [], {}
            for block, (contexts, lengths, total, word, _) in zip(table.column("block").to_pylist(), shares, strict=True):
                place = trie.find_contexts(contexts)
                codes = trie.find(np.repeat(place, lengths), word)
                back = np.full(len(place), ABSENT, np.uint16)
                back[place >= 0] = trie.back_codes[place[place >= 0]]
                mine = np.flatnonzero((total > most) & (place >= 0))
                types = trie.pointers.access(place[mine] + 1) - trie.pointers.access(place[mine])
                hot.update(zip(contexts[mine].tolist(), types.tolist(), strict=True))
                head = np.array([len(codes), len(back)], "<i8").tobytes()
                rows.append((block, shard, B.squeeze(head + B.to_planes(codes, 2) + B.to_planes(back, 2)), None, None, None))
            rows += [(-1, shard, None, v, n, None) for v, n in hot.items()]
            return _rows(rows)
        finally:
            os.unlink(path)

    return run


def _read_codes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs and back-off codes of the contexts."""
    data = B.expand(data)
    n, m = np.frombuffer(data, "<i8", 2).tolist()
    return B.from_planes(data[16 : 16 + 2 * n], 2), B.from_planes(data[16 + 2 * n : 16 + 2 * (n + m)], 2)


def _values() -> np.ndarray:
    """What each code stands for; ABSENT: nothing."""
    return np.append(10.0 ** (np.arange(ABSENT) / -STEPS), 0.0)


def _finish(texts: int, tokens: int, types: int, shards: int, most: int, d: float):
    def run(table: pa.Table) -> pa.Table:
        block, pairs = _pairs(table, texts)
        q, weight = np.full(len(pairs.first), ABSENT, np.uint16), np.zeros(len(pairs.number), np.uint16)
        order, _ = pairs.dealt(shards, most)
        columns = [table.column(c).to_pylist() for c in ("kind", "shard", "data", "a", "b")]
        at = 0
        for _, data in sorted((s, x) for k, s, x, _, _ in zip(*columns, strict=True) if k == 2):
            codes, back = _read_codes(data)
            mine = order[at : at + len(codes)]
            at += len(codes)
            q[mine] = codes
            first = pairs.first[mine]
            contexts = first[np.append(True, first[1:] != first[:-1])]
            weight[contexts] = np.where(back == ABSENT, weight[contexts], back)
        del order
        hot = {a: b for k, _, _, a, b in zip(*columns, strict=True) if k == 3}
        for v in np.flatnonzero(pairs.count > most).tolist():
            follow = hot.get(int(pairs.number[v]), 0)
            weight[v] = quantised(np.array([d * follow / float(pairs.count[v])]))[0] if follow else 0
        value_of, base = _values(), (pairs.count + ADDED) / (tokens + ADDED * (types + 1))
        value = np.log10(base)[pairs.word]
        base_score = np.add.reduceat(value, pairs.starts)
        value[pairs.known] = np.log10(value_of[q[pairs.at]] + value_of[weight[pairs.context[pairs.known]]] * base[pairs.word[pairs.known]])
        return pa.table(
            {
                "doc_id": pa.array(block.ids, pa.int64()),
                "held_out": pa.array(~_learning(block)),
                "n_tokens": pa.array(pairs.lengths.astype(np.int64)),
                "n_known": pa.array(np.add.reduceat(pairs.count[pairs.word] > 0, pairs.starts, dtype=np.int64)),
                "train_tokens": pa.array([tokens] * len(block.ids), pa.int64()),
                "base_score": pa.array(base_score),
                "score": pa.array(np.add.reduceat(value, pairs.starts)),
            }
        )

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, shard_pairs: int = SHARD_PAIRS, word_shards: int | None = None, pair_shards: int | None = None) -> DataFrame:
    """The operator: a row of RESULT for each document."""
    spark = docs.sparkSession
    word_shards = word_shards or max(2 * spark.sparkContext.defaultParallelism, docs.select("doc_id").rdd.getNumPartitions())
    rows = saved(_block_rows(docs, word_shards), "lm-blocks")
    texts, size = rows.where("shard = -1").agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    words = saved(rows.where("shard >= 0").select(*NAMES).groupBy("shard").applyInArrow(_sum_words(word_shards), SCHEMA), "lm-words")
    tokens, types = words.where("block = -1").agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    tokens, types = tokens + texts, types + (texts > 0)
    known = rows.where("shard = -1").withColumn("kind", F.lit(0)).unionByName(words.where("block >= 0").withColumn("kind", F.lit(1)))
    shards = pair_shards or max(spark.sparkContext.defaultParallelism, -(-size // shard_pairs))
    sent = known.groupBy("block").applyInArrow(_send_pairs(texts, shards, shard_pairs), SCHEMA)
    sent = saved_by(sent.repartition(shards, "shard"), "lm-sent", "shard", shards)
    pairs = sent.where(F.col("shard") != ASKS)
    once, twice = pairs.groupBy("shard").applyInArrow(_count_pairs, SCHEMA).agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    d = discount(once, twice)
    answered = saved(pairs.groupBy("shard").applyInArrow(_answer_pairs(shard_pairs, d), SCHEMA), "lm-pairs")
    followers = answered.where("block = -1").groupBy("a").agg(F.sum("b").alias("b"))
    hot = sent.where(F.col("shard") == ASKS).select("block", "a").join(followers, "a").select("block", F.lit(ASKS).alias("shard"), F.lit(None).cast("binary").alias("data"), "a", "b", F.lit(None).cast("double").alias("x"))
    every = known.unionByName(answered.where("block >= 0").withColumn("kind", F.lit(2))).unionByName(hot.withColumn("kind", F.lit(3)))
    return every.groupBy("block").applyInArrow(_finish(texts, tokens, types, shards, shard_pairs, d), RESULT)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
ORACLES: dict[str, str] = {}
