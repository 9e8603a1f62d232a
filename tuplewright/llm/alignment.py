"""Alignment of two tokenizers' tokens over the bytes of each text, and how often each pair of tokens meets.

Tokenizer A (a byte-level BPE file) reads a space and the text; tokenizer B (a sentence-piece model, which adds the space
itself) reads the text. Both cut the same bytes. Offsets at which tokens of both end cut them into groups; two tokens
whose ranges overlap are a link.

Method. After tokenising, Spark's higher-order functions align each unit. A unit's ends of A and of B are intersected
(``array_intersect``: its groups' ends), and ``transform`` finds each group's last tokens. The ends of both together
(``array_union``) are its links: each is a link of the tokens that cover the byte before it.

Units. A text is cut where a white space follows something else, but for those white spaces that a piece of B can have
after something (the carriage return). No token of either crosses such a place, as the vocabularies show (where B's
pieces hold spaces inside, a whole text is one unit), so each unit is tokenised and aligned by itself, once a task
(anew after some ``UNITS_HELD``, which bounds what a task holds), and a text is the list of its units. Tests hold this against the
libraries on whole texts.

How it is distributed. A map task's texts become rows: its units, one to a row, so that the functions' arrays are short, and
behind them the documents of about ``BLOCK_BYTES`` of text as lists of units' numbers. The aligned units stay in their task, where
documents' groups are hashed and each document's distinct pairs are counted, and a block becomes a row. Blocks are
saved, ``FILE_BLOCKS`` to a file, as many as a task that reads them holds at once. Blocks' counts of pairs are summed.
They return to the pairs of a block: those of frequent pairs (more than a ``HOT_PAIRS``-th of all, so
fewer than ``HOT_PAIRS``) by broadcast, the others by shuffle, and then to the block, whose documents are summed up. The best count of each
id of A is broadcast: as many rows as A has ids. No text is shuffled; what is, are blocks' pairs and lists of numbers. A document longer than
a block is a block of its own.

Nulls and edge cases: null and empty texts, and texts whose bytes either tokenizer does not give back (those with
U+2581), have no tokens: zeros and an empty digest; a null doc_id is kept; repeated rows each count as a document; an
empty table gives no rows; other columns are ignored. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewright.llm.common import by_bytes, documents, join_hot, saved, texts
from tuplewright.llm.packing import encoder

BLOCK_BYTES = 4 << 20
ROW_BYTES = 1 << 20
UNIT_ROWS = 2048
UNITS_HELD = 450_000
FILE_BLOCKS = 4
HOT_PAIRS = 200_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 256
MARK = "▁"
SPACES = "\t-\r \x85\xa0  -     　"  # \s in the patterns of byte-level vocabularies

UNITS = "a array<int>, ae array<int>, at_a array<int>, b array<int>, be array<int>, at_b array<int>"
DOCS_SQL = "array<struct<doc_id:long,n_a:long,n_b:long,units:array<int>>>"
DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("units", pa.list_(pa.int32()))]))
BLOCKS = "block long, pairs array<long>, n array<long>, unit_links array<int>, places array<int>, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,units:array<int>>>"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokens:
    """Both tokenizers on units."""

    def __init__(self, path_a: str, path_b: str, pattern: str) -> None:
        import sentencepiece

        self.a, self.b = encoder(path_a, pattern), sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(MARK)
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        white = set(re.findall(f"[{SPACES}]", "".join(map(chr, range(0x3001)))))
        joined = "".join(sorted({y for p in plain for y in p[1:] if y in white}))  # white spaces that a piece can have after something
        more = f"(?:[{re.escape(joined)}][{SPACES}]*[^{SPACES}]*)*" if joined else ""
        inside = any(x not in white and x != MARK and y == MARK for p in plain for x, y in zip(p, p[1:], strict=False))
        self.unit = re.compile("(?s:.+)" if inside else f"[{SPACES}]*[^{SPACES}]+{more}|[{SPACES}]+")
        self.bytes_a = {self.a.encode_single_token(x): x for x in self.a.token_byte_values()}
        self.width_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(self.a.n_vocab)], np.int32)
        self.width_b = np.array([len(x) for x in self.bytes_b], np.int32)

    def units(self, text: str) -> list[str]:
        """Of the space and the text."""
        return self.unit.findall(" " + text)

    def of_b(self, units: list[str]) -> list[list[int]]:
        out = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for i, u in enumerate(units):
            if u == " ":
                out[i] = [self.mark]
            elif u[0] != " ":  # the space that the model adds is a token of its own here
                if out[i][0] != self.mark:
                    raise ValueError(f"the piece model joins a space to {u[:1]!r}")
                del out[i][0]
        return out

    def both(self, units: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """The ids of A and of B for each unit; None if either doesn't give the bytes back."""
        a, b = list(map(self.a.encode_ordinary, units)), self.of_b(units)
        joined = lambda side, of: b"".join(map(of.__getitem__, chain.from_iterable(side)))
        if joined(a, self.bytes_a) == joined(b, self.bytes_b) == "".join(units).encode():
            return list(zip(a, b, strict=True))
        return [(x, y) if joined([x], self.bytes_a) == joined([y], self.bytes_b) == u.encode() else None for x, y, u in zip(a, b, units, strict=True)]


class Units:
    """A task's distinct units, how many tokens each has, and the tokens of the newest, one after another."""

    def __init__(self, of: Tokens) -> None:
        self.of, self.places, self.sent = of, {}, 0
        self.a, self.b, self.na, self.nb = (array("i") for _ in range(4))

    def drained(self) -> tuple[array, array, array, array]:
        """Ids of A and B, and how many of each a unit has, of the units since the last call."""
        out = self.a, self.b, self.na[self.sent :], self.nb[self.sent :]
        self.a, self.b, self.sent = array("i"), array("i"), len(self.places)
        return out

    def listed(self, text: str) -> list[int]:
        """A text's units as places, new ones added; none if a tokenizer doesn't give its bytes back."""
        if not text or MARK in text:
            return []
        units, places = self.of.units(text), self.places
        new = [u for u in dict.fromkeys(units) if u not in places]
        found = self.of.both(new) if new else []
        if None in found:
            return []
        for u, (a, b) in zip(new, found, strict=True):
            places[u] = len(places)
            self.na.append(len(a))
            self.nb.append(len(b))
            self.a.extend(a)
            self.b.extend(b)
        return [places[u] for u in units]


@lru_cache(maxsize=2)
def tokens(path_a: str, path_b: str, pattern: str) -> Tokens:
    return Tokens(path_a, path_b, pattern)


def tokenised(docs: DataFrame, path_a: str, path_b: str, pattern: str, most: int = BLOCK_BYTES) -> DataFrame:
    """Blocks as rows, in order: each unit that is new, then documents as lists of units (from 0; none: no tokens), some ``ROW_BYTES`` of text to a row.

    held: how many units came with earlier blocks; 0 where units are counted anew, after some ``UNITS_HELD``. a, ae, b, be: ids and ends (bytes from the unit's start) of both tokenizers; at_a, at_b: for each byte the place of
    the token that covers it. All null in rows of documents, whose docs alone are not empty.
    """
    names = [c.split()[0] for c in UNITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokens(path_a, path_b, pattern)
        base, made = TaskContext.get().partitionId() << 32, 0
        units = Units(of)
        rows: list[tuple[list[int | None], list[array]]] = []
        size = row = 0

        def side(ids: array, widths: np.ndarray, n: np.ndarray) -> list[pa.ListArray]:
            """Ids, ends and places by byte of all units."""
            ids = np.array(ids, np.int32)
            widths, last = widths[ids], np.cumsum(n)
            ends = np.concatenate([[0], np.cumsum(widths)])
            starts = np.concatenate([[0], last])
            lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))
            places = np.arange(len(ids)) - np.repeat(starts[:-1], n)
            return [lists(starts, ids), lists(starts, ends[1:] - np.repeat(ends[starts[:-1]], n)), lists(ends[starts], np.repeat(places, widths))]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, size, row, units, rows
            held = units.sent
            a, b, new_a, new_b = units.drained()
            lists = side(a, of.width_a, np.array(new_a, np.int64)) + side(b, of.width_b, np.array(new_b, np.int64))
            na, nb = np.array(units.na, np.int64), np.array(units.nb, np.int64)
            for at in range(0, len(new_a), UNIT_ROWS):
                part = [x.slice(at, UNIT_ROWS) for x in lists]
                n = len(part[0])
                none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], DOCS.value_type))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, base + made)), pa.array(np.full(n, held, np.int32)), *part, none], ["block", "held", *names, "docs"])
            for ids, found in rows:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                flat = np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in found)])
                sums = [np.concatenate([[0], np.cumsum(n[flat])]) for n in (na, nb)]
                totals = [pa.array(x[ends[1:]] - x[ends[:-1]]) for x in sums]
                of_row = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), *totals, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["doc_id", "n_a", "n_b", "units"])
                one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), of_row)
                yield pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([held], pa.int32()), *(pa.nulls(1, pa.list_(pa.int32())) for _ in names), one], ["block", "held", *names, "docs"])
            made, size, row, rows = made + 1, 0, 0, []
            if len(units.places) > UNITS_HELD:
                units = Units(of)

        for batch in by_bytes(batches):
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                n = len(text)
                if rows and size + n > most:
                    yield from flush()
                if not rows or row + n > ROW_BYTES:
                    rows.append(([], []))
                    row = 0
                size, row = size + n, row + n
                rows[-1][0].append(doc)
                rows[-1][1].append(array("i", units.listed(text)))
        if rows:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"block long, held int, {UNITS}, docs {DOCS_SQL}")


def unit_links(a: Column, ae: Column, at_a: Column, b: Column, be: Column, at_b: Column) -> Column:
    """A unit's links as a * 2**32 + b: one for each offset at which a token of either ends, of the tokens that cover the byte before."""
    return F.transform(F.array_union(ae, be), lambda e: F.shiftleft(F.get(a, F.get(at_a, e - 1)).cast("long"), 32).bitwiseOR(F.get(b, F.get(at_b, e - 1)).cast("long")))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements one after another, and where each list starts (and the last one ends)."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each list's values."""
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return before[starts[1:]] - before[starts[:-1]]


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


class Held:
    """A task's aligned units: the text of each one's groups, how many groups, and its links."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.groups, self.links, self.n_links = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, units: pa.Table) -> None:
        ids = {x: _flat(_column(units, x)) for x in ("a", "b", "last_a", "last_b", "links")}
        of = ids["last_a"][1]  # units' groups

        def side(ids: tuple[np.ndarray, np.ndarray], last: tuple[np.ndarray, np.ndarray]) -> pa.Array:
            """Each group's ids of one tokenizer as text."""
            ends = np.concatenate([[0], last[0] + np.repeat(ids[1][:-1], np.diff(of)) + 1])
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[0]).cast(pa.string())), ",")

        groups = pc.binary_join_element_wise(side(ids["a"], ids["last_a"]), side(ids["b"], ids["last_b"]), "|")
        self.texts += pc.binary_join(pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), groups), ";").to_pylist()
        self.groups = np.concatenate([self.groups, np.diff(of)])
        self.links = np.concatenate([self.links, ids["links"][0]])
        self.n_links = np.concatenate([self.n_links, np.diff(ids["links"][1])])


def _ranges(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each start, so many, one after another."""
    return np.repeat(starts - np.cumsum(many) + many, many) + np.arange(many.sum())


def block_row(block: int, held: Held, parts: list[pa.StructArray]) -> pa.RecordBatch:
    """A block's documents, and the pairs and links of their units."""
    doc_id, n_a, n_b, lists = pa.concat_arrays(parts).flatten()
    units, ends = _flat(lists)
    own, units = np.unique(units, return_inverse=True)
    n_links, groups = held.n_links[own], held.groups[own]
    texts_of = list(map(held.texts.__getitem__, own.tolist()))
    links = held.links[_ranges((np.cumsum(held.n_links) - held.n_links)[own], n_links)]
    pairs, place = np.unique(links, return_inverse=True)
    place, starts, n = place.astype(np.int32), np.cumsum(n_links) - n_links, np.zeros(len(pairs), np.int64)
    digests = []
    for i, end in zip(ends, ends[1:], strict=False):
        if i == end:
            digests.append("")
            continue
        of = units[i:end]
        digests.append(hashlib.sha256(";".join(map(texts_of.__getitem__, of.tolist())).encode()).hexdigest())
        once = np.unique(of)
        n[np.unique(place[_ranges(starts[once], n_links[once])])] += 1
    sums = [pa.array(_sums(x[units], ends)) for x in (groups, n_links)]
    listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(units.astype(np.int32)))
    docs = pa.StructArray.from_arrays([doc_id, n_a, n_b, *sums, pa.array(digests, pa.string()), listed], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "units"])
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    lists = [one(pa.array(x)) for x in (pairs, n, n_links.astype(np.int32), place)]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists, one(docs)], ["block", "pairs", "n", "unit_links", "places", "docs"])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligned units and documents, in order, to a row for each block."""
    held, parts = Held(), []

    def row() -> pa.RecordBatch:
        nonlocal held
        rows = pa.Table.from_batches(parts)
        if not rows.column("held")[0].as_py():
            held = Held()
        units = rows.filter(rows.column("links").is_valid())
        if units.num_rows:
            held.add(units)
        docs = [x for x in (c.flatten() for c in rows.column("docs").chunks) if len(x)]
        return block_row(rows.column("block")[0].as_py(), held, docs)

    for batch in batches:
        block = batch.column("block").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for i, end in zip(cuts, cuts[1:], strict=False):
            if parts and i < end and parts[0].column("block")[0].as_py() != block[i]:
                yield row()
                parts = []
            if i < end:
                parts.append(batch.slice(i, end - i))
    if parts:
        yield row()


def blocks(rows: DataFrame) -> DataFrame:
    """Tokenised blocks, a row each: pairs (longs a * 2**32 + b) with n, how many of its documents have each; how many links each unit has and, one after
    another, their places among the pairs; docs: doc_id, units, n_a, n_b, n_groups, n_links, groups_sha256."""
    a, ae, at_a, b, be, at_b = (F.col(c.split()[0]) for c in UNITS.split(", "))
    last = lambda at: F.transform("cuts", lambda end: F.get(at, end - 1))
    rows = rows.select("*", F.array_intersect(ae, be).alias("cuts"))  # offsets where tokens of both end: a group's last tokens
    aligned = rows.select("block", "held", a, b, last(at_a).alias("last_a"), last(at_b).alias("last_b"), unit_links(a, ae, at_a, b, be, at_b).alias("links"), "docs")
    return aligned.mapInArrow(gathered, BLOCKS)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n: how many documents have it."""
    rows = found.select(F.explode(F.arrays_zip("pairs", "n")).alias("x")).select(F.col("x.pairs").alias("pair"), "x.n")
    return rows.groupBy("pair").agg(F.sum("n").alias("n"))


def summed(block: pa.Table, scores: pa.Table) -> pa.Table:
    """The documents of a block with the sums over their links. scores: place, n and best of each pair of the block."""
    at = scores.column("place").to_numpy()
    n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    n[at], best[at] = scores.column("n").to_numpy(), scores.column("best").to_numpy()
    places, (many, _) = _flat(_column(block, "places"))[0], _flat(_column(block, "unit_links"))
    starts = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
    docs = _column(block, "docs").flatten()
    columns = dict(zip([f.name for f in docs.type], docs.flatten(), strict=True))
    units, ends = _flat(columns.pop("units"))
    columns |= {c: pa.array(_sums(_sums(x[places], starts)[units], ends)) for c, x in (("n_best", best), ("count_sum", n))}
    return pa.table({c.split()[0]: columns[c.split()[0]] for c in OUT.split(", ")})


def scored(found: DataFrame) -> DataFrame:
    """The documents with n_best and count_sum, one row each."""
    counts = saved(pair_counts(found), "pair-counts")
    side = F.shiftright("pair", 32).alias("a")
    best = counts.groupBy(side).agg(F.max("n").alias("most"))  # a row for each id of A
    counts = saved(counts.withColumn("a", side).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pair-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = found.select("block", F.posexplode("pairs").alias("place", "pair"))
    scores = join_hot(pairs, counts.withColumn("copies", F.col("n")), "pair", "copies", total, HOT_PAIRS).select(F.col("block").alias("of"), "place", "n", "best")
    return found.select("block", "unit_links", "places", "docs").groupBy("block").cogroup(scores.groupBy("of")).applyInArrow(summed, OUT)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows for the jobs inside: texts that wait for a block are held once on each side."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, pattern: str | None = None, most: int = BLOCK_BYTES) -> DataFrame:
    """The operator: documents (doc_id, text) to doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import public_tokenizers as P

    rows = tokenised(docs, path_a or P.path("byte_bpe_50k.json"), path_b or P.path("piece_bpe_32k.model"), pattern or P.PATTERN, most)
    with _small_batches(docs.sparkSession):
        aligned = saved(blocks(rows), "aligned", FILE_BLOCKS)
    return scored(aligned)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))


QUERIES = {"op13_alignment": op13_alignment}
ORACLES: dict[str, str] = {}
