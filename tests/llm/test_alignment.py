import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F
from tests.llm import cases
from tokenizers import Tokenizer

from tuplewright.llm import alignment

ODD = ["a", "b", "the", " ", "  ", "   ", "\n", "\r", "\r\n", "\t", "\xa0", "\x1c", "\x85", " ", "　", "é", "日本語", "🙂", "!", "();", ")", "}", "'s", "12", "\x00", "<s>", "</s>", "​", "﻿", "é", "{\r", "\x0b", "<|endoftext|>", " \r", "ﬁ", " "]


class Whole:
    """Both libraries on whole texts."""

    def __init__(self):
        self.a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}

    def __call__(self, text):
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return None
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 300 else list(_sums(parts))
        return a, ends(bytes_a), b, ends(bytes_b)


def _sums(parts):
    at = 0
    for p in parts:
        at += len(p)
        yield at


def brute(rows):
    whole, tokens = Whole(), []
    docs_of = Counter()
    for _, text in rows:
        t = whole(text)
        if t is None:
            tokens.append(None)
            continue
        a, ae, b, be = t
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):  # ranges overlap
            links.append((a[i], b[j]))
            step_a, step_b = ae[i] <= be[j], be[j] <= ae[i]
            i, j = i + step_a, j + step_b
        cuts = sorted(set(ae) & set(be))
        groups, x, y = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while x < len(a) and ae[x] <= c:
                ga.append(a[x])
                x += 1
            while y < len(b) and be[y] <= c:
                gb.append(b[y])
                y += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        tokens.append((len(a), len(b), groups, links))
        docs_of.update(set(links))
    best = defaultdict(int)
    for (a, _), n in docs_of.items():
        best[a] = max(best[a], n)
    out = []
    for (doc, _), t in zip(rows, tokens, strict=True):
        if t is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, groups, links = t
            out.append((doc, na, nb, len(groups), len(links), sum(docs_of[x] == best[x[0]] for x in links), sum(docs_of[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_whole_texts(spark):
    rng = random.Random(3)
    given = [(r[0], r[1]) for r in cases.rows()] + [(1000 + i, "".join(rng.choices(ODD, k=rng.randint(1, 14)))) for i in range(400)]
    given += [(5000, "holds the mark ▁ itself"), (5001, "no break " + "日本語の長い文" * 400), (5002, "x" * 3000 + " y")] + [(6000 + i, "hot text of all") for i in range(60)]
    docs = spark.createDataFrame([(d, t, 1, "u") for d, t in given], "doc_id long, text string, links int, units string").repartition(3)
    got = alignment.align(docs, most=2000)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert all(t == "bigint" for c, t in got.dtypes if c != "groups_sha256")
    want = brute(given)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(r[1] > 0 for r in want) > 400 and any(r[2] == 0 for r in want)


def test_whole_table_and_cold_pairs(spark, monkeypatch):
    """Documents of the test tables, with pairs that come back by shuffle."""
    monkeypatch.setattr(alignment, "HOT_PAIRS", 50)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, alignment.align(docs, most=100_000).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], cases.SCHEMA)).collect() == []


def test_a_block_holds_a_megabyte_of_text(spark):
    """Aligning holds a block's tokens and groups on the heap, so blocks are small by default and no result depends on them."""
    rows = [(i, f"{i} " + "some words of a text, " * 2000) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    made = alignment.tokenised(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)
    sizes = [r.n for r in made.selectExpr("aggregate(docs, 0L, (n, d) -> n + length(array_join(transform(d.units, i -> ''), ',')) + 1) n").collect()]
    assert len(sizes) >= 3 and max(sizes) * 4 <= 1 << 20


def test_few_blocks_to_a_file(spark, monkeypatch):
    """A reading task holds the rows of a file at once, up to 4096."""
    made = []
    whole = alignment.saved
    monkeypatch.setattr(alignment, "saved", lambda df, name, *more: made.append((name, whole(df, name, *more))) or made[-1][1])
    docs = spark.createDataFrame([(i, f"a text of its own {i}") for i in range(40)], "doc_id long, text string").repartition(1)
    assert alignment.align(docs, most=40).count() == 40
    aligned = dict(made)["aligned"]
    most = aligned.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert aligned.count() > 8 and most <= 4


def test_a_unit_is_aligned_once_a_task(spark, monkeypatch):
    """Not once a block, and a row each; where units are counted anew, and they are several times, results are the same."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(ODD + ["words", "of", "all", "texts"], k=30))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    of = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)
    units = {u for _, text in rows if alignment.MARK not in text for u in alignment.tokens(*of).units(text)}
    made = alignment.tokenised(docs, *of, most=300)
    assert made.select("block").distinct().count() > 8
    assert made.where("a is not null").count() == len(units)
    monkeypatch.setattr(alignment, "UNITS_HELD", 60)
    anew = alignment.tokenised(docs, *of, most=300).where("held = 0")
    assert anew.select("block").distinct().count() > 3
    assert sorted(map(tuple, alignment.align(docs, most=300).collect()), key=str) == brute(rows)
