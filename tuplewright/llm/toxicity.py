"""Toxicity by class-conditional Kneser-Ney models.

Method: toxic and ordinary texts each get a Kneser-Ney bigram model with absolute discounting,

    p_c(w | v) = max(k_c(v, w) - D2, 0) / K_c(v) + B_c(v) * p_c(w)
    p_c(w)     = max(k_c(w) - D1, 0) / K_c + B_c * 1 / (V + 1)

Counts are continuation counts at both levels: k_c(w) are the distinct words seen before w in class c,
k_c(v, w) those before the pair; B is the share that was taken off. Copies of a passage thus count once.
The lowest level is shared by the classes: each of the V words of both, and any other, is equally likely,
so that what is too rare to tell is as likely in either. A count of one is taken off whole; above it D1
is n1 / (n1 + 2 n2), and D2 is ``PAIR_DISCOUNT`` contexts: a pair speaks for itself only when it is
common in one class, else its words do. (D2 from n1 and n2 of the pairs lets chance pairs outweigh words: README has
both measured.)

A text's evidence is the length-normalised difference of its log-likelihoods: over the whole text, and
over its strongest stretch of each of ``WINDOWS`` words (so that an insult in a long text isn't thinned
out). A logistic fit over these, on texts that the counts have not seen, turns them into a score.

Training uses at most ``SAMPLE`` labelled texts of each class, those of least hash of their id; the bound
is a parameter. The fit is made on a third of the sample with counts from the other two, the counts that
score are of the whole sample. Spark counts: distinct contexts of each pair, then sums for each word; the third's features are made in tasks. The
driver gets a row of sums for each word, the pairs that pass the discount and the features, no text. Where a class has none, every score is the share of label 1 in the sample.
Texts are scored in one map with the model as a broadcast value, whose size the sample bounds: a hash
and a log ratio for each word and for each pair that passed the discount.

Words are runs of letters of the lower-cased text, hashed by XXH64.

Nulls and edge cases: a null text is the empty text and gets the score of no evidence; a null label or id is
not learnt from; labels repeated with another value each count; repeated rows are learnt from once; a null doc_id is
scored; repeated rows get equal scores; no labels at all: score 0; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewright.llm.common import by_bytes, doc_crc, documents, saved, texts

SAMPLE = 4500
WINDOWS = (3, 6, 12, 40)
PAIR_DISCOUNT = 16.0
THRESHOLD = 0.3
HELD_OUT = 2  # of crc32(doc_id) mod 4

_WORDS = re.compile(r"[^\W\d_]+")


def word_hashes(text: str) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) for w in _WORDS.findall(text.lower())], np.uint64)


def pairs_of(words: np.ndarray) -> np.ndarray:
    """A hash of each word with the one before it."""
    return words[:-1] * np.uint64(0x9E3779B97F4A7C15) + (words[1:] ^ (words[1:] >> np.uint64(29)))


def discount(counts: np.ndarray) -> float:
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return n1 / (n1 + 2 * n2) if n1 else 0.5


def kneser_ney(counts: np.ndarray, group: np.ndarray, groups: int, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Of counts by group: each one's discounted share of its group, and per group the share that was taken off (1 if it's empty)."""
    off = np.where(counts > 1, np.minimum(counts, d), np.minimum(counts, 1))
    total = np.bincount(group, counts, minlength=groups)
    return (counts - off) / np.maximum(total, 1)[group], np.where(total > 0, np.bincount(group, off, minlength=groups) / np.maximum(total, 1), 1.0)


class ClassModels:
    """Log ratios (toxic less ordinary) of words and of words in context, as sorted arrays."""

    def __init__(self, by_class: tuple[list[np.ndarray], list[np.ndarray]]) -> None:
        """by_class: the word hashes of each ordinary, and of each toxic text."""
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *(d for docs in by_class for d in docs)]))
        size = len(self.words)
        codes, contexts = [], []  # per class: distinct bigrams as v * size + w, and the distinct words before each
        for docs in by_class:
            ids = [np.searchsorted(self.words, d).astype(np.int32) for d in docs if len(d) > 1]
            two = np.concatenate([np.zeros(0, np.int64), *(i[:-1] * np.int64(size) + i[1:] for i in ids)])
            before = np.concatenate([np.zeros(0, np.int32), *(np.append(np.int32(-1), i[:-2]) for i in ids)])
            del ids
            order = np.lexsort((before, two))
            two, before = two[order], before[order]
            del order
            new = np.append(np.ones(min(1, len(two)), bool), (two[1:] != two[:-1]) | (before[1:] != before[:-1]))
            del before
            code, count = np.unique(two[new], return_counts=True)
            del two, new
            codes.append(code)
            contexts.append(count.astype(np.int32))
        cont = [np.bincount(c % max(size, 1), minlength=size) for c in codes]
        either = np.unique(np.concatenate(codes))
        group, word = (either // max(size, 1)).astype(np.int32), (either % max(size, 1)).astype(np.int32)
        seen = []
        for c in (0, 1):
            seen.append(np.zeros(len(either), np.int32))
            seen[c][np.searchsorted(either, codes[c])] = contexts[c]
        del codes, contexts, either
        keep = np.maximum(*seen) > PAIR_DISCOUNT  # the others have the value of the lower level
        total, off = ([np.bincount(group, x, minlength=size) for x in of] for of in (seen, [np.minimum(x, PAIR_DISCOUNT) for x in seen]))
        self._ratios(cont, total, off, group[keep], word[keep], [x[keep] for x in seen])

    @classmethod
    def of_counts(cls, words: pa.Table, pairs: pa.Table, which: str) -> ClassModels:
        """The same from the tables of ``counts``. which: every or part."""
        words = words.filter(pc.greater(words.column(f"{which}_has"), 0))
        column = lambda t, c: t.column(c).to_numpy()
        known = column(words, "word").view(np.uint64)
        order = np.argsort(known)
        by_class = lambda t, c, at: [column(t, f"{which}_{c}_{i}")[at] for i in (0, 1)]
        model = cls.__new__(cls)
        model.words = known[order]
        seen = by_class(pairs, "seen", slice(None))
        keep = np.maximum(*seen) > PAIR_DISCOUNT
        group, word = (np.searchsorted(model.words, column(pairs, c).view(np.uint64)[keep]) for c in ("v", "w"))
        model._ratios(*(by_class(words, c, order) for c in ("cont", "total", "off")), group, word, [x[keep] for x in seen])
        return model

    def _ratios(self, cont: list[np.ndarray], total: list[np.ndarray], off: list[np.ndarray], group: np.ndarray, word: np.ndarray, seen: list[np.ndarray]) -> None:
        """By class, for each word: words before it, contexts of pairs that it begins, and how many of these are taken off; for each pair kept, its words' places and contexts."""
        size, uni, taken, back, p = len(self.words), [], [], [], []
        shared = 1 / (size + 1)
        for c in (0, 1):
            share, rest = kneser_ney(cont[c], np.zeros(size, np.int64), 1, discount(cont[c]))
            uni.append(share + rest[0] * shared)
            taken.append(rest[0])
            back.append(np.where(total[c] > 0, off[c] / np.maximum(total[c], 1), 1.0))
            p.append((seen[c] - np.minimum(seen[c], PAIR_DISCOUNT)) / np.maximum(total[c], 1)[group] + back[c][group] * uni[c][word])
        self.unknown = np.float32(np.log(taken[1] / taken[0]))
        self.unigram = np.log(uni[1] / uni[0]).astype(np.float32)
        self.back = np.log(np.maximum(back[1], 1e-9) / np.maximum(back[0], 1e-9)).astype(np.float32)
        keys = pairs_of(np.stack([self.words[group], self.words[word]]))[0]
        order = np.argsort(keys)
        self.pairs, self.pair_ratio = keys[order], np.log(p[1] / p[0])[order].astype(np.float32)
        self.fit = np.zeros(2 + len(WINDOWS))

    def ratios(self, words: np.ndarray) -> np.ndarray:
        """The log ratio of each word of a text after the one before it."""
        if not len(words):
            return np.zeros(0, np.float32)
        if not len(self.words):
            return np.zeros(len(words), np.float32)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[at] == words
        out = np.where(known, self.unigram[at], self.unknown)
        out[1:] += np.where(known[:-1], self.back[at[:-1]], 0)
        if len(self.pairs) and len(words) > 1:
            keys = pairs_of(words)
            found = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            out[1:] = np.where(self.pairs[found] == keys, self.pair_ratio[found], out[1:])
        return out

    def features(self, words: np.ndarray) -> list[float]:
        """Mean log ratio of the text, and of its strongest window of each width."""
        r = self.ratios(words)
        if not len(r):
            return [0.0] * (1 + len(WINDOWS))
        s = np.concatenate([[0.0], np.cumsum(r, dtype=np.float64)])
        return [s[-1] / len(r), *((s[n:] - s[:-n]).max() / n for n in (min(w, len(r)) for w in WINDOWS))]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.fit[0] + features @ self.fit[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Intercept and weights by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(rows: list[tuple[int, int, str | np.ndarray]], share: float) -> ClassModels:
    """rows: (fold 0..2, label, text or its word hashes). share: of label 1 among all labelled rows, to which the fit's intercept is set.

    Counts come from folds 0 and 1, the fit from fold 2; then counts from all folds score with that fit.
    """
    hashed = [(f, y, word_hashes(t) if isinstance(t, str) else t) for f, y, t in rows]
    pick = lambda keep: tuple([w for f, y, w in hashed if keep(f) and y == c] for c in (0, 1))
    part = ClassModels(pick(lambda f: f < 2))
    held = [(y, part.features(w)) for f, y, w in hashed if f == 2]
    del part
    model = ClassModels(pick(lambda f: True))
    return calibrated(model, [a for a, _ in held], [b for _, b in held], share, all(pick(lambda f: f < 2)))


def calibrated(model: ClassModels, labels: list[int], features: list[list[float]], share: float, both: bool) -> ClassModels:
    """The model with its fit. both: whether the counts behind the features have texts of both classes."""
    y = np.array(labels, float)
    share = min(max(share, 1e-6), 1 - 1e-6)
    if 0 < y.sum() < len(y) and both:
        model.fit = logistic(np.array(features), y)
        model.fit[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    else:
        model.fit[0] = np.log(share / (1 - share))
    return model


def counts(rows: DataFrame) -> tuple[pa.Table, pa.Table]:
    """What ClassModels.of_counts takes, of rows toxic, f, text: sums for each word, and the pairs that are in more than PAIR_DISCOUNT contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            words = [word_hashes(t).view(np.int64) for t in texts(batch)]
            sizes = [len(w) for w in words]
            at = np.concatenate([np.zeros(0, np.int64), *map(np.arange, sizes)])
            w = np.concatenate([np.zeros(0, np.int64), *words])
            before = [pa.array(np.roll(w, k), mask=at < k) for k in (1, 2)]
            toxic, f = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("toxic", "f"))
            yield pa.RecordBatch.from_arrays([pa.array(toxic), pa.array((f < 2).astype(np.int32)), before[0], pa.array(w), before[1]], ["toxic", "part", "v", "w", "before"])

    places = rows.select("toxic", "f", "text").mapInArrow(run, "toxic int, part int, v long, w long, before long").repartition("v", "w")
    of_context = places.groupBy("toxic", "v", "w", "before").agg(F.max("part").alias("part"))
    pairs = saved(of_context.groupBy("toxic", "v", "w").agg(F.count("*").alias("every"), F.sum("part").alias("part")), "toxicity-pairs")
    zero, real = F.lit(0).cast("long"), F.col("v").isNotNull()

    def sums(word: str, cont: bool) -> DataFrame:
        columns = []
        for m in ("every", "part"):
            columns.append((F.col(m) if cont else zero).alias(f"{m}_has"))
            for c in (0, 1):
                mine = lambda x, c=c: F.when(real & (F.col("toxic") == c), x).otherwise(zero)
                columns.append(mine((F.col(m) > 0).cast("long") if cont else zero).alias(f"{m}_cont_{c}"))
                columns.append(mine(zero if cont else F.col(m)).alias(f"{m}_total_{c}"))
                columns.append(mine(zero if cont else F.least(F.col(m), F.lit(int(PAIR_DISCOUNT)))).alias(f"{m}_off_{c}"))
        return pairs.where(F.col(word).isNotNull()).select(F.col(word).alias("word"), *columns)

    rows = sums("w", True).unionByName(sums("v", False))
    words = rows.groupBy("word").agg(*(F.sum(c).cast("int").alias(c) for c in rows.columns[1:]))
    seen = [F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col(m))), zero).alias(f"{m}_seen_{c}") for m in ("every", "part") for c in (0, 1)]
    common = pairs.where(real).groupBy("v", "w").agg(*seen).where(F.greatest("every_seen_0", "every_seen_1") > PAIR_DISCOUNT)
    return words.toArrow(), common.toArrow()


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ClassModels:
    """Counts and fit from at most ``sample`` texts of each class, outside the held-out fold."""
    crc = doc_crc()
    named = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    mine = named.withColumn("doc_id", F.col("_id")).where(crc % 4 != HELD_OUT).withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    labelled = {r[0]: r[1] for r in mine.groupBy("toxic").count().collect()}
    if not labelled:
        return train([], 0.0)
    chosen = [mine.where(F.col("toxic") == c).select("_id", "toxic", "h").distinct().orderBy("h", "_id").limit(sample) for c in (0, 1)]
    keys = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * sample rows at most
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fold = F.pmod(F.shiftright("h", 7), F.lit(3)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("text")).join(keys, "_id").select("_id", "toxic", fold.alias("f"), "text").distinct()

    rows = saved(rows, "toxicity-sample")
    folds = {(r.toxic, r.f) for r in rows.select("toxic", "f").distinct().collect()}
    words, pairs = counts(rows)
    shared = docs.sparkSession.sparkContext.broadcast(ClassModels.of_counts(words, pairs, "part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value
        for batch in by_bytes(batches):
            found = pa.array([part.features(word_hashes(t)) for t in texts(batch)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in order), found], [*order, "features"])

    order = ("_id", "toxic", "text_hash")
    held = rows.where("f = 2").select("_id", "toxic", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "_id long, toxic int, text_hash long, features array<double>").toArrow()
    held = held.sort_by([(c, "ascending") for c in order])
    both = all(any((c, f) in folds for f in (0, 1)) for c in (0, 1))
    share = labelled.get(1, 0) / sum(labelled.values())
    return calibrated(ClassModels.of_counts(words, pairs, "every"), held.column("toxic").to_pylist(), held.column("features").to_pylist(), share, both)


def scored(docs: DataFrame, model: ClassModels, extra: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns named) and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = extra or ["doc_id"]
    chosen = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields if f.name != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in by_bytes(batches, "_text"):
            x = np.array([m.features(word_hashes(t)) for t in texts(batch, "_text")]).reshape(-1, 1 + len(WINDOWS))
            arrays = [batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(m.score(x))], [*columns, "score"])

    return chosen.mapInArrow(run, f"{schema}, score double")


def kept(docs: DataFrame, model: ClassModels, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in by_bytes(batches):
            x = np.array([m.features(word_hashes(t)) for t in texts(batch)]).reshape(-1, 1 + len(WINDOWS))
            yield batch.filter(pa.array(m.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return out.select("doc_id", (doc_crc() % 4 == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
