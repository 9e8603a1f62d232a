"""Host-level quality rules.

Method: each document is measured by rules; rule failures are summed by host (the ``source`` column);
each host's failure rate is shrunk with a beta prior whose two parameters are fitted to all hosts by
the method of moments; a host whose shrunken rate passes ``HOST_RATE`` gives its verdict to all its
documents through a join.

The verdict is on the host: at the default rate of one half a host goes only when most of what it
serves fails, so that sound documents of an ordinary host stay.

Plan: one map over the texts (Arrow batches) yields a narrow row per document, saved once. Host sums
are a partial aggregate, so a host with a third of all rows sends one row per task. The prior comes
from a second aggregate: one row of two numbers, read by the driver. Verdicts come back by a join on host in
which hosts of many documents are broadcast and their documents stay where they are (``join_hot``).

Nulls and edge cases: a null or empty text has zero words and fails the base rule; a null source is a
host of its own; a null doc_id is kept; repeated rows each count; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewright.llm.common import bounded, by_bytes, documents, free_name, join_hot, saved, texts

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
HOST_RATE = 0.5
BROADCAST_HOSTS = 10_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def repeat_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words that lie in a window of k words which occurs twice or more in the text, the first included."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(k)), strict=False))
    if len(set(grams)) == n:
        return 0
    found = Counter(grams)
    total, covered = 0, 0  # covered: the first word not yet counted
    for i, gram in enumerate(grams):
        if found[gram] > 1:
            total += i + k - max(i, covered)
            covered = i + k
    return total


def measure(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x and _WORD.search(x)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words))


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the five measures of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            columns = zip(*map(measure, texts(batch)), strict=True) if batch.num_rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, f"doc_id long, host string, {MEASURES}")


def with_rules(measured: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """base_failed, and rules_failed: any rule, the base rules among them."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    symbols = 10 * F.col("n_symbols") > F.col("n_words")  # a symbol for more than each tenth word
    lengths = (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))
    return measured.withColumns({"base_failed": base, "rules_failed": base | symbols | lengths | (5 * F.col("n_dup_lines") > F.col("n_words"))})


def host_rates(ruled: DataFrame) -> DataFrame:
    """host, docs, failed and the shrunken rate.

    The prior Beta(a, b): m is the mean rate of all documents, v the document-weighted variance of the
    hosts' rates less what chance alone gives; a + b = m(1-m)/v - 1, within 2 to 10000 (fewer hosts or
    no spread: 10000, all rates equal m but for hosts of many documents).
    """
    hosts = ruled.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("rules_failed").cast("long")).alias("failed"))
    all_ = hosts.agg(F.sum("docs").alias("n"), F.count("*").alias("h"), F.sum("failed").alias("f"), F.sum(F.col("failed") * F.col("failed") / F.col("docs")).alias("ff")).where("n > 0")
    m = F.col("f") / F.col("n")
    spread = F.col("ff") / F.col("n") - m * m - F.col("h") * m * (1 - m) / F.col("n")
    weight = F.when(spread > 0, F.least(F.lit(10000.0), F.greatest(F.lit(2.0), m * (1 - m) / spread - 1))).otherwise(F.lit(10000.0))
    a, w = all_.select(m * weight, weight).first() or (0.0, 1.0)  # one row, whatever the input
    return hosts.select("host", "docs", "failed", ((F.col("failed") + F.lit(float(a))) / (F.col("docs") + F.lit(float(w)))).alias("rate"))


def verdicts(docs: DataFrame, host: str = "source", rate: float = HOST_RATE) -> DataFrame:
    """The operator: per document its measures, base_failed, host, host_rate and kept."""
    ruled = with_rules(saved(measures(docs, host), "measures"))
    key = F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("key")  # a null host is one of its own
    rates = saved(host_rates(ruled).select(key, "docs", F.col("rate").alias("host_rate")), "rates")
    total = rates.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    joined = join_hot(ruled.select("*", key), rates, "key", "docs", total).drop("key")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= rate))


def base_fails(words: int, repeats: int) -> bool:
    return words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * words


def kept(docs: DataFrame, host: str = "source", rate: float = HOST_RATE) -> DataFrame:
    """The rows of docs that pass, with all their columns.

    Texts are measured twice, once for the hosts' rates and once as they pass by, instead of being joined
    to their measures, which would move every text. Rejected hosts are broadcast up to ``BROADCAST_HOSTS``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            found = [measure(t) for t in texts(batch)]
            yield batch.filter(pa.array([not base_fails(m[0], m[4]) for m in found], pa.bool_()))

    rates = host_rates(with_rules(saved(measures(docs, host), "measures")))
    name = free_name(docs, "_host")
    bad = bounded(saved(rates.where(F.col("rate") > rate).select(F.col("host").alias(name)), "hosts"), BROADCAST_HOSTS)
    return docs.mapInArrow(run, docs.schema).join(bad, F.col(host).cast("string").eqNullSafe(F.col(name)), "left_anti")


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op9_host_rules": op9_host_rules}
ORACLES = {
    "op9_host_rules": r"""
with d as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') as gram from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from d where len(ws) >= 5)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as c from g) where c > 1),
c as (select doc_id, count(distinct i + k) as n from r, range(0, 5) t(k) group by doc_id),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
m as (select d.doc_id, d.source, len(ws) as n_words, coalesce(length(array_to_string(ws, '')), 0) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from d join l on d.doc_id = l.doc_id left join c on d.doc_id = c.doc_id),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
v as (select *, base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 15 * n_words or 5 * n_dup_lines > n_words as failed from f),
h as (select source, count(*) as docs, sum(case when failed then 1 else 0 end) as bad from v group by source),
a as (select sum(bad) / sum(docs) as rate, sum(bad * bad / docs) / sum(docs) - (sum(bad) / sum(docs)) * (sum(bad) / sum(docs)) - count(*) * (sum(bad) / sum(docs)) * (1 - sum(bad) / sum(docs)) / sum(docs) as spread from h),
p as (select rate, case when spread > 0 then least(10000.0, greatest(2.0, rate * (1 - rate) / spread - 1)) else 10000.0 end as w from a)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and (bad + rate * w) / (docs + w) <= 0.5 as kept from v join h on v.source is not distinct from h.source, p"""
}
