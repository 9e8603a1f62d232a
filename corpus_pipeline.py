"""Documents to packed token sequences: toxicity, host-level quality, near-duplicates, personal data, packing.

Each stage works on all that the one before it kept, returns the columns of its input (the last one packed
pieces) and is written as Parquet before the next reads it.

In every stage an empty table gives no rows, columns other than doc_id, text and source pass through whatever their
names, and texts of any length are taken whole. What each makes of nulls, repeated rows and ties is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tuplewright.llm import packing, pii, quality, shingles, toxicity
from tuplewright.llm.common import documents, saved


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches the threshold. The model learns from the labels outside the held-out fold.

    A null text is the empty text, whose score is that of no evidence; a null doc_id is scored but not learnt from;
    repeated rows share their fate and are learnt from once; a score equal to the threshold goes. Without labels none goes.
    """
    return toxicity.kept(docs, toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules and documents of rejected hosts.

    A null or empty text has too few words and goes; a null source is a host of its own; a null doc_id passes like any
    other; repeated rows each count for their host; a host whose rate equals the threshold stays.
    """
    return quality.kept(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five-word shingles, Jaccard similarity of 0.8 or more) the document of least id.

    A null text is the empty text, and texts without words are one group; rows without doc_id stay; of rows with one id
    and text one stays, and another text under the same id is judged by its own group; a tie of ids goes to the least
    hash of the text.
    """
    return shingles.kept(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal numbers, dates and addresses in the text by their pseudonyms.

    A null text stays null; a null doc_id makes no difference; repeated rows and equal values get equal pseudonyms.
    """
    return pii.pseudonymise(docs).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences: a row for each piece.

    A null text packs as the separator alone; a null doc_id is kept; repeated rows are packed each for itself; pieces of
    one length are taken in the order of id, start and checksum.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: no SQL: the stages' models, fingerprints, ciphers and tokenizer are none; tests/llm/test_pipeline.py holds run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
