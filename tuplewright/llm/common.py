"""Helpers shared by the operators on text: shared scratch tables, byte-bounded batches, words.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]``; ``bytes.split()`` splits on just these six
characters, and ``bytes.lower()`` lowers only A-Z.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
BROADCAST_ROWS = 1_000_000
HOT_KEYS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the session has in ``spark.checkpoint.dir``. Only a local session without one gets a
    temporary folder of its own; a cluster without one is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tuplewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def saved(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again: lineage ends here, and a lost
    executor costs no recomputation of what lies before. rows_a_file: at most so many rows in a file (0: any
    number), for wide rows, as a task that reads holds up to 4096 rows of a file at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_by(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Like saved, as a bucketed table: a later grouping by the column takes its files as they are, without a shuffle."""
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", f"{shared_dir(spark)}/tables/{table}").bucketBy(min(buckets, 100_000), column).saveAsTable(table)
    return spark.table(table)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose column holds about ``most`` bytes (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        start, held = 0, 0
        for i in range(batch.num_rows):
            n = len(col[i].as_buffer()) if col[i].is_valid else 0
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's values; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that none of df's columns has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has no more rows than that; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hot(rows: DataFrame, table: DataFrame, key: str, copies: str, total: int, keys: int = HOT_KEYS) -> DataFrame:
    """rows joined to the one row that table has for each key. copies: the table's column of how many rows have the key.

    Keys of more than a ``keys``-th of all rows (so fewer than that many) come by broadcast, and their
    rows stay where they are; the others are joined by shuffle, where no key is large.
    """
    bound = total // keys
    hot, cold = F.broadcast(table.where(F.col(copies) > bound).drop(copies)), table.where(F.col(copies) <= bound).drop(copies)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def doc_crc(column: str = "doc_id"):
    """crc32 of the id as text (null: 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0))
