"""Helpers shared by the training-data operators: reading, stable hash splits, shared scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specdag.sources.scratch import forget, scratch

#: Fixed values. A word is a run of characters outside this set: the space and U+0009 to U+000D.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Fixed value: bytes of an Arrow batch of a materialized table's making.
BATCH_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``: the split that the contracts name."""
    return (F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % modulus).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``: a one-element array holds it, so Catalyst cannot copy its expression."""
    return F.transform(F.array(value), body)[0]


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound the bytes, not only the rows, of what a Python worker gets at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with _small_batches(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._specdag_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables of which everything that reads them has been written."""
    for table in tables:
        forget(table.sparkSession, table._specdag_path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that nothing refers to any more; else they stay until the driver is short of memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Give memory that this process has freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a piece stay near ``most_bytes``: bounded memory whatever their lengths.

    When a partition ends, what the worker has freed goes back to the system: workers are used again by later stages."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
    release()


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a text column, the code of each word in text order, and where each text's words begin.

    Words are runs without the space and U+0009 to U+000D; null counts as empty.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = split.flatten()
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)))
    full = pc.not_equal(flat, "")
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
    coded = flat.filter(full).dictionary_encode()
    # by way of numpy: some thirty times as fast as to_pylist()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False), before[ends]


def _labels_to_learn(labels: DataFrame, label: str, held_out: Callable[[Column], Column]) -> DataFrame:
    """``_id`` and ``label``, once for each document that is not held out. Rows with a null id or label are left out; of
    repeated labels of a document the largest counts."""
    return (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.max("label").alias("label"))
    )


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: Callable[[Column], Column]) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of all labelled documents that are not held out.

    Labels grow with the documents, so both are dealt by id: no task, and not the driver, gets more than its share. The texts are
    not sorted, a task keeps its labels in a hash table.
    """
    learned = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = _labels_to_learn(labels, label, held_out).hint("shuffle_hash")
    return learned.join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Callable[[Column], Column], rows: int) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of at most ``rows`` labelled documents that are not held out, those of least hash.

    The choice is made on the narrow label table, so its size is bounded before any text is joined to it. Rows with a
    null id or label are left out; of repeated labels of a document the largest counts.
    """
    chosen = _labels_to_learn(labels, label, held_out).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
