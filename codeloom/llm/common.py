"""What the operators of this subpackage share: tables, the shared folder and Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.shipping import ship
from codeloom.functions.storage import fresh_path, stored

__all__ = ["binary_array", "by_batch", "fresh_path", "mapped", "renamed", "stored", "table", "tokenizer_path"]

#: The vocabulary that the registered queries use; every operator takes another path as a parameter.
WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over the batches one by one."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from work(b)

    return mapped(df, run, schema)


#: Bytes of a batch that a worker gets, unless the session says otherwise: rows of texts differ in size by orders.
BATCH_BYTES = 12 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` after this package was sent to the executors, with batches bounded by bytes."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    ship(spark)

    def work(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(work, schema)


def give_back() -> None:
    """Memory that a finished task has freed goes back to the system: workers live on, and allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def renamed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under names that nothing else can clash with."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values that lie side by side in ``data``; a byte offset for each, and the end."""
    if int(offsets[-1]) > 2**31 - 1:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(np.ascontiguousarray(data))])
