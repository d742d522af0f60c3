"""Operator 9: token ids as compressed files, static range asymmetric numeral system.

Documents are dealt into ranges of ascending id and sorted there; each task tokenises its range once, slice by slice, and
writes segments: runs of whole documents of about ``SEGMENT_IDS`` ids (one more document may exceed it).  One frequency
table, counted over all ids of the segment, is shared by its blocks of about ``BLOCK_IDS`` ids, also runs of whole
documents.  Blocks are encoded independently, with checkpoints and checksums (:mod:`codeloom.llm.rans`).

A Parquet row is a block with its segment's table, so any block is read alone (:func:`read_token_files`), and any stretch
between two checkpoints too (:func:`read_stretches`); row groups of a few blocks let tasks share a file.  Spark's commit
protocol covers lost executors.  Where a range begins follows from the totals of the ranges before it.  Memory: a slice
and a segment, or one longer document.

Defined results: a null or empty text is the end id alone; null doc_ids come first; rows with equal ids are ordered by the
hash of their text, then the text, and may lie in several ranges; an empty table gives no file rows and reads as no
documents; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm import rans
from codeloom.llm.common import binary_array, fresh_path, mapped, renamed, table, tokenizer_path
from codeloom.llm.wordbpe import LibraryWords, shared

END_ID = 2
SEGMENT_IDS = 1 << 22
BLOCK_IDS = 1 << 20

_GROUP_IDS = 1 << 20
#: Bytes of a Parquet row group.
_ROW_GROUP = 1 << 24

SCHEMA = "part int, segment int, block int, part_start long, n long, doc_ids array<long>, n_tokens array<long>, freq binary, lanes int, check int, words binary, states binary, offsets array<long>, crc32 array<long>"
_LONGS = pa.list_(pa.int64())
_ARROW = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("n", pa.int64()), ("doc_ids", _LONGS), ("n_tokens", _LONGS), ("freq", pa.binary()), ("lanes", pa.int32()), ("check", pa.int32())]
    + [("words", pa.binary()), ("states", pa.binary()), ("offsets", _LONGS), ("crc32", _LONGS)]
)
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_STRETCH = pa.schema([("start", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary())])


def runs(ends: np.ndarray, most: int):
    """(from, to) of runs of documents, each as short as ``most`` ids allow; ``ends``: ids up to the end of each."""
    a, done = 0, 0
    while a < len(ends):
        b = min(int(np.searchsorted(ends, done + most)) + 1, len(ends))
        yield a, b
        a, done = b, int(ends[b - 1])


def segment_rows(part: int, segment: int, part_start: int, doc_ids: pa.Array, ends: np.ndarray, ids: np.ndarray, block_ids: int = BLOCK_IDS, stretch_ids: int = rans.STRETCH):
    """A row for each block of a segment."""
    freq = rans.Table.of(ids)
    raw, counts = freq.to_bytes(), np.diff(ends, prepend=0)
    for k, (a, b) in enumerate(runs(ends, block_ids)):
        first = int(ends[a] - counts[a])
        block = rans.encode(ids[first : int(ends[b - 1])], freq, stretch_ids)
        one = {"part": part, "segment": segment, "block": k, "part_start": part_start + first, "freq": raw, **block}
        cols = {"doc_ids": doc_ids[a:b], "n_tokens": pa.array(counts[a:b])}
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), cols[f.name]) if f.name in cols else pa.array([one[f.name]], f.type) for f in _ARROW], schema=_ARROW)


def write_token_files(df: DataFrame, path: str, tokenizer: str, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS, block_ids: int = BLOCK_IDS, stretch_ids: int = rans.STRETCH) -> None:
    rows = renamed(df, id_col, text_col)
    by = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by, "text")

    def run(batches):
        from pyspark import TaskContext

        part, segment, done = TaskContext.get().partitionId(), 0, 0
        names, counts, ids = [], np.empty(0, np.int64), np.empty(0, np.uint32)
        words = shared(LibraryWords, tokenizer)
        for b in batches:
            for x, y, new, offsets in words.by_slice(b.column(1), end_id=end_id):
                names.append(b.column(0)[x:y])
                counts, ids = np.concatenate([counts, np.diff(offsets)]), np.concatenate([ids, new])
                if len(ids) >= segment_ids:
                    known, ends = pa.concat_arrays(names), np.cumsum(counts)
                    for p, q in runs(ends, segment_ids):
                        first = int(ends[p] - counts[p])
                        size = int(ends[q - 1]) - first
                        if size < segment_ids:  # the rest waits for more
                            names, counts, ids = [known[p:]], counts[p:], ids[first:]
                            break
                        yield from segment_rows(part, segment, done, known[p:q], ends[p:q] - first, ids[first : first + size], block_ids, stretch_ids)
                        segment, done = segment + 1, done + size
                    else:
                        names, counts, ids = [], counts[:0], ids[:0]
        if len(counts):
            yield from segment_rows(part, segment, done, pa.concat_arrays(names), np.cumsum(counts), ids, block_ids, stretch_ids)

    mapped(ordered, run, SCHEMA).write.option("parquet.block.size", _ROW_GROUP).parquet(path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with ``base``, the ids before each in the whole table."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    # one row for each task that wrote, so no more than the partitions of that shuffle: small enough to broadcast
    parts = rows.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(parts.select("part", before.alias("before"))), "part").withColumn("base", F.col("before") + F.col("part_start"))


def _as_block(row: dict) -> tuple[dict, rans.Table]:
    return row, rans.Table.from_bytes(row["freq"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                yield from _documents(b.slice(row, 1).to_pylist()[0])

    return mapped(_blocks(spark, path).select("base", *[c for c in _ARROW.names if c not in ("part", "segment", "block", "part_start")]), run, "doc_id long, start long, n_tokens long, ids binary")


def _documents(row: dict):
    block, freq = _as_block(row)
    flat = rans.decode(block, freq).astype("<u4", copy=False)
    n = np.array(row["n_tokens"], np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    for a, b in runs(ends, _GROUP_IDS):
        first = int(starts[a])
        ids = binary_array(flat[first : int(ends[b - 1])], np.append(starts[a:b], ends[b - 1]) * 4 - first * 4)
        yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][a:b], pa.int64()), pa.array(starts[a:b] + row["base"]), pa.array(n[a:b]), ids], schema=_DOCS)


def read_stretches(spark: SparkSession, path: str) -> DataFrame:
    """start (of all ids), n_ids, ids of each stretch between two checkpoints, decoded from its checkpoint alone.

    A row is cut natively to the states and words of its stretch before it is decoded, so that stretches of one block, as
    of one very long document, can be dealt to many tasks (``repartition``) and a place can be looked up (``start``).
    """
    rows = _blocks(spark, path).select("base", "n", "lanes", "check", "freq", "words", "states", "offsets", "crc32", F.posexplode("offsets").alias("k", "at"))
    until = F.coalesce(F.get("offsets", F.col("k") + 1), (F.octet_length("words") / 4).cast("long"))
    one = rows.select(
        (F.col("base") + F.col("k").cast("long") * F.col("check") * F.col("lanes")).alias("start"),
        F.least(F.col("n") - F.col("k").cast("long") * F.col("check") * F.col("lanes"), F.col("check").cast("long") * F.col("lanes")).alias("n"),
        "lanes",
        "check",
        "freq",
        F.substring("words", (F.col("at") * 4 + 1).cast("int"), ((until - F.col("at")) * 4).cast("int")).alias("words"),
        F.substring("states", F.col("k") * F.col("lanes") * 8 + 1, F.col("lanes") * 8).alias("states"),
        F.array(F.lit(0).cast("long")).alias("offsets"),
        F.array(F.get("crc32", F.col("k"))).alias("crc32"),
    )

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1).to_pylist()[0]
                ids = rans.decode_stretch(*_as_block(row), 0)
                yield pa.RecordBatch.from_arrays([pa.array([row["start"]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ids.astype("<u4", copy=False).tobytes()], pa.binary())], schema=_STRETCH)

    return mapped(one, run, "start long, n_ids long, ids binary")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op9_token_files": op9_token_files}
ORACLE_SQL: dict[str, str] = {}
