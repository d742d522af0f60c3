"""Operator 6: packing by power-of-two decomposition.

A document of n ids becomes pieces of binary length: as many of ``max_tokens`` as fit, then the powers of two of the
rest from large to small.  Pieces of one length share a bucket and each is a sequence of its own, so no sequence
crosses documents and none has padding.  The split is row by row, without a shuffle; ``sequence_id`` is unique over all
rows (partition and position of the piece, as input files are read in a fixed order).

Defined results: a null or empty text is the end id alone, one piece of length 1; repeated rows are packed each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.bpe import encode_documents
from codeloom.llm.common import table, tokenizer_path

#: The id after each document.
END_ID = 1
MAX_TOKENS = 2048


def _piece(start, bucket: int):
    """One piece of ``_ids``: where it starts, log2 of its length, its ids."""
    return F.struct(start.alias("start"), F.lit(bucket).alias("bucket"), F.substring("_ids", (start * 4 + 1).cast("int"), F.lit(4 << bucket)).alias("ids"))


def power_of_two_pieces(df: DataFrame, *, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per piece: doc_id, start, length, bucket (log2 of length), ids (binary), doc_tokens, sequence_id, offset.

    ``ids_col``: little-endian unsigned 32-bit ids as binary; a row without ids has no piece.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens is a power of two")
    top = max_tokens.bit_length() - 1
    src = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("_ids"), (F.octet_length(ids_col) / 4).cast("long").alias("doc_tokens"))
    whole = F.shiftright("doc_tokens", top)
    full = F.when(whole > 0, F.transform(F.sequence(F.lit(0).cast("long"), whole - 1), lambda i: _piece(i * max_tokens, top)))
    parts = [F.when(F.col("doc_tokens").bitwiseAND(F.lit(1 << b)) != 0, _piece(F.col("doc_tokens").bitwiseAND(F.lit(-(2 << b)).cast("long")), b)) for b in range(top - 1, -1, -1)]
    tail = F.array_compact(F.array(*parts)) if parts else None
    none = F.array().cast("array<struct<start:bigint,bucket:int,ids:binary>>")
    pieces = F.concat(F.coalesce(full, none), *([tail] if tail is not None else []))
    # pieces carry their ids: a row for each piece with all ids of its document would take the square of a long text
    out = src.select("doc_id", "doc_tokens", F.explode(pieces).alias("p"))
    return out.select(
        "doc_id",
        F.col("p.start").alias("start"),
        F.expr("shiftleft(1L, p.bucket)").alias("length"),
        F.col("p.bucket").alias("bucket"),
        F.col("p.ids").alias("ids"),
        "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def pack_documents(df: DataFrame, tokenizer: str, *, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each text's ids with ``end_id`` after them."""
    coded = encode_documents(df, tokenizer, id_col=id_col, text_col=text_col, library=True, end_id=end_id)
    return power_of_two_pieces(coded, max_tokens=max_tokens)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences of equal length together, one folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


QUERIES = {"op6_packing": op6_packing}
ORACLE_SQL: dict[str, str] = {}
