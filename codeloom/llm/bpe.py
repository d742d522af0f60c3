"""Operator 8: BPE encoding by forced-boundary splitting, and decoding.

Pairs of bytes that stand side by side inside no vocabulary token can never be merged, so they are certain cuts; the
fragments between cuts are encoded independently and concatenated (:mod:`codeloom.llm.wordbpe`).  Row by row, without a
shuffle.  Texts are encoded by slices of a few million bytes and ids are decoded by groups of ``_GROUP_BYTES``, each of
which leaves the task at once: beside the batch that came in, memory holds a slice or group, or one longer text.

Defined results: a null or empty text, or one of white space only, has no ids and decodes to the empty text; repeated
rows give repeated results; a null id stays null; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import binary_array, by_batch, renamed, table, tokenizer_path
from codeloom.llm.wordbpe import ForcedBoundaryWords, LibraryWords, TokenStrings, shared, slices

_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_GROUP_BYTES = 4_000_000


def encode_documents(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", library: bool = False, end_id: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit) of each text; ``end_id`` is appended when given.

    ``library`` lets the ``tokenizers`` library encode the distinct words, instead of the merges of this package.
    """
    kind = LibraryWords if library else ForcedBoundaryWords

    def work(batch):
        for a, b, ids, ends in shared(kind, tokenizer).by_slice(batch.column(1), end_id=end_id):
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(ends)), binary_array(ids.astype("<u4", copy=False), ends * 4)], schema=_ENCODED)

    return by_batch(renamed(df, id_col, text_col), work, "doc_id long, n_tokens long, ids binary")


def decode_documents(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``keep`` and the decoded text of each row's ids (binary as above; null counts as none)."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("_ids"), *keep)
    out = df.select(F.col(id_col).alias("doc_id"), *keep, F.lit("").alias("decoded")).schema

    def work(batch):
        words = shared(TokenStrings, tokenizer)
        for a, b in slices(batch.column(1), _GROUP_BYTES):
            part = batch.slice(a, b - a)
            text = [words.decode(np.frombuffer(x.as_buffer(), "<u4")) if x.is_valid else b"" for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(text, pa.binary()).cast(pa.string())], names=["doc_id", *keep, "decoded"])

    return by_batch(src, work, out)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    coded = encode_documents(table(spark, sf_dir, "documents"), path)
    coded = coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))
    text = decode_documents(coded, path, keep=("n_tokens", "ids_sha256"))
    return text.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op8_bpe": op8_bpe}
ORACLE_SQL: dict[str, str] = {}
