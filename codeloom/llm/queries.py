"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from codeloom.llm import audio, bpe, chat, jaccard, neighbours, packing, pii, quality, token_counts, token_files

_MODULES = (quality, pii, token_counts, jaccard, neighbours, packing, chat, bpe, token_files, audio)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
