"""Caps on kept rows, without a global sort: the place where the cap is reached is found first, then compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_kept(df: DataFrame, kept, n: int, idx: str = "idx") -> int | None:
    """idx of the n-th kept row, None if there are fewer."""
    ids = df.where(kept).select(idx)
    if ids.count() < n:
        return None  # also spares the queue of n places that an ordered limit sets up
    return ids.orderBy(idx).limit(n).agg(F.max(idx).alias("last")).first()["last"]


def cut_before_reading(df: DataFrame, kept, n: int, idx: str = "idx") -> DataFrame:
    """All rows that a pass reads which stops before a row once n are kept; nothing for n of 0."""
    if n <= 0:
        return df.where(F.lit(False))
    last = last_kept(df, kept, n, idx)
    return df if last is None else df.where(F.col(idx) <= last)


def cut_after_keeping(seeds: DataFrame, more: DataFrame, kept, n: int, idx: str = "idx") -> tuple[DataFrame, DataFrame]:
    """The seeds and further rows read by a pass that stops after a row once n are kept, seeds first.

    If the seeds alone suffice the others are not read; for n of 0 a first kept seed is still taken.
    """
    n = max(n, 1)
    have = seeds.where(kept).count()
    if have >= n:
        return cut_before_reading(seeds, kept, n, idx), more.where(F.lit(False))
    return seeds, cut_before_reading(more, kept, n - have, idx)


def first_rows(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    return df.orderBy(idx).limit(n)
