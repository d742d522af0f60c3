"""Seeded samples."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_order_sample(df: DataFrame, n: int, seed: int, idx: str = "idx") -> DataFrame:
    """n rows in the order of their hashed ids: the same rows on any partitioning, no driver state."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), idx)), idx).limit(n)


def shuffled_sample(df: DataFrame, n: int, rng: random.Random, idx: str = "idx") -> DataFrame:
    """The n rows that Python's shuffle of all rows in order would put first.

    For evaluation sets that fit a driver only; several samples share one generator's state when they share ``rng``.
    """
    order = list(range(df.count()))
    rng.shuffle(order)
    spark = df.sparkSession
    places = spark.createDataFrame([(p, k) for k, p in enumerate(order[:n])] or [], "place long, rank long")
    rows = df.select(idx).orderBy(idx).collect()
    numbered = spark.createDataFrame([(r[0], k) for k, r in enumerate(rows)] or [], f"{idx} {df.schema[idx].dataType.simpleString()}, place long")
    return df.join(numbered.join(F.broadcast(places), "place"), idx).orderBy("rank").drop("place", "rank")
