"""Deduplication in row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.names import unused
from codeloom.functions.storage import stored


def first_by(df: DataFrame, *keys: str | Column, order=("idx",)) -> DataFrame:
    """The first row of each key."""
    (place,) = unused(df.columns, "_place")
    w = Window.partitionBy(*keys).orderBy(*order)
    # Spark cuts each task's rows to the first of a key before they travel
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)


def last_by(df: DataFrame, *keys: str, order: str = "idx") -> DataFrame:
    return first_by(df, *keys, order=(F.col(order).desc(),))


def greedy_two_keys(df: DataFrame, a: str, b: str, idx: str = "idx") -> DataFrame:
    """idx of the rows that one pass in order would keep: those whose two keys no kept row before has.

    Each round keeps all rows that are the first of both their keys, and drops what shares a key with them; the
    smallest row left is always kept, so rounds end.  A dropped row never blocks another, as in the sequential rule.
    Rounds are as many as the longest chain of rows that alternately keep and drop each other; what is left shrinks.
    """
    left = stored(df.select(F.col(idx).alias("idx"), F.col(a).alias("a"), F.col(b).alias("b")), "undecided")
    kept = None
    while True:
        first_a, first_b = left.groupBy("a").agg(F.min("idx").alias("ma")), left.groupBy("b").agg(F.min("idx").alias("mb"))
        now = stored(left.join(first_a, "a").join(first_b, "b").where("idx = ma and idx = mb").select("idx", "a", "b"), "accepted")
        kept = now if kept is None else kept.unionByName(now)
        left = stored(left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti"), "undecided", left)
        if left.isEmpty():
            return kept


def greedy_reasons(df: DataFrame, a: str, b: str, reasons: tuple[str, str, str], idx: str = "idx") -> DataFrame:
    """idx, dup: null for kept rows, else which of the reasons (both keys, first key, second key) drops the row."""
    kept = greedy_two_keys(df, a, b, idx)
    rows = df.select(F.col(idx).alias("idx"), F.col(a).alias("a"), F.col(b).alias("b"))
    by_a = kept.select("a", F.col("idx").alias("ka"), F.col("b").alias("kb_of_a"))
    by_b = kept.select("b", F.col("idx").alias("kb"))
    both, first, second = reasons
    found = rows.join(by_a, "a", "left").join(by_b, "b", "left")
    before_a = F.coalesce(F.col("ka") < F.col("idx"), F.lit(False))
    why = F.when((F.col("ka") == F.col("idx")), None).when(before_a & (F.col("kb_of_a") == F.col("b")), both).when(before_a, first).otherwise(second)
    return found.select("idx", why.alias("dup"))


def first_per_prompt(df: DataFrame, prompt_key: str, pair_key: str, reasons: tuple[str, str], idx: str = "idx") -> DataFrame:
    """The rows with ``dup``: null for the first of each prompt, else whether it repeats the kept pair or the prompt only."""
    key, first, pair = unused(df.columns, "_key", "_first", "_pair")
    # an aggregate joined back: rows of a frequent prompt meet in no one task
    kept = df.groupBy(F.col(prompt_key).alias(key)).agg(F.min(idx).alias(first), F.min_by(pair_key, idx).alias(pair))
    rows = df.join(kept, F.col(prompt_key).eqNullSafe(F.col(key)))
    why = F.when(F.col(first) == F.col(idx), None).when(F.col(pair) == F.col(pair_key), reasons[0]).otherwise(reasons[1])
    return rows.withColumn("dup", why).drop(key, first, pair)
