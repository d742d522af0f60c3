"""Ordered drop reasons: a row's reason is the first condition that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT = "kept"


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Null where no condition holds."""
    return F.coalesce(*[F.when(when, F.lit(reason)) for reason, when in rules])


def open_only(c: Column, reason: str | Column = "reason") -> Column:
    """The value where no reason is known yet, else null: what a Python stage is to look at."""
    return F.when((F.col(reason) if isinstance(reason, str) else reason).isNull(), c)


def then(known: str, rules: list[tuple[str, Column]]) -> Column:
    return F.coalesce(F.col(known), first_reason(rules))


def reason_counts(df: DataFrame, reasons: tuple[str, ...], column: str = "reason") -> DataFrame:
    """reason, n for each listed reason, zero where none has it; one aggregate, no join."""
    sums = df.agg(*[F.count_if(F.col(column) == r).alias(r) for r in reasons])
    pairs = F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n")) for r in reasons])
    return sums.select(F.inline(pairs))
