"""Whole functions to completion form: a prompt of comments and header, and the body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.code import function_parts
from codeloom.functions.predicates import starts_block
from codeloom.functions.pytext import strip, text, unix_lines
from codeloom.functions.texts import first_fence, function_prompt, task_text
from codeloom.operators.cascade import KEPT, first_reason, open_only, then

#: Reasons in order.
SFT_REASONS = ("drop_empty", "drop_no_function", "drop_top_level_def_completion", KEPT)
PAIR_REASONS = ("drop_empty", "drop_no_function", "drop_name_mismatch", "drop_top_level_def_completion", KEPT)


def _source(c):
    return open_only(unix_lines(first_fence(c)))


def converted_instructions(df: DataFrame) -> DataFrame:
    """idx, instruction, input, output, reason; the texts are null unless kept."""
    rows = df.select("idx", task_text("instruction", "input").alias("task"), strip(text("output")).alias("output"))
    rows = rows.withColumn("reason", first_reason([("drop_empty", F.col("output") == "")]))
    rows = rows.withColumn("p", function_parts(_source("output"))[0])
    rows = rows.withColumn("reason", then("reason", [("drop_no_function", F.col("p").isNull()), ("drop_top_level_def_completion", starts_block("p.completion")), (KEPT, F.lit(True))]))
    kept = F.col("reason") == KEPT
    return rows.select("idx", F.when(kept, function_prompt("task", F.col("p.skeleton"))).alias("instruction"), F.when(kept, F.lit("")).alias("input"), F.when(kept, F.col("p.completion")).alias("output"), "reason")


def converted_pairs(df: DataFrame) -> DataFrame:
    """idx, prompt, chosen, rejected, reason; the texts are null unless kept."""
    rows = df.select("idx", *[strip(text(c)).alias(c) for c in ("prompt", "chosen", "rejected")])
    rows = rows.withColumn("reason", first_reason([("drop_empty", (F.col("prompt") == "") | (F.col("chosen") == "") | (F.col("rejected") == ""))]))
    rows = rows.withColumn("p", function_parts(_source("chosen"), _source("rejected")))
    rows = rows.withColumn("c", F.col("p")[0]).withColumn("r", F.col("p")[1])
    rows = rows.withColumn(
        "reason",
        then(
            "reason",
            [
                ("drop_no_function", F.col("c").isNull() | F.col("r").isNull()),
                ("drop_name_mismatch", F.col("c.name") != F.col("r.name")),
                ("drop_top_level_def_completion", starts_block("c.completion") | starts_block("r.completion")),
                (KEPT, F.lit(True)),
            ],
        ),
    )
    kept = F.col("reason") == KEPT
    return rows.select("idx", F.when(kept, function_prompt("prompt", F.col("c.skeleton"))).alias("prompt"), F.when(kept, F.col("c.completion")).alias("chosen"), F.when(kept, F.col("r.completion")).alias("rejected"), "reason")
