"""Cleaning raw instruction rows and rated responses: ordered drop reasons, parsing only what is still in question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.code import first_function, sequence_ratio
from codeloom.functions.predicates import INSTRUCTION_WORDS, about_python, empty, garbled, longer_than
from codeloom.functions.pytext import strip, text
from codeloom.functions.storage import stored
from codeloom.functions.texts import canonical_code, fenced_code, normal_key
from codeloom.operators.cascade import KEPT, first_reason, open_only, reason_counts, then
from codeloom.operators.caps import cut_before_reading
from codeloom.operators.dedup import first_per_prompt, greedy_reasons
from codeloom.operators.ratings import with_pair

#: Reasons in order.
SFT_REASONS = ("drop_empty", "drop_too_long", "drop_garbled", "drop_not_python", "drop_no_function", "drop_dup_pair", "drop_dup_instruction", "drop_dup_output", KEPT)
PAIR_REASONS = ("drop_empty", "drop_no_pair", "drop_small_gap", "drop_too_long", "drop_garbled", "drop_not_python", "drop_no_function", "drop_low_info", "drop_dup_pair", "drop_dup_prompt", KEPT)


def clean_instructions(df: DataFrame, *, max_prompt: int = 1200, max_response: int = 3000, max_kept: int = 50_000) -> DataFrame:
    """idx, instruction, output (the function found), reason, of all rows up to the cap.

    Input: idx, instruction, output, tag; null counts as empty.
    """
    rows = df.select("idx", *[strip(text(c)).alias(c) for c in ("instruction", "output", "tag")])
    rows = rows.withColumn(
        "reason",
        first_reason(
            [
                ("drop_empty", empty("instruction", "output")),
                ("drop_too_long", longer_than(max_prompt, "instruction") | longer_than(max_response, "output")),
                ("drop_garbled", garbled("instruction") | garbled("output")),
                ("drop_not_python", ~about_python("instruction", "output", "tag", words=INSTRUCTION_WORDS)),
            ]
        ),
    )
    rows = rows.withColumn("code", first_function(open_only(fenced_code("output")))[0])
    rows = rows.withColumn("reason", then("reason", [("drop_no_function", F.col("code").isNull())]))
    # the parsed rows are read three times below: parse once
    rows = stored(rows.select("idx", "instruction", "code", "reason", open_only(normal_key("instruction")).alias("a"), open_only(normal_key("code")).alias("b")), "parsed")
    dups = greedy_reasons(rows.where("reason is null"), "a", "b", ("drop_dup_pair", "drop_dup_instruction", "drop_dup_output"))
    done = rows.join(dups, "idx", "left").select("idx", "instruction", F.col("code").alias("output"), F.coalesce("reason", "dup", F.lit(KEPT)).alias("reason"))
    return cut_before_reading(stored(done, "reasons"), F.col("reason") == KEPT, max_kept)


def kept_instructions(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(F.col("reason") == KEPT).select("idx", "instruction", F.lit("").alias("input"), "output")


def clean_pairs(df: DataFrame, *, max_prompt: int = 1200, max_response: int = 3000, min_gap: float = 1.0, same: float = 0.95, max_kept: int = 10_000) -> DataFrame:
    """idx, prompt, chosen, rejected (the functions found), reason, of all rows up to the cap.

    Input: idx, instruction, responses (model, response), annotations (model, rating).
    """
    rows = with_pair(df.select("idx", strip(text("instruction")).alias("prompt"), "responses", "annotations")).select("idx", "prompt", "pair")
    rows = rows.withColumn(
        "reason",
        first_reason(
            [
                ("drop_empty", F.col("prompt") == ""),
                ("drop_no_pair", F.col("pair").isNull()),
                ("drop_small_gap", F.col("pair.hi") - F.col("pair.lo") < min_gap),
                ("drop_too_long", longer_than(max_prompt, "prompt") | longer_than(max_response, "pair.chosen", "pair.rejected")),
                ("drop_garbled", garbled("prompt") | garbled("pair.chosen") | garbled("pair.rejected")),
                ("drop_not_python", ~about_python("prompt", "pair.chosen", "pair.rejected")),
            ]
        ),
    )
    rows = rows.withColumn("f", first_function(open_only(fenced_code("pair.chosen")), open_only(fenced_code("pair.rejected"))))
    rows = rows.withColumn("chosen", F.col("f")[0]).withColumn("rejected", F.col("f")[1])
    rows = rows.withColumn("reason", then("reason", [("drop_no_function", F.col("chosen").isNull() | F.col("rejected").isNull())]))
    rows = rows.withColumn("c", canonical_code("chosen")).withColumn("r", canonical_code("rejected"))
    rows = rows.withColumn("reason", then("reason", [("drop_low_info", (F.col("c") == "") | (F.col("r") == "") | (F.col("c") == F.col("r")))]))
    # no matching can exceed twice the shorter text's share, so most rows need no matcher
    bound = 2 * F.least(F.length("c"), F.length("r")) / (F.length("c") + F.length("r"))
    ask = F.col("reason").isNull() & (bound >= same)
    rows = rows.withColumn("s", sequence_ratio(F.when(ask, F.col("c")), F.when(ask, F.col("r"))))
    rows = rows.withColumn("reason", then("reason", [("drop_low_info", F.col("s") >= same)]))
    rows = stored(rows.select("idx", "prompt", "chosen", "rejected", "reason", normal_key("prompt").alias("prompt_key"), normal_key("prompt", "chosen", "rejected").alias("pair_key")), "parsed")
    known = first_per_prompt(rows.where("reason is null"), "prompt_key", "pair_key", ("drop_dup_pair", "drop_dup_prompt"))
    done = rows.where("reason is not null").withColumn("dup", F.lit(None).cast("string")).unionByName(known)
    done = done.select("idx", "prompt", "chosen", "rejected", F.coalesce("reason", "dup", F.lit(KEPT)).alias("reason"))
    return cut_before_reading(stored(done, "reasons"), F.col("reason") == KEPT, max_kept)


def kept_pairs(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(F.col("reason") == KEPT).select("idx", "prompt", "chosen", "rejected")


def sft_counts(cleaned: DataFrame) -> DataFrame:
    return reason_counts(cleaned, SFT_REASONS)


def pair_counts(cleaned: DataFrame) -> DataFrame:
    return reason_counts(cleaned, PAIR_REASONS)
