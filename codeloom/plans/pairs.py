"""Preference pairs: seeds first, then good bodies against a mutation of themselves, until a target is reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.code import parse_ok
from codeloom.functions.mutation import arithmetic_mutation, logic_mutation
from codeloom.functions.predicates import clean_body, empty
from codeloom.functions.pytext import squeezed, text
from codeloom.functions.storage import stored
from codeloom.functions.texts import joined_prompt, triple_key
from codeloom.operators.cascade import KEPT, first_reason, open_only, then
from codeloom.operators.caps import cut_after_keeping

#: Reasons in order.
ARITHMETIC_REASONS = ("skip_empty", "skip_no_change", "skip_parse_fail", "skip_duplicate", KEPT)
LOGIC_REASONS = ("skip_empty", "skip_dirty_chosen", "skip_no_mutation", "skip_parse_fail", "skip_duplicate", KEPT)
_COLUMNS = ("phase", "idx", "prompt", "chosen", "rejected", "source", "tag", "reason")


def _with_parses(rows: DataFrame, column: str = "reason") -> DataFrame:
    both = [open_only(F.concat(text("prompt"), text(c)), column) for c in ("chosen", "rejected")]
    return rows.withColumn("ok", parse_ok(*both))


def _seeds(seeds: DataFrame, *, checked: bool) -> DataFrame:
    rows = seeds.select(F.lit(0).alias("phase"), "idx", *[text(c).alias(c) for c in ("prompt", "chosen", "rejected")], F.lit("seed_dpo").alias("source"), F.lit(None).cast("string").alias("tag"))
    rules = [("skip_empty", empty("prompt") | empty("chosen") | empty("rejected"))]
    if checked:
        rules.append(("skip_dirty_chosen", ~clean_body("chosen") | ~clean_body("rejected")))
    rows = rows.withColumn("reason", first_reason(rules))
    if checked:
        rows = _with_parses(rows).withColumn("reason", then("reason", [("skip_parse_fail", ~F.col("ok")[0] | ~F.col("ok")[1])]))
    return rows.select(*_COLUMNS)


def arithmetic_candidates(sft: DataFrame) -> DataFrame:
    rows = sft.select(F.lit(1).alias("phase"), "idx", joined_prompt("instruction", "input").alias("prompt"), text("output").alias("chosen"))
    rows = rows.withColumn("rejected", arithmetic_mutation("chosen")).withColumn("source", F.lit("sft_mutation")).withColumn("tag", F.lit(None).cast("string"))
    rows = rows.withColumn("reason", first_reason([("skip_empty", empty("prompt", "chosen")), ("skip_no_change", squeezed("rejected") == squeezed("chosen"))]))
    return _with_parses(rows).withColumn("reason", then("reason", [("skip_parse_fail", ~F.col("ok")[0] | ~F.col("ok")[1])])).select(*_COLUMNS)


def logic_candidates(sft: DataFrame) -> DataFrame:
    rows = sft.select(F.lit(1).alias("phase"), "idx", joined_prompt("instruction", "input").alias("prompt"), text("output").alias("chosen"))
    rows = rows.withColumn("m", logic_mutation("chosen")).withColumn("rejected", F.col("m.text")).withColumn("tag", F.col("m.tag"))
    rows = rows.withColumn("source", F.concat(F.lit("sft_hardneg:"), "tag"))
    changed = F.coalesce((F.col("rejected") != "") & (squeezed("rejected") != squeezed("chosen")) & clean_body("rejected"), F.lit(False))
    rows = rows.withColumn("reason", first_reason([("skip_empty", empty("chosen")), ("skip_dirty_chosen", ~clean_body("chosen")), ("skip_no_mutation", ~changed)]))
    return _with_parses(rows).withColumn("reason", then("reason", [("skip_parse_fail", ~F.col("ok")[0] | ~F.col("ok")[1])])).select(*_COLUMNS)


def deduplicated(rows: DataFrame) -> DataFrame:
    """Of equal triples that are still open, the first (seeds before others) is kept."""
    still = rows.where("reason is null").withColumn("_key", triple_key("prompt", "chosen", "rejected"))
    # an aggregate joined back: copies of a frequent triple meet in no one task
    first = still.groupBy("_key").agg(F.min(F.struct("phase", "idx")).alias("_first"))
    why = F.when(F.col("_first") == F.struct("phase", "idx"), KEPT).otherwise("skip_duplicate")
    still = still.join(first, "_key").withColumn("reason", why).select(rows.columns)
    return rows.where("reason is not null").unionByName(still)


def built_pairs(seeds: DataFrame, sft: DataFrame, *, target: int, logic: bool = True) -> DataFrame:
    """phase (0 seed, 1 built), idx, prompt, chosen, rejected, source, tag, reason, of all rows up to the target."""
    rows = _seeds(seeds, checked=logic).unionByName(logic_candidates(sft) if logic else arithmetic_candidates(sft))
    # mutating and parsing happen once, before the rows part by reason
    rows = stored(deduplicated(stored(rows, "candidates")), "pairs")
    a, b = cut_after_keeping(rows.where("phase = 0"), rows.where("phase = 1"), F.col("reason") == KEPT, target)
    return a.unionByName(b)


def pair_records(built: DataFrame) -> DataFrame:
    return built.where(F.col("reason") == KEPT).select("phase", "idx", "prompt", "chosen", "rejected", "source")


def build_report(built: DataFrame, *, target: int) -> DataFrame:
    """One row: seed_pairs, sft_rows, built_from_sft, a count of each skip reason of built rows, final_pairs, gate_ready."""
    kept, new = F.col("reason") == KEPT, F.col("phase") == 1
    skips = [F.count_if(new & (F.col("reason") == r)).alias(r) for r in LOGIC_REASONS[:-1]] + [F.count_if(new & (F.col("reason") == "skip_no_change")).alias("skip_no_change")]
    out = built.agg(F.count_if(~new & kept).alias("seed_pairs"), F.count_if(new).alias("sft_rows"), F.count_if(new & kept).alias("built_from_sft"), *skips, F.count_if(kept).alias("final_pairs"))
    return out.withColumn("target_pairs", F.lit(target).cast("long")).withColumn("gate_ready", F.col("final_pairs") >= target)


def tag_histogram(built: DataFrame) -> DataFrame:
    return built.where((F.col("phase") == 1) & (F.col("reason") == KEPT) & F.col("tag").isNotNull()).groupBy("tag").agg(F.count("*").alias("n"))
