"""Audits, format checks, gates and style reports: each is one aggregate over one pass.

Shares are exact quotients; :func:`rounded` rounds a report's numbers as Python does, on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.code import parse_ok
from codeloom.functions.predicates import body_like, continues_at_top, empty, has_def, has_fence, has_fill_mark, has_replacement, mostly_foreign, polluted, starts_block
from codeloom.functions.pytext import blank, lines, strip, text
from codeloom.functions.texts import head

#: What a format has to reach.
GATE = (("sft_prompt_has_def", 0.98), ("sft_concat_parse_ok", 0.95), ("dpo_prompt_has_def", 0.98), ("dpo_chosen_parse_ok", 0.95), ("dpo_rejected_parse_ok", 0.95), ("eval_prompt_has_def", 0.98))
MIN_PAIRS, MIN_SHARE = 3000, 0.2
EXEMPLARS = 20
#: The wording of the decision.
PASSED = "pass dpo quantity+quality gate"
FAILED = "fail dpo quantity+quality gate; need data augmentation/cleanup"


def share(n: Column | str, of: Column | str = "total") -> Column:
    n, of = (F.col(c) if isinstance(c, str) else c for c in (n, of))
    return F.when(of > 0, n / of).otherwise(F.lit(0.0))


def rounded(report: dict, places: int = 4) -> dict:
    return {k: round(v, places) if isinstance(v, float) else v for k, v in report.items()}


def with_parse(df: DataFrame, **sources: tuple[str, str]) -> DataFrame:
    """A boolean column for each name: whether the two columns put together parse."""
    both = [F.concat(text(a), text(b)) for a, b in sources.values()]
    out = df.withColumn("_ok", parse_ok(*both))
    for i, name in enumerate(sources):
        out = out.withColumn(name, F.col("_ok")[i])
    return out.drop("_ok")


def _counted(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    out = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    return out.select("*", *[share(n).alias(f"{n}_rate") for n in flags])


def audit_instructions(df: DataFrame, *, parse: bool = True) -> DataFrame:
    """total, counts and rates of rows of instruction and output."""
    flags = {"empty_output": empty("output"), "fim": has_fill_mark("output"), "replacement_char": has_replacement("output"), "top_level_continuation": continues_at_top("output"), "high_non_ascii": mostly_foreign("output"), "body_like": body_like("output")}
    if parse:
        df = with_parse(df, _parsed=("instruction", "output"))
        flags["parse_ok"] = F.col("_parsed")
    return _counted(df, flags)


def usable(c_ok: str = "_c", r_ok: str = "_r") -> Column:
    good = ~empty("chosen", "rejected") & body_like("chosen") & body_like("rejected") & ~polluted("chosen") & ~polluted("rejected")
    return good & F.col(c_ok) & F.col(r_ok)


def audit_pairs(df: DataFrame) -> DataFrame:
    df = with_parse(df, _c=("prompt", "chosen"), _r=("prompt", "rejected"))
    return _counted(df, {"chosen_empty": empty("chosen"), "rejected_empty": empty("rejected"), "chosen_polluted": polluted("chosen"), "rejected_polluted": polluted("rejected"), "chosen_parse_ok": F.col("_c"), "rejected_parse_ok": F.col("_r"), "usable_pairs": usable()})


def quantity_gate(pair_audit: DataFrame, sft_total: Column | int, *, min_pairs: int = MIN_PAIRS, min_share: float = MIN_SHARE) -> DataFrame:
    """usable_pairs, threshold, shortfall, passed, reason."""
    total = sft_total if isinstance(sft_total, Column) else F.lit(sft_total)
    need = F.greatest(F.lit(min_pairs).cast("long"), (total * F.lit(float(min_share))).cast("long"))
    out = pair_audit.select("usable_pairs", need.alias("threshold"))
    out = out.withColumn("shortfall", F.greatest(F.lit(0).cast("long"), F.col("threshold") - F.col("usable_pairs"))).withColumn("passed", F.col("usable_pairs") >= F.col("threshold"))
    return out.withColumn("reason", F.when(F.col("passed"), PASSED).otherwise(FAILED))


def instruction_flags(df: DataFrame) -> DataFrame:
    df = with_parse(df, concat_parse_ok=("instruction", "output"))
    return df.select("idx", "instruction", "output", has_def("instruction").alias("prompt_has_def"), (~has_fence("instruction")).alias("prompt_no_fence"), (~has_fence("output")).alias("output_no_fence"), (~starts_block("output")).alias("output_no_top_def"), "concat_parse_ok")


SFT_FLAGS = ("prompt_has_def", "prompt_no_fence", "output_no_fence", "output_no_top_def", "concat_parse_ok")
PAIR_FLAGS = ("prompt_has_def", "prompt_no_fence", "chosen_no_top_def", "rejected_no_top_def", "chosen_parse_ok", "rejected_parse_ok")


def pair_flags(df: DataFrame) -> DataFrame:
    df = with_parse(df, chosen_parse_ok=("prompt", "chosen"), rejected_parse_ok=("prompt", "rejected"))
    return df.select("idx", "prompt", "chosen", "rejected", has_def("prompt").alias("prompt_has_def"), (~has_fence("prompt")).alias("prompt_no_fence"), (~starts_block("chosen")).alias("chosen_no_top_def"), (~starts_block("rejected")).alias("rejected_no_top_def"), "chosen_parse_ok", "rejected_parse_ok")


def eval_flags(df: DataFrame) -> DataFrame:
    return df.select(has_def("prompt").alias("prompt_has_def"), (~has_fence("prompt")).alias("prompt_no_fence"))


def flag_ratios(flags: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return _counted(flags, {n: F.col(n) for n in names})


def bad_samples(flags: DataFrame, names: tuple[str, ...], texts: tuple[str, ...], n: int = EXEMPLARS) -> DataFrame:
    """The first rows that miss a flag, with heads of their texts."""
    missed = ~F.array_contains(F.array(*names), False)
    return flags.where(~missed).orderBy("idx").limit(n).select("idx", *[head(c, 180).alias(f"{c}_head") for c in texts], *names)


def failed_checks(ratios: DataFrame, gate=GATE) -> DataFrame:
    """passed and the names of the failed checks; ``ratios`` has one row with a column for each name."""
    checks = F.array(*[F.struct(F.lit(n).alias("name"), (F.col(n) >= least).alias("ok")) for n, least in gate])
    names = F.transform(F.filter(checks, lambda x: ~x["ok"]), lambda x: x["name"])
    return ratios.select((F.size(names) == 0).alias("passed"), names.alias("failed_checks"))


def gate_ratios(sft: DataFrame, dpo: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row with the six ratios of ``GATE``, of converted instructions, converted pairs and evaluation tasks."""
    parts = {"sft": flag_ratios(instruction_flags(sft), SFT_FLAGS), "dpo": flag_ratios(pair_flags(dpo), PAIR_FLAGS), "eval": flag_ratios(eval_flags(tasks), ("prompt_has_def", "prompt_no_fence"))}
    out = None
    for part, ratios in parts.items():
        one = ratios.select([F.col(f"{name.removeprefix(part + '_')}_rate").alias(name) for name, _ in GATE if name.startswith(f"{part}_")])
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


#: Label of a prompt by how it begins, lower case.
STYLES = (("you_are", r"\Ayou are"), ("given", r"\Agiven"), ("write_python_function", r"\Awrite (a|an) (python )?function"), ("implement", r"\Aimplement"), ("complete", r"\Acomplete"))


def style(c) -> Column:
    low = F.lower(strip(text(c)))
    out = None
    for label, pattern in STYLES:
        out = F.when(low.rlike(pattern), label) if out is None else out.when(low.rlike(pattern), label)
    return out.otherwise("other")


def style_histogram(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(style(c).alias("label")).agg(F.count("*").alias("n"))


def content_shape(df: DataFrame, c: str) -> DataFrame:
    """n, fences, and averages of code points and of the share of indented lines."""
    filled = F.filter(lines(text(c)), lambda x: ~blank(x))
    indented = F.when(F.size(filled) > 0, F.size(F.filter(filled, lambda x: x.rlike(r"\A[ \t]"))) / F.size(filled)).otherwise(F.lit(0.0))
    return df.agg(F.count("*").alias("n"), F.count_if(has_fence(c)).alias("fenced"), F.avg(F.length(text(c))).alias("avg_chars"), F.avg(indented).alias("avg_indent"))


def field_names(df: DataFrame) -> list[str]:
    return sorted(df.columns)
