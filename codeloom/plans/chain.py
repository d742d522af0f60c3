"""The stages one after the other: clean, convert, validate, audit gate, build, evaluate.

Each stage writes its rows as JSON lines and its report as JSON (the audits as Markdown too) under one folder, and the
next reads what was written.  A stage whose folder is complete is not run again, so a chain that was stopped goes on
where it stopped.  Training lies between building and evaluating; its candidates and scores are inputs of the last stage.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.storage import stored
from codeloom.operators.cascade import KEPT, reason_counts
from codeloom.plans import audit, clean, convert, evaluate, pairs
from codeloom.sources import readers, sinks

_SFT = "idx long, instruction string, input string, output string"
_DPO = "idx long, prompt string, chosen string, rejected string"
_BUILT = "phase int, idx long, prompt string, chosen string, rejected string, source string"


class Chain:
    """Stages under one folder; ``ran`` names those that ran now."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ran = spark, path.rstrip("/"), []

    def rows(self, name: str, schema: str, make: Callable[[], DataFrame]) -> DataFrame:
        at = f"{self.path}/{name}"
        if not readers.exists(self.spark, f"{at}/_SUCCESS"):
            make().write.mode("overwrite").option("ignoreNullFields", False).json(at)
            self.ran.append(name)
        return self.spark.read.schema(schema).option("mode", "FAILFAST").json(at)

    def report(self, name: str, make: Callable[[], dict]) -> dict:
        at = f"{self.path}/reports/{name}.json"
        if not readers.exists(self.spark, at):
            sinks.write_text(self.spark, at, json.dumps(make(), ensure_ascii=False, indent=2))
            self.ran.append(name)
        return json.loads(self.spark.read.text(at, wholetext=True).first()[0])


def _counts(rows: DataFrame, reasons: tuple[str, ...]) -> dict:
    return json.loads(sinks.counts_json(reason_counts(rows, reasons)))


def _one(df: DataFrame) -> dict:
    return audit.rounded(df.first().asDict(recursive=True))


def audited(sft: DataFrame, dpo: DataFrame, *, min_pairs: int = audit.MIN_PAIRS, min_share: float = audit.MIN_SHARE) -> dict:
    """The audit of both sides with the gate's decision."""
    left = _one(audit.audit_instructions(sft))
    seen = stored(audit.audit_pairs(dpo), "audit")
    gate = audit.quantity_gate(seen, left["total"], min_pairs=min_pairs, min_share=min_share).first()
    right = _one(seen)
    right |= {"usable_rate": right.pop("usable_pairs_rate"), "gate_threshold_pairs": gate["threshold"], "gate_pass": gate["passed"], "gate_shortfall_pairs": gate["shortfall"]}
    return {"sft": left, "dpo": right, "decision": {"allow_enter_dpo_training": gate["passed"], "reason": gate["reason"]}}


def run_chain(
    spark: SparkSession, path: str, raw: DataFrame, rated: DataFrame, tasks: DataFrame, *, candidates: DataFrame | None = None, scores: DataFrame | None = None,
    target: int = 10_000, logic: bool = True, max_sft: int = 50_000, max_pairs: int = 10_000, min_pairs: int = audit.MIN_PAIRS, min_share: float = audit.MIN_SHARE, seconds: float = 8.0,
) -> dict[str, dict]:
    """All reports, by stage.

    ``raw``: idx, instruction, output, tag; ``rated``: idx, instruction, responses, annotations; ``tasks``: task_id,
    prompt, test, entry_point; ``candidates``: model, task_id, cand_idx, text (run on the executors); ``scores``: model,
    idx, chosen_lp, rejected_lp, prompt.  Pairs are built only where the audit's gate fails.
    """
    chain, reports = Chain(spark, path), {}

    # clean
    cleaned = chain.rows("clean_sft_all", _SFT.replace("input string, ", "") + ", reason string", lambda: clean.clean_instructions(raw, max_kept=max_sft))
    rated_clean = chain.rows("clean_dpo_all", _DPO + ", reason string", lambda: clean.clean_pairs(rated, max_kept=max_pairs))
    reports["clean"] = chain.report("clean", lambda: {"sft": _counts(cleaned, clean.SFT_REASONS), "dpo": _counts(rated_clean, clean.PAIR_REASONS)})

    # convert
    sft_all = chain.rows("convert_sft_all", _SFT + ", reason string", lambda: convert.converted_instructions(clean.kept_instructions(cleaned)))
    dpo_all = chain.rows("convert_dpo_all", _DPO + ", reason string", lambda: convert.converted_pairs(clean.kept_pairs(rated_clean)))
    sft, dpo = (x.where(F.col("reason") == KEPT).drop("reason") for x in (sft_all, dpo_all))
    reports["convert"] = chain.report("convert", lambda: {"sft": _counts(sft_all, convert.SFT_REASONS), "dpo": _counts(dpo_all, convert.PAIR_REASONS)})

    # validate
    def validated() -> dict:
        ratios = stored(audit.gate_ratios(sft, dpo, tasks), "ratios")
        checks = audit.failed_checks(ratios).first()
        bad = audit.bad_samples(audit.instruction_flags(sft), audit.SFT_FLAGS, ("instruction", "output")).collect()  # EXEMPLARS at most
        return _one(ratios) | {"passed": checks["passed"], "failed_checks": list(checks["failed_checks"]), "bad_samples": [r.asDict() for r in bad]}

    reports["validate"] = chain.report("validate", validated)

    # audit gate, and what it decides
    limits = {"min_pairs": min_pairs, "min_share": min_share}
    reports["audit"] = chain.report("audit", lambda: audited(sft, dpo, **limits))
    sinks.write_text(spark, f"{path}/reports/audit.md", sinks.audit_markdown(**reports["audit"]))
    if not reports["audit"]["decision"]["allow_enter_dpo_training"]:
        reasons = pairs.LOGIC_REASONS if logic else pairs.ARITHMETIC_REASONS
        built_all = chain.rows("build_all", _BUILT + ", tag string, reason string", lambda: pairs.built_pairs(dpo, sft, target=target, logic=logic))
        built = pairs.pair_records(built_all)

        def report() -> dict:
            tags = {r["tag"]: r["n"] for r in pairs.tag_histogram(built_all).collect()}  # one row for each rule
            return _one(pairs.build_report(built_all, target=target)) | {"reasons": _counts(built_all.where("phase = 1"), reasons), "tags": tags}

        reports["build"] = chain.report("build", report)
        reports["audit_built"] = chain.report("audit_built", lambda: audited(sft, built, **limits))
        sinks.write_text(spark, f"{path}/reports/audit_built.md", sinks.audit_markdown(**reports["audit_built"]))

    # evaluate
    if candidates is not None and scores is not None:
        kinds = "model string, task_id string, entry_point string, pass_at_1 boolean, pass_at_k boolean, candidate_results array<boolean>, candidate_samples array<string>"
        cases = chain.rows("cases", kinds, lambda: evaluate.case_log(evaluate.checked_candidates(candidates, tasks, seconds=seconds)))
        board = evaluate.leaderboard(cases, evaluate.preference_log(scores))
        reports["leaderboard"] = chain.report("leaderboard", lambda: {r["model"]: audit.rounded(r.asDict()) for r in board.collect()})  # one row for each model
        sinks.write_leaderboard(board, f"{path}/leaderboard.csv")
    reports["ran"] = {"stages": chain.ran}
    return reports
