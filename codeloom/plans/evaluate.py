"""Evaluation of candidates and scores that models left: pass rates, preference wins, leaderboard, improved cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.code import passes_check
from codeloom.functions.texts import check_script, head, safe_completion, shortened
from codeloom.operators.dedup import last_by


def case_log(results: DataFrame) -> DataFrame:
    """One row for each model and task from (model, task_id, entry_point, cand_idx, passed, text)."""
    cands = F.sort_array(F.collect_list(F.struct("cand_idx", "passed", "text")))
    rows = results.groupBy("model", "task_id", "entry_point").agg(cands.alias("c"))
    passed = F.col("c.passed")
    return rows.select("model", "task_id", "entry_point", F.coalesce(F.get(passed, F.lit(0)), F.lit(False)).alias("pass_at_1"), F.exists(passed, lambda x: x).alias("pass_at_k"), passed.alias("candidate_results"), F.slice(F.col("c.text"), 1, 2).alias("candidate_samples"))


def checked_candidates(candidates: DataFrame, tasks: DataFrame, *, seconds: float = 8.0) -> DataFrame:
    """(model, task_id, entry_point, cand_idx, passed, text): each candidate made safe and run against its task's test.

    Runs untrusted code on the executors.
    """
    rows = candidates.join(tasks.select("task_id", "prompt", "test", "entry_point"), "task_id")
    rows = rows.withColumn("text", safe_completion("text"))
    # a run may take seconds: rows are dealt evenly
    rows = rows.repartition(F.xxhash64("model", "task_id", "cand_idx") % 64)
    return rows.select("model", "task_id", "entry_point", "cand_idx", passes_check(check_script("prompt", "text", "test", "entry_point"), seconds).alias("passed"), "text")


def preference_log(scores: DataFrame) -> DataFrame:
    """model, idx, both scores, chosen_win (a tie is a loss) and the prompt's head."""
    return scores.select("model", "idx", "chosen_lp", "rejected_lp", F.coalesce(F.col("chosen_lp") > F.col("rejected_lp"), F.lit(False)).alias("chosen_win"), head("prompt", 140).alias("prompt_head"))


def pass_rates(cases: DataFrame) -> DataFrame:
    return cases.groupBy("model").agg(F.count("*").alias("tasks"), F.avg(F.col("pass_at_1").cast("int")).alias("pass_at_1"), F.avg(F.col("pass_at_k").cast("int")).alias("pass_at_k"))


def win_rates(log: DataFrame) -> DataFrame:
    return log.groupBy("model").agg(F.count("*").alias("pairs"), F.avg(F.col("chosen_win").cast("int")).alias("preference_win_rate"))


def leaderboard(cases: DataFrame, log: DataFrame) -> DataFrame:
    """One row for each model in either; what a model has no rows for is 0."""
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)).alias(c)
    both = pass_rates(cases).join(win_rates(log), "model", "full")
    return both.select("model", zero("pass_at_1", "double"), zero("pass_at_k", "double"), F.coalesce("pass_at_1", F.lit(0.0)).alias("unit_test_pass_rate"), zero("preference_win_rate", "double"), zero("tasks", "long"), zero("pairs", "long"))


def mean_token_score(tokens: DataFrame, key: str = "id", score: str = "lp") -> DataFrame:
    return tokens.groupBy(key).agg(F.avg(score).alias("mean_lp"))


def recheck(cases: DataFrame, rerun: DataFrame) -> DataFrame:
    """count, pass1, pass2 over cases with a saved candidate; ``rerun``: model, task_id, cand_idx (0 or 1), passed."""
    first = F.max(F.when(F.col("cand_idx") == 0, F.col("passed").cast("int")))
    best = rerun.where("cand_idx < 2").groupBy("model", "task_id").agg(F.coalesce(first, F.lit(0)).alias("p1"), F.max(F.col("passed").cast("int")).alias("p2"))
    rows = cases.where(F.size("candidate_samples") > 0).select("model", "task_id").join(best, ["model", "task_id"], "left")
    return rows.agg(F.count("*").alias("count"), F.coalesce(F.avg(F.coalesce("p1", F.lit(0))), F.lit(0.0)).alias("pass1"), F.coalesce(F.avg(F.coalesce("p2", F.lit(0))), F.lit(0.0)).alias("pass2"))


def missing_tasks(cases: DataFrame, tasks: DataFrame) -> DataFrame:
    """Cases whose task is unknown: a caller fails on any."""
    return cases.join(tasks.select("task_id"), "task_id", "left_anti")


def improved_cases(base: DataFrame, sft: DataFrame, dpo: DataFrame | None, *, most: int = 12) -> DataFrame:
    """rank, task_id, winner, samples of tasks that base fails and sft (first) or dpo passes, by task id as text.

    Inputs: idx, task_id, pass_at_1, candidate_samples; of repeated tasks the last row counts, a missing value is false.
    """

    def side(df, name):
        return last_by(df, "task_id").select("task_id", F.coalesce("pass_at_1", F.lit(False)).alias(name), F.get("candidate_samples", F.lit(0)).alias(f"{name}_sample"))

    rows = side(base, "base").join(side(sft, "sft"), "task_id")
    rows = rows.join(side(dpo, "dpo"), "task_id", "left") if dpo is not None else rows.withColumns({"dpo": F.lit(None).cast("boolean"), "dpo_sample": F.lit(None).cast("string")})
    better = rows.where(~F.col("base") & (F.col("sft") | F.coalesce("dpo", F.lit(False)))).orderBy("task_id").limit(most)
    return better.select("task_id", F.when(F.col("sft"), "SFT").otherwise("DPO").alias("winner"), "base", "sft", "dpo", *[shortened(f"{c}_sample").alias(f"{c}_sample") for c in ("base", "sft", "dpo")])


def consistent_first_rows(*logs: DataFrame) -> DataFrame:
    """The first task of each log, and whether all are the same one."""
    firsts = [df.orderBy("idx").limit(1).select(F.lit(i).alias("log"), "task_id") for i, df in enumerate(logs)]
    rows = firsts[0]
    for f in firsts[1:]:
        rows = rows.unionByName(f)
    return rows.agg(F.min("task_id").alias("task_id"), (F.count_distinct("task_id") == 1).alias("consistent"))


def all_outputs(tasks: DataFrame, **models: DataFrame) -> DataFrame:
    """Tasks with a struct of candidates and checks for each model, joined by task."""
    out = tasks
    for name, cases in models.items():
        one = cases.select("task_id", F.struct("task_id", F.col("candidate_samples").alias("candidates"), F.col("candidate_results").alias("checks")).alias(name))
        out = out.join(one, "task_id", "left")
    return out


def output_rows(outputs: DataFrame, model: str) -> DataFrame:
    """task_id, pos, candidate, passed: candidates beside their checks."""
    zipped = F.posexplode(F.arrays_zip(F.col(f"{model}.candidates").alias("candidate"), F.col(f"{model}.checks").alias("passed")))
    rows = outputs.select("task_id", zipped)
    return rows.select("task_id", "pos", F.col("col.candidate").alias("candidate"), F.col("col.passed").alias("passed"))
