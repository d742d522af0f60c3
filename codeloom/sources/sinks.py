"""Sinks: JSON lines, reports, leaderboards, registries and incremental logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, *, single: bool = False, idx: str = "idx", mode: str = "errorifexists") -> None:
    """UTF-8, unescaped, nulls written; ordered by ``idx`` if there is one, in one file only when asked."""
    out = df.orderBy(idx) if idx in df.columns else df
    out = out.drop(idx)
    (out.coalesce(1) if single else out).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text through the file system of the path, replaced as a whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def report_json(one_row: DataFrame) -> str:
    """A one-row aggregate as indented JSON."""
    return json.dumps(json.loads(one_row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]), ensure_ascii=False, indent=2)


def counts_json(counts: DataFrame) -> str:
    """reason, n rows as one object, in row order, with their total."""
    rows = counts.collect()
    return json.dumps({"total": sum(r["n"] for r in rows)} | {r["reason"]: r["n"] for r in rows}, indent=2)


def write_leaderboard(board: DataFrame, path: str) -> None:
    """CSV with header, a row for each model, in one file: as many rows as models."""
    board.orderBy("model").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_cases(cases: DataFrame, path: str, *, restart: bool = False) -> None:
    """Case logs by model; ``restart`` first drops what the models at hand left before."""
    writer = cases.write.partitionBy("model")
    if restart:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)
    else:
        writer.mode("append").json(path)


def snapshot(board: DataFrame, path: str) -> None:
    """The leaderboard so far, replaced after each model."""
    board.write.mode("overwrite").parquet(path)


def preview(df: DataFrame, n: int = 20, idx: str = "idx") -> DataFrame:
    return df.orderBy(idx).limit(n)


def markdown_table(df: DataFrame, columns: list[str], order: str) -> str:
    """A small table as Markdown; rows are put together by Spark."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
    body = df.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))), lambda x: x["r"]), "\n").alias("t")).first()["t"]
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), body or ""]) + "\n"


def show(report: dict | str) -> None:
    """A report on standard output, as one line of JSON or as it is."""
    print(report if isinstance(report, str) else json.dumps(report, ensure_ascii=False))


def markdown_fields(title: str, parts: dict[str, dict]) -> str:
    """A report of named values: a heading for each part, a line for each value."""
    out = [f"# {title}"]
    for name, values in parts.items():
        out += ["", f"## {name}", *[f"- {k}: `{v}`" for k, v in values.items()]]
    return "\n".join(out) + "\n"


#: The title, parts and values of the audit report.
AUDIT_TITLE = "Step1 Data Audit Report"
AUDIT_PARTS = {
    "SFT": ("total", "empty_output_rate", "fim_rate", "replacement_char_rate", "top_level_continuation_rate", "parse_ok_rate"),
    "DPO": ("total", "usable_pairs", "usable_rate", "gate_threshold_pairs", "gate_pass", "gate_shortfall_pairs", "chosen_polluted_rate", "rejected_polluted_rate"),
    "Decision": ("allow_enter_dpo_training", "reason"),
}


def audit_markdown(sft: dict, dpo: dict, decision: dict) -> str:
    """The audit report: the fixed choice of values of the three parts."""
    values = dict(zip(AUDIT_PARTS, (sft, dpo, decision), strict=True))
    return markdown_fields(AUDIT_TITLE, {part: {k: values[part][k] for k in names} for part, names in AUDIT_PARTS.items()})


#: The wording of the outputs report.
OUTPUTS_TITLE = "# Strict Eval Full Outputs (Question + Code)\n\n"
CODE_OPEN, CODE_CLOSE, RULE = "```python\n", "```\n\n", "---\n\n"


def with_output_sections(outputs: DataFrame, models: tuple[str, ...], name: str = "section") -> DataFrame:
    """Tasks (pos from 1, task_id, entry_point, prompt, a struct of candidates and checks for each model) with their Markdown."""
    ended = lambda c: F.concat(c, F.when(F.endswith(c, F.lit("\n")), F.lit("")).otherwise(F.lit("\n")))
    truth = lambda c: F.when(c, F.lit("True")).otherwise(F.lit("False"))
    bits = [F.lit("## "), F.col("pos").cast("string"), F.lit(". "), F.coalesce("task_id", F.lit("")), F.lit(" / entry: `"), F.col("entry_point"), F.lit("`\n\n### Prompt\n\n" + CODE_OPEN), ended(F.col("prompt")), F.lit(CODE_CLOSE)]
    for m in models:
        both = F.arrays_zip(F.col(f"{m}.candidates").alias("code"), F.col(f"{m}.checks").alias("ok"))
        each = F.transform(both, lambda x, i: F.concat(F.lit("- cand"), (i + 1).cast("string"), F.lit(" pass="), truth(x["ok"]), F.lit("\n\n" + CODE_OPEN), ended(F.coalesce(x["code"], F.lit(""))), F.lit(CODE_CLOSE)))
        bits += [F.lit(f"### {m.upper()}\n\n"), F.coalesce(F.array_join(each, ""), F.lit(""))]
    return outputs.withColumn(name, F.concat(*bits, F.lit(RULE)))


def outputs_markdown(outputs: DataFrame, models: tuple[str, ...]) -> str:
    """The outputs report of an evaluation set (which fits a driver), in the order of ``pos``."""
    rows = with_output_sections(outputs, models).orderBy("pos").select("section").collect()
    return OUTPUTS_TITLE + "".join(r["section"] for r in rows)


#: The wording of the report of improved cases.
CASES_TITLE = "Improved Badcases (base fail -> sft or dpo success)"
CASES_FOUND = "total_improved_found: "
CASES_NONE = "No improved badcases found under current outputs."


def case_report(improved: DataFrame) -> str:
    """The improved cases, numbered, as plain text; the count is of the cases shown."""
    rows = improved.orderBy("task_id").collect()  # as many as the caller's limit
    out = [CASES_TITLE, f"{CASES_FOUND}{len(rows)}", ""]
    if not rows:
        out.append(CASES_NONE)
    for i, r in enumerate(rows, 1):
        out += [f"[Case {i}] {r['task_id']}", f"- improved_by: {r['winner']}"]
        for name, label in (("base", "base"), ("sft", "sft "), ("dpo", "dpo ")):
            out.append(f"- {label} pass@1: {'N/A' if r[name] is None else r[name]}")
        for name in ("base", "sft", "dpo"):
            out += [f"- {name} sample:", "N/A" if r[name] is None else r[f"{name}_sample"] or ""]
        out.append("")
    return "\n".join(out) + "\n"


def upserted(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """The registry with the entries added; an entry of a name that is there replaces it."""
    return registry.join(entries.select("name"), "name", "left_anti").unionByName(entries)


def registry_json(registry: DataFrame) -> str:
    """The registry as one object, a key for each name; false flags and null fields are left out."""
    rows = registry.orderBy("name").collect()  # one row for each dataset
    entry = lambda r: {k: v for k, v in r.asDict(recursive=True).items() if k != "name" and v not in (None, False)}
    return json.dumps({r["name"]: entry(r) for r in rows}, ensure_ascii=False, indent=2)
