"""Chat rendering: messages of role and content in the marks of the model's template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.pytext import text

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
SCORING_SYSTEM = "You are a helpful coding assistant."
#: Fixed values of the generation prompt.
GENERATION_SYSTEM = "You are a precise Python coding assistant."
GENERATION_RULES = (
    "Complete the given Python function.",
    "Rules:",
    "1) Output only valid Python code.",
    "2) Do not add tests, explanations, markdown, or extra functions.",
    "3) Only continue the target function body.",
    "",
    "Function skeleton:",
)


def message(role: Column, content: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text(content), F.lit(f"{END}\n"))


def scoring_text(prompt, answer) -> Column:
    """System, user and assistant messages, without a mark for another answer."""
    return F.concat(*[message(F.lit(r), c) for r, c in (("system", F.lit(SCORING_SYSTEM)), ("user", F.col(prompt)), ("assistant", F.col(answer)))])


def generation_text(prompt, mode: str = "chat") -> Column:
    """``chat``: system message, the rules with the skeleton as the user's, and the assistant's turn opened; ``continuation``: the prompt."""
    if mode == "continuation":
        return text(prompt)
    if mode != "chat":
        raise ValueError(f"unknown mode {mode}")
    user = F.concat(F.lit("".join(f"{line}\n" for line in GENERATION_RULES)), text(prompt))
    return F.concat(message(F.lit("system"), F.lit(GENERATION_SYSTEM)), message(F.lit("user"), user), F.lit(f"{START}assistant\n"))


def rendered_conversations(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """conv_id, n_turns, rendered: turns in order, the default system message first if the conversation has none.

    Runs of ``tool`` turns are one user message of tool responses.
    """
    turns = df.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("r"), text(content).alias("c")))).alias("m"))
    at = lambda i: F.get(F.col("m"), i)["r"]
    tool = lambda r: F.coalesce(r == "tool", F.lit(False))
    body = lambda x: F.concat(F.lit("\n<tool_response>\n"), x["c"], F.lit("\n</tool_response>"))

    def part(x, i):
        opened = F.when(tool(at(i - 1)), F.lit("")).otherwise(F.lit(f"{START}user"))
        closed = F.when(tool(at(i + 1)), F.lit("")).otherwise(F.lit(f"{END}\n"))
        return F.when(tool(x["r"]), F.concat(opened, body(x), closed)).otherwise(message(x["r"], x["c"]))

    system = F.when(F.get(F.col("m"), F.lit(0))["r"] == "system", F.lit("")).otherwise(message(F.lit("system"), F.lit(DEFAULT_SYSTEM)))
    return turns.select(conv, F.size("m").cast("long").alias("n_turns"), F.concat(system, F.array_join(F.transform("m", part), "")).alias("rendered"))
