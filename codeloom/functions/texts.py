"""Projections over text columns: fences, keys, prompts, completions, renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.predicates import FENCE, FILL_MARKS, REPLACEMENT, has_fence
from codeloom.functions.pytext import WS, blank, collapsed, lines, rstrip, squeezed, strip, text, unix_lines

_TAGGED = rf"(?is){FENCE}python{WS}*(.*?){FENCE}"
_BARE = rf"(?s){FENCE}{WS}*(.*?){FENCE}"
_EITHER = rf"(?is){FENCE}(?:python)?{WS}*(.*?){FENCE}"

#: What ends a completion.
STOPS = ("\nclass ", "\nif __name__", "\nprint(", "\ndef test", "\ndef check", "\n# Test", "\n# test", "\n# Check", "\n**Created Question**", "\nHere", "\nassert ", "\n```")


def fenced_code(c) -> Column:
    """The first python block anywhere, else the first block, else all; stripped."""
    c = text(c)
    return strip(F.when(c.rlike(_TAGGED), F.regexp_extract(c, _TAGGED, 1)).when(c.rlike(_BARE), F.regexp_extract(c, _BARE, 1)).otherwise(c))


def first_fence(c) -> Column:
    """The first block with or without its python tag, else all; stripped."""
    c = strip(text(c))
    return F.when(c.rlike(_EITHER), strip(F.regexp_extract(c, _EITHER, 1))).otherwise(c)


def canonical_code(c) -> Column:
    """Without comments (any # to the line's end) and white space."""
    return squeezed(F.regexp_replace(text(c), r"#[^\n]*", ""))


def key(*parts: Column, between: str = "\n") -> Column:
    return F.sha2(F.concat_ws(between, *parts), 256)


def normal_key(*cols) -> Column:
    """Hash of the texts with white space collapsed."""
    return key(*[collapsed(text(c)) for c in cols])


def triple_key(prompt, chosen, rejected) -> Column:
    return F.sha2(F.concat(text(prompt), F.lit("\n@@\n"), text(chosen), F.lit("\n##\n"), text(rejected)), 256)


def comment_block(c) -> Column:
    """Each non-blank line, without fences, as a comment line."""
    bare = F.replace(F.regexp_replace(strip(unix_lines(text(c))), r"(?i)```(?:python)?", ""), F.lit(FENCE), F.lit(""))
    kept = F.filter(F.transform(lines(bare), strip), lambda x: x != "")
    return F.when(F.size(kept) > 0, F.concat(F.array_join(F.transform(kept, lambda x: F.concat(F.lit("# "), x)), "\n"), F.lit("\n"))).otherwise(F.lit(""))


def task_text(instruction, given) -> Column:
    instruction, given = strip(text(instruction)), strip(text(given))
    return F.when(given == "", instruction).otherwise(F.concat(instruction, F.lit("\n\nInput:\n"), given))


def function_prompt(task, skeleton) -> Column:
    return F.concat(comment_block(task), skeleton)


def joined_prompt(instruction, given) -> Column:
    """The input on a line of its own after the instruction, if it is not blank."""
    instruction, given = text(instruction), text(given)
    between = F.when(F.endswith(instruction, F.lit("\n")), F.lit("")).otherwise(F.lit("\n"))
    return F.when(blank(given), instruction).otherwise(F.concat(instruction, between, given))


def rating(c) -> Column:
    """A number, else null; NaN is no rating."""
    x = strip(text(c)).try_cast("double")
    return F.when(~F.isnan(x), x)


def completion_of(c) -> Column:
    """What a model wrote, without fence, tail and further functions."""
    c = unix_lines(text(c))
    c = F.when(has_fence(c) & c.rlike(_EITHER), F.regexp_extract(c, _EITHER, 1)).otherwise(c)
    at = F.array_min(F.filter(F.array(*[F.instr(c, s) for s in STOPS]), lambda i: i > 0))
    c = rstrip(F.when(at.isNotNull(), F.substring(c, F.lit(1), at - 1)).otherwise(c))
    more = rf"(?sU)\A(.*?)(?<!\n)def{WS}+[A-Za-z_]\w*{WS}*\("
    return F.when(c.rlike(more), rstrip(F.regexp_extract(c, more, 1))).otherwise(c)


def safe_completion(c) -> Column:
    """Printable ASCII up to the first mark or top-level line, indented if nothing is."""
    c = unix_lines(text(c))
    for mark in FILL_MARKS:
        c = F.substring_index(c, mark, 1)
    c = F.regexp_replace(F.replace(c, F.lit(REPLACEMENT), F.lit("")), r"[^\n\t\x20-\x7e]", "")
    stop = r"\A((def|class|from|import)[ \t]+|<\||#!|[A-Za-z_]\w*(\.\w+)+[ \t]*[-+*/]?=)"
    rows = F.split(c, "\n", -1)
    kept = F.array_min(F.filter(F.transform(rows, lambda x, i: F.when(x.rlike(stop), i)), lambda i: i.isNotNull()))
    rows = F.when(kept.isNotNull(), F.slice(rows, F.lit(1), kept)).otherwise(rows)
    tail = r"(?<![ \t\n])[ \t\n]++\z"
    c = F.regexp_replace(F.array_join(rows, "\n"), tail, "")
    rows = F.split(c, "\n", -1)
    filled = lambda x: x.rlike(r"[^ \t]")
    flush = F.exists(rows, lambda x: filled(x) & ~x.rlike(r"\A[ \t]"))
    return F.when(flush, F.array_join(F.transform(rows, lambda x: F.when(filled(x), F.concat(F.lit("    "), x)).otherwise(x)), "\n")).otherwise(c)


def check_script(prompt, completion, test, entry_point) -> Column:
    return F.concat(text(prompt), text(completion), F.lit("\n\n"), text(test), F.lit("\n\ncheck("), text(entry_point), F.lit(")\n"))


def shortened(c, limit: int = 280) -> Column:
    c = unix_lines(text(c))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("...(truncated)"))).otherwise(c)


def head(c, n: int) -> Column:
    return F.substring(text(c), 1, n)


def task_prompt(prompt, instruction, question) -> Column:
    """The first that is neither null nor empty."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(some(prompt), some(instruction), F.col(question))
