"""Row predicates over text columns; a null text counts as empty."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.pytext import WS, blank, lines, lstrip, text

#: Fixed values.
PYTHON_WORDS = ("python", "def ", "```python", "函数")
INSTRUCTION_WORDS = (*PYTHON_WORDS, "function")
FILL_MARKS = ("<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>")
FENCE = "```"
REPLACEMENT = "\ufffd"
BODY_SHARE = 0.6
FOREIGN_SHARE = 0.05


def contains_any(c, words) -> Column:
    return reduce(or_, [F.contains(text(c), F.lit(w)) for w in words])


def garbled(c) -> Column:
    """Empty, or holds NUL or the replacement character."""
    return (text(c) == "") | contains_any(c, ("\0", REPLACEMENT))


def about_python(*cols, words=PYTHON_WORDS) -> Column:
    return contains_any(F.lower(F.concat_ws("\n", *[text(c) for c in cols])), words)


def longer_than(limit: int, *cols) -> Column:
    return reduce(or_, [F.length(text(c)) > limit for c in cols])


def empty(*cols) -> Column:
    return reduce(or_, [blank(text(c)) for c in cols])


def has_def(c) -> Column:
    return F.contains(text(c), F.lit("def "))


def has_fence(c) -> Column:
    return F.contains(text(c), F.lit(FENCE))


def starts_block(c) -> Column:
    """Begins, after white space, with a def or class (an async def does not count)."""
    c = lstrip(text(c))
    return F.startswith(c, F.lit("def ")) | F.startswith(c, F.lit("class "))


def body_like(c) -> Column:
    """At least BODY_SHARE of the non-blank lines are indented by a space or tab."""
    filled = F.filter(lines(text(c)), lambda x: ~blank(x))
    indented = F.filter(filled, lambda x: x.rlike(r"\A[ \t]"))
    return F.coalesce((F.size(filled) > 0) & (F.size(indented) / F.size(filled) >= BODY_SHARE), F.lit(False))


def has_fill_mark(c) -> Column:
    return contains_any(c, FILL_MARKS)


def has_replacement(c) -> Column:
    return F.contains(text(c), F.lit(REPLACEMENT))


def continues_at_top(c) -> Column:
    return text(c).rlike(rf"(?md)^(def|class|from|import){WS}+")


def has_unittest(c) -> Column:
    return contains_any(c, ("import unittest", "def test"))


def foreign_share(c) -> Column:
    """Share of code points beyond ASCII, 0 of an empty text."""
    n = F.length(text(c))
    return F.when(n > 0, F.length(F.regexp_replace(text(c), r"[\x00-\x7F]", "")) / n).otherwise(F.lit(0.0))


def mostly_foreign(c) -> Column:
    return foreign_share(c) > FOREIGN_SHARE


def polluted(c) -> Column:
    return has_fill_mark(c) | has_replacement(c) | continues_at_top(c)


def clean_body(c) -> Column:
    """Not blank, unmarked and without an import at the start of any line, indented or not."""
    return ~blank(text(c)) & ~has_fill_mark(c) & ~has_replacement(c) & ~text(c).rlike(rf"(?md)^{WS}*(import|from){WS}+")
