"""Column expressions with the exact white space, line and replacement rules of Python's ``str`` and ``re``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside a character class, the code points that Python counts as white space.
WS_CLASS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS, NOT_WS = f"[{WS_CLASS}]", f"[^{WS_CLASS}]"
#: Where Python's splitlines cuts.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null counts as empty."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lstrip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"\A{WS}+", "")


def rstrip(c: Column | str) -> Column:
    # the look-behind lets a run be tried from its start only
    return F.regexp_replace(col(c), rf"(?<!{WS}){WS}++\z", "")


def strip(c: Column | str) -> Column:
    return rstrip(lstrip(c))


def blank(c: Column | str) -> Column:
    return ~col(c).rlike(NOT_WS)


def lines(c: Column | str) -> Column:
    """Array of lines without their ends; the end of the last line does not start another."""
    parts = F.split(col(c), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def collapsed(c: Column | str) -> Column:
    """Each run of white space one space, none at the ends."""
    return F.btrim(F.regexp_replace(col(c), f"{WS}+", " "))


def squeezed(c: Column | str) -> Column:
    """No white space at all."""
    return F.regexp_replace(col(c), f"{WS}+", "")


def first_replaced(c: Column | str, pattern: str, by: str) -> Column:
    """The first match replaced; groups of the pattern count from $2 in ``by``."""
    return F.regexp_replace(col(c), rf"(?sU)\A(.*?){pattern}", f"$1{by}")


def found(c: Column | str, pattern: str) -> Column:
    """Whether ``first_replaced`` finds something to replace."""
    return col(c).rlike(rf"(?sU){pattern}")


def unix_lines(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("\r\n"), F.lit("\n"))
