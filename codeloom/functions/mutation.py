"""Small logic changes to function bodies: the first rule of an ordered list that changes the text, else the last return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.pytext import WS, blank, first_replaced, found, let, lines, strip, text

#: Pattern and replacement of the arithmetic rules, in order.
ARITHMETIC = (
    (r"\b==\b", "!="),
    (r"\b!=\b", "=="),
    (r"\b<=\b", "<"),
    (r"\b>=\b", ">"),
    (r"\b<\b", "<="),
    (r"\b>\b", ">="),
    (r"\bTrue\b", "False"),
    (r"\bFalse\b", "True"),
    (rf"\breturn{WS}+0\b", "return 1"),
    (rf"\breturn{WS}+1\b", "return 0"),
    (r"\+", "-"),
    (r"-", "+"),
    (r"\*", "//"),
    (r"//", "*"),
)
#: Pattern, replacement ($2 is the pattern's group) and tag of the logic rules, in order.
LOGIC = (
    (r"\b==\b", "!=", "cmp_eq_to_ne"),
    (r"\b!=\b", "==", "cmp_ne_to_eq"),
    (r"\b<=\b", "<", "cmp_le_to_lt"),
    (r"\b>=\b", ">", "cmp_ge_to_gt"),
    (r"\band\b", "or", "bool_and_to_or"),
    (r"\bor\b", "and", "bool_or_to_and"),
    (r"\bTrue\b", "False", "true_to_false"),
    (r"\bFalse\b", "True", "false_to_true"),
    (r"\bsorted\(([^()]*)\)\b", "list($2)", "sorted_to_list"),
    (r"\bmax\(([^()]*)\)\b", "min($2)", "max_to_min"),
    (r"\bmin\(([^()]*)\)\b", "max($2)", "min_to_max"),
)
_RETURN = rf"\A({WS}*)return{WS}+([^\n]+)\z"


def _first_rule(c: Column, rules, result) -> Column:
    """``result`` of the first rule that finds something, as every rule's replacement changes the text; rules after it are not tried."""
    return F.coalesce(*[F.when(found(c, rule[0]), result(first_replaced(c, *rule[:2]), *rule[2:])) for rule in rules])


def _last_return(c: Column, change) -> Column:
    """``change`` of the last return line's expression and of a function that puts another in its place; null without such a line."""

    def changed(rows: Column, at: Column) -> Column:
        line = F.get(rows, at)
        parts = F.struct(F.regexp_extract(line, _RETURN, 1).alias("indent"), strip(F.regexp_extract(line, _RETURN, 2)).alias("value"))
        put = lambda m, v: F.array_join(F.concat(F.slice(rows, F.lit(1), at), F.array(F.concat(m["indent"], F.lit("return "), v)), F.slice(rows, at + 2, F.size(rows))), "\n")
        return let(parts, lambda m: change(m["value"], lambda v: put(m, v)))

    last = lambda rows: F.array_max(F.transform(rows, lambda x, i: F.when(x.rlike(_RETURN), i)))
    return let(lines(c), lambda rows: let(last(rows), lambda at: F.when(at.isNotNull(), changed(rows, at))))


def arithmetic_mutation(c) -> Column:
    """The changed text; the text itself if it is blank or nothing applies."""
    c = text(c)
    last = _last_return(c, lambda value, put: put(F.concat(F.lit("("), value, F.lit(") + 1"))))
    return F.when(blank(c), c).otherwise(F.coalesce(_first_rule(c, ARITHMETIC, lambda t: t), F.when(c.rlike(r"(?U)\breturn\b"), last), c))


def logic_mutation(c) -> Column:
    """Struct of text and tag: ``empty`` or ``no_mutation`` without a text."""
    c = text(c)
    result = lambda t, tag: F.struct(t.alias("text"), tag.alias("tag"))
    changed = _first_rule(c, LOGIC, lambda t, tag: result(t, F.lit(tag)))

    def negated(value: Column, put) -> Column:
        minus = F.startswith(value, F.lit("-"))
        return result(put(F.when(minus, strip(F.substr(value, F.lit(2)))).otherwise(F.concat(F.lit("-("), value, F.lit(")")))), F.when(minus, "return_drop_minus").otherwise("return_add_minus"))

    last = F.when(F.contains(c, F.lit("return")), _last_return(c, negated))
    none = F.lit(None).cast("string")
    return F.when(blank(c), result(none, F.lit("empty"))).otherwise(F.coalesce(changed, last, result(none, F.lit("no_mutation"))))
