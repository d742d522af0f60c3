"""Text expressions against Python's own str and re."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.functions import pytext as T
from codeloom.functions import texts as X
from codeloom.functions.mutation import arithmetic_mutation, logic_mutation
from codeloom.queries import inputs

ODD = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2003\u200a\u2028\u2029\u202f\u205f\u3000 \t\n\r"


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def texts(n, alphabet, longest=24, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_white_space_as_python_has_it(spark):
    rows = texts(800, "ab" + ODD)
    got = values(spark, rows, T.strip("t"), T.lstrip("t"), T.rstrip("t"), T.lines("t"), T.collapsed("t"), T.squeezed("t"), T.blank("t"))
    for t, g in zip(rows, got, strict=True):
        assert g == (t.strip(), t.lstrip(), t.rstrip(), t.splitlines(), re.sub(r"\s+", " ", t).strip(), re.sub(r"\s+", "", t), not t.strip()), repr(t)


def test_line_anchors_and_body_shares(spark):
    rows = texts(600, "def \n\rx\tim", 40) + ["  a\n  b\n  c\nd\ne", "  a\n  b\nc\nd", "", " ", "import x", " import x", "x\rimport y", "from  a"]
    got = values(spark, rows, P.continues_at_top("t"), P.body_like("t"), P.clean_body("t"), P.starts_block("t"))
    for t, g in zip(rows, got, strict=True):
        filled = [x for x in t.splitlines() if x.strip()]
        body = bool(filled) and sum(x[0] in " \t" for x in filled) / len(filled) >= 0.6
        clean = bool(t.strip()) and not re.search(r"(?m)^\s*(import|from)\s+", t)
        assert g == (bool(re.search(r"(?m)^(def|class|from|import)\s+", t)), body, clean, t.lstrip().startswith(("def ", "class "))), repr(t)


@pytest.mark.parametrize("share,flag", [("é" + "a" * 19, False), ("é" * 2 + "a" * 37, True), ("", False)])
def test_foreign_share_is_strict(spark, share, flag):
    assert values(spark, [share], P.mostly_foreign("t")) == [(flag,)]


def test_null_counts_as_empty(spark):
    got = values(spark, [None], P.garbled("t"), P.has_def("t"), P.body_like("t"), P.clean_body("t"), X.fenced_code("t"), X.comment_block("t"), X.safe_completion("t"), X.completion_of("t"))
    assert got == [(True, False, False, False, "", "", "", "")]


def test_lengths_count_code_points(spark):
    got = values(spark, ["🙂" * 1200, "🙂" * 1201], P.longer_than(1200, "t"))
    assert got == [(False,), (True,)]


def test_fences(spark):
    rows = ["```js\na\n```\n```python\nb\n```", "```\na```", "no", "```PYTHON x```", "``` open"]
    assert values(spark, rows, X.fenced_code("t"), X.first_fence("t")) == [("b", "js\na"), ("a", "a"), ("no", "no"), ("x", "x"), ("``` open", "``` open")]


def test_comment_block_and_prompts(spark):
    got = values(spark, [" a\r\n\n b ```python\nc``` ", "", "```"], X.comment_block("t"), X.joined_prompt("t", F.lit(" x")), X.joined_prompt("t", F.lit(" ")))
    assert got[0][0] == "# a\n# b\n# c\n" and got[1] == ("", "\n x", "") and got[2][0] == ""


@pytest.mark.parametrize("text,arithmetic,logic", [
    ("a == b", "a == b", (None, "no_mutation")),
    ("a==b\nx", "a!=b\nx", ("a!=b\nx", "cmp_eq_to_ne")),
    ("# x and y\nreturn x", "# x and y\nreturn (x) + 1", ("# x or y\nreturn x", "bool_and_to_or")),
    ("  return -x\n", "  return +x\n", ("  return x", "return_drop_minus")),
    ("return a\n  return  b \ny", "return a\n  return (b) + 1\ny", ("return a\n  return -(b)\ny", "return_add_minus")),
    ("a ** b", "a //* b", (None, "no_mutation")),
    (" \n", " \n", (None, "empty")),
    ("é==é", "é!=é", ("é!=é", "cmp_eq_to_ne")),
    ("return\xa00", "return 1", ("return -(0)", "return_add_minus")),
])
def test_mutations(spark, text, arithmetic, logic):
    (a, m), = values(spark, [text], arithmetic_mutation("t"), logic_mutation("t"))
    assert a == arithmetic and (m["text"], m["tag"]) == logic


def test_rows_of_a_small_file_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for sql in (inputs.CODE, inputs.BODY, inputs.BUILD_SFT):
        sizes = [r["count"] for r in inputs.spark_rows(spark, str(tmp_path), sql).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 5000 and max(sizes) <= 5000 / spark.sparkContext.defaultParallelism


def test_mutations_read_a_text_once(spark):
    """No line is looked for anew for each use of it, and rules after the first that applies are not tried."""
    for c in (arithmetic_mutation("t"), logic_mutation("t")):
        assert spark.createDataFrame([("x",)], "t string").select(c)._jdf.queryExecution().analyzed().toString().count("*)return[") <= 6


@pytest.mark.parametrize("text,want", [
    ("x\nclass A", "x"), ("    a\n\nprint(1)", "    a"), ("return xdef g(y):", "return x"), ("def f(a):\n  b", ""), ("  a\n  def g(x):", "  a"), ("a\ndef g(x): y", "a\ndef g(x): y"), ("```python\n  a\n```b", "a"), ("a\r\n# Test", "a"),
])
def test_completion(spark, text, want):
    assert values(spark, [text], X.completion_of("t")) == [(want,)]


@pytest.mark.parametrize("text,want", [
    ("a<|fim_middle|>b", "    a"), ("  a\n#!x", "  a"), ("a\n  b", "    a\n      b"), ("  x\nfoo.bar = 1\n  y", "  x"), ("\té🙂z", "\tz"), ("  a\r\n  b\r\n", "  a\n  b"), ("def f(x):", ""), ("x\n\nimport os", "    x"), ("", ""),
])
def test_safe_completion(spark, text, want):
    assert values(spark, [text], X.safe_completion("t")) == [(want,)]


def test_safe_completion_is_ascii(spark):
    for (c,) in values(spark, texts(300, "a \n\té�<|#!.=:", 40), X.safe_completion("t")):
        assert all(x in "\n\t" or " " <= x <= "~" for x in c)


def test_ratings(spark):
    rows = ["1.5", " 2 ", "nan", "N/A", "inf", None]
    assert values(spark, rows, X.rating("t")) == [(1.5,), (2.0,), (None,), (None,), (float("inf"),), (None,)]


def test_similarity_bound_never_hides_a_match():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(2))
        assert difflib.SequenceMatcher(None, a, b).ratio() <= 2 * min(len(a), len(b)) / (len(a) + len(b)) + 1e-12
