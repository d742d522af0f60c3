"""Inputs of the queries, derived from the shared tables by SQL that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Python's white space as a class of the SQL engine's regular expressions.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: A user's turn and the assistant's next one as instruction and output.
SFT = """SELECT conv_id * 1000 + turn AS idx, text AS instruction, next_text AS output FROM (
  SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM {conversations}
) WHERE role = 'user' AND next_role = 'assistant'"""


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of few bytes a row that queries do much work for, and their keys.
_NARROW = {"part": "p_partkey", "supplier": "s_suppkey"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by a key: a file of few bytes is one task or two, however many rows it has and whatever follows."""
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def spark_rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of an input: table names stand in braces."""
    rows = {t: table(spark, sf_dir, t) for t in tables_of(sql)}
    return spark.sql(sql, **{t: spread(df, _NARROW[t]) if t in _NARROW else df for t, df in rows.items()})


def plain(sql: str) -> str:
    """The same for an engine that has the tables as views."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def literal(template: str, key: str = "CAST(p_partkey AS STRING)") -> str:
    """An SQL expression for a text; ``@`` stands for the key."""
    out = []
    for i, line in enumerate(template.split("\n")):
        if i:
            out.append("chr(10)")
        for j, bit in enumerate(line.split("@")):
            if j:
                out.append(key)
            if bit:
                out.append("'" + bit.replace("'", "''") + "'")
    return "(" + " || ".join(out or ["''"]) + ")"


def choice(options: list[str | None], key: str = "CAST(p_partkey AS STRING)", by: str = "p_partkey % 12") -> str:
    """An SQL expression that takes one of the texts by a remainder."""
    cases = " ".join(f"WHEN {i} THEN {'CAST(NULL AS STRING)' if t is None else literal(t, key)}" for i, t in enumerate(options))
    return f"CASE {by} {cases} END"


#: Sources by kind, with what each operator has to make of them: raw, function, name, skeleton, completion.
KINDS: list[tuple[str, str | None, str | None, str | None, str | None]] = [
    ("def f_@(a, b):\n    c = a + @\n    return c * b\n", "def f_@(a, b):\n    c = a + @\n    return c * b", "f_@", "def f_@(a, b):\n", "    c = a + @\n    return c * b\n"),
    ('def f_@(a):\n    """Adds @."""\n    return a + @\n', 'def f_@(a):\n    """Adds @."""\n    return a + @', "f_@", 'def f_@(a):\n    """Adds @."""\n', "    return a + @\n"),
    ("def f_@(a): return a", "def f_@(a): return a", "f_@", "def f_@(a): return a\n", "def f_@(a): return a\n"),
    ("def f_@(a,\n        b):\n    return a - b\n", "def f_@(a,\n        b):\n    return a - b", "f_@", "def f_@(a,\n", "    return a - b\n"),
    ("def f_@(a):\n    def g(x):\n        return x\n    return g(a)\n", "def f_@(a):\n    def g(x):\n        return x\n    return g(a)", "f_@", "def f_@(a):\n", "    def g(x):\n        return x\n    return g(a)\n"),
    ("Here:\n```python\ndef f_@(a):\n    return a and @\n```\nDone", "def f_@(a):\n    return a and @", "f_@", "def f_@(a):\n", "    return a and @\n"),
    ("Text\n```\ndef f_@(a):\n    return not a\n```", "def f_@(a):\n    return not a", "f_@", "def f_@(a):\n", "    return not a\n"),
    ("def f_@(a:\n    return a", None, None, None, None),
    ("x = @\nprint(x)", None, None, None, None),
    ("import os\n@d\ndef f_@(a):\n    if a == @:\n        return True\n    return False\n".replace("@d", "%d"), "def f_@(a):\n    if a == @:\n        return True\n    return False", "f_@", "def f_@(a):\n", "    if a == @:\n        return True\n    return False\n"),
    ("async def f_@(a):\n    return a\n", "async def f_@(a):\n    return a", "f_@", "async def f_@(a):\n", "    return a\n"),
    ('def f_@():\n    """Only words."""\n', 'def f_@():\n    """Only words."""', None, None, None),
]
#: A decorator's mark would be read as the key, so it is written by its code.
_RAW = choice([k[0] for k in KINDS]).replace("'%d'", "chr(64) || 'd'")

CODE = f"SELECT p_partkey AS idx, CAST(p_partkey % 12 AS INT) AS kind, {_RAW} AS raw FROM {{part}}"
EXPECTED = f"""SELECT p_partkey AS idx, CAST(p_partkey % 12 AS INT) AS kind, {_RAW} AS raw, {choice([k[1] for k in KINDS])} AS code, {choice([k[2] for k in KINDS])} AS name,
  {choice([k[3] for k in KINDS])} AS skeleton, {choice([k[4] for k in KINDS])} AS completion FROM part"""

#: Bodies by kind, with the arithmetic mutation, the logic mutation and its tag.
BODIES: list[tuple[str, str, str | None, str]] = [
    ("    return a==@\n", "    return a!=@\n", "    return a!=@\n", "cmp_eq_to_ne"),
    ("    if a<=@:\n        return a\n    return 0\n", "    if a<@:\n        return a\n    return 0\n", "    if a<@:\n        return a\n    return 0\n", "cmp_le_to_lt"),
    ("    return a and b or @\n", "    return (a and b or @) + 1", "    return a or b or @\n", "bool_and_to_or"),
    ("    return a or @\n", "    return (a or @) + 1", "    return a and @\n", "bool_or_to_and"),
    ("    ok = True\n    return ok\n", "    ok = False\n    return ok\n", "    ok = False\n    return ok\n", "true_to_false"),
    ("    return False\n", "    return True\n", "    return True\n", "false_to_true"),
    ("    x = a + @\n    return x\n", "    x = a - @\n    return x\n", "    x = a + @\n    return -(x)", "return_add_minus"),
    ("    return -a\n", "    return +a\n", "    return a", "return_drop_minus"),
    ("    return 0\n", "    return 1\n", "    return -(0)", "return_add_minus"),
    ("    a ** @\n", "    a //* @\n", None, "no_mutation"),
    ("    y = max(a)\n    return y\n", "    y = max(a)\n    return (y) + 1", "    y = max(a)\n    return -(y)", "return_add_minus"),
    ("    pass\n", "    pass\n", None, "no_mutation"),
]
BODY = f"SELECT p_partkey AS idx, {choice([b[0] for b in BODIES])} AS body FROM {{part}}"
BODY_EXPECTED = f"SELECT p_partkey AS idx, {choice([b[0] for b in BODIES])} AS body, {choice([b[1] for b in BODIES])} AS arithmetic, {choice([b[2] for b in BODIES])} AS logic, {choice([b[3] for b in BODIES])} AS tag FROM part"

#: Rows to build pairs from, and seeds: every tenth prompt repeats one before it, some are dirty or broken.
BUILD_SFT = f"""SELECT p_partkey AS idx, 'def g_' || CAST(p_partkey % 1500 AS STRING) || '(a, b):' || chr(10) AS instruction, '' AS input,
  CASE WHEN p_partkey % 29 = 3 THEN '    import os' || chr(10) ELSE '' END || {choice([b[0] for b in BODIES], "CAST(p_partkey % 1500 AS STRING)")} || CASE WHEN p_partkey % 31 = 4 THEN '  )' ELSE '' END AS output FROM {{part}}"""
SEEDS = """SELECT s_suppkey AS idx, 'def s_' || CAST(s_suppkey % 70 AS STRING) || '(a):' || chr(10) AS prompt, '    return a' || chr(10) AS chosen, CASE WHEN s_suppkey % 9 = 0 THEN ' ' WHEN s_suppkey % 9 = 1 THEN '    return (' ELSE '    return -a' END AS rejected FROM {supplier}"""

#: Lines with a place that is unique in their order.
LINES = """(SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_returnflag) AS pos FROM {lineitem})"""

#: Rated responses: a model's later answer replaces an earlier one; some ratings are no number.
RATED = f"""SELECT l_orderkey AS idx, CAST(pos AS BIGINT) AS pos, 'm' || CAST(l_suppkey % 5 AS STRING) AS model, 'answer ' || CAST(l_partkey AS STRING) AS response,
  CASE WHEN pos % 5 = 4 THEN 'N/A' ELSE CAST(CAST(floor(l_quantity) AS BIGINT) % 6 AS STRING) END AS rating FROM {LINES}"""

#: Candidates of three models for tasks.
CANDIDATES = f"""SELECT CASE l_suppkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'sft' ELSE 'dpo' END AS model, 'Task/' || CAST(l_orderkey % 997 AS STRING) AS task_id, 'f' || CAST(l_orderkey % 997 AS STRING) AS entry_point,
  l_orderkey * 1000 + pos AS cand_idx, l_quantity > 40 AS passed, 'text ' || CAST(l_partkey AS STRING) AS text FROM {LINES}"""
SCORES = "SELECT event_type AS model, event_id AS idx, value AS chosen_lp, CAST(user_id % 100 AS DOUBLE) AS rejected_lp, props AS prompt FROM {events}"
