"""Queries over text operators: predicates, keys, prompts, completions, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import predicates as P
from codeloom.functions import texts as X
from codeloom.functions.chat import rendered_conversations, scoring_text
from codeloom.functions.mutation import arithmetic_mutation, logic_mutation
from codeloom.functions.pytext import collapsed, lines, squeezed, strip
from codeloom.plans import audit
from codeloom.queries.inputs import BODY, BODY_EXPECTED, CODE, SFT, WS, plain, spark_rows, table

QUERIES, ORACLE_SQL = {}, {}


class Template(str):
    """Text whose ``{}`` or ``{0}`` is filled in; other braces are the engine's own."""

    def format(self, *values):
        out = str(self).replace("{}", values[0])
        for i, v in enumerate(values):
            out = out.replace(f"{{{i}}}", v)
        return out


_SFT = f"WITH sft AS ({plain(SFT)}) "
_STRIP = Template(rf"regexp_replace({{}}, '^{WS}+|{WS}+$', '', 'g')")
_STOPS = "[" + ", ".join("chr(10) || '" + s[1:].replace("'", "''") + "'" for s in X.STOPS) + "]"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _flag(name: str, test: str) -> str:
    return f"count(*) FILTER (WHERE {test})::BIGINT AS {name}, CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE {test}) / count(*)::DOUBLE ELSE 0.0 END AS {name}_rate"


_LINES = Template(r"list_filter(regexp_split_to_array({0}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e]'), lambda x: regexp_matches(x, '\S'))")
_BODY_LIKE = Template(f"(len({_LINES.format('{0}')}) > 0 AND len(list_filter({_LINES.format('{0}')}, lambda x: x[1] IN (' ', chr(9)))) / len({_LINES.format('{0}')})::DOUBLE >= 0.6)")
_FIM = Template("(contains({0}, '<|fim_prefix|>') OR contains({0}, '<|fim_middle|>') OR contains({0}, '<|fim_suffix|>'))")
_TOP = Template(rf"regexp_matches({{0}}, '(?m)^(def|class|from|import){WS}+')")
_FOREIGN = Template(r"(length({0}) > 0 AND length(regexp_replace({0}, '[\x00-\x7f]', '', 'g')) / length({0})::DOUBLE > 0.05)")
_AUDIT = ", ".join(
    [_flag("empty_output", f"{_STRIP.format('output')} = ''"), _flag("fim", _FIM.format("output")), _flag("replacement_char", "contains(output, chr(65533))"), _flag("top_level_continuation", _TOP.format("output")), _flag("high_non_ascii", _FOREIGN.format("output")), _flag("body_like", _BODY_LIKE.format("output"))]
)


@query(f"{_SFT} SELECT count(*)::BIGINT AS total, {_AUDIT} FROM sft")
def audit_sft_rates(spark, sf_dir):
    return audit.audit_instructions(spark_rows(spark, sf_dir, SFT), parse=False)


@query(rf"""SELECT page_id, html = '' OR contains(html, chr(65533)) AS garbled, contains(html, 'def ') AS has_def, contains(html, '```') AS has_fence, {_TOP.format('html')} AS top, {_FOREIGN.format('html')} AS is_foreign,
  regexp_matches(html, '^{WS}*(def|class) ') AS starts_block, contains(html, 'import unittest') OR contains(html, 'def test') AS unittest, contains(lower(html), 'python') OR contains(lower(html), 'def ') OR contains(html, '函数') AS about_python,
  NOT (regexp_replace(html, '{WS}', '', 'g') = '' OR {_FIM.format('html')} OR contains(html, chr(65533)) OR regexp_matches(html, '(?m)^{WS}*(import|from){WS}+')) AS clean_body, length(html) > 3000 AS too_long FROM pages""")
def text_predicates(spark, sf_dir):
    c = "html"
    return table(spark, sf_dir, "pages").select("page_id", P.garbled(c).alias("garbled"), P.has_def(c).alias("has_def"), P.has_fence(c).alias("has_fence"), P.continues_at_top(c).alias("top"), P.mostly_foreign(c).alias("is_foreign"), P.starts_block(c).alias("starts_block"), P.has_unittest(c).alias("unittest"), P.about_python(c).alias("about_python"), P.clean_body(c).alias("clean_body"), P.longer_than(3000, c).alias("too_long"))


@query(rf"""SELECT doc_id, sha256(trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ')) AS normal_key, sha256(regexp_replace(text, '{WS}+', '', 'g')) AS squeezed_key, len({_LINES.format('text')})::BIGINT AS filled_lines FROM documents""")
def norm_hash_keys(spark, sf_dir):
    filled = F.size(F.filter(lines("text"), lambda x: x.rlike(r"\S"))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", X.normal_key("text").alias("normal_key"), F.sha2(squeezed("text"), 256).alias("squeezed_key"), filled.alias("filled_lines"))


@query(rf"""WITH code AS ({plain(CODE)}), t AS (SELECT idx, raw || ' # note ' || raw AS raw FROM code) SELECT idx, regexp_replace(regexp_replace(raw, '#[^\n]*', '', 'g'), '{WS}+', '', 'g') AS canonical FROM t""")
def canonical_code(spark, sf_dir):
    rows = spark_rows(spark, sf_dir, CODE).select("idx", F.concat("raw", F.lit(" # note "), "raw").alias("raw"))
    return rows.select("idx", X.canonical_code("raw").alias("canonical"))


#: Texts with fences of all sorts around the code of each kind.
_FENCED = "SELECT idx, CASE idx % 4 WHEN 0 THEN raw WHEN 1 THEN 'a' || chr(10) || '```js' || chr(10) || 'x()' || chr(10) || '```' || chr(10) || raw WHEN 2 THEN '```Python ' || raw || ' ``` tail ```' ELSE '``` open ' || raw END AS t FROM ({0})"


def _first_group(t: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '{pattern}') THEN regexp_extract({t}, '{pattern}', 1)"


_TAGGED, _BARE, _EITHER = rf"(?is)```python{WS}*(.*?)```", rf"(?s)```{WS}*(.*?)```", rf"(?is)```(?:python)?{WS}*(.*?)```"


@query(f"WITH code AS ({plain(CODE)}), f AS ({_FENCED.format('SELECT * FROM code')}) SELECT idx, {_STRIP.format(_first_group('t', _TAGGED) + ' ' + _first_group('t', _BARE)[5:] + ' ELSE t END')} AS code FROM f")
def fence_extract_any(spark, sf_dir):
    rows = spark.sql(_FENCED.format("SELECT * FROM {code}"), code=spark_rows(spark, sf_dir, CODE))
    return rows.select("idx", X.fenced_code("t").alias("code"))


@query(f"WITH code AS ({plain(CODE)}), f AS (SELECT idx, {_STRIP.format('t')} AS t FROM ({_FENCED.format('SELECT * FROM code')})) SELECT idx, {_STRIP.format(_first_group('t', _EITHER) + ' ELSE t END')} AS code FROM f")
def fence_extract_first(spark, sf_dir):
    rows = spark.sql(_FENCED.format("SELECT * FROM {code}"), code=spark_rows(spark, sf_dir, CODE))
    return rows.select("idx", X.first_fence("t").alias("code"))


_COMMENT = rf"array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(replace(regexp_replace({_STRIP.format('t')}, '(?i)```(?:python)?', '', 'g'), '```', ''), '\n'), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), lambda x: '# ' || x), chr(10))"


@query(rf"""{_SFT}, t AS (SELECT idx, {_STRIP.format('instruction')} || CASE WHEN idx % 3 = 0 THEN '' ELSE chr(10) || chr(10) || 'Input:' || chr(10) || {_STRIP.format('output')} END AS t, CASE WHEN idx % 3 = 0 THEN instruction ELSE instruction || chr(10) || output END AS joined FROM sft)
  SELECT idx, CASE WHEN {_COMMENT} = '' THEN '' ELSE {_COMMENT} || chr(10) END || 'def f():' || chr(10) AS prompt, joined FROM t""")
def comment_prompts(spark, sf_dir):
    rows = spark_rows(spark, sf_dir, SFT).withColumn("given", F.when(F.col("idx") % 3 == 0, " ").otherwise(F.col("output")))
    return rows.select("idx", X.function_prompt(X.task_text("instruction", "given"), F.lit("def f():\n")).alias("prompt"), X.joined_prompt("instruction", "given").alias("joined"))


@query(f"SELECT idx, arithmetic AS mutated FROM ({BODY_EXPECTED})")
def mutate_arithmetic(spark, sf_dir):
    return spark_rows(spark, sf_dir, BODY).select("idx", arithmetic_mutation("body").alias("mutated"))


@query(f"SELECT idx, logic AS mutated, tag FROM ({BODY_EXPECTED})")
def mutate_logic(spark, sf_dir):
    return spark_rows(spark, sf_dir, BODY).withColumn("m", logic_mutation("body")).select("idx", F.col("m.text").alias("mutated"), F.col("m.tag").alias("tag"))


@query(f"SELECT tag, count(*)::BIGINT AS n FROM ({BODY_EXPECTED}) GROUP BY tag")
def mutate_logic_tags(spark, sf_dir):
    return spark_rows(spark, sf_dir, BODY).groupBy(logic_mutation("body")["tag"].alias("tag")).agg(F.count("*").alias("n"))


#: A model's answers: a text with one of the stops in it, further functions, or none.
_ANSWERS = "SELECT conv_id * 1000 + turn AS idx, text || CASE turn % 4 WHEN 0 THEN ' ' || chr(10) || 'print(x)' || chr(10) || 'class A' WHEN 1 THEN chr(10) || 'assert x' WHEN 2 THEN ' return xdef g(' ELSE '' END || chr(10) || text AS t FROM {conversations}"
_RSTRIP = Template(rf"regexp_replace({{}}, '{WS}+$', '')")
_DEF = rf"def{WS}+[A-Za-z_]\w*{WS}*\("


@query(
    rf"""WITH a AS ({plain(_ANSWERS)}), c AS (SELECT idx, t, list_min(list_filter(list_transform({_STOPS}, lambda s: strpos(t, s)), lambda i: i > 0)) AS pos FROM a),
    s AS (SELECT idx, {_RSTRIP.format("CASE WHEN pos IS NULL THEN t ELSE substr(t, 1, pos - 1) END")} AS t FROM c)
  SELECT idx, CASE WHEN regexp_matches(t, '(^|[^\n]){_DEF}') THEN {_RSTRIP.format(f"regexp_extract(t, '(?s)^(.*?(?:^|[^' || chr(10) || ']))' || '{_DEF}', 1)")} ELSE t END AS completion FROM s"""
)
def extract_completion(spark, sf_dir):
    return spark_rows(spark, sf_dir, _ANSWERS).select("idx", X.completion_of("t").alias("completion"))


_MESSY = "SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN chr(10) || 'import os' || chr(10) || 'x' WHEN 1 THEN '<|fim_suffix|> more' WHEN 2 THEN chr(10) || 'a.b_c += 1' || chr(10) || 'y' WHEN 3 THEN chr(10) || '#!x' WHEN 4 THEN chr(13) || chr(10) || '  z  ' || chr(10) ELSE chr(10) || chr(9) || 'import os' END AS t FROM {documents}"


@query(
    rf"""WITH a AS ({plain(_MESSY)}), b AS (SELECT doc_id, replace(t, chr(13) || chr(10), chr(10)) AS t FROM a),
    c AS (SELECT doc_id, list_min(list_filter([strpos(t, '<|fim_prefix|>'), strpos(t, '<|fim_middle|>'), strpos(t, '<|fim_suffix|>')], lambda i: i > 0)) AS pos, t FROM b),
    d AS (SELECT doc_id, string_split(regexp_replace(CASE WHEN pos IS NULL THEN t ELSE substr(t, 1, pos - 1) END, '[^\n\t\x20-\x7e]', '', 'g'), chr(10)) AS ls FROM c),
    e AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches(x, '^((def|class|from|import)[ \t]+|<\||#!|[A-Za-z_]\w*(\.\w+)+[ \t]*[-+*/]?=)')), true) AS bad FROM d),
    f AS (SELECT doc_id, string_split(regexp_replace(array_to_string(CASE WHEN bad > 0 THEN ls[1:bad - 1] ELSE ls END, chr(10)), '[ \t\n]+$', ''), chr(10)) AS ls FROM e)
  SELECT doc_id, CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '^[^ \t]'))) > 0 THEN array_to_string(list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '[^ \t]') THEN '    ' || x ELSE x END), chr(10)) ELSE array_to_string(ls, chr(10)) END AS completion FROM f"""
)
def sanitize_completion(spark, sf_dir):
    return spark_rows(spark, sf_dir, _MESSY).select("doc_id", X.safe_completion("t").alias("completion"))


@query("SELECT doc_id, CASE WHEN length(text) > 280 THEN substr(text, 1, 280) || '...(truncated)' ELSE text END AS short, substr(text, 1, 180) AS head FROM documents")
def shorten_heads(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.shortened("text").alias("short"), X.head("text", 180).alias("head"))


@query("SELECT n_nationkey, coalesce(nullif(p, ''), nullif(i, ''), q) AS prompt FROM (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN '' END AS p, CASE n_nationkey % 2 WHEN 0 THEN '' ELSE 'i' END AS i, 'q' AS q FROM nation)")
def prompt_fallback(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.when(k % 3 == 0, F.col("n_name")).when(k % 3 == 1, "").alias("p"), F.when(k % 2 == 0, "").otherwise("i").alias("i"), F.lit("q").alias("q"))
    return rows.select("n_nationkey", X.task_prompt("p", "i", "q").alias("prompt"))


_MESSAGE = "'<|im_start|>' || {0} || chr(10) || {1} || '<|im_end|>' || chr(10)"


@query(
    f"""WITH m AS (SELECT conv_id, turn, role, {_MESSAGE.format('role', 'text')} AS part FROM conversations)
  SELECT conv_id, count(*)::BIGINT AS n_turns, CASE WHEN arg_min(role, turn) = 'system' THEN '' ELSE {_MESSAGE.format("'system'", "'You are Qwen, created by Alibaba Cloud. You are a helpful assistant.'")} END || string_agg(part, '' ORDER BY turn) AS rendered FROM m GROUP BY conv_id"""
)
def chat_render(spark, sf_dir):
    return rendered_conversations(table(spark, sf_dir, "conversations"))


@query(f"{_SFT} SELECT idx, {_MESSAGE.format(chr(39) + 'system' + chr(39), chr(39) + 'You are a helpful coding assistant.' + chr(39))} || {_MESSAGE.format(chr(39) + 'user' + chr(39), 'instruction')} || {_MESSAGE.format(chr(39) + 'assistant' + chr(39), 'output')} AS scored FROM sft")
def chat_scoring_text(spark, sf_dir):
    return spark_rows(spark, sf_dir, SFT).select("idx", scoring_text("instruction", "output").alias("scored"))


_LOW = f"lower({_STRIP.format('instruction')})"


@query(
    f"""{_SFT} SELECT CASE WHEN {_LOW} LIKE 'you are%' THEN 'you_are' WHEN {_LOW} LIKE 'given%' THEN 'given' WHEN regexp_matches({_LOW}, '^write (a|an) (python )?function') THEN 'write_python_function'
    WHEN {_LOW} LIKE 'implement%' THEN 'implement' WHEN {_LOW} LIKE 'complete%' THEN 'complete' ELSE 'other' END AS label, count(*)::BIGINT AS n FROM sft GROUP BY 1"""
)
def style_hist(spark, sf_dir):
    return audit.style_histogram(spark_rows(spark, sf_dir, SFT), "instruction")


@query(
    rf"""WITH l AS (SELECT html, {_LINES.format('html')} AS ls FROM pages)
  SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE contains(html, '```'))::BIGINT AS fenced, sum(length(html))::BIGINT AS chars, sum(len(list_filter(ls, lambda x: x[1] IN (' ', chr(9)))))::BIGINT AS indented FROM l"""
)
def content_flags(spark, sf_dir):
    shape = audit.content_shape(table(spark, sf_dir, "pages"), "html").select("n", "fenced", F.round(F.col("avg_chars") * F.col("n")).cast("long").alias("chars"))
    # the average's parts, as sums of whole numbers compare exactly
    ls = F.filter(lines("html"), lambda x: x.rlike(r"\S"))
    total = table(spark, sf_dir, "pages").agg(F.sum(F.size(F.filter(ls, lambda x: x.rlike(r"\A[ \t]")))).cast("long").alias("indented"))
    return shape.crossJoin(total)  # one row each


@query(f"SELECT c_custkey, {_STRIP.format('t')} AS stripped, trim(regexp_replace(t, '{WS}+', ' ', 'g'), ' ') AS collapsed FROM (SELECT c_custkey, chr(11) || c_name || chr(160) || chr(8232) || ' x ' || chr(28) || chr(133) || c_mktsegment || chr(12288) AS t FROM customer)")
def white_space(spark, sf_dir):
    odd = lambda *n: F.lit("".join(map(chr, n)))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(odd(11), "c_name", odd(160, 8232), F.lit(" x "), odd(28, 133), "c_mktsegment", odd(12288)).alias("t"))
    return rows.select("c_custkey", strip("t").alias("stripped"), collapsed("t").alias("collapsed"))
