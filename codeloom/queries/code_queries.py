"""Queries over parsed code: functions, conversion, cleaning, pair building, validation, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import chat
from codeloom.functions.code import first_function, function_parts, parse_ok, passes_check, sequence_ratio
from codeloom.functions.pytext import unix_lines
from codeloom.functions.texts import fenced_code, first_fence
from codeloom.operators.cascade import KEPT, reason_counts
from codeloom.plans import audit, clean, convert, evaluate, pairs
from codeloom.queries.inputs import BODY_EXPECTED, BUILD_SFT, CODE, EXPECTED, SEEDS, plain, spark_rows

QUERIES, ORACLE_SQL = {}, {}
#: More than any table has: no cap.
_TARGET = 10**12


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_E = f"WITH e AS ({EXPECTED})"


def _counts(rows: str, reasons: tuple[str, ...]) -> str:
    listed = ", ".join(f"('{r}')" for r in reasons)
    return f"SELECT v.reason, count(r.reason)::BIGINT AS n FROM (VALUES {listed}) v(reason) LEFT JOIN ({rows}) r ON r.reason = v.reason GROUP BY v.reason"


@query(f"{_E} SELECT idx, code FROM e")
def first_functions(spark, sf_dir):
    return spark_rows(spark, sf_dir, CODE).select("idx", first_function(fenced_code("raw"))[0].alias("code"))


@query(f"{_E} SELECT idx, name, skeleton, completion FROM e")
def functions_in_parts(spark, sf_dir):
    rows = spark_rows(spark, sf_dir, CODE).select("idx", function_parts(unix_lines(first_fence("raw")))[0].alias("p"))
    return rows.select("idx", "p.name", "p.skeleton", "p.completion")


@query(f"{_E} SELECT idx, kind NOT IN (5, 6, 7) AS raw_ok, kind <> 7 AND kind <> 5 AND kind <> 6 AS again_ok FROM e")
def parses(spark, sf_dir):
    rows = spark_rows(spark, sf_dir, CODE).select("idx", parse_ok(F.col("raw"), F.concat("raw", F.lit("\n"), "raw")).alias("ok"))
    return rows.select("idx", F.col("ok")[0].alias("raw_ok"), F.col("ok")[1].alias("again_ok"))


_TASK = "SELECT idx, kind, raw, CASE WHEN idx % 7 = 0 THEN '' ELSE raw END AS output, 'Task ' || CAST(idx AS STRING) || chr(10) || '  do it ' AS instruction, CASE WHEN idx % 2 = 0 THEN ' ' ELSE 'n' END AS input FROM ({0})"
_CONVERTED = f"""WITH e AS ({EXPECTED}), c AS (SELECT idx, CASE WHEN idx % 7 = 0 THEN 'drop_empty' WHEN completion IS NULL THEN 'drop_no_function' WHEN kind IN (2, 4) THEN 'drop_top_level_def_completion' ELSE 'kept' END AS reason,
  '# Task ' || CAST(idx AS STRING) || chr(10) || '# do it' || chr(10) || CASE WHEN idx % 2 = 0 THEN '' ELSE '# Input:' || chr(10) || '# n' || chr(10) END || skeleton AS instruction, completion AS output FROM e)"""


def _tasks(spark, sf_dir):
    return spark.sql(_TASK.format("SELECT * FROM {code}"), code=spark_rows(spark, sf_dir, CODE))


@query(f"{_CONVERTED} {_counts('SELECT reason FROM c', convert.SFT_REASONS)}")
def convert_hist(spark, sf_dir):
    return reason_counts(convert.converted_instructions(_tasks(spark, sf_dir)), convert.SFT_REASONS)


@query(f"{_CONVERTED} SELECT idx, instruction, output FROM c WHERE reason = 'kept'")
def convert_kept(spark, sf_dir):
    return convert.converted_instructions(_tasks(spark, sf_dir)).where(F.col("reason") == KEPT).select("idx", "instruction", "output")


#: A second answer to each task: another kind, under another name for every fifth.
_OTHER = "SELECT a.idx, 'Task ' || CAST(a.idx AS STRING) AS prompt, a.raw AS chosen, CASE WHEN a.idx % 5 = 0 THEN 'def other(x):' || chr(10) || '    return x' WHEN a.idx % 11 = 0 THEN ' ' ELSE 'def f_' || CAST(a.idx AS STRING) || '(x):' || chr(10) || '    return x' END AS rejected FROM ({0}) a"
_PAIRED = f"""WITH e AS ({EXPECTED}), c AS (SELECT idx, CASE WHEN idx % 5 <> 0 AND idx % 11 = 0 THEN 'drop_empty' WHEN completion IS NULL THEN 'drop_no_function' WHEN idx % 5 = 0 THEN 'drop_name_mismatch' WHEN kind IN (2, 4) THEN 'drop_top_level_def_completion' ELSE 'kept' END AS reason,
  '# Task ' || CAST(idx AS STRING) || chr(10) || skeleton AS prompt, completion AS chosen, '    return x' || chr(10) AS rejected FROM e)"""


def _pairs(spark, sf_dir):
    return spark.sql(_OTHER.format("SELECT * FROM {code}"), code=spark_rows(spark, sf_dir, CODE))


@query(f"{_PAIRED} {_counts('SELECT reason FROM c', convert.PAIR_REASONS)}")
def convert_pairs_hist(spark, sf_dir):
    return reason_counts(convert.converted_pairs(_pairs(spark, sf_dir)), convert.PAIR_REASONS)


@query(f"{_PAIRED} SELECT idx, prompt, chosen, rejected FROM c WHERE reason = 'kept'")
def convert_pairs_kept(spark, sf_dir):
    return convert.converted_pairs(_pairs(spark, sf_dir)).where(F.col("reason") == KEPT).select("idx", "prompt", "chosen", "rejected")


#: Raw rows: dirt of each sort, every instruction twice or more.
_RAW = """SELECT idx, CASE WHEN idx % 41 = 0 THEN '' ELSE 'python task ' || CAST(idx % 900 AS STRING) END || CASE WHEN idx % 43 = 0 THEN repeat('x', 1200) ELSE '' END AS instruction,
  CASE WHEN idx % 47 = 0 THEN raw || '�' ELSE raw END AS output, 'tag' AS tag FROM ({0})"""
_CLEAN = f"""WITH e AS ({EXPECTED}), r AS (SELECT idx, CASE WHEN idx % 1763 = 0 THEN -1 ELSE idx % 900 END AS a, code, CASE WHEN idx % 41 = 0 AND idx % 43 <> 0 THEN 'drop_empty' WHEN idx % 43 = 0 AND length(CASE WHEN idx % 41 = 0 THEN '' ELSE 'python task ' || CAST(idx % 900 AS STRING) END) > 0 THEN 'drop_too_long'
    WHEN idx % 47 = 0 THEN 'drop_garbled' WHEN idx % 41 = 0 AND kind = 8 THEN 'drop_not_python' WHEN code IS NULL THEN 'drop_no_function' END AS reason FROM e),
  o AS (SELECT idx, a, code FROM r WHERE reason IS NULL),
  first AS (SELECT a, min(idx) AS first FROM o GROUP BY a),
  c AS (SELECT r.idx, r.code, coalesce(reason, CASE WHEN r.idx = first THEN 'kept' ELSE 'drop_dup_instruction' END) AS reason FROM r LEFT JOIN first USING (a))"""


def _raw(spark, sf_dir):
    return spark.sql(_RAW.format("SELECT * FROM {code}"), code=spark_rows(spark, sf_dir, CODE))


@query(f"{_CLEAN} {_counts('SELECT reason FROM c', clean.SFT_REASONS)}")
def clean_reason_hist(spark, sf_dir):
    return clean.sft_counts(clean.clean_instructions(_raw(spark, sf_dir), max_kept=_TARGET))


@query(f"{_CLEAN}, k AS (SELECT idx, code AS output FROM c WHERE reason = 'kept' ORDER BY idx LIMIT 300) SELECT * FROM k")
def clean_kept_capped(spark, sf_dir):
    """The cap itself is what this query shows."""
    return clean.kept_instructions(clean.clean_instructions(_raw(spark, sf_dir), max_kept=300)).select("idx", "output")


def _rated_code(spark, sf_dir):
    """Two rated answers to each task: the code of its kind, and a plain function or the same code."""
    rows = spark_rows(spark, sf_dir, CODE)
    k, plain_answer = F.col("idx"), F.concat(F.lit("def h(value):\n    result = [value] * 3\n    return result, "), F.col("idx").cast("string"))
    second = F.when(k % 4 == 0, F.concat(F.col("raw"), F.lit(""))).otherwise(plain_answer)
    entry = lambda m, r: F.struct(F.lit(m).alias("model"), r.alias("response"))
    note = lambda m, r: F.struct(F.lit(m).alias("model"), r.alias("rating"))
    low = F.when(k % 13 == 0, "5").when(k % 13 == 1, "4.5").when(k % 13 == 2, "N/A").otherwise("3")
    return rows.select(
        "idx", F.concat(F.lit("write python "), (k % 700).cast("string")).alias("instruction"), F.array(entry("a", F.col("raw")), entry("b", second)).alias("responses"), F.array(note("a", F.lit("5")), note("b", low), note("c", F.lit("1"))).alias("annotations")
    )


_PAIR_CLEAN = f"""WITH e AS ({EXPECTED}), r AS (SELECT idx, idx % 700 AS a, CASE WHEN idx % 13 IN (0, 2) THEN 'drop_no_pair' WHEN idx % 13 = 1 THEN 'drop_small_gap' WHEN code IS NULL THEN 'drop_no_function' WHEN idx % 4 = 0 THEN 'drop_low_info' END AS reason FROM e),
  first AS (SELECT a, min(idx) AS first FROM r WHERE reason IS NULL GROUP BY a),
  c AS (SELECT idx, coalesce(reason, CASE WHEN idx = first THEN 'kept' ELSE 'drop_dup_prompt' END) AS reason FROM r LEFT JOIN first USING (a))"""


@query(f"{_PAIR_CLEAN} {_counts('SELECT reason FROM c', clean.PAIR_REASONS)}")
def pair_clean_hist(spark, sf_dir):
    return clean.pair_counts(clean.clean_pairs(_rated_code(spark, sf_dir), max_kept=_TARGET))


_BUILD = f"""WITH b AS ({plain(BUILD_SFT)}), m AS (SELECT b.idx, instruction, output, e.* EXCLUDE (idx) FROM b JOIN ({BODY_EXPECTED}) e USING (idx)),
  r AS (SELECT idx, instruction, output, tag, CASE WHEN idx % 29 = 3 THEN 'skip_dirty_chosen' WHEN tag = 'no_mutation' AND NOT (idx % 31 = 4) THEN 'skip_no_mutation' WHEN idx % 31 = 4 AND tag = 'no_mutation' THEN 'skip_no_mutation' WHEN idx % 31 = 4 THEN 'skip_parse_fail' END AS reason FROM m),
  first AS (SELECT instruction, output, min(idx) AS first FROM r WHERE reason IS NULL GROUP BY ALL),
  c AS (SELECT r.idx, r.tag, coalesce(reason, CASE WHEN r.idx = first THEN 'kept' ELSE 'skip_duplicate' END) AS reason FROM r LEFT JOIN first ON r.instruction = first.instruction AND r.output = first.output AND reason IS NULL),
  s AS (SELECT DISTINCT s_suppkey % 70 AS p FROM supplier WHERE s_suppkey % 9 NOT IN (0, 1))"""


def _built(spark, sf_dir, target=_TARGET, **options):
    return pairs.built_pairs(spark_rows(spark, sf_dir, SEEDS), spark_rows(spark, sf_dir, BUILD_SFT), target=target, **options)


@query(f"{_BUILD} {_counts('SELECT reason FROM c', pairs.LOGIC_REASONS)}")
def build_logic_hist(spark, sf_dir):
    return reason_counts(_built(spark, sf_dir).where("phase = 1"), pairs.LOGIC_REASONS)


@query(f"{_BUILD} SELECT tag, count(*)::BIGINT AS n FROM c WHERE reason = 'kept' GROUP BY tag")
def build_logic_tags(spark, sf_dir):
    return pairs.tag_histogram(_built(spark, sf_dir))


@query(f"{_BUILD}, t AS (SELECT (SELECT count(*) FROM s) AS seeds), k AS (SELECT idx FROM c WHERE reason = 'kept' ORDER BY idx LIMIT greatest(0, 200 - (SELECT seeds FROM t))) SELECT seeds::BIGINT AS seed_pairs, (SELECT count(*) FROM k)::BIGINT AS built_from_sft, coalesce((SELECT count(*) FROM c WHERE idx <= (SELECT max(idx) FROM k)), 0)::BIGINT AS sft_rows, (seeds + (SELECT count(*) FROM k))::BIGINT AS final_pairs, seeds + (SELECT count(*) FROM k) >= 200 AS gate_ready FROM t")
def build_to_target(spark, sf_dir):
    """Stops where the target is reached; that is what this query shows."""
    return pairs.build_report(_built(spark, sf_dir, 200), target=200).select("seed_pairs", "built_from_sft", "sft_rows", "final_pairs", "gate_ready")


_ARITHMETIC = f"""WITH b AS ({plain(BUILD_SFT)}), r AS (SELECT b.idx, instruction, output, CASE WHEN arithmetic = body THEN 'skip_no_change' WHEN b.idx % 31 = 4 OR contains(body, '**') THEN 'skip_parse_fail' END AS reason FROM b JOIN ({BODY_EXPECTED}) e USING (idx)),
  first AS (SELECT instruction, output, min(idx) AS first FROM r WHERE reason IS NULL GROUP BY ALL),
  c AS (SELECT coalesce(reason, CASE WHEN r.idx = first THEN 'kept' ELSE 'skip_duplicate' END) AS reason FROM r LEFT JOIN first ON r.instruction = first.instruction AND r.output = first.output AND reason IS NULL)"""


@query(f"{_ARITHMETIC} {_counts('SELECT reason FROM c', pairs.ARITHMETIC_REASONS)}")
def build_arithmetic_hist(spark, sf_dir):
    return reason_counts(_built(spark, sf_dir, logic=False).where("phase = 1"), pairs.ARITHMETIC_REASONS)


#: Converted rows as their audits see them: header and body, and a body of another sort.
_BODIES = "SELECT idx, 'def g(a, b):' || chr(10) AS instruction, output, 'def g(a, b):' || chr(10) AS prompt, output AS chosen, CASE WHEN idx % 6 = 0 THEN '' WHEN idx % 6 = 1 THEN 'return a' WHEN idx % 6 = 2 THEN 'import os' || chr(10) || output ELSE '    return -(a)' END AS rejected FROM ({0})"


def _bodies(spark, sf_dir):
    return spark.sql(_BODIES.format("SELECT * FROM {rows}"), rows=spark_rows(spark, sf_dir, BUILD_SFT))


#: A body parses unless it ends in a stray bracket; its lines are indented.
_SEEN = f"WITH b AS ({plain(BUILD_SFT)}), a AS ({_BODIES.format('SELECT * FROM b')}), f AS (SELECT idx, idx % 6 AS k, idx % 31 <> 4 AS ok FROM a)"
_PAIR_AUDIT = """count(*)::BIGINT AS total, 0::BIGINT AS chosen_empty, count(*) FILTER (WHERE k = 0)::BIGINT AS rejected_empty, 0::BIGINT AS chosen_polluted, count(*) FILTER (WHERE k = 2)::BIGINT AS rejected_polluted,
  count(*) FILTER (WHERE ok)::BIGINT AS chosen_parse_ok, count(*) FILTER (WHERE k >= 3)::BIGINT AS rejected_parse_ok, count(*) FILTER (WHERE k >= 3 AND ok)::BIGINT AS usable_pairs"""


@query(f"{_SEEN} SELECT {_PAIR_AUDIT} FROM f")
def audit_pair_rates(spark, sf_dir):
    names = ("total", "chosen_empty", "rejected_empty", "chosen_polluted", "rejected_polluted", "chosen_parse_ok", "rejected_parse_ok", "usable_pairs")
    return audit.audit_pairs(_bodies(spark, sf_dir)).select(*names)


@query(f"""{_SEEN}, t AS (SELECT count(*) FILTER (WHERE k >= 3 AND ok)::BIGINT AS u, greatest(500, trunc(count(*) * 0.2)::BIGINT) AS need FROM f)
  SELECT u AS usable_pairs, need::BIGINT AS threshold, greatest(0, need - u)::BIGINT AS shortfall, u >= need AS passed, CASE WHEN u >= need THEN 'pass dpo quantity+quality gate' ELSE 'fail dpo quantity+quality gate; need data augmentation/cleanup' END AS reason FROM t""")
def quantity_gate(spark, sf_dir):
    found = audit.audit_pairs(_bodies(spark, sf_dir)).select("usable_pairs", "total")
    return audit.quantity_gate(found, F.col("total"), min_pairs=500)


@query(f"""WITH b AS ({plain(BUILD_SFT)}) SELECT count(*)::BIGINT AS total, 0::BIGINT AS empty_output, 0.0::DOUBLE AS empty_output_rate, 0::BIGINT AS fim, 0.0::DOUBLE AS fim_rate, 0::BIGINT AS replacement_char, 0.0::DOUBLE AS replacement_char_rate,
  0::BIGINT AS top_level_continuation, 0.0::DOUBLE AS top_level_continuation_rate, 0::BIGINT AS high_non_ascii, 0.0::DOUBLE AS high_non_ascii_rate, count(*)::BIGINT AS body_like, 1.0::DOUBLE AS body_like_rate,
  count(*) FILTER (WHERE idx % 31 <> 4)::BIGINT AS parse_ok, count(*) FILTER (WHERE idx % 31 <> 4) / count(*)::DOUBLE AS parse_ok_rate FROM b""")
def audit_built_rates(spark, sf_dir):
    return audit.audit_instructions(spark_rows(spark, sf_dir, BUILD_SFT))


@query(f"""WITH b AS ({plain(BUILD_SFT)}) SELECT count(*)::BIGINT AS total, count(*)::BIGINT AS prompt_has_def, 1.0::DOUBLE AS prompt_has_def_rate, count(*)::BIGINT AS output_no_fence, 1.0::DOUBLE AS output_no_fence_rate, count(*)::BIGINT AS output_no_top_def, 1.0::DOUBLE AS output_no_top_def_rate,
  count(*)::BIGINT AS prompt_no_fence, 1.0::DOUBLE AS prompt_no_fence_rate, count(*) FILTER (WHERE idx % 31 <> 4)::BIGINT AS concat_parse_ok, count(*) FILTER (WHERE idx % 31 <> 4) / count(*)::DOUBLE AS concat_parse_ok_rate FROM b""")
def validate_ratios(spark, sf_dir):
    return audit.flag_ratios(audit.instruction_flags(spark_rows(spark, sf_dir, BUILD_SFT)), audit.SFT_FLAGS)


@query(f"""WITH b AS ({plain(BUILD_SFT)}) SELECT idx, instruction AS instruction_head, output AS output_head, true AS prompt_has_def, true AS prompt_no_fence, true AS output_no_fence, true AS output_no_top_def, false AS concat_parse_ok FROM b WHERE idx % 31 = 4 ORDER BY idx LIMIT 20""")
def validate_bad_samples(spark, sf_dir):
    """The first twenty rows that miss a check; the limit is the feature."""
    return audit.bad_samples(audit.instruction_flags(spark_rows(spark, sf_dir, BUILD_SFT)), audit.SFT_FLAGS, ("instruction", "output"))


_ALL = "count(*)::BIGINT AS {0}, 1.0::DOUBLE AS {0}_rate"
_SOME = "count(*) FILTER (WHERE {1})::BIGINT AS {0}, count(*) FILTER (WHERE {1}) / count(*)::DOUBLE AS {0}_rate"


@query(f"{_SEEN} SELECT count(*)::BIGINT AS total, {', '.join(_ALL.format(c) for c in ('prompt_has_def', 'prompt_no_fence', 'chosen_no_top_def', 'rejected_no_top_def'))}, {_SOME.format('chosen_parse_ok', 'ok')}, {_SOME.format('rejected_parse_ok', 'k >= 3')} FROM f")
def validate_pair_ratios(spark, sf_dir):
    return audit.flag_ratios(audit.pair_flags(_bodies(spark, sf_dir)), audit.PAIR_FLAGS)


@query(f"""{_SEEN}, r AS (SELECT count(*) FILTER (WHERE ok) / count(*)::DOUBLE AS ok, count(*) FILTER (WHERE k >= 3) / count(*)::DOUBLE AS low FROM f), e AS (SELECT count(*) FILTER (WHERE contains(text, 'def ')) / count(*)::DOUBLE AS d FROM benchmark)
  SELECT d >= 0.98 AND ok >= 0.95 AND low >= 0.95 AS passed, array_to_string(list_filter([CASE WHEN ok < 0.95 THEN 'sft_concat_parse_ok' END, CASE WHEN ok < 0.95 THEN 'dpo_chosen_parse_ok' END, CASE WHEN low < 0.95 THEN 'dpo_rejected_parse_ok' END, CASE WHEN d < 0.98 THEN 'eval_prompt_has_def' END], lambda x: x IS NOT NULL), ',') AS failed FROM r, e""")
def gate_failed_checks(spark, sf_dir):
    row = audit.gate_ratios(spark_rows(spark, sf_dir, BUILD_SFT), _bodies(spark, sf_dir), spark_rows(spark, sf_dir, "SELECT text AS prompt FROM {benchmark}"))
    return audit.failed_checks(row).select("passed", F.array_join("failed_checks", ",").alias("failed"))


@query(f"""WITH code AS ({plain(CODE)}), l AS (SELECT idx, unnest(string_split(raw, chr(10))) AS x FROM code), f AS (SELECT idx, avg(CASE WHEN x[1] IN (' ', chr(9)) THEN 1.0 ELSE 0.0 END) AS share FROM l WHERE trim(x) <> '' GROUP BY idx)
  SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE contains(raw, '```'))::BIGINT AS fenced, round(avg(length(raw)), 6) AS avg_chars, round(avg(share), 6) AS avg_indent FROM code JOIN f USING (idx)""")
def code_shape(spark, sf_dir):
    out = audit.content_shape(spark_rows(spark, sf_dir, CODE), "raw")
    return out.select("n", "fenced", F.round("avg_chars", 6).alias("avg_chars"), F.round("avg_indent", 6).alias("avg_indent"))


@query(None)
def seq_similarity(spark, sf_dir):
    """Not expressible in SQL."""
    rows = spark_rows(spark, sf_dir, CODE)
    return rows.select("idx", sequence_ratio(F.col("raw"), F.reverse("raw")).alias("ratio"))


@query("SELECT r_regionkey, r_regionkey % 2 = 0 AS passed FROM region")
def run_check(spark, sf_dir):
    """Scripts of our own: every second one fails."""
    rows = spark_rows(spark, sf_dir, "SELECT r_regionkey FROM {region}")
    script = F.concat(F.lit("def f():\n    return "), F.col("r_regionkey").cast("string"), F.lit("\n\ndef check(c):\n    assert c() % 2 == 0\n\ncheck(f)\n"))
    return rows.select("r_regionkey", passes_check(script).alias("passed"))


@query("SELECT CASE n_nationkey % 2 WHEN 0 THEN 'base' ELSE 'sft' END AS model, 'T/' || n_regionkey AS task_id, n_nationkey::BIGINT AS cand_idx, n_nationkey % 3 = n_regionkey % 3 AS passed, '    return x + ' || (n_nationkey % 3) AS text FROM nation")
def check_candidates(spark, sf_dir):
    """Candidates of our own: a flush body, made safe and run with its task's test; each task asks for another sum."""
    key = F.col("n_nationkey")
    rows = spark_rows(spark, sf_dir, "SELECT n_nationkey, n_regionkey FROM {nation}").withColumn("task_id", F.concat(F.lit("T/"), F.col("n_regionkey").cast("string")))
    cands = rows.select(F.when(key % 2 == 0, "base").otherwise("sft").alias("model"), "task_id", key.cast("long").alias("cand_idx"), F.concat(F.lit("return x + "), (key % 3).cast("string"), F.lit("\ndef more(): pass\n")).alias("text"))
    tests = F.concat(F.lit("def check(c):\n    assert c(1) == 1 + "), (F.col("n_regionkey") % 3).cast("string"))
    tasks = rows.select("task_id", "n_regionkey").distinct().select("task_id", F.lit("def f(x):\n").alias("prompt"), tests.alias("test"), F.lit("f").alias("entry_point"))
    return evaluate.checked_candidates(cands, tasks).select("model", "task_id", "cand_idx", "passed", "text")


_RULES = " || chr(10) || ".join(f"'{line}'" for line in chat.GENERATION_RULES)
_TURN = "'<|im_start|>{0}' || chr(10) || {1} || '<|im_end|>' || chr(10)"


@query(f"""SELECT item_id, text AS continued, {_TURN.format('system', f"'{chat.GENERATION_SYSTEM}'")} || {_TURN.format('user', f"{_RULES} || chr(10) || text")} || '<|im_start|>assistant' || chr(10) AS asked FROM benchmark""")
def generation_prompts(spark, sf_dir):
    rows = spark_rows(spark, sf_dir, "SELECT item_id, text FROM {benchmark}")
    return rows.select("item_id", chat.generation_text("text", "continuation").alias("continued"), chat.generation_text("text").alias("asked"))
