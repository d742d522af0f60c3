"""Queries over deduplication, caps, rated pairs, evaluation logs, samples and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import caps, dedup
from codeloom.operators.cascade import first_reason, reason_counts
from codeloom.operators.ratings import with_pair
from codeloom.operators.sampling import hash_order_sample
from codeloom.plans import evaluate
from codeloom.queries.inputs import CANDIDATES, LINES, RATED, SCORES, plain, spark_rows, table
from codeloom.sources.sinks import upserted

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Orders as rows with two keys; many share one, some share both.
_KEYED = "SELECT o_orderkey AS idx, o_custkey AS a, CAST(floor(o_totalprice) AS BIGINT) % 4000 AS b FROM {orders}"


def _greedy(rounds: int) -> str:
    """The rule in unrolled rounds: what comes first by both keys stays, what shares a key with it goes."""
    steps = [f"u0 AS MATERIALIZED ({plain(_KEYED)})"]
    for i in range(rounds):
        steps.append(f"k{i} AS MATERIALIZED (SELECT idx, a, b FROM (SELECT *, min(idx) OVER (PARTITION BY a) AS ma, min(idx) OVER (PARTITION BY b) AS mb FROM u{i}) WHERE idx = ma AND idx = mb)")
        steps.append(f"u{i + 1} AS MATERIALIZED (SELECT * FROM u{i} WHERE a NOT IN (SELECT a FROM k{i}) AND b NOT IN (SELECT b FROM k{i}))")
    kept = " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(rounds))
    return f"WITH {', '.join(steps)}, kept AS MATERIALIZED ({kept})"


_GREEDY = _greedy(14)


@query(f"{_GREEDY} SELECT idx FROM kept")
def greedy_dedup_kept(spark, sf_dir):
    return dedup.greedy_two_keys(spark_rows(spark, sf_dir, _KEYED), "a", "b").select("idx")


@query(f"""{_GREEDY} SELECT u0.idx, CASE WHEN x.idx = u0.idx THEN NULL WHEN x.idx < u0.idx AND x.b = u0.b THEN 'pair' WHEN x.idx < u0.idx THEN 'first' ELSE 'second' END AS dup FROM u0 LEFT JOIN kept x ON x.a = u0.a""")
def greedy_dedup_reasons(spark, sf_dir):
    return dedup.greedy_reasons(spark_rows(spark, sf_dir, _KEYED), "a", "b", ("pair", "first", "second"))


_PROMPTS = f"SELECT l_orderkey * 1000 + pos AS idx, l_partkey AS prompt, l_partkey * 10 + l_suppkey % 4 AS pair FROM {LINES}"


@query(f"""WITH r AS ({plain(_PROMPTS)}) SELECT idx, CASE WHEN row_number() OVER w = 1 THEN NULL WHEN first_value(pair) OVER w = pair THEN 'dup_pair' ELSE 'dup_prompt' END AS dup FROM r WINDOW w AS (PARTITION BY prompt ORDER BY idx)""")
def first_per_prompt(spark, sf_dir):
    return dedup.first_per_prompt(spark_rows(spark, sf_dir, _PROMPTS), "prompt", "pair", ("dup_pair", "dup_prompt")).select("idx", "dup")


_TRIPLES = f"SELECT CAST(pos % 2 AS BIGINT) AS phase, l_orderkey * 1000 + pos AS idx, CAST(l_partkey AS STRING) AS prompt, CAST(l_suppkey AS STRING) AS chosen, l_returnflag AS rejected FROM {LINES}"


@query(f"WITH r AS ({plain(_TRIPLES)}) SELECT phase, idx FROM r QUALIFY row_number() OVER (PARTITION BY prompt, chosen, rejected ORDER BY phase, idx) = 1")
def triple_dedup(spark, sf_dir):
    from codeloom.functions.texts import triple_key

    rows = spark_rows(spark, sf_dir, _TRIPLES).withColumn("k", triple_key("prompt", "chosen", "rejected"))
    return dedup.first_by(rows, "k", order=("phase", "idx")).select("phase", "idx")


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS idx, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def last_wins_load(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), "o_custkey", F.col("o_orderstatus").alias("status"))
    return dedup.last_by(rows, "o_custkey").select("o_custkey", "idx", "status")


_REASONS = ("drop_open", "drop_large", "drop_low", "kept")
_JUDGED = "SELECT o_orderkey AS idx, CASE WHEN o_orderstatus = 'O' THEN 'drop_open' WHEN o_totalprice > 300000 THEN 'drop_large' WHEN o_orderpriority LIKE '5%' THEN 'drop_low' ELSE 'kept' END AS reason FROM orders"


def _judged(spark, sf_dir):
    rules = [("drop_open", F.col("o_orderstatus") == "O"), ("drop_large", F.col("o_totalprice") > 300000), ("drop_low", F.startswith("o_orderpriority", F.lit("5"))), ("kept", F.lit(True))]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), first_reason(rules).alias("reason"))


def _zero_filled(rows: str) -> str:
    return f"SELECT v.reason, count(r.reason)::BIGINT AS n FROM (VALUES {', '.join(f'({chr(39)}{r}{chr(39)})' for r in _REASONS)}) v(reason) LEFT JOIN ({rows}) r USING (reason) GROUP BY v.reason"


@query(_zero_filled(_JUDGED))
def cascade_hist(spark, sf_dir):
    return reason_counts(_judged(spark, sf_dir), _REASONS)


@query(_zero_filled(f"SELECT reason FROM ({_JUDGED}) WHERE idx <= (SELECT max(idx) FROM (SELECT idx FROM ({_JUDGED}) WHERE reason = 'kept' ORDER BY idx LIMIT 500))"))
def cap_prefix_stats(spark, sf_dir):
    """What a pass reads that stops at 500 kept rows; the cap is the feature."""
    return reason_counts(caps.cut_before_reading(_judged(spark, sf_dir), F.col("reason") == "kept", 500), _REASONS)


@query(f"""WITH j AS ({_JUDGED}), s AS (SELECT * FROM j WHERE idx % 10 = 0), m AS (SELECT * FROM j WHERE idx % 10 <> 0), n AS (SELECT count(*) FILTER (WHERE reason = 'kept') AS have FROM s),
  c AS (SELECT max(idx) AS last FROM (SELECT idx FROM m WHERE reason = 'kept' ORDER BY idx LIMIT (SELECT greatest(0, have) FROM n))) SELECT (SELECT count(*) FROM s)::BIGINT AS seeds, (SELECT count(*) FROM m, c WHERE idx <= last)::BIGINT AS more FROM c""")
def cap_target_stats(spark, sf_dir):
    """Seeds are a tenth; the target is twice what they give."""
    rows = _judged(spark, sf_dir)
    seeds, more, kept = rows.where("idx % 10 = 0"), rows.where("idx % 10 <> 0"), F.col("reason") == "kept"
    a, b = caps.cut_after_keeping(seeds, more, kept, 2 * seeds.where(kept).count())
    return a.agg(F.count("*").alias("seeds")).crossJoin(b.agg(F.count("*").alias("more")))  # one row each


@query(f"""WITH r AS ({plain(RATED)}), last AS (SELECT idx, model, arg_max(response, pos) AS response FROM r GROUP BY idx, model), n AS (SELECT idx, model, TRY_CAST(rating AS DOUBLE) AS x FROM r WHERE TRY_CAST(rating AS DOUBLE) IS NOT NULL),
  e AS (SELECT idx, count(*) AS n, max(x) AS hi, min(x) AS lo FROM n GROUP BY idx), p AS (SELECT n.idx, hi, lo, min(model) FILTER (WHERE x = hi) AS best, min(model) FILTER (WHERE x = lo) AS worst FROM n JOIN e USING (idx) WHERE e.n >= 2 AND hi > lo GROUP BY n.idx, hi, lo)
  SELECT p.idx, b.response AS chosen, w.response AS rejected, hi, lo FROM p JOIN last b ON b.idx = p.idx AND b.model = best JOIN last w ON w.idx = p.idx AND w.model = worst""")
def pick_pair(spark, sf_dir):
    rows = spark_rows(spark, sf_dir, RATED)
    lists = rows.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("pos", "model", "response", "rating"))).alias("r"))
    cut = lambda *names: F.transform("r", lambda x: F.struct(*[x[n].alias(n) for n in names]))
    pair = with_pair(lists.select("idx", cut("model", "response").alias("responses"), cut("model", "rating").alias("annotations")), "p")
    return pair.where("p is not null").select("idx", "p.chosen", "p.rejected", "p.hi", "p.lo")


_CASES = f"""WITH c AS ({plain(CANDIDATES)}), cases AS (SELECT model, task_id, arg_min(passed, cand_idx) AS p1, bool_or(passed) AS pk FROM c GROUP BY model, task_id)"""


def _cases(spark, sf_dir):
    return evaluate.case_log(spark_rows(spark, sf_dir, CANDIDATES))


@query(f"{_CASES} SELECT model, task_id, p1 AS pass_at_1, pk AS pass_at_k FROM cases")
def case_log(spark, sf_dir):
    return _cases(spark, sf_dir).select("model", "task_id", "pass_at_1", "pass_at_k")


@query(f"{_CASES} SELECT model, count(*)::BIGINT AS tasks, avg(p1::INT) AS pass_at_1, avg(pk::INT) AS pass_at_k FROM cases GROUP BY model")
def pass_at_k(spark, sf_dir):
    return evaluate.pass_rates(_cases(spark, sf_dir))


@query(f"WITH s AS ({plain(SCORES)}) SELECT model, count(*)::BIGINT AS pairs, avg(CASE WHEN chosen_lp > rejected_lp THEN 1 ELSE 0 END) AS preference_win_rate FROM s GROUP BY model")
def preference_win_rate(spark, sf_dir):
    return evaluate.win_rates(evaluate.preference_log(spark_rows(spark, sf_dir, SCORES)))


@query(f"""{_CASES}, w AS (SELECT CASE event_id % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'sft' WHEN 2 THEN 'dpo' ELSE 'other' END AS model, avg(CASE WHEN value > user_id % 100 THEN 1 ELSE 0 END) AS r, count(*)::BIGINT AS pairs FROM events GROUP BY 1),
  p AS (SELECT model, count(*)::BIGINT AS tasks, avg(p1::INT) AS a, avg(pk::INT) AS b FROM cases GROUP BY model)
  SELECT coalesce(p.model, w.model) AS model, coalesce(a, 0) AS pass_at_1, coalesce(b, 0) AS pass_at_k, coalesce(a, 0) AS unit_test_pass_rate, coalesce(r, 0) AS preference_win_rate, coalesce(tasks, 0) AS tasks, coalesce(pairs, 0) AS pairs FROM p FULL JOIN w ON p.model = w.model""")
def leaderboard(spark, sf_dir):
    rows = spark_rows(spark, sf_dir, SCORES)
    k = F.col("idx") % 4
    rows = rows.withColumn("model", F.when(k == 0, "base").when(k == 1, "sft").when(k == 2, "dpo").otherwise("other"))
    return evaluate.leaderboard(_cases(spark, sf_dir), evaluate.preference_log(rows))


@query(f"""{_CASES}, n AS (SELECT model, task_id, passed, row_number() OVER (PARTITION BY model, task_id ORDER BY cand_idx) AS k FROM c), b AS (SELECT model, task_id, max(passed::INT) FILTER (WHERE k = 1) AS p1, max(passed::INT) AS p2 FROM n WHERE k <= 2 GROUP BY model, task_id)
  SELECT count(*)::BIGINT AS count, avg(p1) AS pass1, avg(p2) AS pass2 FROM b""")
def recheck_pass(spark, sf_dir):
    """Saved first two candidates; their results stand for a new run."""
    cases = _cases(spark, sf_dir)
    rerun = cases.select("model", "task_id", F.posexplode(F.slice("candidate_results", 1, 2)).alias("cand_idx", "passed"))
    return evaluate.recheck(cases, rerun)


@query(f"""{_CASES}, s AS (SELECT model, task_id, arg_min(text, cand_idx) AS t FROM c GROUP BY model, task_id), x AS (SELECT cases.*, t FROM cases JOIN s USING (model, task_id))
  SELECT b.task_id, CASE WHEN s.p1 THEN 'SFT' ELSE 'DPO' END AS winner, b.p1 AS base, s.p1 AS sft, d.p1 AS dpo, b.t AS base_sample, s.t AS sft_sample, coalesce(d.t, '') AS dpo_sample FROM (SELECT * FROM x WHERE model = 'base') b JOIN (SELECT * FROM x WHERE model = 'sft') s USING (task_id) LEFT JOIN (SELECT * FROM x WHERE model = 'dpo') d USING (task_id)
  WHERE NOT b.p1 AND (s.p1 OR coalesce(d.p1, false)) ORDER BY b.task_id LIMIT 12""")
def improved_cases(spark, sf_dir):
    """Twelve cases at most: the limit is the report's."""
    cases = _cases(spark, sf_dir).withColumn("idx", F.lit(0).cast("long"))
    return evaluate.improved_cases(*[cases.where(F.col("model") == m) for m in ("base", "sft", "dpo")])


@query(f"""{_CASES}, n AS (SELECT *, row_number() OVER (PARTITION BY model, task_id ORDER BY cand_idx) AS k FROM c WHERE model = 'sft') SELECT task_id, (k - 1)::INT AS pos, CASE WHEN k <= 2 THEN text END AS candidate, passed FROM n""")
def output_rows(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    tasks = cases.select("task_id").distinct()
    return evaluate.output_rows(evaluate.all_outputs(tasks, sft=cases.where("model = 'sft'")), "sft")


@query("SELECT item_id, text AS prompt FROM benchmark WHERE item_id = 7")
def task_lookup(spark, sf_dir):
    """A point lookup; the filter is the feature."""
    return table(spark, sf_dir, "benchmark").where("item_id = 7").select("item_id", F.col("text").alias("prompt"))


@query("SELECT count(*)::BIGINT AS missing FROM (SELECT DISTINCT l_orderkey % 997 AS t FROM lineitem) WHERE t NOT IN (SELECT item_id FROM benchmark)")
def missing_tasks(spark, sf_dir):
    cases = spark_rows(spark, sf_dir, "SELECT DISTINCT l_orderkey % 997 AS task_id FROM {lineitem}")
    return evaluate.missing_tasks(cases, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"))).agg(F.count("*").alias("missing"))


@query("SELECT min(t) AS task_id, count(DISTINCT t) = 1 AS consistent FROM (SELECT arg_min(doc_id % 3, doc_id) AS t FROM documents UNION ALL SELECT arg_min(doc_id % 3, doc_id) FROM labels UNION ALL SELECT arg_min(item_id % 3, item_id) FROM benchmark)")
def first_rows_agree(spark, sf_dir):
    log = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("idx"), (F.col(c) % 3).alias("task_id"))
    return evaluate.consistent_first_rows(log("documents", "doc_id"), log("labels", "doc_id"), log("benchmark", "item_id"))


@query("SELECT l_orderkey, round(avg(l_quantity), 6) AS mean_lp FROM lineitem GROUP BY l_orderkey")
def mean_token_score(spark, sf_dir):
    out = evaluate.mean_token_score(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity")
    return out.withColumn("mean_lp", F.round("mean_lp", 6))


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    """A sample of a hundred; sampling is the feature."""
    return hash_order_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, 42, "doc_id")


@query("SELECT n_name AS name, 'new.json' AS file_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name, 'old.json' FROM nation WHERE n_regionkey IN (0, 2, 3, 4) UNION ALL SELECT r_name, 'new.json' FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)")
def registry_upsert(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    old = nation.select(F.col("n_name").alias("name"), F.lit("old.json").alias("file_name"))
    new = nation.where("n_regionkey = 1").select("n_name").unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("n_name")))
    return upserted(old, new.select(F.col("n_name").alias("name"), F.lit("new.json").alias("file_name")))


@query("SELECT event_id, list_sort(json_keys(props)) AS k, len(json_keys(props))::BIGINT AS n FROM events")
def record_fields(spark, sf_dir):
    keys = F.array_sort(F.json_object_keys("props"))
    return table(spark, sf_dir, "events").select("event_id", keys.alias("k"), F.size(keys).cast("long").alias("n"))
