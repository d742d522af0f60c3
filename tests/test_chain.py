"""The whole chain of stages, its reports, and every source and sink."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.functions import storage
from codeloom.functions.names import unused
from codeloom.operators import dedup
from codeloom.operators.sampling import shuffled_sample
from codeloom.plans import chain, evaluate
from codeloom.sources import readers, sinks
from codeloom.streaming import stages


def test_chain_of_stages(spark, tmp_path):
    body = lambda i: f"def f{i}(a):\n    return a + {i}"
    raw = spark.createDataFrame([(i, f"python task {i}", body(i) if i % 5 else "x = 1", "") for i in range(40)], readers.RAW_SFT.replace("instruction", "idx long, instruction", 1))
    answers = lambda i: [("m", body(i)), ("n", f"def f{i}(values):\n    total = [values] * 3\n    return sum(total)")]
    rated = spark.createDataFrame([(i, f"python pair {i}", answers(i), [("m", "5"), ("n", "2")]) for i in range(6)], "idx long, " + readers.RAW_RATED)
    tasks = spark.createDataFrame([("t/1", "def f(x):\n", "def check(c):\n    assert c(1) == 2", "f")], "task_id string, prompt string, test string, entry_point string")
    cands = spark.createDataFrame([("base", "t/1", 0, "return x"), ("sft", "t/1", 0, "return x + 1")], "model string, task_id string, cand_idx long, text string")
    scores = spark.createDataFrame([("sft", 0, 2.0, 1.0, "p")], "model string, idx long, chosen_lp double, rejected_lp double, prompt string")
    at = str(tmp_path / "chain")
    go = lambda: chain.run_chain(spark, at, raw, rated, tasks, candidates=cands, scores=scores, target=20, min_pairs=10)
    got = go()
    assert got["clean"]["sft"]["total"] == 40 and got["clean"]["sft"]["kept"] == 32 and got["convert"]["sft"]["kept"] == 32
    assert got["clean"]["dpo"]["kept"] == 6 == got["convert"]["dpo"]["kept"] and got["validate"]["passed"] and got["validate"]["sft_concat_parse_ok"] == 1.0
    assert got["audit"]["decision"]["reason"].startswith("fail") and got["audit"]["dpo"]["usable_pairs"] == 6
    assert got["build"]["final_pairs"] == 20 and got["build"]["gate_ready"] and got["audit_built"]["decision"]["allow_enter_dpo_training"]
    assert got["build"]["tags"] == {"return_add_minus": 14} and got["leaderboard"]["sft"]["pass_at_1"] == 1.0 and got["leaderboard"]["base"]["pass_at_k"] == 0.0
    report = (tmp_path / "chain" / "reports" / "audit.md").read_text().splitlines()
    assert report[:4] == ["# Step1 Data Audit Report", "", "## SFT", "- total: `32`"] and "- gate_shortfall_pairs: `4`" in report and "- allow_enter_dpo_training: `False`" in report
    again = go()
    assert again["ran"]["stages"] == [] and {k: v for k, v in again.items() if k != "ran"} == {k: v for k, v in got.items() if k != "ran"}
    # a stage that did not end is run again, with nothing before it
    (tmp_path / "chain" / "build_all" / "_SUCCESS").unlink()
    assert go()["ran"]["stages"] == ["build_all"]


def test_outputs_report(spark):
    tasks = spark.createDataFrame([(1, "t/1", "f", "def f():"), (2, None, "g", "def g():\n")], "pos int, task_id string, entry_point string, prompt string")
    log = lambda name, rows: spark.createDataFrame([(t, [x for x, _ in c], [ok for _, ok in c]) for t, c in rows], "task_id string, candidate_samples array<string>, candidate_results array<boolean>")
    outputs = evaluate.all_outputs(tasks, base=log("base", [("t/1", [("    return 1\n", True), ("x", False)])]), sft=log("sft", []))
    text = sinks.outputs_markdown(outputs, ("base", "sft"))
    first = "## 1. t/1 / entry: `f`\n\n### Prompt\n\n```python\ndef f():\n```\n\n### BASE\n\n- cand1 pass=True\n\n```python\n    return 1\n```\n\n- cand2 pass=False\n\n```python\nx\n```\n\n### SFT\n\n---\n\n"
    assert text == "# Strict Eval Full Outputs (Question + Code)\n\n" + first + "## 2.  / entry: `g`\n\n### Prompt\n\n```python\ndef g():\n```\n\n### BASE\n\n### SFT\n\n---\n\n"


def test_malformed_files_fail(spark, tmp_path):
    for name, text in (("list", '[{"task_id":"a"'), ("map", '{"b":{"prompt":"q"}')):
        (tmp_path / f"{name}.json").write_text(text)
        for read in (readers.task_file, readers.registry):
            with pytest.raises(Exception):
                read(spark, str(tmp_path / f"{name}.json")).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps([{"task_id": "t/1", "prompt": "é"}, {"task_id": "t/0"}]))
    rows = readers.json_document(spark, str(tmp_path / "doc.json"), readers.TASK)
    assert [(r["task_id"], r["prompt"]) for r in rows.collect()] == [("t/1", "é"), ("t/0", None)]
    assert readers.first_record(readers.numbered(rows)).first()["task_id"] == "t/1"
    rows.write.parquet(str(tmp_path / "hub"))
    assert readers.hub_copy(spark, str(tmp_path / "hub")).count() == 2
    full = spark.createDataFrame([(f"t/{i}",) for i in range(9)], "task_id string")
    assert [r["task_id"] for r in readers.subset_or_sample(spark, str(tmp_path / "doc.json"), full, 1).collect()] == ["t/1"]
    some = [r["task_id"] for r in readers.subset_or_sample(spark, str(tmp_path / "none.json"), full, 4).collect()]
    assert len(set(some)) == 4 and some == [r["task_id"] for r in readers.subset_or_sample(spark, str(tmp_path / "none.json"), full.repartition(3), 4).collect()]


def test_sinks(spark, tmp_path, capsys):
    one = spark.createDataFrame([(3, 0.5, None)], "total long, rate double, note string")
    assert json.loads(sinks.report_json(one)) == {"total": 3, "rate": 0.5, "note": None} and sinks.report_json(one).startswith('{\n  "total"')
    counts = spark.createDataFrame([("drop_empty", 2), ("kept", 5)], "reason string, n long")
    assert json.loads(sinks.counts_json(counts)) == {"total": 7, "drop_empty": 2, "kept": 5}
    sinks.show({"a": "é"})
    assert capsys.readouterr().out == '{"a": "é"}\n'
    board = spark.createDataFrame([("sft", 0.5), ("base", 0.25)], "model string, pass_at_1 double")
    sinks.write_leaderboard(board, str(tmp_path / "board"))
    assert next((tmp_path / "board").glob("part-*")).read_text() == "model,pass_at_1\nbase,0.25\nsft,0.5\n"
    for model in ("base", "sft"):
        sinks.snapshot(board.where(F.col("model") == model), str(tmp_path / "snap"))
    assert [r["model"] for r in spark.read.parquet(str(tmp_path / "snap")).collect()] == ["sft"]
    case = lambda m, t: spark.createDataFrame([(m, t)], "model string, task_id string")
    at = str(tmp_path / "cases")
    sinks.append_cases(case("base", "old"), at)
    sinks.append_cases(case("sft", "kept"), at)
    sinks.append_cases(case("base", "t/1"), at, restart=True)
    sinks.append_cases(case("base", "t/2"), at)
    assert sorted((r["model"], r["task_id"]) for r in spark.read.json(at).collect()) == [("base", "t/1"), ("base", "t/2"), ("sft", "kept")]
    rows = spark.range(50).select(F.col("id").alias("idx"))
    assert [r["idx"] for r in sinks.preview(rows).collect()] == list(range(20))


def test_exact_shuffle(spark):
    import random

    order = list(range(30))
    random.Random(42).shuffle(order)
    got = shuffled_sample(spark.range(30).select(F.col("id").alias("idx")).repartition(3), 7, random.Random(42))
    assert [r["idx"] for r in got.collect()] == order[:7]


def test_distinct_pairs_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"prompt": "p", "chosen": c, "rejected": "r", "at": "2024-01-01T00:00:00"}) + "\n" for c in ("a", "a", f"b{i}")))
    rows = stages.json_stream(spark, str(tmp_path / "in"), "prompt string, chosen string, rejected string, at timestamp")
    stages.run_available(stages.distinct_pairs(rows, arrival="at", delay="1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["chosen"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b0", "b1"]


def test_helper_columns_clash_with_nothing(spark):
    assert unused(["a", "_A"], "a", "b", "_a") == ["__a", "b", "___a"]
    df = spark.createDataFrame([(0, "k", "x", 7), (1, "k", "x", 8), (2, "k", "y", 9), (3, None, "x", 1), (4, None, "x", 2)], "idx long, key string, pair string, _place int")
    df = df.withColumn("_key", F.lit("mine")).withColumn("_first", F.lit(1)).withColumn("_pair", F.lit(2))
    assert sorted((r["idx"], r["_place"]) for r in dedup.first_by(df, "key").collect()) == [(0, 7), (3, 1)]
    got = dedup.first_per_prompt(df, "key", "pair", ("pair", "prompt")).orderBy("idx").collect()
    assert [r["dup"] for r in got] == [None, "pair", "prompt", None, "pair"] and got[0]["_key"] == "mine" and set(got[0].asDict()) == {*df.columns, "dup"}


def test_stored_tables(spark, tmp_path):
    first = storage.stored(spark.range(3).toDF("x"), "one")
    second = storage.stored(first.selectExpr("x + 1 AS x"), "two", first)
    assert sorted(r["x"] for r in second.collect()) == [1, 2, 3] and not readers.exists(spark, first._stored_at)

    class Cluster:  # a session without the setting, away from local mode
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        storage.shared_dir(Cluster)
