"""Deduplication, caps, ratings, plans and evaluation against sequential models."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import code as C
from codeloom.operators import caps, dedup
from codeloom.operators.ratings import with_pair
from codeloom.plans import audit, clean, convert, evaluate, pairs
from codeloom.sources import readers, sinks
from codeloom.streaming import stages


def greedy(rows):
    seen_a, seen_b, seen, kept, why = set(), set(), set(), [], {}
    for i, a, b in rows:
        r = "pair" if (a, b) in seen else "a" if a in seen_a else "b" if b in seen_b else None
        why[i] = r
        if r is None:
            kept.append(i)
            seen_a.add(a), seen_b.add(b), seen.add((a, b))
    return kept, why


@pytest.mark.parametrize("seed", range(4))
def test_greedy_dedup_is_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"a{rng.randint(0, 25)}", f"b{rng.randint(0, 25)}") for i in range(120)]
    df = spark.createDataFrame(rows, "idx long, a string, b string").repartition(3)
    got = {r["idx"]: r["dup"] for r in dedup.greedy_reasons(df, "a", "b", ("pair", "a", "b")).collect()}
    assert got == greedy(rows)[1]


def test_greedy_dedup_example(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, "B", "x"), (3, "B", "y")], "idx long, a string, b string")
    assert sorted(r["idx"] for r in dedup.greedy_two_keys(df, "a", "b").collect()) == [1, 3]


def test_greedy_dedup_of_nothing(spark):
    df = spark.createDataFrame([], "idx long, a string, b string")
    assert dedup.greedy_two_keys(df, "a", "b").collect() == []


@pytest.mark.parametrize("n,total", [(0, 0), (1, 2), (2, 4), (3, 6), (4, 6)])
def test_cap_before_reading(spark, n, total):
    df = spark.createDataFrame([(i, i % 2 == 1) for i in range(6)], "idx long, k boolean")
    assert caps.cut_before_reading(df, F.col("k"), n).count() == total


@pytest.mark.parametrize("n,want", [(0, (2, 0)), (1, (2, 0)), (2, (4, 0)), (3, (4, 2)), (9, (4, 6))])
def test_cap_after_keeping(spark, n, want):
    df = spark.createDataFrame([(i, i % 2 == 1) for i in range(6)], "idx long, k boolean")
    a, b = caps.cut_after_keeping(df.where("idx < 4"), df, F.col("k"), n)
    assert (a.count(), b.count()) == want


def rated(spark, responses, annotations):
    schema = "responses array<struct<model:string,response:string>>, annotations array<struct<model:string,rating:string>>"
    return with_pair(spark.createDataFrame([(responses, annotations)], schema), "p").first()["p"]


@pytest.mark.parametrize("notes,want", [
    ([("b", "5"), ("a", "5"), ("c", "1"), ("d", "1")], ("ra", "rc")),
    ([("a", "5"), ("x", "1")], None),
    ([("a", "5"), ("b", "N/A"), ("c", "nan")], None),
    ([("a", "2"), ("b", "2")], None),
    ([("a", "2"), ("a", "1")], ("ra", "ra")),
    (None, None),
])
def test_picked_pair(spark, notes, want):
    got = rated(spark, [("a", "old"), ("b", "rb"), ("c", "rc"), ("d", "rd"), ("a", "ra"), ("", "z"), ("e", None)], notes)
    assert (got and (got["chosen"], got["rejected"])) == want


def test_function_parsing():
    assert C.function_text("@d\nasync def f():\n  return 1\n") == "async def f():\n  return 1"
    assert C.function_text("class A:\n  def f(self): pass") is None and C.function_text("x = (") is None and C.function_text("\0") is None
    assert C.split_function('def f(a):\n    ""\n    return a') == ("f", "def f(a):\n", '    ""\n    return a\n')
    assert C.split_function("def f():\n    # note\n    x = 1\n    return x\n")[2] == "    x = 1\n    return x\n"
    assert C.split_function('def f():\n    """d"""\n') is None
    assert C.parses("def f(:") is False and C.parses(None) is None
    assert C.function_text("x = 1\n\x0cdef f():\n  return 1\n") is None  # form feeds shift lines


def test_scripts_run_apart():
    assert C.passes("assert 1 == 1") and not C.passes("assert 0") and not C.passes("while True: pass", 1.0) and C.passes(None) is None
    assert not C.passes("x = bytearray(4 << 30)")


def test_cleaning_reasons_cover_every_row(spark):
    rows = [
        (0, "", "def f(): pass", ""), (1, "x" * 1201, "def f(): pass", ""), (2, "a", "def f(): pass\ufffd", ""), (3, "hello", "world", ""), (4, "python", "x = 1", ""), (5, "python one", "def f():\n  return 1", None), (6, "python  one", "def f():\n  return 1", ""),
        (7, "python one", "def g():\n  return 2", ""), (8, "python two", "def f():\n  return  1", ""), (9, "python three", "```python\ndef h(): return 3\n```", ""), (10, None, None, None),
    ]
    done = clean.clean_instructions(spark.createDataFrame(rows, "idx long, instruction string, output string, tag string"))
    got = [r["reason"].removeprefix("drop_") for r in done.orderBy("idx").collect()]
    assert got == ["empty", "too_long", "garbled", "not_python", "no_function", "kept", "dup_pair", "dup_instruction", "dup_output", "kept", "empty"]
    counts = {r["reason"]: r["n"] for r in clean.sft_counts(done).collect()}
    assert sum(counts.values()) == len(rows) and set(counts) == set(clean.SFT_REASONS)


def test_pair_cleaning(spark):
    long_a = "def f(x):\n    return " + " + ".join(f"x{i}" for i in range(60))
    r = lambda *rs: [(m, t) for m, t in zip("abc", rs, strict=False)]
    f, g = "def f(x):\n    return x * 2", "def f(value):\n    total = [value]\n    return sum(total)"
    n = [("a", "5"), ("b", "1")]
    rows = [(0, "", r(f, g), n), (1, "python", r(f, g), [("a", "5")]), (2, "python", r(f, g), [("a", "1.5"), ("b", "1")]), (3, "python 3", r(f, f + "  # x"), n), (4, "python 4", r(long_a, long_a + "1"), n), (5, "python 5", r(f, g), n), (6, "python  5", r(f, g), n), (7, "python 5", r(g, f), n), (8, "python 8", r(f, "x"), n), (9, "python", r(f, g), [("a", "2"), ("b", "1")])]
    schema = "idx long, instruction string, responses array<struct<model:string,response:string>>, annotations array<struct<model:string,rating:string>>"
    got = [x["reason"].removeprefix("drop_") for x in clean.clean_pairs(spark.createDataFrame(rows, schema)).orderBy("idx").collect()]
    assert got == ["empty", "no_pair", "small_gap", "low_info", "low_info", "kept", "dup_pair", "dup_prompt", "no_function", "kept"]


def test_conversion(spark):
    df = spark.createDataFrame([(0, "Do", "x", "def f(a):\n  return a"), (1, "", None, "def f(a): return a"), (2, "a", "", ""), (3, "a", "", "class A: pass")], "idx long, instruction string, input string, output string")
    rows = convert.converted_instructions(df).orderBy("idx").collect()
    assert [r["reason"] for r in rows] == ["kept", "drop_top_level_def_completion", "drop_empty", "drop_no_function"]
    assert (rows[0]["instruction"], rows[0]["output"]) == ("# Do\n# Input:\n# x\ndef f(a):\n", "  return a\n")


def test_pairs_stop_at_the_target(spark):
    seeds = spark.createDataFrame([(0, "def f():\n", "    return 1", "    return 2"), (1, "def f():\n", "    return 1", "    return 2"), (2, "p", " ", "x")], "idx long, prompt string, chosen string, rejected string")
    sft = spark.createDataFrame([(i, f"def f{i}(a):\n", "", "    return a") for i in range(5)], "idx long, instruction string, input string, output string")
    built = pairs.built_pairs(seeds, sft, target=3)
    report = pairs.build_report(built, target=3).first()
    assert (report["seed_pairs"], report["sft_rows"], report["built_from_sft"], report["final_pairs"], report["gate_ready"]) == (1, 2, 2, 3, True)
    assert pairs.build_report(pairs.built_pairs(seeds, sft, target=1), target=1).first()["sft_rows"] == 0
    v3 = pairs.pair_records(pairs.built_pairs(seeds, sft, target=9, logic=False)).where("phase = 1").first()
    assert v3["rejected"] == "    return (a) + 1" and v3["source"] == "sft_mutation"


def test_gate_threshold(spark):
    one = spark.createDataFrame([(675,)], "usable_pairs long")
    got = audit.quantity_gate(one, 49108).first()
    assert (got["threshold"], got["shortfall"], got["passed"]) == (9821, 9146, False)
    assert audit.quantity_gate(one, 100).first()["threshold"] == 3000
    assert audit.rounded({"a": 1 / 32, "b": 3 / 20000, "n": 3}) == {"a": 0.0312, "b": 0.0001, "n": 3}


def test_evaluation(spark):
    tasks = spark.createDataFrame([("t/10", "def f(x):\n", "def check(c):\n    assert c(1) == 2", "f"), ("t/2", "def g(x):\n", "def check(c):\n    assert c(1) == 1", "g")], "task_id string, prompt string, test string, entry_point string")
    cands = spark.createDataFrame([("base", "t/10", 0, "return 5"), ("base", "t/10", 1, "    return x + 1"), ("sft", "t/10", 0, "return x + 1"), ("base", "t/2", 0, "return 0"), ("sft", "t/2", 0, "return 9")], "model string, task_id string, cand_idx long, text string")
    cases = evaluate.case_log(evaluate.checked_candidates(cands, tasks))
    got = {(r["model"], r["task_id"]): (r["pass_at_1"], r["pass_at_k"]) for r in cases.collect()}
    assert got == {("base", "t/10"): (False, True), ("sft", "t/10"): (True, True), ("base", "t/2"): (False, False), ("sft", "t/2"): (False, False)}
    log = evaluate.preference_log(spark.createDataFrame([("base", 0, 1.0, 1.0, "p"), ("base", 1, 2.0, 1.0, None)], "model string, idx long, chosen_lp double, rejected_lp double, prompt string"))
    board = {r["model"]: r for r in evaluate.leaderboard(cases, log).collect()}
    assert board["base"]["preference_win_rate"] == 0.5 and board["sft"]["pairs"] == 0 and board["base"]["pass_at_k"] == 0.5
    rows = cases.withColumn("idx", F.lit(0).cast("long"))
    better = evaluate.improved_cases(rows.where("model = 'base'"), rows.where("model = 'sft'"), None)
    assert [(r["task_id"], r["winner"]) for r in better.collect()] == [("t/10", "SFT")] and "N/A" in sinks.case_report(better)


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instruction":"é","output":"x"}\n\n{"instruction":null}\n', encoding="utf-8")
    rows = readers.json_lines(spark, str(tmp_path / "a.jsonl"), readers.SFT)
    assert [(r["idx"], r["instruction"], r["output"]) for r in rows.orderBy("idx").collect()] == [(0, "é", "x"), (1, None, None)]
    sinks.write_json_lines(rows, str(tmp_path / "out"), single=True)
    lines = [p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*")][0].splitlines()
    assert "é" in lines[0] and json.loads(lines[1]) == {"instruction": None, "input": None, "output": None}
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), readers.SFT, idx=False).collect()
    (tmp_path / "list.json").write_text('[{"task_id":"a","prompt":"p"}]')
    (tmp_path / "map.json").write_text('{"b":{"prompt":"q"}}')
    assert [(r["task_id"], r["prompt"]) for f in ("list", "map") for r in readers.task_file(spark, str(tmp_path / f"{f}.json")).collect()] == [("a", "p"), ("b", "q")]
    (tmp_path / "reg.json").write_text('{"x":{"file_name":"f.json","ranking":true,"columns":{"prompt":"p"}}}')
    reg = readers.registry(spark, str(tmp_path / "reg.json"))
    new = spark.createDataFrame([("y", "g.json", False, {"prompt": "q"})], reg.schema)
    assert json.loads(sinks.registry_json(sinks.upserted(reg, new))) == {"x": {"file_name": "f.json", "ranking": True, "columns": {"prompt": "p"}}, "y": {"file_name": "g.json", "columns": {"prompt": "q"}}}
    sinks.write_text(spark, str(tmp_path / "r.txt"), sinks.markdown_table(new, ["name", "file_name"], "name"))
    assert (tmp_path / "r.txt").read_text().splitlines()[-1] == "| y | g.json |"
    (tmp_path / "log.txt").write_text("step 1\nx\nstep 2\n")
    assert readers.last_match(spark, str(tmp_path / "log.txt"), r"^step").first()["value"] == "step 2"


def test_rows_are_numbered_by_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = []
    for name, n in (("a", 1), ("b", 400), ("c", 30)):
        (tmp_path / "in" / f"{name}.jsonl").write_text("".join(json.dumps({"instruction": f"{name}{i}"}) + "\n" for i in range(n)))
        want += [f"{name}{i}" for i in range(n)]
    rows = readers.json_lines(spark, str(tmp_path / "in"), readers.SFT).orderBy("idx").collect()
    assert [r["instruction"] for r in rows] == want and [r["idx"] for r in rows] == list(range(len(want)))


def test_streams_agree_with_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"instruction": "i", "output": f"    return {i}\nimport x" if i else "x"}) + "\n" for _ in range(2)))
    stream = stages.audited(stages.json_stream(spark, str(tmp_path / "in"), readers.SFT))
    for _ in range(2):  # a second run finds nothing new
        stages.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    want = stages.audited(spark.read.schema(readers.SFT).json(str(tmp_path / "in")))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    seen = []
    stages.when_arrived(spark, str(tmp_path / "in"), "*.json", str(tmp_path / "ck2"), seen.extend)
    stages.when_arrived(spark, str(tmp_path / "in"), "*.json", str(tmp_path / "ck2"), seen.extend)
    assert len(seen) == 3
