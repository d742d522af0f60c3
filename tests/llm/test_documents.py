"""Quality, personal data, counts, similarity join, neighbours, chat and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import chat, jaccard, neighbours, pii, quality, token_counts
from codeloom.llm.common import tokenizer_path
from codeloom.llm.components import components


# --- quality


def good(rng):
    return ". ".join(" ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(4, 12))).capitalize() for _ in range(rng.randint(2, 12))) + "."


def junk(rng):
    return rng.choice([lambda t: t.replace(" ", "*** "), lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join([t.split()[0]] * 80), lambda t: t.replace(" ", " | ")])(good(rng))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows = [(i, junk(rng) if i % 4 == 0 else good(rng)) for i in range(900)] + [(900, None), (901, ""), (None, "no id"), (902, "x " * 60_000)]
    docs = spark.createDataFrame([(*r, "en", "s", "extra") for r in rows], "doc_id long, text string, lang string, source string, x string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(900)] + [(None, 1, 0), (901, None, 0), (5000, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 900]
    assert len(held) > 120 and np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.97


def test_held_out_labels_do_not_matter(labelled):
    docs, labels = labelled
    wrong = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: round(r["score"], 9) for r in quality.quality_scores(docs, x).collect()} for x in (labels, wrong))
    assert a == b


def test_without_both_classes(labelled):
    docs, labels = labelled
    assert {r["score"] for r in quality.quality_scores(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).collect() == []


def test_normal_equations_add_up():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((60, len(quality.STATISTICS))), rng.integers(0, 2, 60).astype(float)
    m = quality.Model(x.mean(0), x.std(0), features=32)
    assert np.allclose(m.normal_sums(x, y), m.normal_sums(x[:25], y[:25]) + m.normal_sums(x[25:], y[25:]))


def test_random_features_approach_the_kernel():
    rng = np.random.default_rng(1)
    d = 5
    m = quality.Model(np.zeros(d), np.ones(d), features=20_000)
    x = rng.standard_normal((6, d))
    z = m.mapped(x)[:, :20_000]
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-far / d)).max() < 0.04


def test_isotonic_is_monotone():
    rng = np.random.default_rng(2)
    m = quality.Model(np.zeros(1), np.ones(1))
    raw = rng.standard_normal(500)
    m.calibrate(raw, (raw + rng.standard_normal(500) > 0).astype(float))
    assert (np.diff(m.values) > 0).all() and (np.diff(m.knots) > 0).all()


# --- personal data

_EMAIL, _IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(t):
    out = [(0, *m.span()) for m in _EMAIL.finditer(t)] + [(1, *m.span()) for m in _IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern, lo, hi in ((2, r"[0-9]([\x20-]?[0-9])+", 13, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            if lo <= len(d) <= hi and (kind == 3 or pii.luhn(d)):
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("aB1234567890.@-+ ()%_\né") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), repr(t)


def test_field_finds_what_the_patterns_miss():
    field = pii.fitted()
    right = found = there = 0
    for t, spans in pii.examples(99, 300):
        got = set(field.added_spans(t, pii.base_spans(t)))
        right, found, there = right + len(got & set(spans)), found + len(got), there + len(spans)
    assert right / found > 0.95 and right / there > 0.95


def test_decoding_is_the_best_segmentation():
    field = pii.fitted()
    for t, _ in pii.examples(5, 60):
        taken = sorted((s, e) for _, s, e in pii.base_spans(t))
        of = {(a, b): field.scores(pii.segment_features(t, a, b)).max() - pii.NONE for a, b in pii.candidate_segments(t, taken)}
        arcs = [(a, b, x) for (a, b), x in of.items()]
        if len(arcs) > 14:
            continue
        best = 0.0
        for mask in range(1 << len(arcs)):
            pick = sorted(x for k, x in enumerate(arcs) if mask >> k & 1)
            if all(a[1] <= b[0] for a, b in zip(pick, pick[1:], strict=False)):
                best = max(best, sum(x[2] for x in pick))
        got = field.decode(t, taken)
        assert abs(sum(of[s, e] for _, s, e in got) - best) < 1e-9 and all(a[2] <= b[1] for a, b in zip(got, got[1:], strict=False))


def test_spelled_addresses_are_found_whole():
    field = pii.fitted()
    letters = ".".join("abcdefghijklmnop")
    dots = " dot ".join("abcdefghijklmnop")
    for t in ("john at example.com", "john AT example (dot) com", "john at example [dot] com", "jane at mail.corp dot org", f"{letters} at example dot com", f"{'long-part.' * 8}x at example dot com", f"{dots} at example dot com", "x at " + "lab dot " * 20 + "com", "j.d [at] some-where[dot]xyz", "a_b+c @ d"):
        text = f"please write to: {t} soon"
        want = [] if t == "a_b+c @ d" else [(0, 17, 17 + len(t))]
        assert pii.all_spans(text, field)[1] == want, t


def test_candidates_do_not_depend_on_what_is_far_away():
    """A text between others, each on its own line, has the spans it has alone."""
    field, rng = pii.fitted(), random.Random(6)
    bits = [" at ", " AT ", "  at ", "(at)", " [at] ", " dot ", "(dot)", " [.] ", ".", ".", "-", " ", " ", " ", "AT", "DOT", "(", " email ", ", ", "@", " 555 ", "12", "(234) ", "com", " dot com"]
    found = 0
    for _ in range(400):
        lines = ["".join(rng.choice(bits) if rng.random() < 0.6 else "".join(rng.choice("abco") for _ in range(rng.choice([1, 4, 12]))) for _ in range(rng.randint(3, 60))) for _ in range(4)]
        whole, at, apart = pii.all_spans("\n".join(lines), field)[1], 0, []
        for x in lines:
            apart += [(k, s + at, e + at) for k, s, e in pii.all_spans(x, field)[1]]
            at += len(x) + 1
        assert whole == sorted(apart), lines
        found += len(whole)
    assert found > 100


def test_planted_corpus():
    """Texts with many spans that no base pattern has: precision and recall of the added ones."""
    field, rng, right, found, there = pii.fitted(), random.Random(31), 0, 0, 0
    for t, spans in pii.examples(1234, 600):
        before = " ".join(good(rng) for _ in range(2)) + "\n"
        got = set(field.added_spans(before + t, pii.base_spans(before + t)))
        want = {(k, s + len(before), e + len(before)) for k, s, e in spans}
        right, found, there = right + len(got & want), found + len(got), there + len(want)
    assert there > 400 and right / found > 0.95 and right / there > 0.95, (right, found, there)


def test_clean_texts_are_left_alone():
    field = pii.fitted()
    for t in ("He came at noon and left at ten dot.", "v1.2.3 on 2024-01-15 at 10:30:00, 1,000,000 items, $12.50", "no digits", "a@b", "978-3-1612-3456-7"):
        assert pii.all_spans(t, field)[1] == [], t


@pytest.mark.parametrize("text", ["1" * 40_000 + "@", "a" * 40_000 + "@", "a@" * 20_000, "1." * 20_000, "@" * 40_000, "+1" * 20_000])
def test_long_runs_take_linear_time(text):
    import time

    began = time.time()
    pii.all_spans(text, pii.fitted())
    assert time.time() - began < 30


def test_personal_data_rows(spark):
    rows = [(1, "mail a.b@c.de or 1.2.3.4", "k"), (1, "mail a.b@c.de or 1.2.3.4", "k"), (None, "+1 (234) 555-1234 é🙂 x@y.zz", "k"), (2, None, "k"), (3, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r["doc_id"], r["s"]) for r in pii.find_personal_data(df).select("doc_id", pii.joined("spans").alias("s")).collect()}
    assert got == {(1, "email:5:13,ip:17:24"), (None, "email:21:27,phone:0:17"), (2, ""), (3, "")}
    clean = [(r["doc_id"], r["text"], r["spans"]) for r in pii.redact(df).collect()]
    assert clean[0] == (1, "mail <EMAIL> or <IP>", "k") and clean[2][1] == "<PHONE> é🙂 <EMAIL>" and clean[3:] == [(2, None, "k"), (3, "", None)]
    assert pii.find_personal_data(df.limit(0)).collect() == []


# --- token counts


def test_batches_count_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "s", "en", "a b"), (2, "s", None, None), (3, "t", "en", "c"), (3, "t", "en", "c")], "doc_id long, source string, lang string, text string")
    roll = token_counts.Rollup(spark, str(tmp_path / "r"))
    counts = token_counts.counted(docs, ("words-v1",))
    assert roll.commit("1", token_counts.inserts(counts)) and not roll.commit("1", token_counts.inserts(counts))
    state = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in roll.totals().collect()}
    assert state() == {("s", "en", "words-v1"): (1, 2, 3), ("s", None, "words-v1"): (1, 0, 0), ("t", "en", "words-v1"): (2, 2, 2)}
    new = token_counts.counted(docs.where("doc_id = 1").withColumn("source", F.lit("u")), ("words-v1",), text=F.lit("a b c"))
    roll.commit("2", token_counts.revisions(counts.where("doc_id = 1"), new))
    roll.commit("3", token_counts.deletes(counts.where("doc_id = 3")))
    roll.commit("4", token_counts.inserts(counts.limit(0)))
    want = {("u", "en", "words-v1"): (1, 3, 5), ("s", None, "words-v1"): (1, 0, 0)}
    assert state() == want and roll.compact() and state() == want and roll.holds("2") and not roll.commit("2", token_counts.inserts(counts))
    roll.commit("5", token_counts.inserts(counts.where("doc_id = 3")))
    assert roll.compact() and state() == want | {("t", "en", "words-v1"): (2, 2, 2)}


def test_an_unfinished_batch_is_not_seen(spark, tmp_path):
    roll = token_counts.Rollup(spark, str(tmp_path / "r"))
    spark.createDataFrame([("s", "en", "t", 1, 1, 1)], token_counts._SCHEMA).write.parquet(str(tmp_path / "r" / "_batch=1-dead" / "rows"))
    assert roll.totals().collect() == [] and roll.committed() == []


@pytest.fixture
def three_batches(spark, tmp_path):
    roll = token_counts.Rollup(spark, str(tmp_path / "r"))
    for i in range(3):
        roll.commit(str(i), spark.createDataFrame([("s", "en", "t", 1, 2, 3)], token_counts._SCHEMA))
    return roll


def _total(roll):
    return [tuple(r)[3:] for r in roll.totals().collect()]


def test_a_commit_during_compaction_counts_once(spark, three_batches):
    roll, read = three_batches, token_counts.Rollup._rows

    def late(self, names):
        del self._rows  # only the compaction's own read is late
        self.commit("late", spark.createDataFrame([("s", "en", "t", 1, 2, 3)], token_counts._SCHEMA))
        return read(self, names)

    roll._rows = late.__get__(roll)
    assert roll.compact() and _total(roll) == [(4, 8, 12)] and len(roll.committed()) == 2


def test_compactions_at_the_same_time_count_once(spark, three_batches):
    roll = three_batches
    other = token_counts.Rollup(spark, roll.path)
    folders = other.committed()
    assert roll.compact()
    other.committed = lambda: folders  # listed before the first compaction was done
    assert not other.compact() and _total(roll) == [(3, 6, 9)]
    roll.commit("3", spark.createDataFrame([("s", "en", "t", 1, 2, 3)], token_counts._SCHEMA))
    other.committed = lambda: ["batch=0", "batch=3"]  # shares a batch with the summary that is there
    assert other.compact() and _total(roll) == [(4, 8, 12)]
    assert roll.compact() and _total(roll) == [(4, 8, 12)] and not roll.compact()


def test_two_writers_of_a_batch(spark, three_batches):
    roll = three_batches
    roll.holds = lambda batch_id: False  # the other writer's rename came after this look
    assert not roll.commit("1", spark.createDataFrame([("s", "en", "t", 9, 9, 9)], token_counts._SCHEMA)) and _total(roll) == [(3, 6, 9)]
    exists = roll._fs.exists

    class Late:  # a file system that moves a folder into one that is there already
        def __getattr__(self, name):
            return getattr(real, name)

        def exists(self, path):
            return exists(path) if "/batch=1/" in str(path) else False

    real, roll._fs = roll._fs, Late()
    assert not roll.commit("1", spark.createDataFrame([("s", "en", "t", 9, 9, 9)], token_counts._SCHEMA)) and _total(roll) == [(3, 6, 9)]


def test_counts_of_a_vocabulary(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    texts = ["It's a test, 12 times.", None, "", "x" * 50_000, "a b " * 30_000, "é 漢"]
    # columns with the names the operator uses inside
    docs = spark.createDataFrame([(i if i else None, "s", None, t, 7, "q") for i, t in enumerate(texts)], "doc_id long, source string, lang string, text string, tokens int, tokenizer string")
    got = {r["doc_id"]: (r["tokenizer"], r["tokens"], r["chars"]) for r in token_counts.counted_ids(docs, "bpe", tokenizer_path()).collect()}
    assert got == {i if i else None: ("bpe", len(library.encode(t or "", add_special_tokens=False).ids), len(t or "")) for i, t in enumerate(texts)}
    plain = {(r["doc_id"], r["tokenizer"]): r["tokens"] for r in token_counts.counted(docs, tuple(token_counts.TOKENIZERS)).collect()}
    assert plain[3, "words-v1"] == 1 and plain[4, "words-v1"] == 60_000 and plain[1, "pieces-v2"] == 0


def test_recounting_either_way(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "s", "en", "a b"), (2, "s", "en", "c!"), (2, "s", "en", "c!"), (None, "s", "en", "d")], "doc_id long, source string, lang string, text string")
    ids = spark.createDataFrame([(2,), (5,)], "doc_id long")
    get = lambda: sorted(tuple(r) for r in token_counts.recounted(docs, ids, ("words-v1",), text=F.regexp_replace("text", "!", " x")).collect())
    few = get()
    monkeypatch.setattr(token_counts, "MOST_SENT", 1)
    assert few == get() == [(2, "s", "en", "words-v1", 2, 3)] * 2


# --- similarity join


def linked(docs, k, num, den):
    sets = []
    for t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]))
    n, root, degree = len(docs), list(range(len(docs))), [0] * len(docs)
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                degree[i], degree[j] = degree[i] + 1, degree[j] + 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(len(s), r, d) for s, r, d in zip(sets, root, degree, strict=True)]


def near_copies(seed, groups=6, size=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    out, passage = ["", None, " \t", "One", "one", "two words", "TWO\nwords"], [word() for _ in range(20)]
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([12, 40, 90]))] + passage
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    rng.shuffle(out)
    return out + ["x y " * 3000]


@pytest.mark.parametrize("seed,k,num,den,bucket", [(1, 3, 90, 100, 64), (2, 3, 90, 100, 3), (3, 5, 80, 100, 3), (4, 2, 60, 100, 5)])
def test_similarity_join_is_exact(spark, seed, k, num, den, bucket, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 6)  # several blocks to a family
    texts = near_copies(seed)
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, e string").repartition(5)
    rows = sorted(jaccard.jaccard_classes(df, words=k, num=num, den=den, bucket=bucket, sketch_bits=12).collect())
    assert [tuple(r)[1:] for r in rows] == linked(texts, k, num, den)


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100), (2, 60, 100)])
def test_classes_without_counts_are_the_same(spark, monkeypatch, k, num, den):
    monkeypatch.setattr(jaccard, "BLOCK", 20)  # so that families have several blocks
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for size, edits in ((120, 1), (90, 3), (60, 8), (25, 2), (14, 0)):
        a = [rng.choice(vocab) for _ in range(size)]
        b = a[: size // 2] + [rng.choice(vocab) for _ in range(size // 2)]  # shares half of its shingles
        for base in (a, b):
            for _ in range(24):
                w = list(base)
                for _ in range(rng.randint(0, edits)):
                    w[rng.randrange(len(w))] = rng.choice(vocab)
                texts.append(" ".join(w[: rng.randint(len(w) - 3, len(w))]))
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = [(i, n, c) for i, (n, c, _) in enumerate(linked(texts, k, num, den))]
    for bucket in (2, None):
        rows = jaccard.jaccard_classes(df, words=k, num=num, den=den, bucket=bucket, sketch_bits=12, count_links=False).collect()
        assert sorted(tuple(r)[:3] for r in rows) == want and all(r["n_links"] in (0, None) for r in rows), bucket


def test_work_of_a_large_family_follows_its_size(spark, monkeypatch):
    """20,000 near copies of one text: what is compared in blocks, and what is returned, stays far below all pairs."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(3000)}" for _ in range(130)]
    texts = []
    for i in range(20_000):
        w = list(base)
        w[rng.randrange(130)] = f"x{i}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    counted, real = {}, jaccard._by_pivots

    def seen(members, num, den):
        edges, groups = real(members, num, den)
        counted["members"], counted["edges"], counted["rows"] = members.count(), edges.count(), groups.count()
        return edges, groups

    monkeypatch.setattr(jaccard, "_by_pivots", seen)
    rows = jaccard.jaccard_classes(df, words=5, num=80, den=100, count_links=False).select("component_id").distinct().collect()
    assert len(rows) == 1 and counted["members"] == 20_000 and counted["edges"] < 5 * 20_000 and counted["rows"] < 4_000, counted


def test_pairs_of_copies_grow_with_the_table(spark, monkeypatch):
    """A group of near copies that grows with its table: candidate pairs keep to the group's size, and links are all counted."""
    rng, counted, real = random.Random(3), {}, jaccard.stored

    def seen(df, name, instead_of=None):
        out = real(df, name, instead_of)
        if name == "candidates":
            counted[size] = out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", seen)
    base = [f"w{rng.randrange(3000)}" for _ in range(130)]
    for size in (60, 300):
        copies = [" ".join([*base[:k], f"x{i}", *base[k + 1 :]]) for i in range(size) for k in [rng.randrange(130)]]
        texts = copies + [" ".join(f"y{rng.randrange(100_000)}" for _ in range(200)) for i in range(19 * size)]
        texts += [t + " end" for t in texts[size:]]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        rows = {r["doc_id"]: r for r in jaccard.jaccard_classes(df, words=3, num=90, den=100).collect()}
        want = linked(copies, 3, 90, 100)
        assert [(rows[i]["n_shingles"], rows[i]["component_id"], rows[i]["n_links"]) for i in range(size)] == want
        assert all(rows[i]["component_id"] == rows[i + 19 * size]["component_id"] == i for i in range(size, 20 * size))
    assert counted[300] < 6 * counted[60], counted


def test_similarity_join_odd_rows(spark):
    schema = "doc_id long, text string"
    rows = jaccard.jaccard_classes(spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "q r s t"), (None, "q r s t"), (7, None)], schema), words=3, num=90, den=100).collect()
    assert sorted(map(str, rows)) == sorted(map(str, [type(rows[0])(*x) for x in []])) or {(r["doc_id"], r["component_id"], r["n_links"]) for r in rows} == {(None, 3, 2), (3, 3, 2), (None, None, 1), (7, 7, 0)}
    assert jaccard.jaccard_classes(spark.createDataFrame([], schema), words=3, num=90, den=100).collect() == []


def test_prefixes_share_as_many_as_they_ask():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = rng.integers(1, 60)
        a = rng.choice(400, n, replace=False).astype(np.uint64)
        b = a.copy()
        m = rng.integers(0, max(1, n // 8) + 1)
        b[:m] = rng.choice(400, m, replace=False) + 1000
        a, b = np.unique(a), np.unique(b)
        i = len(np.intersect1d(a, b))
        if 100 * i >= 80 * (len(a) + len(b) - i):
            level = lambda g: ((g * 7) % 5).astype(np.uint8)
            (p, x), (q, y) = (jaccard.prefix(g, level(g), 80, 100) for g in (a, b))
            assert len(np.intersect1d(p, q)) >= min(x, y)


def test_components(spark):
    rng = random.Random(8)
    for edges in ([(i, i + 1) for i in range(60)], [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(70)], [], [(5, 5)], [(0, i) for i in range(1, 40)]):
        root = {x: x for e in edges for x in e if e[0] != e[1]}
        for a, b in edges:
            if a != b:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
        got = components(spark.createDataFrame(edges + edges[:3], "a long, b long")).collect()
        assert {r["node"]: r["root"] for r in got} == root and len(got) == len(root)


# --- neighbours


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((600, 16)), np.repeat(rng.standard_normal((3, 16)), 40, axis=0)]).astype(np.float32)
    x *= rng.uniform(0.5, 2, (len(x), 1)).astype(np.float32)
    x[600:640] = x[600]  # one vector forty times
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 0), (5010, [0.0] * 16, 0), (5020, [float("nan")] * 16, 0), (5030, [1.0, None], 0), (5040, [], 0), (5050, [2.0, 3.0], 0), (0, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, nid int")
    got = {}
    for r in neighbours.nearest(df, every=10, k=5, block_rows=200).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(range(0, len(x), 10))
    hits, d = 0, x.astype(float)
    for q, found in got.items():
        s = d @ d[q]
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 and r["vec_id"] != q for r in found)
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        s[q] = -np.inf
        hits += len({r["vec_id"] for r in found} & set(np.lexsort((np.arange(len(s)), -s))[:5].tolist()))
    assert hits / len(got) / 5 >= 0.9


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(12)
    x = np.repeat(rng.standard_normal((60, 16)), 60, axis=0)
    x = x + 0.02 * rng.standard_normal(x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(len(x))].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, every=9, k=5, block_rows=1000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits, d = 0, x.astype(float)
    for q in range(0, len(x), 9):
        s = d @ d[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / len(got) / 5 >= 0.97


def test_share_of_nodes_that_is_scored(spark, capsys):
    """No structure at all is the hardest case for a graph; the share falls as the table grows."""
    rng, share = np.random.default_rng(4), {}
    for n in (1500, 12_000):
        x = rng.standard_normal((n, 48))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
        got, scored = {}, {}
        for r in neighbours.nearest(df, every=100, k=20).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
            scored[r["query_id"]] = r["n_scored"]
        hits, d = 0, x.astype(np.float32).astype(float)
        for q in got:
            s = d @ d[q]
            s[q] = -np.inf
            hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
        recall, share[n] = hits / len(got) / 20, np.mean(list(scored.values())) / n
        with capsys.disabled():
            print(f"{n} vectors: recall {recall:.3f}, scored share {share[n]:.3f}")
        assert len(got) == n // 100 and recall >= 0.9
    assert share[12_000] < 0.3 and share[12_000] < share[1500] / 2


def test_groups_of_nodes_are_bounded(spark, monkeypatch):
    """No task has the lists or candidates of a whole block at once, and a table of 6 GB has smaller groups to score."""
    pairs, merged = neighbours._pairs, neighbours._merged

    def few_lists(*args):
        run = pairs(*args)

        def work(lists):
            assert len(lists["p"].unique()) <= 512
            return run(lists)

        return work

    def few_nodes(*args):
        run = merged(*args)

        def work(nodes, cand):
            assert nodes["nid"].nunique() <= 512
            return run(nodes, cand)

        return work

    monkeypatch.setattr(neighbours, "_pairs", few_lists)
    monkeypatch.setattr(neighbours, "_merged", few_nodes)
    x = np.random.default_rng(7).standard_normal((1500, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert neighbours.nearest(df, every=100).count() == 15 * 20
    reached = neighbours.EXPAND * 2 * neighbours.GRAPH_K
    for dim, nodes in ((64, 23_000_000), (768, 2_000_000)):
        width = 1 << neighbours.query_bits(nodes, nodes // 20, dim, reached)
        assert nodes // 20 * reached * width / nodes * dim <= neighbours.QUERY_VALUES


def test_few_queries_have_small_groups_too(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_VALUES", 1 << 9)
    x = np.random.default_rng(8).standard_normal((700, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, d, hits = {}, x.astype(float), 0
    for r in neighbours.nearest(df, every=5, k=5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, 700, 5):
        s = d @ d[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / len(got) / 5 >= 0.95


def test_files_of_beams_are_bounded(spark, monkeypatch):
    """A beam's row has every node seen: a batch of thousands of them does not fit; and single nodes carry no vector."""
    kept, rows = neighbours.stored, []

    def seen(df, name, *args):
        out = kept(df, name, *args)
        if name == "beams" and args:
            rows.extend(r["n"] for r in out.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect())
        return out

    monkeypatch.setattr(neighbours, "stored", seen)
    monkeypatch.setattr(neighbours, "BEAM_ROWS", 20)
    x = np.random.default_rng(3).standard_normal((400, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in neighbours.nearest(df, k=3).collect()}
    assert rows and max(rows) <= 20
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    assert np.mean([got[q, 1] == s[q].argmax() for q in range(400)]) >= 0.95


def test_new_nodes_are_dealt_by_group():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"q": [1, 2, 3], "vec": [[0.5], [1.5], [2.5]], "least": [0.0, 1.0, 2.0], "new": [[9, 1, 8], [], [2, 17]]})
    assert pa.Table.from_batches(neighbours._dealt(3)([b])).to_pylist() == [
        {"q": 1, "at": 0, "vec": [0.5], "least": 0.0, "ns": [1]},
        {"q": 1, "at": 1, "vec": [0.5], "least": 0.0, "ns": [8, 9]},
        {"q": 3, "at": 0, "vec": [2.5], "least": 2.0, "ns": [2]},
        {"q": 3, "at": 2, "vec": [2.5], "least": 2.0, "ns": [17]},
    ]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, every=20).orderBy("query_id", "rank").collect()]
    assert rows == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert neighbours.nearest(df.limit(0)).collect() == []


# --- chat


def test_perspectives(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "🙂<|im_end|>"), (2, 0, "system", "only"), (None, 1, None, "x"), (3, 1, "a", "same"), (3, 1, "a", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {(r["conv_id"], r["participant"]): r for r in chat.perspectives(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "a")}
    r = got[1, "ann"]
    assert r["text"] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\n🙂<​|im_end|><|im_end|>\n"
    assert [r["text"][s["start"] : s["end"]] for s in r["mask"]] == ["hi<|im_end|>", "🙂<​|im_end|><|im_end|>"]
    assert got[3, "a"]["n_turns"] == 2 and got[1, "bob"]["n_masked"] == len("<|im_end|>")
    assert chat.perspectives(df.limit(0)).collect() == []


def test_masks_of_long_conversations(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["system", "ann", "b\nb", "<|c"]), rng.choice(["", "x", "hey 🙂", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("pos", F.lit(1)).withColumn("before", F.lit("x"))
    got = {r["participant"]: r for r in chat.perspectives(df.repartition(3)).collect()}
    assert set(got) == {"ann", "b b", "<​|c"}
    for name, r in got.items():
        said = [(t or "") + "<|im_end|>" for _, _, who, t in rows if who.replace("\n", " ").replace("<|", "<​|") == name]
        assert [r["text"][s["start"] : s["end"]] for s in r["mask"]] == said and r["n_turns"] == 3000 and r["n_masked"] == sum(map(len, said))
        assert r["text"].count("<|im_start|>assistant\n") == len(said) and "name=b b\n" in got["ann"]["text"]


def test_masks_take_linear_time(spark):
    import time

    def took(n):
        df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.lit("some words").alias("text"))
        began = time.time()
        assert chat.perspectives(df).agg(F.sum(F.size("mask"))).first()[0] == n
        return time.time() - began

    took(2000)
    assert took(160_000) < 3 * took(80_000) + 1


def test_chat_is_native(spark):
    plan = chat.perspectives(spark.createDataFrame([(1, 0, "a", "b")], "conv_id long, turn int, role string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- pipeline


def test_near_duplicates_go_by_row(spark):
    rng = random.Random(21)
    a, b, c, d, e = (good(rng) + " " + good(rng) + " " + good(rng) for _ in range(5))
    rows = [(1, a), (2, a + " end"), (2, b), (3, c + " end"), (3, c), (None, d), (None, d), (None, d + " end"), (None, a), (4, e), (4, e.upper()), (5, ""), (5, ""), (5, " "), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    want = [(1, a), (2, b), (3, c), (None, d), (4, e.upper()), (5, ""), (5, " "), (None, ""), (None, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_pipeline_stages(spark, tmp_path, labelled):
    docs, labels = labelled
    rng = random.Random(1)
    base = good(rng) + " " + good(rng) + " call +1 (234) 555-1234"
    more = spark.createDataFrame([(2000, base, "en", "s"), (2001, base + " end", "en", "s"), (2002, base, "en", "s"), (2002, base, "en", "s"), (None, good(rng), "en", "s")], "doc_id long, text string, lang string, source string")
    docs = docs.drop("x").unionByName(more).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"stage{k}"))
        seen[name], now = now, spark.read.schema(out.schema).parquet(str(tmp_path / f"stage{k}"))
    kept = {r["doc_id"]: r for r in now.collect()}
    assert 2000 in kept and 2001 not in kept and 2002 not in kept and kept[2000]["text"].endswith("call <PHONE>") and kept[2000]["n_chars"] == len(kept[2000]["text"])
    rejected = {r["doc_id"] for r in docs.collect() if r["doc_id"] is not None} - {r["doc_id"] for r in seen["n-gram Jaccard join"].collect()}
    assert np.mean([i % 4 == 0 for i in rejected if i < 900]) > 0.97
    rows = seen["n-gram Jaccard join"].collect()
    classes = linked([r["text"] for r in rows], 5, 80, 100)
    ids = [r["doc_id"] for r in rows]
    want = {ids[i] for i, (n, root, _) in enumerate(classes) if ids[i] is not None and all(ids[j] is None or ids[j] >= ids[i] for j in range(len(rows)) if classes[j][1] == root)}
    assert {i for i in kept if i is not None} == want
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept) and tokenizer_path()
