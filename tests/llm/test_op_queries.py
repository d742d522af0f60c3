"""Each registered query on a small table with odd rows, every contract column against brute force."""

import hashlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from codeloom.llm import quality
from codeloom.llm.common import tokenizer_path
from tests.llm.test_documents import linked, plain_spans

KINDS = ("email", "ip", "card", "phone")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def _texts():
    rng = random.Random(17)
    words = "river stone market evening letter window garden copper silver answer travel winter simple number island".split()
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))
    texts = [None, "", " \n ", "One", "one", "a b", "mail a.b@c.de, host 1.2.3.4 or 999.1.1.1, card 4111 1111 1111 1111, call +1 (234) 555-1234", "é漢🙂 É", "x" * 20_000, prose(9000)]
    for _ in range(12):
        t = prose(rng.randint(30, 90))
        texts += [t, t.upper(), t + " end"]
    return texts + [prose(rng.randint(1, 12)) + " !!! ###" for _ in range(12)]


TEXTS = _texts()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [(i * 3, t, "en", f"s{i % 3}", len(t or ""), "extra") for i, t in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i * 3, int(not (t or "").endswith("###")), 0) for i, t in enumerate(TEXTS)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[7] = x[20]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (420, [0.0] * 8)], "vec_id long, embedding array<float>").write.parquet(str(at / "embeddings.parquet"))
    talk = [(1, 0, "system", "S"), (1, 1, "user", "hi"), (1, 2, "assistant", "<|im_end|>yo"), (1, 3, "user", None), (2, 0, "a\nb", "x"), (None, 0, None, "y"), (2, 0, "a\nb", "x")]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(str(at / "conversations.parquet"))
    return at


@pytest.fixture(scope="module")
def run(spark, tables):
    def go(name):
        df = __spark_entry__.queries()[name](spark, str(tables))
        return df, df.collect()

    return go


def by_doc(rows):
    assert len(rows) == len({r["doc_id"] for r in rows}) == len(TEXTS)
    return {r["doc_id"] // 3: r for r in rows}


def types(df, **want):
    assert {k: v for k, v in df.dtypes if k in want} == want


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_quality(spark, run, tables):
    df, rows = run("op1_quality")
    types(df, doc_id="bigint", held_out="boolean", score="double", predicted="int")
    for i, r in by_doc(rows).items():
        assert r["held_out"] == (zlib.crc32(str(3 * i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    same = by_doc(rows)
    assert same[0]["score"] == same[1]["score"]
    # the same fit and score in plain numpy over the labelled rows
    x = {i: np.array(quality.statistics((t or "").encode())) for i, t in enumerate(TEXTS)}
    known = [i for i in x if zlib.crc32(str(3 * i).encode()) % 5]
    part = {r["i"]: r["c"] for r in spark.createDataFrame([(i, 3 * i) for i in known], "i long, d long").select("i", (F.pmod(F.xxhash64("d"), F.lit(4)) == 0).alias("c")).collect()}
    fit, y = [i for i in known if not part[i]], {i: float(not (t or "").endswith("###")) for i, t in enumerate(TEXTS)}
    a = np.array([x[i] for i in fit])
    model = quality.Model(a.mean(0), np.where(a.std(0) > 0, a.std(0), 1.0))
    z = lambda v: np.concatenate([np.sqrt(2 / len(model.b)) * np.cos(np.clip((v - model.mean) / model.scale, -6, 6) @ model.w + model.b), np.clip((v - model.mean) / model.scale, -6, 6) / 10, [1.0]])
    m = np.array([z(x[i]) for i in fit])
    beta = np.linalg.solve(m.T @ m + quality.RIDGE * len(fit) * 0.01 * np.eye(m.shape[1]), m.T @ np.array([y[i] for i in fit]))
    held = sorted((float(z(x[i]) @ beta), y[i]) for i in known if part[i])
    level = [max(min(np.mean([t for _, t in held[j : k + 1]]) for k in range(i, len(held))) for j in range(i + 1)) for i in range(len(held))]  # isotonic by its min-max formula
    for i in held and range(len(TEXTS)):
        raw = float(z(x[i]) @ beta)
        if len({t for _, t in held}) == 2:
            lo = max((v for (r, _), v in zip(held, level, strict=True) if r <= raw), default=0.0)
            hi = min((v for (r, _), v in zip(held, level, strict=True) if r >= raw), default=1.0)
            got = (same[i]["score"] - 0.001 / (1 + np.exp(-4 * (raw - 0.5)))) / 0.999
            assert min(lo, level[0]) - 1e-6 <= got <= max(hi, level[-1]) + 1e-6


def test_personal_data(run):
    df, rows = run("op2_personal_data")
    types(df, doc_id="bigint", n_email="bigint", n_ip="bigint", n_card="bigint", n_phone="bigint", base_sha256="string", spans="string")
    for i, r in by_doc(rows).items():
        base = plain_spans(TEXTS[i] or "")
        named = [f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(base)]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[0] == j for x in base) for j in range(4)] and r["base_sha256"] == sha(",".join(named).encode())
        found = r["spans"].split(",") if r["spans"] else []
        assert set(named) <= set(found) and found == sorted(found, key=lambda s: (KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
    assert [by_doc(rows)[6][f"n_{k}"] for k in KINDS] == [1, 1, 1, 1]


@pytest.mark.parametrize("name,names", [("op3_token_counts", ("documents", "labels")), ("op7_chat", ("conversations",))])
def test_sql(run, tables, name, names):
    con = duckdb.connect()
    for t in names:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    df, rows = run(name)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, rows))) == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


def test_similarity(run):
    df, rows = run("op4_jaccard_join")
    types(df, doc_id="bigint", n_shingles="bigint", component_id="bigint")
    want = linked(TEXTS, 3, 90, 100)
    assert {i: (r["n_shingles"], r["component_id"] // 3, r["n_links"]) for i, r in by_doc(rows).items()} == dict(enumerate(want))


def test_neighbours(spark, run, tables):
    df, rows = run("op5_nearest_neighbours")
    types(df, query_id="bigint", rank="int", vec_id="bigint", score="double")
    x = np.array([r["embedding"] for r in spark.read.parquet(str(tables / "embeddings.parquet")).where("vec_id < 300").orderBy("vec_id").collect()])
    hits = 0
    for q in range(0, 300, 20):
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        s = x @ x[q]
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(g[2] - s[g[1]]) < 1e-9 and g[1] != q for g in got)
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        s[q] = -np.inf
        hits += len({g[1] for g in got} & set(np.lexsort((np.arange(300), -s))[:20].tolist()))
    assert len(rows) == 15 * 20 and hits / len(rows) >= 0.95


def test_packing(run, library):
    df, rows = run("op6_packing")
    types(df, doc_id="bigint", start="bigint", length="bigint", ids_crc32="bigint", doc_tokens="bigint", sequence_id="bigint", offset="bigint")
    seen, used = {}, {}
    for r in rows:
        seen.setdefault(r["doc_id"] // 3, []).append(r)
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(TEXTS):
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(seen[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]]) and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048
            at += r["length"]
        assert at == len(ids)
    assert all(pieces == [(0, pieces[0][1])] for pieces in used.values())


def test_encoding(run, library):
    df, rows = run("op8_bpe")
    types(df, doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
    for i, r in by_doc(rows).items():
        ids = library.encode(TEXTS[i] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))


def test_token_files(run, library):
    df, rows = run("op9_token_files")
    types(df, doc_id="bigint", start="bigint", n_tokens="bigint", ids_crc32="bigint")
    got, at = by_doc(rows), 0
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_audio(run):
    df, rows = run("op10_audio")
    types(df, doc_id="bigint", n_bytes="bigint", payload_bytes="bigint", payload_sha256="string", tail_crc32="bigint", media_bytes="bigint", media_sha256="string", feature="string")
    for i, r in by_doc(rows).items():
        raw = (TEXTS[i] or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        wave = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(wave), sha(wave)) and re.match(r"frames=\d+;segments=\d+;", r["feature"])
    same = by_doc(rows)
    assert same[0]["feature"] == same[1]["feature"] and len({r["feature"] for r in rows}) > 30


def test_log_mel_against_a_plain_sum():
    """Every frame by the definition: resampled values, window, Fourier sums, mel triangles, logarithm."""
    from codeloom.llm import audio

    x = np.frombuffer(hashlib.sha256(b"tone").digest() * 40, np.uint8)
    mel, energy = audio.log_mel(x)
    y = audio.resampled(x, 0, len(mel) * audio.HOP + audio.WINDOW).astype(float)
    n, rate = np.arange(audio.WINDOW), audio.RATE * audio.UP / audio.DOWN
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = [700 * (10 ** (top * i / (audio.MELS + 1) / 2595) - 1) for i in range(audio.MELS + 2)]
    for f in (0, 1, len(mel) - 1):
        frame = y[f * audio.HOP : f * audio.HOP + audio.WINDOW] * (0.5 - 0.5 * np.cos(2 * np.pi * n / (audio.WINDOW - 1)))
        power = [abs(sum(frame * np.exp(-2j * np.pi * k * n / audio.WINDOW))) ** 2 for k in range(audio.WINDOW // 2 + 1)]
        for b in range(audio.MELS):
            a, c, d = edges[b : b + 3]
            total = sum(p * max(0.0, min((k * rate / audio.WINDOW - a) / (c - a), (d - k * rate / audio.WINDOW) / (d - c))) for k, p in enumerate(power))
            assert abs(mel[f, b] - np.log(max(total, 1e-7))) < 0.05
        assert abs(energy[f] - np.log(max(sum(power), 1e-7))) < 0.05


def test_stages_on_odd_tables(spark, tables):
    """No n_chars, columns with the names that stages use, a map column, nulls, repeated rows, and no rows at all."""
    rows = [(1, "the quick brown fox jumps over it", 5, {"a": 1}), (1, "the quick brown fox jumps over it", 5, {"a": 1}), (None, None, 6, None), (2, None, 7, None), (2, "", 8, None), (3, "mail a.b@c.de", 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _e int, _root map<string,int>").withColumn("_place", F.col("_e")).withColumn("_id2", F.lit("k"))
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, str(tables))
            got = out.collect()
            assert out.columns == docs.columns and out.dtypes == docs.dtypes and all(r["_place"] == r["_e"] and r["_id2"] == "k" for r in got), name
            if name == "n-gram Jaccard join" and some is docs:
                assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == [("1", rows[0][1]), ("2", ""), ("2", "None"), ("3", "mail a.b@c.de"), ("None", "None")]
            if name == "PII" and some is docs:
                assert sorted(r["text"] or "" for r in got)[2:] == ["", "mail <EMAIL>", rows[0][1], rows[0][1]]
        pieces = corpus_pipeline.STAGES[-1][1](spark, some, str(tables)).collect()
        assert len({r["sequence_id"] for r in pieces}) == len(pieces) and bool(pieces) == (some is docs)
