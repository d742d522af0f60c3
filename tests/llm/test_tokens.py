"""Encoding, packing, token files and audio against the library, brute force and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import audio, bpe, packing, rans, token_files
from codeloom.llm.common import tokenizer_path
from codeloom.llm.wordbpe import ForcedBoundaryWords, LibraryWords

TEXTS = [None, "", " \n\t ", "Hello, World! it's I'D we'll", "x" * 3000, "ab " * 5000, "<|endoftext|>a <|ENDOFTEXT|> b<|startoftext|>", "é É ñ ß İ Σας ẖ H̱ 漢字 🙂 　 \x1c\x85x", "a\x00b �", "same text", "same text", "1234 5.6,7. end."]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "x", 1.5) for i, t in enumerate(TEXTS)] + [(1, "same text", "y", None)]
    # columns with the names the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens double").repartition(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("kind", [LibraryWords, ForcedBoundaryWords])
def test_words_equal_the_library(library, kind):
    rng = random.Random(3)
    alphabet = "abcdefgXYZ  \t\n'sтьéÉñß.,!?#$012<|endoftext|>́  İΣ漢🙂\x1c\x85-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + TEXTS + ["".join(rng.choice("abcdefghij") for _ in range(2000))]
    words = kind(tokenizer_path())
    for _ in range(2):  # the second time from memory
        for i, got in words.each(pa.array(texts, pa.string())):
            assert got.tolist() == ids_of(library, texts[i]), repr(texts[i])


def test_forced_boundaries_are_inside_no_token(library):
    words = ForcedBoundaryWords(tokenizer_path())
    for token in random.Random(1).sample(sorted(library.get_vocab()), 3000):
        body = token.removesuffix("</w>")
        if not token.startswith("<|"):
            b = [words.byte_of[c] for c in body]
            assert words.joins[b[:-1], b[1:]].all()


def test_memory_is_bounded(library, monkeypatch):
    from codeloom.llm import wordbpe

    monkeypatch.setattr(wordbpe, "_REMEMBERED", 50)
    words = LibraryWords(tokenizer_path())
    texts = [" ".join(f"w{i * j}q" for j in range(30)) for i in range(20)]
    for _ in range(3):
        for i, got in words.each(pa.array(texts)):
            assert got.tolist() == ids_of(library, texts[i])
        assert len(words.memo) <= 50


def test_encode_and_decode(docs, library):
    path = tokenizer_path()
    coded = bpe.encode_documents(docs, path)
    got = bpe.decode_documents(coded, path, keep=("n_tokens", "ids")).collect()
    want = sorted((raw(ids_of(library, t)), library.decode(ids_of(library, t), skip_special_tokens=False)) for t in [*TEXTS, "same text"])
    assert sorted((bytes(r["ids"]), r["decoded"]) for r in got) == want
    assert sum(r["doc_id"] is None for r in got) == 1


def test_packing(docs, library):
    rows = packing.pack_documents(docs, tokenizer_path(), max_tokens=64).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    by_doc = {}
    for r in rows:
        assert r["length"] == 1 << r["bucket"] <= 64 and r["offset"] == 0 and len(r["ids"]) == 4 * r["length"]
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for i, t in enumerate(TEXTS):
        if i in (0, 2, 3, 4, 6, 7, 8):
            ids, at = [*ids_of(library, t), 1], 0
            for r in sorted(by_doc[i, len(ids)], key=lambda r: r["start"]):
                assert r["start"] == at and bytes(r["ids"]) == raw(ids[at : at + r["length"]])
                at += r["length"]
            assert at == len(ids)
            # as few pieces as whole blocks and the bits of the rest
            assert len(by_doc[i, len(ids)]) == len(ids) // 64 + (len(ids) % 64).bit_count()


def test_packing_lengths(spark):
    df = spark.createDataFrame([(n, raw(range(n))) for n in (0, 1, 2, 7, 8, 9, 4096 + 2047)], "doc_id long, ids binary")
    rows = packing.power_of_two_pieces(df).collect()
    assert {n: sorted((r["length"] for r in rows if r["doc_id"] == n), reverse=True) for n in (0, 1, 7, 9)} == {0: [], 1: [1], 7: [4, 2, 1], 9: [8, 1]}
    assert sum(r["length"] for r in rows if r["doc_id"] == 6143) == 6143
    with pytest.raises(ValueError):
        packing.power_of_two_pieces(df, max_tokens=3)


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (5, 3), (300, 50), (5000, 49408), (600_000, 2000)])
def test_numeral_system_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % top).astype(np.uint32)
    table = rans.Table.of(ids)
    again = rans.Table.from_bytes(table.to_bytes())
    assert table.freq.sum() == 1 << rans.BITS and (again.freq == table.freq).all() and (again.symbols == table.symbols).all()
    block = rans.encode(ids, table)
    assert (rans.decode(block, again) == ids).all()
    # any checkpoint alone is enough to begin
    size = block["check"] * block["lanes"]
    for k in range(len(block["crc32"])):
        assert (rans.decode_stretch(block, again, k) == ids[k * size : (k + 1) * size]).all()


def test_numeral_system_sees_damage():
    ids = np.random.default_rng(0).integers(0, 500, 4000).astype(np.uint32)
    table = rans.Table.of(ids)
    block = rans.encode(ids, table)
    words = bytearray(block["words"])
    words[len(words) // 2] ^= 1
    with pytest.raises((ValueError, IndexError)):
        rans.decode(block | {"words": bytes(words)}, table)
    with pytest.raises(ValueError):
        rans.encode(np.array([501], np.uint32), table)


def test_token_files(spark, docs, library, tmp_path):
    token_files.write_token_files(docs, str(tmp_path / "f"), tokenizer_path(), segment_ids=200)
    rows = sorted(token_files.read_token_files(spark, str(tmp_path / "f")).collect(), key=lambda r: r["start"])
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"] and bytes(r["ids"])[-4:] == raw([2])
        at += r["n_tokens"]
    assert sorted(bytes(r["ids"]) for r in rows) == sorted(raw([*ids_of(library, t), 2]) for t in [*TEXTS, "same text"])


def test_blocks_and_stretches_are_read_alone(spark, docs, tmp_path):
    token_files.write_token_files(docs.coalesce(1), str(tmp_path / "f"), tokenizer_path(), segment_ids=9000, block_ids=1500, stretch_ids=512)
    whole = sorted(token_files.read_token_files(spark, str(tmp_path / "f")).collect(), key=lambda r: r["start"])
    ids = b"".join(bytes(r["ids"]) for r in whole)
    rows = spark.read.schema(token_files.SCHEMA).parquet(str(tmp_path / "f")).collect()
    assert len({(r["part"], r["segment"]) for r in rows}) < len(rows)
    at = {(r["part"], r["segment"], r["block"]): r for r in rows}
    starts = {r["doc_id"]: r["start"] for r in whole}
    one = at[max(at)]
    got = [d for b in token_files._documents({**one.asDict(), "base": 0}) for d in b.to_pylist()]
    assert [d["doc_id"] for d in got] == list(one["doc_ids"]) and {d["ids"] for d in got} <= {bytes(r["ids"]) for r in whole}
    assert all(len(r["n_tokens"]) == len(r["doc_ids"]) and sum(r["n_tokens"]) == r["n"] for r in rows) and starts
    pieces = sorted(token_files.read_stretches(spark, str(tmp_path / "f")).repartition(5).collect(), key=lambda r: r["start"])
    assert len(pieces) > len(rows) and b"".join(bytes(p["ids"]) for p in pieces) == ids
    assert all(ids[4 * p["start"] : 4 * (p["start"] + p["n_ids"])] == bytes(p["ids"]) for p in pieces)


def test_groups_are_bounded_by_bytes():
    col = pa.array(["a" * 3000] * 50 + ["b " * 20_000] + [None, ""] * 3)
    words = LibraryWords(tokenizer_path())
    parts = [(a, b) for a, b, _, _ in words.by_slice(col, 10_000)]
    assert [a for a, _ in parts[1:]] == [b for _, b in parts[:-1]] and parts[-1][1] == len(col)
    assert all(sum(len(t or "") for t in col[a:b].to_pylist()) <= 10_000 or b - a == 1 for a, b in parts)


def test_audio(docs):
    rows = audio.audio_features(audio.store_audio(docs)).collect()
    by_payload = {}
    for r in rows:
        n = r["n_bytes"]
        assert len(r["payload"]) % 64 == 0 and len(r["payload"]) - 64 <= max(n, 0) <= len(r["payload"]) and set(bytes(r["payload"])[n:]) <= {0}
        assert audio.wave_payload(bytes(r["media"])) == (audio.RATE, bytes(r["payload"])) and len(r["media"]) == 44 + len(r["payload"])
        cell = audio.read_tensors(bytes(r["tensors"]))
        assert cell.schema.field("log_mel").type.shape == [64, 32] and cell.num_rows == -(-r["n_frames"] // 64) and cell["end_s"][-1].as_py() == audio.seconds(r["n_frames"])
        assert all(0 <= s["start_s"] < s["end_s"] <= audio.seconds(r["n_frames"]) for s in r["segments"])
        by_payload.setdefault(bytes(r["payload"]), set()).add((bytes(r["tensors"]), str(r["segments"])))
    assert all(len(v) == 1 for v in by_payload.values())
    want = sorted((t or "").encode() for t in [*TEXTS, "same text"])
    assert sorted(bytes(r["payload"])[: r["n_bytes"]] for r in rows) == want


def test_resampler_against_direct_filter():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, 400).astype(np.uint8)
    phases = audio._filters()[0].astype(float)
    signal = (x.astype(float) - 128) / 128
    whole = audio.resampled(x, 0, 300)
    for n in (0, 1, 2, 50, 151, 299):
        first = n * audio.DOWN // audio.UP - audio.TAPS // 2
        want = sum(phases[n * audio.DOWN % audio.UP][t] * signal[first + t] for t in range(audio.TAPS) if 0 <= first + t < len(signal))
        assert abs(whole[n] - want) < 1e-5
    assert np.allclose(audio.resampled(x, 150, 300), whole[150:], atol=1e-6)


def test_hysteresis():
    energy = np.array([0, 5, 9, 5, 0, 5, 5, 0, 9.0])
    runs = audio.energy_segments(energy)
    assert (1, 4) in runs and (8, 9) in runs


def test_long_audio_in_parts(monkeypatch):
    x = np.frombuffer(hashlib.sha256(b"x").digest() * 700, np.uint8)
    whole, _ = audio.log_mel(x)
    monkeypatch.setattr(audio, "FRAMES_AT_ONCE", 7)
    parts, _ = audio.log_mel(x)
    assert np.abs(whole - parts).max() <= 1 / 64


def test_empty_tables(spark, empty, tmp_path):
    path = tokenizer_path()
    assert bpe.encode_documents(empty, path).collect() == [] and packing.pack_documents(empty, path).collect() == []
    token_files.write_token_files(empty, str(tmp_path / "e"), path)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).collect() == []
    assert audio.audio_features(audio.store_audio(empty)).collect() == []


def test_crc_of_padding():
    assert zlib.crc32(audio.padded(b"")) == zlib.crc32(b"\0" * 64) and audio.padded(b"a" * 64) == b"a" * 64


def test_a_piece_carries_its_own_ids_only(spark):
    """What is exploded holds no document's whole ids beside each of its pieces."""
    df = spark.createDataFrame([(1, bytes(range(256)) * 33)], "doc_id long, ids binary")
    pieces = packing.power_of_two_pieces(df, max_tokens=64)
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    beside = next(x for x in plan.split("\n") if "Generate" in x).rsplit("], false, [", 1)[0].rsplit("[", 1)[1]
    assert "doc_id" in beside and "_ids" not in beside, beside
    rows = sorted(pieces.collect(), key=lambda r: r["start"])
    assert b"".join(r["ids"] for r in rows) == bytes(range(256)) * 33 and len(rows) == 33
