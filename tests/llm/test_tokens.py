"""Encoding, decoding and token files against the tokenizers library and exact round trips."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orrery.llm import bpe, tokenfile

TEXTS = [None, "", " ", "  two", "a\n\n b \x1c c", "x <|endoftext|> y<|endoftext|>", "é ß 中文 \U0001f600", "it's we'll 'S", "ab" * 4000, "word " * 500, "՘ odd ՘՘ class", "plain words, twice", "plain words, twice"]
library = Tokenizer.from_file(bpe.default_path())
ours, theirs = bpe.Encoder(), tokenfile.LibraryEncoder()


def ids(text):
    return library.encode(text or "", add_special_tokens=False).ids


def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(3, "tie", "clash", 2), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, shard int")


@pytest.mark.parametrize("encoder", [ours, theirs])
def test_encoders_equal_the_library(encoder):
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_batch(TEXTS)] == [ids(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab AB'sl1.\n\t  é<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_any_text(texts):
    want = [ids(t) for t in texts]
    for encoder in (ours, theirs):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_batch(texts)]
        assert got == want
    assert [ours.decode(i).decode() for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_verification_finds_exactly_the_wrong_proposals():
    words = [w.encode() for w in "thhationion unbelievable zzzz aaaa'''' hashingly éèê xqzj".split()]
    before = ours.n_exact
    assert ours.encode_words(words) == [ours.merged(w) for w in words]
    assert ours.n_exact - before == sum(ours.proposed(w) != ours.merged(w) for w in words)


def test_words_are_merged_together_as_they_are_alone(monkeypatch):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aabehinorst' é"), n)).encode() for n in [*range(1, 60), *range(1, 30), 90, 700]] + [b"a" * 64, b"\xff\xc3"]
    encoder = bpe.Encoder()
    want = [encoder.merged(w) for w in words]
    assert encoder.encode_words(words) == want
    alone = []
    monkeypatch.setattr(encoder, "merged", lambda w: alone.append(w) or ours.merged(w))
    encoder.ordered = False
    assert encoder.encode_words(words) == want
    assert alone and all(len(w) > max(bpe.WIDTHS) for w in alone)


def test_cached_pieces_change_nothing(monkeypatch):
    texts = ["a few words, then more", "more words\nthen a \u2028 few", "it's  <|endoftext|> x" + "y" * 600]
    for encoder in (ours, theirs):
        for size in (0, 3, 100):
            monkeypatch.setattr(bpe, "CACHE", size)
            encoder.forget()
            for part in (texts, texts[::-1], texts[:1], texts):
                assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_batch(part)] == [ids(t) for t in part]


def test_every_entry_is_reached_by_merging_its_bytes():
    assert all(ours.merged(b) == [i] for b, i in list(ours.id_of.items())[::97])


def test_query_digest(spark):
    rows = bpe.digest(docs(spark)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is not None and r.doc_id != 3:
            want = ids(TEXTS[r.doc_id])
            assert r.n_tokens == len(want)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_encode_then_decode(spark):
    got = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs(spark).where("doc_id <> 3"))).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS) if i != 3}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.integers(0, 2**31))
def test_blocks_round_trip(values, low):
    stream = np.array([v if v % 7 == 0 else low + v % 50 for v in values], np.int64)
    blocks = tokenfile.pack(stream)
    got = tokenfile.unpack(blocks, [min(tokenfile.BLOCK, len(stream) - k * tokenfile.BLOCK) for k in range(len(blocks))])
    assert np.array_equal(np.concatenate(got) if got else np.empty(0), stream)


@pytest.mark.parametrize("shards", [1, 5])
def test_files_hold_all_documents_in_order(spark, tmp_path, shards):
    folder = f"file://{tmp_path}/tokens"
    manifest = tokenfile.write(docs(spark), folder, shards=shards)
    got = sorted(tokenfile.read(spark, folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted([*range(len(TEXTS)), 3])]
    at = 0
    for r in got:
        texts = ["no id"] if r.doc_id is None else [TEXTS[3], "tie"] if r.doc_id == 3 else [TEXTS[r.doc_id]]
        assert r.ids in [[*ids(t), tokenfile.END_ID] for t in texts]
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in tokenfile.read(spark, folder, manifest, digest=True).collect()}
    assert sums == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    assert not [p for p in tmp_path.rglob("*.part")]


@pytest.mark.parametrize("wide", [False, True])
def test_every_text_gets_its_end_id(wide):
    flat, ends = theirs.encode_texts(pa.array(TEXTS, pa.string()))
    got = tokenfile._ended(flat, ends, wide).to_pylist()
    assert [np.frombuffer(x, "<u4" if wide else "<u2").tolist() for x in got] == [[*ids(t), tokenfile.END_ID] for t in TEXTS]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digest(none).count() == tokenfile.digest(none).count() == 0


def test_packed_values_come_back():
    rng = np.random.default_rng(3)
    for w in range(0, 33):
        for n in (1, 7, 8, 9, 1024):
            v = rng.integers(0, 1 << w, (3, n))
            bodies = tokenfile.lay(v, w)
            assert bodies.shape == (3, (n * w + 7) // 8)
            assert (tokenfile.lift(bodies, n, w) == v).all()
            whole = [sum(int(x) << (w * k) for k, x in enumerate(row)) for row in v]
            assert [int.from_bytes(b.tobytes(), "little") for b in bodies] == whole


def test_a_task_that_runs_twice_changes_nothing(tmp_path):
    rows = pd.DataFrame({"doc_id": pd.array([1, None], "Int64"), "ids": [np.array([5, 2], "<u2").tobytes()] * 2, "wide": False, "shard": 0})
    first, second = (pd.concat(tokenfile._store(iter([rows]), f"file://{tmp_path}")).iloc[0] for _ in range(2))
    assert first.file != second.file and tuple(first[:3]) == tuple(second[:3]) == (0, 2, 4)
    assert [x.tolist() for _, _, ids in tokenfile.Reader(f"file://{tmp_path}/{first.file}").documents() for x in ids] == [[5, 2], [5, 2]]


def test_a_doc_id_of_many_rows_fills_several_shards(spark, tmp_path):
    texts = [f"text {k % 40}" for k in range(300)]
    d = spark.createDataFrame([(7 if k % 3 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    manifest = tokenfile.write(d, f"file://{tmp_path}", shards=8)
    assert max(m[1] for m in manifest) < 150
    got = sorted(tokenfile.read(spark, f"file://{tmp_path}", manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(7 if k % 3 else k for k in range(300))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
