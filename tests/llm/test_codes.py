"""BPE round trips and token shards against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hitwatch.llm import bpe, common, tokenstore

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def coder():
    return bpe.Codec(BYTE)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.text(alphabet=" \n\ta'b,.é1<|>", max_size=80))
def test_any_text_is_coded_like_the_library(a, b):
    coder, lib = bpe.codec(BYTE), library(BYTE)
    for text in (a, b, (a + " word " + b) * 90):
        ids = list(coder.encode(text))
        assert ids == ids_of(lib, text) and coder.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_chunks_are_shared_and_joined_exactly(coder):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    passage = " ".join(words)
    lib, before = library(BYTE), coder.reused
    for head in ("", "Another start. ", "x" * 700 + " "):
        text = head + passage + head
        assert list(coder.encode(text)) == ids_of(lib, text)
    assert coder.reused - before > 30  # cuts depend on content, so the passage's chunks come back


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 6000, "a b " * 9000, "word\n" * 9000, "é" * 9000, "it's 's  's " * 2000, "<|endoftext|>" * 50])
def test_texts_without_certain_borders(coder, text):
    lib = library(BYTE)
    assert list(coder.encode(text)) == ids_of(lib, text)


@pytest.mark.parametrize("odd", ["ё", "😀", "<|endoftext|>", " <|endoftext|> ", "\u0e01\u0e33", "\U0001f468\u200d\U0001f469", "\x1c", "\u2003x", "a\u0301"])
def test_odd_runs_are_cut_out_of_long_texts(coder, odd):
    rng, lib = random.Random(odd), library(BYTE)
    words = ["".join(rng.choice("abcde,'é1") for _ in range(rng.randrange(1, 8))) for _ in range(3000)]
    for gap in (1, 40, 1500):
        text = " ".join(w + (odd if i % gap == 0 else "") for i, w in enumerate(words))
        for t in (text, odd + text + odd, text.replace(" ", "  ", 50)):
            before = coder.made + coder.reused
            ids = list(coder.encode(t))
            assert ids == ids_of(lib, t) and coder.decode(ids) == lib.decode(ids, skip_special_tokens=False)
            assert gap < 1500 or coder.made + coder.reused > before  # the rest still goes by chunks


def test_a_window_widens_until_its_outer_words_agree(coder):
    rng, lib = random.Random(5), library(BYTE)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    left, right = " ".join(words[:200]), " " + " ".join(words[200:])
    a, b = (bpe.Chunk(t, bpe.array("I", coder.ranked.encode_ordinary(t)), coder.sizes) for t in (left, right))
    at, ids = coder.window(a, b)
    assert at == 1
    spoiled = bpe.Chunk(left, bpe.array("I", a.ids), coder.sizes)
    spoiled.borders(coder.sizes, bpe.BORDERS)
    for i in range(spoiled.tail[2][1], spoiled.tail[0][1]):  # the words between the first three borders do not agree
        spoiled.ids[i] ^= 1
    at, ids = coder.window(spoiled, b)
    assert at == 3
    whole = spoiled.ids[: spoiled.tail[at][1]] + ids + b.ids[b.head[at][1] :]
    assert list(whole) == ids_of(lib, left + right)


def test_cuts_cover_a_text_and_move_with_it():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefg ") for _ in range(60_000))
    ends = bpe.cuts(text)
    assert ends[-1] == len(text) and all(b - a <= bpe.MOST for a, b in zip([0, *ends], ends, strict=False))
    moved = bpe.cuts("zz" + text)
    assert len(set(ends) & {e - 2 for e in moved}) > 0.8 * len(ends)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 20_000)
    coder, lib, rng = bpe.Codec(BYTE), library(BYTE), random.Random(3)
    for _ in range(20):
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(2000))
        assert list(coder.encode(text)) == ids_of(lib, text)
    assert coder.held <= 20_000 + 60_000


def test_other_tokenizers_go_through_the_library(odd_docs):
    coder, lib = bpe.Codec(WORD), library(WORD)
    assert list(coder.encode("Some Words")) == ids_of(lib, "Some Words")


def test_round_trip_of_odd_documents(odd_docs, no_docs):
    lib = library(BYTE)
    got = bpe.digests(bpe.round_trip(odd_docs, BYTE, batch_bytes=1000)).collect()
    want = []
    for r in odd_docs.collect():
        ids = ids_of(lib, r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.round_trip(no_docs, BYTE).count() == 0


def test_encoder_and_decoder_columns(odd_docs):
    lib = library(BYTE)
    coded = odd_docs.select("doc_id", "text", bpe.encoder(BYTE).alias("codes"))
    for r in coded.withColumn("back", bpe.decoder(BYTE, "codes")).collect():
        assert r["codes"] == ids_of(lib, r["text"]) and r["back"] == lib.decode(r["codes"], skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aB é,.'s1²\n\t\x1c\xa0<|>", max_size=60)), min_size=1, max_size=6))
def test_words_are_coded_like_the_library(texts):
    own, lib = tokenstore.words(WORD), library(WORD)
    ids, counts = own.encode(pa.array(texts, pa.string()))
    want = [ids_of(lib, t) for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano(values):
    values.sort()
    packed = tokenstore.EliasFano.of(np.array(values, "u8"))
    back, used = tokenstore.EliasFano.read(memoryview(packed.to_bytes()))
    assert used == len(packed.to_bytes()) and back.all().tolist() == values
    assert [back.select(i) for i in range(len(values))] == values
    for first in range(0, len(values), 37):
        for count in (0, 1, 40, 300):
            count = min(count, len(values) - first)
            assert back.run(first, count).tolist() == values[first : first + count]
    with pytest.raises(IndexError):
        back.select(len(values))


def test_elias_fano_is_small():
    values = np.arange(0, 3_000_000, 300, dtype="u8")
    assert len(tokenstore.EliasFano.of(values).to_bytes()) * 8 / len(values) < 12


def test_shards_of_odd_documents(spark, odd_docs, no_docs):
    lib = library(WORD)
    folder = common.scratch(spark, "test-tokens")
    manifest = tokenstore.write(odd_docs, folder, WORD, shard_ids=2000)
    got = tokenstore.read(spark, folder, manifest).orderBy("start").collect()
    rows = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))  # rows of one id have one text here
    start = 0
    for g, r in zip(got, rows, strict=True):
        ids = [*ids_of(lib, r["text"]), 1]
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert manifest.count() > 1
    other = common.scratch(spark, "test-tokens")
    assert tokenstore.read(spark, other, tokenstore.write(no_docs, other, WORD)).count() == 0


def test_shard_gives_single_documents():
    ids = np.arange(10, dtype="<u2")
    shard = tokenstore.Shard(tokenstore.pack([None, -5, 7, 7], np.array([1, 4, 0, 5]), ids))
    assert [shard.doc_ids(a, 2) for a in range(3)] == [[None, -5], [-5, 7], [7, 7]]
    assert shard.doc_ids() == [None, -5, 7, 7] and shard.tokens(1).tolist() == [1, 2, 3, 4] and shard.tokens(2).tolist() == []
    with pytest.raises(ValueError, match="shard"):
        tokenstore.Shard(b"\0" * 200)
