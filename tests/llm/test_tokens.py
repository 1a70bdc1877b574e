"""Token counts and the BPE codec against their libraries."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm.chunk_bpe import UNUSUAL, ChunkCodec, bpe_decode, bpe_digests, bpe_encode, codec, cuts
from colloquy.llm.queries import QUERIES
from colloquy.llm.token_counts import MARK, PieceCounter, byte_lengths, check_model, portions, token_counts

ODD = [" ", "\n", "\t", "▁", "a", "b", "ab", "the", "ing", "<s>", "</s>", "<0x0A>", "é", "梦", "🙂", "\0", "\x85", "　", "'", "'ll", "l", "1", "२", "!", "<|endoftext|>", "<|end", "\U00010940", "՘", "ﬁ", "\r\n"]


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def counter():
    return PieceCounter(P.path("piece_bpe_32k.model"))


def odd_texts(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_counts_equal_the_library(counter, sp):
    texts = [*odd_texts(3000, 40, 1), "", "a" * 5000, "ab" * 3000, " " * 777, "\n" * 99, "the" * 2000, "abcabcab" * 500, "x" * 3 + " " * 5]
    assert [counter.count([t])[0] for t in texts] == [len(sp.encode(t)) for t in texts]
    assert counter.count([None]) == [0]


def test_long_pretokens(counter, sp):
    """By lists of places: the same counts, and time in proportion."""
    texts = [t for t in odd_texts(400, 60, 3) if t] + ["a" * 501, "ab" * 300, "abcabcab" * 50]
    cut = [w for t in texts for w in counter.split(MARK + t.replace(" ", MARK))]
    assert [counter.merge_long(w) for w in cut] == counter.merge(cut).tolist()
    rng = random.Random(8)
    long = ["".join(rng.choice("abcdefghijklmnop é梦") for _ in range(20_000)), "".join(rng.choice("etaoinshrdlu") for _ in range(400_000)), "qu" * 5000, " " * 5000, "x" * 2000 + " y"]
    start = time.perf_counter()
    want = [len(sp.encode(t)) for t in long]
    half = time.perf_counter()
    assert [counter.count([t])[0] for t in long] == want
    assert time.perf_counter() - half < 5 + 20 * (half - start)


def test_models_that_change_texts_are_refused():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    check_model(data)
    for more in (b"\x12\x02\x18\x01", b"\x1a\x02\x18\x00", b"\x1a\x02\x20\x01", b"\x1a\x06\x12\x02ab\x20\x00", b"\x12\x05\x18\x02\xc0\x01\x01"):
        with pytest.raises(ValueError):
            check_model(data + more)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_counts_as_in_the_library(text):
    import sentencepiece

    global _SP, _C
    if "_SP" not in globals():
        _SP, _C = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), PieceCounter(P.path("piece_bpe_32k.model"))
    assert _C.count([text]) == [len(_SP.encode(text))]


def test_portions_cover_everything_once():
    texts = pa.array(["x" * n for n in (5, 0, 9, 30, 1, 1)] + [None, "é"])
    lengths = byte_lengths(texts)
    assert lengths == [5, 0, 9, 30, 1, 1, 0, 2]
    got = list(portions(lengths, 10))
    assert [n for s in got for n in lengths[s]] == lengths and len(got) == 4 and list(portions([], 10)) == []


def test_token_counts_of_rows(spark, sp):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "y"), (3, "", None), (None, "é" * 9000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, P.path("piece_bpe_32k.model")).collect())
    n = len(sp.encode("é" * 9000))
    assert got == [(0, 18000, n, n > 4096), (1, 3, 2, False), (1, 3, 2, False), (2, 0, 0, False), (3, 0, 0, False)]
    assert token_counts(df.limit(0), P.path("piece_bpe_32k.model")).count() == 0


@pytest.fixture(scope="module")
def bpe():
    return codec(P.path("byte_bpe_50k.json"))


def test_ids_equal_the_library(bpe):
    texts = [*odd_texts(2000, 600, 2), "", "a" * 5000, " " * 3000 + "x", "\n" * 500, "x'll " * 400, "'l" * 300]
    lib = [np.array(e.ids, "<u4").tobytes() for e in bpe.lib.encode_batch(texts, add_special_tokens=False)]
    assert bpe.encode(texts) == lib
    assert [bpe.decode(x) for x in lib] == [bpe.lib.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in lib] == texts


def test_chunks_are_shared_whatever_stands_before(bpe):
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000))
    a, b = [passage[x:y] for x, y in zip([0, *cuts(passage)], cuts(passage), strict=False)], "Other start. " + passage
    chunks = {b[x:y] for x, y in zip([0, *cuts(b)], cuts(b), strict=False)}
    assert sum(c in chunks for c in a) > 0.8 * len(a) > 8


def test_passages_of_other_texts_are_not_encoded_again(monkeypatch):
    """A chunk's ids are remembered: of a passage that another text had, only the chunk around its start is new."""
    c = ChunkCodec(P.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000))
    seen = []
    words_ids = c.words_ids
    monkeypatch.setattr(c, "words_ids", lambda words: seen.extend(words) or words_ids(words))
    want = [np.array(e.ids, "<u4").tobytes() for e in c.lib.encode_batch([passage, "It begins. " + passage], add_special_tokens=False)]
    assert c.encode([passage]) == want[:1]
    first = sum(map(len, seen))
    seen.clear()
    c.ids.clear()  # without any pre-token remembered
    assert c.encode(["It begins. " + passage]) == want[1:]
    assert sum(map(len, seen)) < 0.1 * first
    assert all(len(x.ids) % 4 == 0 and isinstance(x.ids, bytes) for x in c.chunks.values())


def test_texts_without_spaces_take_linear_time(bpe):
    """A pre-token over many chunks is put off until it has doubled."""
    rng = random.Random(7)
    took = []
    for n in (100_000, 800_000):
        text = "".join(rng.choice("abcdefgh") for _ in range(n))
        start = time.perf_counter()
        got = bpe.encode([text, text + " end of it"])
        took.append(time.perf_counter() - start)
        assert got[0] == np.array(bpe.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert bpe.decode(got[1]) == text + " end of it"
    assert took[1] < 30 * took[0]


def test_query_on_the_documents(spark, bpe, sp):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = {k: bpe.lib.encode(t, add_special_tokens=False).ids for k, t in docs.items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_bpe_codec"](spark, SMALL).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {k: (len(x), sha(np.array(x, "<u4").tobytes()), sha(bpe.lib.decode(x, skip_special_tokens=False).encode())) for k, x in ids.items()}
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op1_token_counts"](spark, SMALL).collect()}
    assert counts == {k: (len(t.encode()), n := len(sp.encode(t)), n > 4096) for k, t in docs.items()}


def test_usual_characters_split_as_in_the_library(bpe):
    for low in range(0, 0xA800, 1024):
        usual = [chr(c) for c in range(low, low + 1024) if not UNUSUAL.search(chr(c))]
        s = "".join(f"a{c}a1{c}1 {c}{c}! {c}  {c}!" for c in usual)
        assert bpe.usual(s) == [s[x:y] for _, (x, y) in bpe.lib.pre_tokenizer.pre_tokenize_str(s)]


def test_codec_of_rows(spark, bpe):
    rows = [(1, "Hello there"), (1, "Hello there"), (2, None), (3, "<|endoftext|> x"), (None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = P.path("byte_bpe_50k.json")
    back = bpe_decode(bpe_encode(df, path), path)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t in rows)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_digests(df, path).collect()}
    ids = bpe.lib.encode("<|endoftext|> x", add_special_tokens=False).ids
    assert got[3] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(b"<|endoftext|> x").hexdigest())
    assert got[2][0] == 0 and bpe_digests(df.limit(0), path).count() == 0
