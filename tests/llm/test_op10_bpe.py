import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from frameloom.llm import bpe, tokenbin

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.TrieEncoder(f.read())


def encode(own, text):
    ids = own.encode_texts(pa.array([text]))
    return np.frombuffer(ids[0].as_py(), "<u4").tolist(), own.decode_texts(ids)[0].as_py()


def same(own, text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert encode(own, text) == (want, LIBRARY.decode(want, skip_special_tokens=False)), repr(text)


PARTS = ["a", "e", "th", "ing", "'s", "'LL", "!", "!!", "é", "é", "É", "ß", "Σ", "ΑΣ", "İ", " ", "\n", "9", "½", "٣", "日本", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>x", "\x00", "\x1c", "\x85", "​", "😀", "a" * 70, "____", "-", "<", "|>", "the", "of", "﻿", "ﬁ", "Ⅷ", "²"]


def test_mixed_texts(own):
    rng = random.Random(5)
    for _ in range(1500):
        same(own, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz", max_size=40))
def test_words(text):
    same(bpe.encoder(open(PATH, encoding="utf-8").read()), text)


def test_every_token_and_pairs(own):
    rng = random.Random(6)
    tokens = [t.replace("</w>", "") for t in rng.sample(own.text, 1500)]
    byte_of = {c: b for b, c in enumerate(bpe.byte_letters())}
    for a, b in zip(tokens, tokens[1:], strict=False):
        same(own, bytes(byte_of[c] for c in a + b).decode("utf-8", "ignore"))


def test_small_caches_change_nothing(own, monkeypatch):
    for name in ("_KEPT_PAIRS", "_KEPT_MOVES"):
        monkeypatch.setattr(bpe, name, 5)
    with open(PATH, encoding="utf-8") as f:
        other = bpe.TrieEncoder(f.read())
    other.encode_texts._keep = 3
    for text in ("the quick brown fox", "jumping over internationalisation", "the quick unbelievable <|endoftext|>", "the <|endoftext|>!"):
        same(other, text)
    assert len(other.encode_texts._words) == 3


def test_every_code_point(own):
    """Each code point between letters, alone and after another word, through both encoders."""
    with open(PATH, encoding="utf-8") as f:
        files = tokenbin._encoder(f.read())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}B {chr(c)}" for c in points[at : at + 200]) for at in range(0, len(points), 200)]
    for encode, upto in ((own.encode_texts, len(texts)), (files, 100)):  # one splitter; the blocks that have a path of their own go through both
        want = [e.ids for e in LIBRARY.encode_batch_fast(texts[:upto], add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(pa.array(texts[:upto])).to_pylist()] == want


def test_unknown_ids_are_left_out(own):
    ids = pa.array([np.array([320, 10**6, 49407], "<u4").tobytes(), None, b""], pa.binary())
    assert own.decode_texts(ids).to_pylist() == [f"{own.token[320]} {own.token[49407]}", "", ""]


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y"), (2, None, None, "y")], "doc_id long, text string, c1 string, ids string")
    out = bpe.encode(df, PATH, keep=["doc_id", "c1", "text"], decoded=True)
    assert out.columns == ["doc_id", "c1", "text", "ids", "decoded"]
    assert [(r.doc_id, r.c1, r.text, r.decoded) for r in out.collect()] == [(1, "x", "a b", "a</w> b</w>"), (2, None, None, "")]


def test_another_kind_of_file_is_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises((ValueError, KeyError, TypeError)):
        bpe.TrieEncoder(f.read())


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "Hello <|endoftext|> world", "x"), (3, " \n ", "x"), (4, "internationalisation " * 20_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(df, PATH, keep=["doc_id"], decoded=True).collect()
    for (i, t, _), r in zip(rows, out, strict=True):
        want = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert r.doc_id == i and np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == LIBRARY.decode(want, skip_special_tokens=False)
    back = bpe.decode(bpe.encode(df, PATH, keep=["doc_id"]), PATH, keep=["doc_id"]).collect()
    assert [b.decoded for b in back] == [r.decoded for r in out]
    assert bpe.encode(df.limit(0), PATH, keep=["doc_id"]).count() == 0
