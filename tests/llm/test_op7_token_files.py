import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from frameloom.llm import tokenbin

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_round_trip(ids):
    v = np.array(ids, np.uint64)
    words, offsets, wide = tokenbin.pack(v)
    assert tokenbin.unpack(words, offsets, wide, len(v)).tolist() == ids
    docs, counts, back = tokenbin.from_bytes(tokenbin.to_bytes([5, None], np.array([len(ids), 0]), v))
    assert docs == [5, None] and counts.tolist() == [len(ids), 0] and back.tolist() == ids


@pytest.mark.parametrize("n", [1023, 1024, 1025, 5000])
def test_blocks_decode_on_their_own(n):
    rng = np.random.default_rng(n)
    v = rng.integers(0, 50_000, n, dtype=np.uint64)
    v[rng.integers(0, n, n // 2)] = 1
    v[rng.integers(0, n, 5)] = (1 << 64) - 1
    words, offsets, wide = tokenbin.pack(v)
    for b in range(len(offsets) - 1):
        s, e = offsets[b], offsets[b + 1]
        own = v[b * 1024 : (b + 1) * 1024]
        assert (tokenbin.unpack(words[s:e], offsets[b : b + 2] - s, wide, len(own)) == own).all()


def test_words_hold_as_many_ids_as_fit():
    words, _, _ = tokenbin.pack(np.ones(60, np.uint64))
    assert len(words) == 1 and int(words[0]) >> 60 == 1
    words, _, _ = tokenbin.pack(np.array([1 << 29, 1 << 29, (1 << 60) - 1, 1 << 60], np.uint64))
    assert [int(w) >> 60 for w in words] == [13, 14, 0]


def test_documents(spark, monkeypatch, tmp_path):
    texts = ["Hello the world's  end", None, "", "é" * 3 + "\n<|endoftext|> ABC 12", "x " * 20_000, "naïve   don't", "Hello the world's  end"]
    rows = [((i * 7) % 11, t, "en", 1) for i, t in enumerate(texts)] + [(None, "no id", "en", 1), (0, "again", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, start int")
    folder = f"file://{tmp_path}/ids"
    manifest = tokenbin.write(df, PATH, folder)
    got = tokenbin.read(spark, folder, manifest, with_ids=True).orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x))
    at, left = 0, {}
    for i, t, *_ in rows:
        left.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        left[r.doc_id].remove(ids)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(bytes(r.ids)))
        at += len(ids)
    assert sum(f["docs"] for f in manifest.collect()) == len(rows)
    assert tokenbin.write_and_read(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        tokenbin.from_bytes(b"something else" * 10)


def test_many_files_keep_the_order(spark, monkeypatch):
    df = spark.range(500).selectExpr("id AS doc_id", "concat('word ', id, repeat(' the end', cast(id % 9 AS int))) AS text").repartition(5)
    got = tokenbin.write_and_read(df, PATH).orderBy("doc_id").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
