import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from frameloom.llm import neardup


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def classes(texts):
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and alike(texts[i], texts[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def planted(rng, n, groups=12):
    """Prose without shared shingles, and copies of it with words replaced one after another."""
    word = lambda: "w%d" % rng.randrange(5000)
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([8, 64, 300]))]
        out.append(" ".join(base))
        for _ in range(n // groups):
            copy = list(base if rng.random() < 0.6 else out[-1].split())
            for _ in range(rng.randrange(0, 1 + len(copy) // 24)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy + [word()] * (rng.random() < 0.3)))
    return out + ["", " ", "A b", "a  B", "one two three four five", "One two three four five", "one two three four five six"]


def test_sets():
    texts = ["", "a b", "A  b\tc d e", "a b c d e a b c d e a b", "x " * 30]
    values, starts = neardup.shingle_sets(pa.array(texts))
    assert np.diff(starts).tolist() == [len(shingles(t)) for t in texts]
    keys = neardup.set_keys(*neardup.shingle_sets(pa.array(["A b c", "a\nb  c", "a b", "", " "])))
    assert keys[0] == keys[1] != keys[2] and keys[3] == keys[4]


def test_bands_find_pairs_at_the_least_similarity():
    rng = np.random.default_rng(3)
    for size in (9, 90):
        shared, own = size * 8 // 9, size // 9  # two sets of this size have a similarity of 0.8
        sets = []
        for _ in range(1500):
            v = rng.integers(0, 1 << 64, shared + 2 * own, np.uint64)
            sets += [np.sort(v[: shared + own]), np.sort(np.concatenate([v[:shared], v[shared + own :]]))]
        bands, bits, wide = neardup.signatures(np.concatenate(sets), np.arange(0, len(sets) * size + 1, size))
        assert (bands[::2] == bands[1::2]).any(axis=1).all()
        assert (np.bitwise_count(~(bits[::2] ^ bits[1::2])).sum(axis=1) >= neardup.AGREE).all()
        assert ((wide[::2] == wide[1::2]).sum(axis=1) >= neardup.AGREE_WIDE).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_keeps_one_of_planted_near_copies(spark, sf_dir, seed):
    texts = planted(random.Random(seed), 150)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1), (None, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(classes(texts)))


def test_tables_without_groups(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (None, "m")], "doc_id long, text string")
    assert neardup.keep_one(df).count() == 3 and neardup.keep_one(df.limit(0)).count() == 0


def test_fingerprints_are_majorities_of_shingle_hashes(spark):
    texts = ["", "a b", "the cat and the dog went to the old house", "x " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [r[f"w{k}"] % (1 << 64) for k in range(neardup.WORDS)] for r in neardup.prints_of(docs).collect()}
    values, starts = neardup.shingle_sets(pa.array(texts))
    for i in range(len(texts)):
        own = values[starts[i] : starts[i + 1]]
        for k, word in enumerate(got[i]):
            hashes = neardup._mix(own * neardup._M2 + np.uint64(k + 1)).tolist()
            assert word == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("n", [3, 40, 5000])
def test_index_links_what_lies_within_the_radius(spark, n):
    rng = np.random.default_rng(n)
    words = rng.integers(0, 1 << 64, (n, neardup.WORDS), np.uint64)
    for i in range(0, n, 3):  # copies of earlier ones with up to 40 bits changed, chains of them too
        bits = np.unpackbits(words[rng.integers(0, i + 1)].view(np.uint8))
        bits[rng.choice(256, rng.integers(1, 41), replace=False)] ^= 1
        words[i] = np.packbits(bits).view(np.uint64)
    rows = [(i, *map(int, w)) for i, w in enumerate(words.view(np.int64))]
    df = spark.createDataFrame(rows, ", ".join(["fp long", *[f"w{k} long" for k in range(neardup.WORDS)]]))
    found = [(r.u, r.v) for r in neardup.candidates(df, n).collect()]
    apart = np.stack([np.bitwise_count(words ^ w).sum(axis=1) for w in words])
    near, within = (np.argwhere(np.triu(apart <= most, 1)).tolist() for most in (40, neardup.RADIUS))

    def sets(*links):
        label = np.arange(n)
        for u, v in (x for some in links for x in some):
            label[label == label[u]] = label[v]
        return len(set(label.tolist()))

    assert sets(found, near) == sets(found) and sets(within, found) == sets(within)


def test_groups_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 4)
    texts = planted(random.Random(5), 150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == sorted(set(classes(texts)))


def test_a_set_moves_once_however_many_links_it_has(spark):
    rng = random.Random(8)
    base = ["w%d" % rng.randrange(5000) for _ in range(300)]
    texts = []
    for _ in range(600):
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(300)] = "w%d" % rng.randrange(5000)
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    kept = [r.doc_id for r in neardup.keep_one(docs).collect()]
    assert kept == [0]
    assert written() - before < 4 * sum(map(len, texts))
