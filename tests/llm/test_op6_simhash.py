import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from frameloom.llm import simhash
from frameloom.llm.components import components


def fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def classes(values, most=2):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


TEXTS = ["", " ", "One", "one two", "a b c", "A  b\tc\n", "É a b c d é", "x " * 5000, "the cat\x0bsat\x0con the mat", " nbsp a", "\x1c a b c", "a b c d e f g"]


def test_fingerprints():
    got = simhash.fingerprints_of(pa.array(TEXTS))
    assert got.tolist() == [fingerprint(t) for t in TEXTS]
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    assert simhash.fingerprints_of(pa.array(["b", long, "c"])).tolist()[0::2] == [fingerprint("b"), fingerprint("c")]
    assert int(simhash.fingerprints_of(pa.array([long]))[0]) == int(simhash.fingerprints_of(pa.array(["a", long]))[1])


def near_values(n, seed, centres=6):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        v = rng.choice(base)
        for _ in range(rng.randint(0, 6)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("n", [2, 17, 200, 900])
def test_index_finds_all_links(n):
    values = near_values(n, n)
    index = simhash.GrayIndex(np.array(values, np.uint64))
    found = {tuple(sorted((int(index.members[a]), int(index.members[b])))) for q, c in index.links(2) for a, b in zip(q, c, strict=True)}
    assert found == {(a, b) for i, b in enumerate(values) for a in values[:i] if (a ^ b).bit_count() <= 2}


def test_gray_ranks():
    x = np.arange(1 << 12, dtype=np.uint64)
    assert (simhash.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


@pytest.mark.parametrize("members", [2048, 20])
def test_classes_with_large_nodes_factored(spark, monkeypatch, members):
    monkeypatch.setattr(simhash, "GROUP_MEMBERS", members)
    values = near_values(500, 5, 3)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    roots = {r.u: r.root for r in components(edges).collect()}
    group = classes(values)
    got = [roots.get(v, v) for v in signed]
    assert len(set(zip(got, group, strict=True))) == len(set(got)) == len(set(group))


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(200 + i, 200) for i in range(50)] + [(7, 7), (1, 2), (2, 1)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {200 + i: 200 for i in range(1, 50)} | {2: 1}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) for _ in range(rng.randint(0, 5))) for _ in range(150)] + [None, "", "AB cd"]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)] + [(150, None, "y", 0), (3, texts[3], "x", 0), (None, "zz zz zz zz", "n", 0), (None, texts[4], "n", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, fp int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = sorted({fingerprint(r[1]) for r in rows})
    group = dict(zip(prints, classes(prints), strict=True))
    least = {}
    for i, t, *_ in rows:
        g = group[fingerprint(t)]
        least[g] = min(x for x in (least.get(g), i) if x is not None) if (least.get(g) is not None or i is not None) else None
    for r in got:
        assert r.component_id == least[group[r.fp % (1 << 64)]]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert len(kept.collect()) == len(set(group.values()))
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0
