import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import annsearch


def brute(rows, k, every=20):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            found = sorted((-float(np.dot(q, v)), j) for j, v in good if j != i)[:k]
            out[i] = [(j, -s) for s, j in found]
    return out


@pytest.mark.parametrize("n", [5, 300])
def test_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(30)]  # ties go to the smaller id
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0] * 7 + [None]), (1080, [1.0]), (1100, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in annsearch.nearest(df, F.col("vec_id") % 20 == 0, 20, block_bytes=8 * 8 * 100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute([r for r in rows if r[0] is not None], 20)
    assert set(got) == set(want)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.99
    for q in got:
        vectors = dict(rows)
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(float(np.dot(np.array(vectors[q], float), np.array(vectors[j], float))), abs=1e-12) for j, s in got[q])


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert annsearch.nearest(df, F.col("vec_id") % 20 == 0, 20).count() == 0
    df = spark.createDataFrame([(1, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert annsearch.nearest(df, F.col("vec_id") % 20 == 0, 20).count() == 0


def test_estimates_are_near_and_bounded():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(2000, 96))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centre, turn = v.mean(axis=0), annsearch.rotation(96)
    guess, off = annsearch.Codes(v, centre, turn).estimate(v[:50], centre, turn, 2.5)
    err = guess - v[:50] @ v.T
    assert abs(err.mean()) < 0.01
    assert (np.abs(err) <= off).mean() > 0.98


def test_rows_that_repeat(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows + rows + [rows[7]] * 500, "vec_id long, embedding array<double>").repartition(5)
    got = annsearch.nearest(df, F.col("vec_id") % 20 == 0, 20, block_bytes=8 * 8 * 16).orderBy("query_id", "rank").collect()
    want = brute(rows, 20)
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(q, k, j) for q in sorted(want) for k, (j, _) in enumerate(want[q], 1)]


def test_an_id_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = annsearch.nearest(df, F.col("vec_id") == 0, 20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 2.0), (0, 1, 1, 3.0), (0, 2, 1, 0.0), (0, 2, 1, 0.0)]


@pytest.mark.parametrize("dim", [64, 768])
def test_recall_at_the_production_bound(dim):
    """Recall of the search itself with its own parameters, on clustered vectors."""
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(40, dim))
    v = centres[rng.integers(0, 40, 6000)] + 0.7 * rng.normal(size=(6000, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, q = np.arange(6000), np.arange(0, 6000, 120)
    centre, turn = v.mean(axis=0), annsearch.rotation(dim)
    own, found, _ = annsearch.search_block(q, v[q], ids, annsearch.Codes(v, centre, turn), np.ascontiguousarray(v.T), 20, centre, turn, annsearch.EPSILON)
    scores = v[q] @ v.T
    scores[np.arange(len(q)), q] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(set(found[own == k]) & set(best[k])) / 20 for k in range(len(q))]) >= 0.99


def test_few_pairs_are_summed_in_order(monkeypatch):
    """Codes of 64 bits leave a great part of unclustered vectors to rerank; few of them are near the k-th."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[1000:1030] = v[7]  # ties go to the smaller id
    ids, q = np.arange(4000), np.append(np.arange(0, 4000, 100), 7)
    centre, turn, summed, plain = v.mean(axis=0), annsearch.rotation(64), [], annsearch.exact_scores
    monkeypatch.setattr(annsearch, "exact_scores", lambda a, b, x, y: (summed.append(len(x)), plain(a, b, x, y))[1])
    own, found, score = annsearch.search_block(q, v[q], ids, annsearch.Codes(v, centre, turn), np.ascontiguousarray(v.T), 20, centre, turn, annsearch.EPSILON)
    assert sum(summed) <= 50 * len(q)
    for k in range(len(q)):
        every = np.zeros(4000)
        for x, y in zip(v.T, v[q[k]], strict=True):
            every += x * y
        best = [j for j in np.lexsort((ids, -every)).tolist() if j != q[k]][:20]
        assert found[own == k].tolist() == best and score[own == k].tolist() == every[best].tolist()


@pytest.mark.parametrize("blocks", [1, 6, 100])
def test_blocks_have_partitions_of_their_own(spark, blocks):
    names = annsearch.block_names(spark, blocks)
    df = spark.createDataFrame([(x,) for x in names], "block int").repartition(blocks, "block")
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() == len(set(names)) == blocks
