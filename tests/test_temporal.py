import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom.functions import scalars
from frameloom.operators import models, temporal
from frameloom.streaming.series import DepthWindowCore, Signature


def chain_model(windows):
    """Sequential alignment and blending with plain arrays: windows[k] is [32, cells]."""
    ref, out = None, {}
    total = len(windows)
    for k, d in enumerate(windows):
        if k == 0:
            ref = [d[0], d[12]]
        else:
            a = np.concatenate([d[0], d[1]])
            m = np.stack([a, np.ones_like(a)], axis=1)
            scale, shift = np.linalg.lstsq(m, np.concatenate(ref), rcond=None)[0]
            d = np.maximum(0, d * scale + shift)
            ref = [ref[0], d[12]]
            for i in range(8):
                out[22 * (k - 1) + 24 + i] = out[22 * (k - 1) + 24 + i] * (1 - i / 7) + d[2 + i] * (i / 7)
        for p in range(10 if k else 0, 32 if k == total - 1 else 32):
            out[22 * k + p] = d[p]
    return out


@pytest.mark.parametrize("n", [1, 22, 23, 32, 33, 45, 97])
def test_alignment_chain_equals_a_sequential_model(spark, n):
    rng = np.random.default_rng(n)
    base = rng.uniform(0.2, 1, size=(n, 4))
    rows = [(i, base[i].tolist()) for i in range(n)]
    frames = spark.createDataFrame(rows, "frame_idx long, d array<double>")
    wins = temporal.hop_windows(frames, [], "frame_idx", ["d"]).withColumn("d", F.transform("d", lambda v: v * (1 + F.col("window") / 5) + F.col("window") / 9))
    got = temporal.blend_windows(wins, [], "frame_idx", "d", temporal.align_chain(wins, [], "d")).collect()
    windows = [np.stack([base[min(22 * k + p, n - 1)] * (1 + k / 5) + k / 9 for p in range(32)]) for k in range((n - 1) // 22 + 1)]
    want = chain_model(windows)
    assert sorted(r.frame_idx for r in got) == list(range(n))
    assert all(np.allclose(r.d, want[r.frame_idx], atol=1e-9) for r in got)
    core, streamed = DepthWindowCore(lambda w: w * (1 + core.window / 5) + core.window / 9), {}
    for at in range(0, n, 13):
        streamed |= dict(core.push(list(base[at : at + 13]), at + 13 >= n))
    assert sorted(streamed) == list(range(n))
    assert all(np.allclose(streamed[i], want[i], atol=1e-9) for i in range(n))


@pytest.mark.parametrize(
    ("n", "batch", "counts"),
    [(22, 44, [22]), (23, 44, [23]), (33, 44, [33]), (33, 32, [24, 9]), (44, 44, [44]), (44, 32, [24, 20]), (45, 44, [24, 21]), (54, 44, [24, 30]), (88, 44, [24, 64]), (88, 32, [24, 22, 42]), (132, 44, [24, 44, 64]), (132, 32, [24, 22, 22, 44, 20])],
)
def test_frames_come_out_when_they_are_final(n, batch, counts):
    core = DepthWindowCore(lambda w: w)
    got = [core.push([np.array([float(i)]) for i in range(at, min(n, at + batch))], at + batch >= n) for at in range(0, n, batch)]
    assert [len(g) for g in got] == counts
    assert [i for g in got for i, _ in g] == list(range(n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=6))
def test_batches_dont_change_the_windows(sizes):
    n = sum(sizes)
    frames = [np.array([np.sin(i), i / n]) for i in range(n)]
    once = dict(DepthWindowCore(np.abs).push(frames, True))
    core, at, parts = DepthWindowCore(np.abs), 0, {}
    for k, size in enumerate(sizes):
        parts |= dict(core.push(frames[at : at + size], k == len(sizes) - 1))
        at += size
    assert sorted(parts) == sorted(once) == list(range(n))
    assert all(np.allclose(parts[i], once[i]) for i in once)


def test_emission_weights_sum_to_one(spark):
    df = spark.range(1000).select("id", F.explode(temporal.emission(F.col("id"))).alias("e"))
    assert df.groupBy("id").agg(F.sum("e.weight").alias("w")).where("abs(w - 1) > 1e-12").count() == 0
    assert df.where("e.place < 0 OR e.place > 31 OR e.window * 22 + e.place <> id").count() == 0


def series(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, v double")


def test_densify_counts_and_holds(spark):
    dense = lambda values, m, **how: [r.v for r in temporal.densify(series(spark, values), [], "idx", "v", m, **how).orderBy("out_idx").collect()]
    assert dense(range(7), 4) == pytest.approx([min(k / 4, 6.0) for k in range(28)])
    assert len(dense(range(7), 4, tail=False)) == 25
    assert dense(range(3), 1) == [0.0, 1.0, 2.0]
    cut = series(spark, [0, 0.1, 1, 0.9]).withColumn("cut", F.col("idx") == 1)
    got = [r.v for r in temporal.densify(cut, [], "idx", "v", 2, cut="cut", tail=False).orderBy("out_idx").collect()]
    assert got == pytest.approx([0, 0.05, 0.1, 0.1, 1, 0.95, 0.9])
    with pytest.raises(ValueError):
        temporal.densify(cut, [], "idx", "v", 17)


def test_cadence(spark):
    cases = [(24, 120, 5, 120), (30, 120, 4, 120), (60, 120, 2, 120), (23.976, 120, 5, 119.88), (119.88, 120, 1, 119.88), (120, 120, 1, 120), (120.006, 120, 1, 120.006), (100, 120, None, None), (240, 120, None, None), (0, 120, None, None)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b, _, _ in cases], "s double, t double")
    got = df.select(scalars.cadence(F.col("s"), F.col("t")).alias("c")).collect()
    for row, (_, _, m, fps) in zip(got, cases, strict=True):
        assert row.c.multiplier == m
        assert row.c.fps == (pytest.approx(fps) if fps else None)
        assert (row.c.problem is None) == (m is not None)
    with pytest.raises(Exception, match="multiplier"):
        df.select(scalars.strict_cadence(F.col("s"), F.col("t")).alias("c")).select("c.multiplier").collect()


def test_recursions_restart_by_stream_and_cut(spark):
    rows = [("a", i, float(v), float(v) + 1, c) for i, (v, c) in enumerate([(0, False), (1, False), (5, True), (6, False)])] + [("b", 0, 9.0, 10.0, False)]
    df = spark.createDataFrame(rows, "s string, i long, low double, high double, cut boolean")
    got = {(r.s, r.i): r.norm_low for r in temporal.smooth_bounds(df, ["s"], "i", ema=0.5).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0.5, ("a", 2): 5, ("a", 3): 5.5, ("b", 0): 9}
    mixed = temporal.stabilise(df, ["s"], ["i"], "low", stability=0.5, threshold=3).orderBy("s", "i").collect()
    assert [r.stable for r in mixed] == [0, 0.5, 5, 5.5, 9]


def test_flat_frames_keep_their_bounds_apart(spark):
    df = spark.createDataFrame([(0, y, x, 0.5) for y in range(4) for x in range(4)], "f long, y long, x long, v double")
    row = temporal.percentile_bounds(df, ["f"], "v", size=(4, 4)).first()
    assert row.high - row.low == pytest.approx(1e-6)


def test_degenerate_least_squares(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 4.0), (2, 1.0, 2.0), (2, 2.0, 4.0)], "g long, p double, t double")
    got = {r.g: (r.scale, r["shift"]) for r in temporal.least_squares(df, ["g"], "p", "t").collect()}
    assert got[1] == (1, 0) and got[2] == pytest.approx((2, 0))


def test_models(spark):
    assert models.call_pair(lambda a, b, t: a + b, 1, 2, 0.5, {}) == 3
    with pytest.raises(ValueError):
        models.run_backend(lambda f, m: f, np.zeros((3, 1)), 2)
    with pytest.raises(ValueError):
        models.register(models.DEPTH, "luma", models.luma_depth)
    pairs = spark.createDataFrame([([0.0, 2.0], [2.0, 4.0], 0.25), ([1.0], None, 0.5)], "a array<double>, b array<double>, t double")
    assert [r.value for r in models.apply_pairs(pairs, "a", "b", "t", models.linear).collect()] == [[0.5, 2.5], [1.0]]
    rgb = pd.DataFrame({"s": ["x"] * 2, "window": [0, 0], "place": [1, 0], "rgb": [[1.0] * 12, [0.5] * 12]})
    out = models.apply_windows(spark.createDataFrame(rgb), ["s"], "rgb", (2, 2), models.luma_depth).orderBy("place").collect()
    assert out[0].depth == pytest.approx([0.5] * 4) and out[1].depth == pytest.approx([1.0] * 4)


def test_signatures():
    assert Signature("a").carries_on("a")
    assert not Signature("a", "new").carries_on("b")
    with pytest.raises(ValueError):
        Signature("a").carries_on("b")


def test_null_keys_are_a_stream(spark):
    rows = [(None, i, float(i > 0), 2.0, False) for i in range(3)] + [("b", 0, 9.0, 9.5, False)]
    df = spark.createDataFrame(rows, "s string, i long, low double, high double, cut boolean")
    assert [r.norm_low for r in temporal.smooth_bounds(df, ["s"], "i", ema=0.5).orderBy("s", "i").collect()] == [0, 0.5, 0.75, 9]
    assert [r.stable for r in temporal.stabilise(df, ["s"], ["i"], "low", stability=0.5, threshold=3).orderBy("s", "i").collect()] == [0, 0.5, 0.75, 9]
    numbered = df.selectExpr("CAST(NULL AS bigint) AS s", "i", "low").where("high = 2")
    assert [r.stable for r in temporal.stabilise(numbered, ["s"], ["i"], "low", stability=0.5, threshold=3).orderBy("i").collect()] == [0, 0.5, 0.75]


def test_bounds_in_blocks_equal_a_loop(spark, monkeypatch):
    """Blocks of blocks: the same averages as one after another, wherever cuts and blocks begin."""
    monkeypatch.setattr(temporal, "BLOCK", 4)
    rng = np.random.default_rng(8)
    rows = [(s, i, float(v), float(v + w), bool(c)) for s, n in (("a", 300), ("b", 17), (None, 1)) for i, (v, w, c) in enumerate(zip(rng.normal(size=n), rng.random(n), rng.random(n) < 0.05, strict=True))]
    df = spark.createDataFrame(rows, "s string, i long, low double, high double, cut boolean").repartition(3)
    got = {(r.s, r.i): (r.norm_low, r.norm_high) for r in temporal.smooth_bounds(df, ["s"], "i", ema=0.9).collect()}
    held, before = None, object()
    for s, i, low, high, cut in rows:
        held = (low, high) if s != before or cut else tuple(0.9 * a + (1 - 0.9) * b for a, b in zip(held, (low, high), strict=True))
        before = s
        assert got[s, i] == pytest.approx(held, rel=1e-12, abs=1e-12)
    alone = temporal.smooth_bounds(df.where("s = 'a'"), [], "i", ema=0.9).collect()
    assert len(alone) == 300 and all((r.norm_low, r.norm_high) == pytest.approx(got["a", r.i]) for r in alone)


def test_counted_on_the_way(spark):
    df, seen = temporal.counted(spark.range(50))
    assert df.where("id < 10").count() == 10 and temporal.verify(seen, 50) == 50
    with pytest.raises(ValueError):
        temporal.verify(seen, 51)


def test_proxies_find_cuts(spark):
    rng = np.random.default_rng(2)
    base = rng.random((12, 16, 3))
    frames = [base, base + 0.01, 1 - base, 1 - base]
    rows = [(f, y, x, *map(float, v[y, x])) for f, v in enumerate(frames) for y in range(12) for x in range(16)]
    df = spark.createDataFrame(rows, "f long, y long, x long, r double, g double, b double")
    proxy = temporal.luma_proxy(df, ["f"], ["r", "g", "b"], (12, 16), to=(3, 4))
    grey = [v @ [0.2126, 0.7152, 0.0722] for v in frames]
    small = [g.reshape(3, 4, 4, 4).mean(axis=(1, 3)).reshape(-1) for g in grey]
    got = {r.f: r.proxy for r in proxy.collect()}
    assert all(np.allclose(got[f], small[f]) for f in range(4))
    cuts = {r.f: r.cut for r in temporal.cut_after(proxy, [], "f", "proxy", 0.05).collect()}
    assert cuts == {f: f < 3 and bool(np.abs(small[f] - small[f + 1]).mean() >= 0.05) for f in range(4)}
    thumbs = {r.f: r.thumb for r in temporal.thumbnail(df, ["f"], ["r", "g", "b"], (12, 16), side=4).collect()}
    assert all(np.allclose(thumbs[f], frames[f][::3, ::4].reshape(-1)) for f in range(4))
