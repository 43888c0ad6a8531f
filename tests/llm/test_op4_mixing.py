import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import mixing


def docs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), ["en", "fr", None][i % 3], f"s{i % 2 if i % 7 else 0}") for i in range(600)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, draw string")


def dims():
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of(F.col("text"))}


TARGETS = {"source": {"s0": 0.3, "s1": 0.7}, "lang": 0.5, "topic": 1.0}


def test_marginals_and_probabilities(spark):
    measured = mixing.measure(docs(spark), dims())
    raked = mixing.fit(measured, list(dims()), TARGETS, keep=0.5)
    cells = raked.cells.toPandas()
    total = cells.tokens.sum()
    by = cells.groupby("source").raked.sum() / total
    assert by["s0"] == pytest.approx(0.3, abs=1e-6) and by["s1"] == pytest.approx(0.7, abs=1e-6)
    own = cells.groupby("lang").tokens.sum() ** 0.5
    assert np.allclose(cells.groupby("lang").raked.sum() / total, own / own.sum(), atol=1e-6)
    assert (cells.tokens * cells.prob).sum() == pytest.approx(0.5 * total)
    assert set(cells.lang) == {"en", "fr", mixing.NONE}
    drawn = mixing.draw(measured, raked).toPandas()
    assert len(drawn) == 600 and (drawn.sampled == (drawn.draw < drawn.prob)).all()
    kept = mixing.mix(docs(spark), dims(), TARGETS, keep=0.5)
    assert kept.columns == docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(drawn[drawn.sampled].doc_id)


def by_brute_force(cells, dims, targets, keep):
    """Raking and calibration over a dict, value by value, to the last digit."""
    total = sum(t for t in cells.values())
    w = {c: float(t) for c, t in cells.items()}
    shares = []
    for k, dim in enumerate(dims):
        own = {}
        for c, t in cells.items():
            own[c[k]] = own.get(c[k], 0) + t
        shares.append(targets[dim] if isinstance(targets[dim], dict) else {v: t ** targets[dim] for v, t in own.items() if t})
    for _ in range(3000):
        for k in range(len(dims)):
            held = {}
            for c, x in w.items():
                held[c[k]] = held.get(c[k], 0.0) + x
            named = sum(shares[k].get(v, 0) for v, x in held.items() if x > 0)
            w = {c: x * shares[k].get(c[k], 0) / named * total / held[c[k]] if held[c[k]] > 0 else 0.0 for c, x in w.items()}
    ratio = {c: w[c] / t for c, t in cells.items() if t}
    if keep is None:
        c = 1 / max(ratio.values())
    else:
        low, high = 0.0, 1e12
        for _ in range(300):
            c = (low + high) / 2
            low, high = (c, high) if sum(t * min(1, c * ratio[x]) for x, t in cells.items() if t) < keep * total else (low, c)
    return {x: (w[x], min(1.0, c * ratio[x]) if t else 1.0) for x, t in cells.items()}


@pytest.mark.parametrize("driver_cells", [200_000, 0])
@pytest.mark.parametrize(("targets", "keep"), [(TARGETS, None), (TARGETS, 0.4), ({"source": 0.7, "lang": {"en": 1.0, "fr": 2.0, "nowhere": 5.0}, "topic": 1.0}, 0.9)])
def test_against_brute_force(spark, monkeypatch, targets, keep, driver_cells):
    """On arrays and on a table: the same numbers."""
    monkeypatch.setattr(mixing, "DRIVER_CELLS", driver_cells)
    key = ["source", "lang", "topic"]
    measured = mixing.cut(mixing.measure(docs(spark), dims()))
    got = {(r.source, r.lang, r.topic): r for r in mixing.fit(measured, key, targets, keep=keep).cells.collect()}
    want = by_brute_force({k: r.tokens for k, r in got.items()}, key, targets, keep)
    for k, (raked, prob) in want.items():
        assert got[k].raked == pytest.approx(raked, rel=1e-8, abs=1e-8) and got[k].prob == pytest.approx(prob, rel=1e-8, abs=1e-8)


def test_many_cells_are_dealt_out(spark, monkeypatch):
    """Rows meet broadcast cells or cells in copies with one result."""
    measured = mixing.cut(mixing.measure(docs(spark), dims()))
    raked = mixing.fit(measured, list(dims()), TARGETS, keep=0.5)
    a = sorted(map(tuple, mixing.draw(measured, raked).collect()))
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    dealt = mixing.draw(measured, raked)
    assert sorted(map(tuple, dealt.select(*mixing.draw(measured, raked).columns).collect())) == a


def test_targets_that_no_weights_meet():
    tokens, codes = np.array([5.0, 7.0]), [np.array([0, 1]), np.array([0, 1])]
    w = mixing.rake_arrays(tokens, codes, [np.array([0.9, 0.1]), np.array([0.5, 0.5])])
    assert w.sum() == pytest.approx(12) and (w > 0).all()
    assert mixing.rake_arrays(tokens, codes, [np.zeros(2), np.ones(2)]).tolist() == [0, 0]


def test_columns_that_clash(spark):
    df = docs(spark).selectExpr("*", "1 AS _prob", "2 AS _draw", "3 AS _dim0", "4 AS __prob", "5 AS tokens", "'a' AS weight")
    kept = mixing.mix(df, dims(), TARGETS, keep=0.5)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in mixing.mix(docs(spark), dims(), TARGETS, keep=0.5).collect())
    with pytest.raises(ValueError):
        mixing.measure(df, {"tokens": F.col("source")})


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, "", "en", "a"), (1, "", "en", "a"), (2, "word " * 100_000, "en", "a")], "doc_id long, text string, lang string, source string")
    raked = mixing.fit(mixing.measure(df, dims()), list(dims()), TARGETS | {"source": 1.0}, keep=1.0)
    assert mixing.draw(mixing.measure(df, dims()), raked).where("sampled").count() == 4
    empty = df.limit(0)
    assert mixing.mix(empty, dims(), TARGETS, keep=0.5).count() == 0
    assert df.select(mixing.token_count(F.col("text")).alias("n")).toPandas().n.tolist() == [0, 0, 0, 100_000]
