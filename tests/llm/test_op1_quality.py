import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import quality
from frameloom.llm.textstats import STATISTICS, statistics_of, windows_of, with_statistics
import pyarrow as pa


def samples(n=400):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and"]
    good = [" ".join(rng.choice(words, 60)) + f" w{i}" for i in range(n)]
    bad = [" ".join(w + "!!" for w in rng.choice(words, 60)) for _ in range(n)]
    return [(i, t) for i, t in enumerate(good + bad)], [(i, int(i < n), 0) for i in range(2 * n)]


def test_learns_and_compiles(spark):
    docs, labels = samples()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, quality int, toxic int")
    model = quality.train(d, lab, trees=10)
    assert model.rules
    got = {r.doc_id: r.score for r in quality.score(d, model, keep=["doc_id"]).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, y, _ in labels)
    x = statistics_of(pa.array([t for _, t in docs]))  # the column expression is the ensemble
    assert np.allclose([got[i] for i, _ in docs], model.score(x))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (2, "", "x"), (3, "w" * 300_000 + " " + "v " * 50_000, "x")], "doc_id long, text string, score string")
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, none, keep=["doc_id"]).collect()} == {0.5}
    one = quality.train(docs, spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0), (3, 0), (3, 1)], "doc_id long, quality int"))
    out = quality.score(docs, one, keep=["doc_id"]).collect()
    assert len(out) == 5 and all(0.5 < r.score < 1 for r in out)
    stats = with_statistics(docs, "text", ["doc_id"]).where("doc_id = 1 OR doc_id = 2").collect()
    assert len(stats) == 3 and all(r[n] == 0 for r in stats for n in STATISTICS)
    assert quality.score(docs.limit(0), one, keep=["doc_id"]).count() == 0


def test_statistics_by_hand():
    x = dict(zip(STATISTICS, statistics_of(pa.array(["aB a a\nx!\nx!", "é"]))[0], strict=True))
    assert x["n_words"] == 5 and x["upper_share"] == pytest.approx(1 / 8) and x["bang_share"] == pytest.approx(2 / 8)
    assert x["distinct_share"] == pytest.approx(3 / 5) and x["next_equal_share"] == pytest.approx(2 / 5) and x["dup_line_share"] == pytest.approx(1 / 3)
    codes = np.array([0, 1, 2, 0, 1, 2], np.int32)
    for n in (3, 1 << 21):
        w = windows_of(codes, n)
        assert w[0] == w[3] and len(set(w.tolist())) == 3


def by_brute_force(text):
    """The statistics of one text, counted one after another."""
    import re

    raw = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    if not words:
        return dict.fromkeys(STATISTICS, 0.0)
    shown = [b for b in raw if b not in b" \t\n\x0b\x0c\r"]
    share = lambda test: sum(map(test, shown)) / len(shown)
    lines = [x for x in text.split("\n") if x.strip()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return {
        "upper_share": share(lambda b: 65 <= b <= 90),
        "digit_share": share(lambda b: 48 <= b <= 57),
        "bang_share": share(lambda b: b == 33),
        "pipe_share": share(lambda b: b == 124),
        "symbol_share": share(lambda b: b in b"#*$%&<>"),
        "stop_share": share(lambda b: b in b".,;:?"),
        "other_ascii_share": share(lambda b: b in b"\"'()[]{}-_=+/\\@^~`"),
        "beyond_ascii_share": share(lambda b: b > 127),
        "n_words": len(words),
        "mean_word": len(shown) / len(words),
        "words_per_line": len(words) / max(1, len(lines)),
        "distinct_share": len(set(words)) / len(words),
        "next_equal_share": sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words),
        "dup_line_share": 1 - len(set(lines)) / max(1, len(lines)),
        "window_repeat_share": (len(windows) - len(set(windows))) / max(1, len(words) - 2),
    }


def test_scores_by_brute_force(spark, sf_dir):
    """The query's scores of every document, from rules that are tried one by one on statistics counted one by one."""
    import math

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 <> 0")
    model = quality.train(docs, labels)
    assert model.rules
    got = {r.doc_id: r.score for r in quality.score(docs, model, keep=["doc_id"]).collect()}
    for r in docs.collect():
        own = by_brute_force(r.text or "")
        total = model.bias
        for rule, weight in zip(model.rules, model.weights, strict=True):
            if all((own[name] > limit) == above for name, above, limit in rule.conditions):
                total += weight
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-9)


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a b!", 5, "x", 0.5)], "doc_id long, text string, n_words int, _text string, score double")
    out = quality.score(df, quality.RuleEnsemble((), (), 0.0), keep=["doc_id", "n_words", "_text", "score"])
    assert out.columns == ["doc_id", "n_words", "_text", "score"] and out.first()[:] == (1, 5, "x", 0.5)
