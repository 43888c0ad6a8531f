import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import langid

WORDS = {"en": "the of and that with this from".split(), "fr": "le la des que dans pour est".split(), "de": "der die und nicht mit ein ich".split(), "pl": "nie jest się przez które oraz".split(), "fi": "ja on että mutta kuin oli".split(), "tr": "bir ve için olan gibi daha".split()}


def corpus(langs, n=60, seed=0):
    rng = np.random.default_rng(seed)
    return [(k * 1000 + i, " ".join(rng.choice(WORDS[lang], 25)), lang) for k, lang in enumerate(langs) for i in range(n)]


@pytest.mark.parametrize("langs", [["en", "fr"], ["en", "fr", "de"], list(WORDS)])
def test_held_out_accuracy(spark, langs):
    train = spark.createDataFrame(corpus(langs), "doc_id long, text string, lang string")
    model = langid.train(train, "text", "lang", "doc_id")
    assert model.langs == tuple(sorted(langs))
    test = spark.createDataFrame(corpus(langs, 20, 1), "doc_id long, text string, lang string")
    out = langid.identify(test, model, "text", ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_codewords_differ():
    for n in (2, 3, 4, 5, 6, 12, 40):
        code = langid.codewords(n)
        assert len(code) == n and len(np.unique(code, axis=0)) == n
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_bit_errors_are_corrected():
    code = langid.codewords(5)
    model = langid.CodedModel(tuple("abcde"), code, np.full(code.shape, 1 / code.shape[1]), np.zeros((1, code.shape[1])), np.zeros(code.shape[1]))
    for k in range(5):
        for wrong in range(code.shape[1]):
            margins = 4 * code[k].copy()
            margins[wrong] *= -1
            best, _, _ = model.decode(margins[None])
            assert best[0] == k
    _, score, vague = model.decode(np.zeros((1, code.shape[1])))
    assert vague[0] and score[0] == pytest.approx(0.2)


def test_edges(spark):
    model = langid.train(spark.createDataFrame(corpus(["en", "fr"]), "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    rows = [(1, None, "q"), (2, "", "q"), (3, "12 34 !! \n", "q"), (None, "THE OF AND THAT", "q"), (3, "½ ² 4", "q"), (5, "the of " * 50_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = langid.identify(docs, model, "text", ["doc_id"]).collect()
    assert [r.lang_pred for r in out] == ["und", "und", "und", "en", "und", "en"]
    assert [r.score for r in out if r.lang_pred == "und"] == [0.0] * 4
    empty = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    assert {r.lang_pred for r in langid.identify(docs, empty, "text", ["doc_id"]).collect()} == {"und"}
    single = langid.train(spark.createDataFrame(corpus(["fr"]), "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    assert {r.lang_pred for r in langid.identify(docs, single, "text", ["doc_id"]).collect()} == {"und", "fr"}
    assert langid.identify(docs.limit(0), model, "text", ["doc_id"]).count() == 0


def by_brute_force(model, text):
    """lang_pred and score of one text, n-gram by n-gram and bit by bit."""
    import math

    m32, raw = 0xFFFFFFFF, (text or "").lower().encode()
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    b = [x if x > 127 or 97 <= x <= 122 else 32 for x in raw]
    buckets = len(model.weights)
    half, three, two = buckets // 2, {}, {}
    mixed = lambda h: ((h ^ h >> 15) * 0x2C1B3C6D & m32) >> 8
    pair = [(x * 0x9E3779B1 + y * 0x85EBCA77) & m32 for x, y in zip(b, b[1:], strict=False)]
    fine = [(x, y) != (32, 32) for x, y in zip(b, b[1:], strict=False)]
    for k, h in enumerate(pair):
        if fine[k]:
            two[mixed(h) % half] = two.get(mixed(h) % half, 0) + 1
        if k + 1 < len(pair) and fine[k] and fine[k + 1]:
            t = (h ^ b[k + 2] * 0xC2B2AE3D & m32) * 0x27D4EB2F & m32
            three[mixed(t) % half] = three.get(mixed(t) % half, 0) + 1
    margin = [float(x) for x in model.bias]
    for part, shift in ((three, 0), (two, half)):
        for k, n in part.items():
            for bit in range(len(margin)):
                margin[bit] += math.sqrt(n / sum(part.values())) * float(model.weights[k + shift, bit])
    near = [-len(margin) * sum(t * math.log1p(math.exp(-c * f)) for t, c, f in zip(trust, code, margin, strict=True)) for trust, code in zip(model.trust, model.codes, strict=True)]
    share = [math.exp(x - max(near)) for x in near]
    best = max(range(len(share)), key=share.__getitem__)
    return model.langs[best], share[best] / sum(share)


def test_predictions_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.lit(1).alias("lang_pred"), F.lit(2).alias("_text"))
    model = langid.train(docs.where("doc_id % 4 <> 2"), "text", "lang", "doc_id")
    got = {r.doc_id: r for r in langid.identify(docs, model, "text", ["doc_id", "lang_pred", "_text"]).collect()}
    rows = [r for r in docs.collect() if len(r.text or "") < 6000]
    assert len(rows) > 100
    for r in rows:
        lang, score = by_brute_force(model, r.text)
        assert got[r.doc_id]["_text"] == 2 and got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-3)
