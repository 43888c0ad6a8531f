import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from frameloom.llm import catalogue, pii


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}


def test_stages_on_their_own_inputs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(900, None, "en", "s", None), (901, "", None, None, 0), (902, "12 34", "en", "s", 5), (None, "the of and that is with", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(extra)
    kept = stage("language_id")(spark, docs, sf_dir).cache()
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {900, 901, 902} and ids >= {r.doc_id for r in docs.where("doc_id < 200").collect()}
    one = stage("near_duplicates")(spark, kept, sf_dir).cache()
    rows = kept.select("doc_id", "text").toPandas()
    sets = [shingles(t) for t in rows.text]
    near = [np.array([j for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)]) for a in sets]
    label = np.arange(len(rows))
    while (new := np.array([label[n].min() for n in near])).tolist() != label.tolist():
        label = new
    assert one.count() == len(set(label.tolist())) and one.columns == docs.columns
    hidden = stage("personal_data")(spark, one, sf_dir).cache()
    before, after = (x.where("doc_id IS NOT NULL").toPandas().set_index("doc_id") for x in (one, hidden))
    for i, row in before.iterrows():
        assert after.text[i] == pii.replace(row.text, pii.session_key(spark).encode())[0]
        assert after.n_chars[i] == len(after.text[i])
    mixed = stage("mixture")(spark, hidden, sf_dir).cache()
    assert mixed.columns == docs.columns and 0 < mixed.count() <= hidden.count()
    assert mixed.subtract(hidden).count() == 0
    out = stage("tokens")(spark, mixed, sf_dir).where("doc_id IS NOT NULL").toPandas().set_index("doc_id")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in mixed.where("doc_id IS NOT NULL").collect()[:60]:
        want = library.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(out.ids[r.doc_id], "<u4").tolist() == want and out.n_tokens[r.doc_id] == len(want)
        assert out.ids_sha256[r.doc_id] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert out.decoded_sha256[r.doc_id] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_run_and_empty(spark, sf_dir, tmp_path):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.where("n_tokens IS NULL").count() == 0
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    names = list(catalogue.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(catalogue.oracle_sql()) <= set(names) and __spark_entry__.queries().keys() >= {*names, "pipeline"}


def test_small_contracts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = catalogue.op1_quality(spark, sf_dir)
    assert one.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and one.count() == docs.count()
    assert one.where((F.col("predicted") == 1) != (F.col("score") >= 0.3)).count() == 0
    two = catalogue.op2_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id")
    assert two.where("held_out AND lang = lang_pred").count() >= 0.95 * two.where("held_out").count()


def awkward(spark):
    """Nulls in each column, empty and very long texts, repeated rows, ids that repeat or lack, and columns that clash."""
    prose = "the cat and the dog went to the old house by the river and it was a good day for them all"
    rows = [
        (1, prose, "en", "a", 10),
        (1, prose, "en", "a", 10),
        (2, None, None, None, None),
        (3, "", "en", None, 0),
        (4, f"{prose} and they said that this was the way of the world " * 4000, None, "b", None),
        (5, "mail me at some.body@mail.example.org or call 212-555-0187 when you are in the city and have the time", "en", None, 5),
        (5, "another text with the same id as the one before it, which is about something that is not like it at all", None, "a", 5),
        (None, "this one has no id at all but it is a text like the others and there is nothing wrong with it", "en", "a", 5),
        (None, None, None, None, None),
    ]
    base = [(100 + i, f"{prose} {' '.join(f'word{i}x{k} of the' for k in range(30))}", "en", "ab"[i % 2], 1) for i in range(40)]
    base += [(200 + i, f"der hund und die katze sind nicht in dem haus {' '.join(f'wort{i}x{k} und das' for k in range(30))}", "de", "b", 1) for i in range(40)]
    df = spark.createDataFrame(rows + base, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS lang_pred", "2 AS _text", "'x' AS ids", "map(1, 2) AS _prob", "array(1) AS fp")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_awkward_tables(spark, sf_dir, name):
    docs = awkward(spark)
    out = stage(name)(spark, docs, sf_dir)
    assert stage(name)(spark, docs.limit(0), sf_dir).count() == 0
    got = out.collect()
    ids = [r.doc_id for r in got]
    if name != "tokens":
        assert out.columns == list(corpus_pipeline.COLUMNS)
    if name == "language_id":
        assert not {2, 3} & set(ids) and all(r.text for r in got) and ids.count(1) == 2 and all(r.lang for r in got)
    if name == "near_duplicates":
        assert ids.count(1) == 1 and ids.count(5) == 2 and ids.count(None) == 1 and 2 in ids and 3 not in ids
    if name == "personal_data":
        assert len(got) == docs.count() and {r.text for r in got if r.doc_id == 2} == {None}
        assert "some.body@" not in str([r.text for r in got]) and "555-0187" not in str([r.text for r in got])
    if name == "mixture":
        assert ids.count(1) in (0, 2) and set(got) <= set(docs.select(*corpus_pipeline.COLUMNS).collect())
    if name == "tokens":
        assert len(got) == docs.count() and all((r.n_tokens == 0) == (r.doc_id in (2, 3) or len(r.ids) == 0) for r in got)
        assert max(r.n_tokens for r in got) > 100_000
