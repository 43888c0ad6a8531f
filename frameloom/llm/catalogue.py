"""The queries of this subpackage, one for each operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annsearch, bpe, chat, langid, mixing, pii, quality, rules, simhash, tokenbin
from .common import crc_mod, cut

VOCABULARY = "word_bpe_49k.json"
#: Powers that temper the sources' and languages' token shares, topics as they are.
TARGETS = {"source": 0.7, "lang": 0.8, "topic": 1.0}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(doc_id: Column, m: int, rest: int) -> Column:
    """Whether the id is kept from learning; a null id is not, but nothing is learned from it either."""
    return F.coalesce(crc_mod(doc_id, m) == rest, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", _held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_mod(F.col("doc_id"), 4) != 2), "text", "lang", "doc_id")
    judged = langid.identify(docs, model, "text", ["doc_id"])
    return judged.select("doc_id", _held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of(F.col("text"))}
    measured = cut(mixing.measure(docs, dims))
    raked = mixing.fit(measured, list(dims), TARGETS, keep=0.5)
    return mixing.draw(measured, raked).select("doc_id", *dims, "tokens", "weight", "prob", "sampled")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(_table(spark, sf_dir, "conversations"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.write_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.plan(docs), keep=["doc_id"])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"), pii.session_key(spark))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), keep=["doc_id"], decoded=True)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict:
    own = (op1_quality, op2_language_id, op3_nearest, op4_mixture, op5_chat, op6_simhash, op7_token_files, op8_rules, op9_pii, op10_bpe)
    return {f.__name__: f for f in own}


#: Exact nearest neighbours by brute force; maximal conversations by comparing lists; the base counts and rules.
_SQL = {
    "op3_nearest": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_chat": """
        WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        c AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text) AS l FROM t GROUP BY conv_id),
        one AS (SELECT l, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY l),
        kept AS (SELECT conv_id, copies, len(l) AS n_turns FROM one a
                 WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.l[1] = a.l[1] AND len(b.l) > len(a.l) AND b.l[1:len(a.l)] = a.l))
        SELECT conv_id, (turn // 256)::BIGINT AS part, 0::BIGINT AS piece, n_turns::BIGINT AS n_turns, copies,
               string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS chat
        FROM kept JOIN t USING (conv_id) GROUP BY conv_id, turn // 256, n_turns, copies""",
    "op8_rules": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
                   len(string_split(coalesce(text, ''), chr(10))) AS n_lines FROM documents),
        win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
        b AS (SELECT doc_id, text, n_lines, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
              (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
              (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
              FROM d LEFT JOIN rep USING (doc_id)),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (n_dup_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines)
                    OR word_chars > 15 * n_words OR word_chars < 2 * n_words
                    OR 10 * length(regexp_replace(text, '[^\\p{Lu}]+', '', 'g')) > 5 * word_chars
                    OR 10 * (length(text) - length(replace(text, '!', ''))) > 2 * n_words) AS kept FROM f""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
