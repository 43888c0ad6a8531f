"""The corpus pipeline: language ID, near-duplicates, personal data, mixing, tokens.

Every stage takes a table with the columns of documents and more, of whatever names and types, which it leaves
out; all but the last return the columns of documents. Nulls may stand in any column; ids may repeat or lack. A very
long text is handled whole, by one task. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import bpe, langid, mixing, neardup, pii
from frameloom.llm.catalogue import TARGETS, VOCABULARY
from frameloom.llm.common import crc_mod, delete_folder, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The share of tokens that the mixture keeps.
KEEP_TOKENS = 0.85
#: The gap between the two nearest codewords below which a text's language is unclear. The operator's default of 0.2
#: marks texts for a second look; here they would go, so only those that lie between two codewords do.
UNCLEAR = 0.02


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; a null lang becomes the predicted one. Rejected: null and empty texts, texts
    without a letter, texts between two codewords. Each row is judged by its text alone, so rows that repeat
    or share an id fare alike; nothing is learned from rows without an id or lang."""
    docs = _documents(docs)
    model = langid.train(docs.where(crc_mod(F.col("doc_id"), 4) != 2), "text", "lang", "doc_id", ambiguous_below=UNCLEAR)
    judged = langid.identify(docs, model, "text", list(COLUMNS))
    kept = judged.where((F.col("lang_pred") != langid.UNDETERMINED) & ~F.col("ambiguous"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more), the one with the
    smallest id. Texts without words, null ones too, are copies of each other. Of rows that repeat one stays; rows
    that share an id but not a group are told apart; a row without an id stays if none of its group has one."""
    return neardup.keep_one(_documents(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms under the session's key; n_chars is that of the new text.
    A null text stays null and keeps its n_chars; an empty one stays empty. Rows are handled one by one."""
    out = pii.pseudonymise(_documents(docs), pii.session_key(spark), counts=False)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards the tempered source and language shares. A null source or language is a value of its
    own; null and empty texts have no tokens and share their cell's chance; rows that share an id share its fate,
    rows without one are drawn by their text."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of(F.col("text"))}
    return mixing.mix(_documents(docs), dims, TARGETS, keep=KEEP_TOKENS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (little-endian 32-bit), how many they are, and digests of ids and decoded text. Null
    and empty texts have no ids; rows are encoded one by one, those that repeat as often as they come."""
    keep = ["doc_id", "lang", "source"]
    out = bpe.encode(_documents(docs), public_tokenizers.path(VOCABULARY), keep=keep, decoded=True)
    return out.select(*keep, "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: Classifiers, near-duplicates and byte-pair encoding have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again. What a stage was given is
    deleted when its result is written; the last result stays for whoever reads it."""
    folder, docs = shared_folder(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            delete_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
