"""A pipeline over ``documents``: language, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and
read again as the next one's docs. All but the last keep the columns of
documents; the mixture adds the output shard, which packing keeps apart. Tables that a stage keeps in the shared folder are dropped when the
next stage begins, since its result is written by then.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vframe.llm import langid, mixing, neardup, packing, pii
from vframe.llm.common import Scratch, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
#: The setting that holds the secret key of the pseudonyms. Where there is none, the key is public: fit for tests only.
KEY_SETTING, TEST_KEY = "spark.vframe.pii.key", "corpus-2024"

_last: list[Scratch] = []


def _scratch(spark: SparkSession) -> Scratch:
    while _last:
        _last.pop().drop()
    _last.append(Scratch(spark))
    return _last[-1]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or like none of the labelled languages, go."""
    _scratch(spark)
    return langid.keep_known(docs, langid.train(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id."""
    return neardup.keep_first(docs, shingle=5, percent=80, scratch=_scratch(spark))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to pseudonyms of its format."""
    _scratch(spark)
    return pii.redact(docs, spark.conf.get(KEY_SETTING, TEST_KEY))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mixture takes, with its output shard, and shuffled there."""
    docs = docs.drop("shard")
    return mixing.emit(mixing.mix(docs, scratch=_scratch(spark))).select(*docs.columns, "shard")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens at most, each of one of the mixture's shards."""
    return packing.pack(docs, TOKENIZER, END_ID, within="shard", scratch=_scratch(spark)).withColumnRenamed("within", "shard")


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", without_near_duplicates),
    ("personal_data", without_personal_data),
    ("mixture", mixed),
    ("packing", packed),
]

#: No stage but the third could be stated in SQL; the tests hold each to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; the result of each but the last is written and read again."""
    docs, kept = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept.table(docs, name)
    return docs
