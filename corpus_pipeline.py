"""The corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again.

1. language: documents without an identified language go (null texts, texts without a letter);
2. near_duplicates: one document of each component stays, that of the least id;
3. repeats: bytes of 50-byte strings that a document with a smaller id has too are cut out; a document of which
   nothing but white space is left goes;
4. personal_data: identifiers are replaced by their kind in brackets;
5. packing: what is left becomes sequences of at most 1024 tokens, one row per piece.

Stages 1 to 4 return the columns of documents, whatever their names and further ones, with n_chars counted anew if there is
such a column. Empty tables give empty results. Null values stay as they are in all columns but text, whose nulls go in stage
1; rows with a null id take part in every stage, before all others where order counts; repeated rows are near copies, of which
one stays; of rows with one id and different texts those stay that are no near copies; ties go to the least id, then to the
least fingerprint. Texts of any length pass whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noetica.llm import langid, packing, pii, simhash, suffix_dedup
from noetica.llm.common import documents, recounted, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, shingle=4, radius=4)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(suffix_dedup.deduplicated(docs, width=50).where(F.col("text").rlike(r"\S")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(pii.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("personal_data", personal_data), ("packing", pack)]
#: SQL can express neither the classifier nor the byte-level stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
