"""A corpus from raw documents to token counts: five operators, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again for the next.
All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.llm import bpe, dedup, mixing, pii, quality
from braidlake.llm.common import fresh, prepare, stage, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 at least by a classifier of all labels; the score is taken along, so nothing is shuffled."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs.select("doc_id", "text"), labels)
    (score,) = fresh(docs.columns, "quality_score")
    return quality.score_column(docs, "text", model, docs.columns, score).where(F.col(score) >= 0.5).drop(score)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least doc_id; documents without doc_id stay.

    Rows that repeat both doc_id and text are one document, of which any one row stays; different texts
    under one doc_id are different documents. A null text is in a class of its own id.
    """
    prepare(spark)
    found = dedup.near_duplicates(docs.select("doc_id", "text"))
    (key,) = fresh(docs.columns, "text_key")
    kept = stage(found.where("first").select(F.col("id").alias("doc_id"), F.col("key").alias(key)).distinct())
    keyed = docs.where(F.col("doc_id").isNotNull()).withColumn(key, dedup.row_key(F.col("doc_id"), F.col("text")))
    once = keyed.join(kept, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return once.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for the personal data in their texts; null and empty texts stay."""
    return pii.replace_pii(docs, "text").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in copies of its row."""
    prepare(spark)
    (size,) = fresh(docs.columns, "mix_size")
    mixed = mixing.mix(mixing.with_word_count(docs, "text", size), size)
    copies = mixed.columns[-1]
    (copy,) = fresh(mixed.columns, "copy")
    return mixed.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, a row for each row of docs."""
    prepare(spark)
    return bpe.bpe(docs, "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", keep_one_of_each_group),
    ("personal data", replace_personal_data),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]
#: Trained and sampled stages can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result but the last one written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
    return docs
