"""From raw documents to packed training sequences: quality, toxicity, near-duplicates, packing.

Each stage takes what its predecessor kept, as a table read from Parquet. The two filters learn from the labels of documents that reach them
and drop what they reject; of a group of near-duplicates the document with the smallest doc_id stays; the rest is packed.

Rows without doc_id are scored and packed like others and are never duplicates; rows that repeat a doc_id are documents of their own, of which
the near-duplicate stage keeps one where their texts are alike, and all where they differ. An empty table gives an empty result. Further columns of the documents travel along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesurvey.llm import neardup, packing, quality, toxicity
from lakesurvey.llm.common import small_batches, stored, table


ROW = "__row"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3."""
    model = quality.fit_model(docs, table(spark, sf_dir, "labels"))
    return docs.mapInArrow(quality.accepted_rows(model, 0.3), docs.schema)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = toxicity.fit_model(docs, table(spark, sf_dir, "labels"))
    return docs.mapInArrow(toxicity.accepted_rows(model, 0.5), docs.schema)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest doc_id.

    Each row is a document of its own, with a key that is written down with it: rows that share a doc_id and differ in text are told apart.
    """
    small_batches(spark)
    keyed = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    known = keyed.where("doc_id is not null")
    found = neardup.near_duplicates(known.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id")
    first = found.join(known.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(F.struct("doc_id", ROW)).alias("first"))
    kept = keyed.join(first.select(F.col("first")[ROW].alias(ROW)), ROW, "left_semi")
    return kept.unionByName(keyed.where("doc_id is null")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its sequence and place."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_duplicates", one_of_each), ("packing", packed)]

#: Classifiers and tokenizers are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
