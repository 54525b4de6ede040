"""A training-data pipeline over `documents`: five stages, each one of the operators of evidentia.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, exact_dedup, langid, mixing, ngram_join
from evidentia.llm.common import shared_dir
from evidentia.llm.queries import tokenizer


#: Calibrated probability of its best language under which a document's language can't be told.
LEAST_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: without letters (or null), or with a score under LEAST_SCORE. Where the
    table names no language, the one predicted is put in; of equally likely ones the first by name. Without any label to learn from, only
    texts without letters go. Repeated rows are judged alike and all stay; an empty table stays empty."""
    model = langid.fit(docs.where(langid.fold() != 0), key=F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    told = langid.predict(docs, model, as_col="evidentia_told")
    if model.languages:
        told = told.where((F.col("evidentia_told.lang_pred") != langid.UNKNOWN) & (F.col("evidentia_told.score") >= LEAST_SCORE))
        told = told.withColumn("lang", F.coalesce("lang", "evidentia_told.lang_pred"))
    return told.select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; null is empty) the row with the largest doc_id stays; of rows that repeat that doc_id, one. An
    empty table stays empty."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of Jaccard similarity 0.8 or more on five-word shingles the smallest doc_id stays; of rows that repeat it, the
    smallest text hash. Texts without words all stay; an empty table stays empty."""
    return ngram_join.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, none to three times each as the sources' targets demand, in the order of training; readings at one position come
    in any order. Equal rows are rows of their own; an empty table stays empty."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document that the mix took, as digests: a row for each reading. Null is empty; an empty table gives none."""
    return bpe.round_trip(docs, *tokenizer())


STAGES = [
    ("language ID", known_language),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing", mixed_sources),
    ("byte-level BPE", encoded),
]

#: Learning a language classifier and byte-level BPE can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole table; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/evidentia-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/stage{n}")
        docs = spark.read.parquet(f"{at}/stage{n}")
    return STAGES[-1][1](spark, docs, sf_dir)
