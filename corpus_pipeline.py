"""From raw documents to packed sequences: five stages, each on all that the last one kept.

``docs`` has doc_id, text, lang, source and n_chars; any value may be null, rows
may repeat, and other columns of any name are kept by all stages but the last.
An empty table goes through all stages and gives one without rows. Texts of any
length are read whole. No stage writes texts beyond its result: what it keeps in
the shared folder are hashes, verdicts and lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, langid, ngram_join, packing, quality, secret_scan
from weftline.llm.common import bounded_batches, stage, table

#: Documents whose language is less sure than this go.
LEAST_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go; null and empty texts fail, repeated rows are judged alike."""
    return quality.filter_quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language or of an unsure one go; a missing lang is filled in. Without any labelled document nothing can be told, and all go."""
    bounded_batches(spark)
    model = langid.train(docs, F.lit(True))
    found = langid.identify(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    lang = F.coalesce("row.lang", "lang_pred").alias("lang")
    return found.select(*[lang if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: that of the least doc_id, null before others; of rows that are the same in all columns one."""
    bounded_batches(spark)
    return ngram_join.keep_one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced in the texts, with n_chars of changed ones; all documents stay, repeated ones too."""
    bounded_batches(spark)
    return secret_scan.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in the sequences; a null text is a lone end token, repeated rows are documents of their own."""
    bounded_batches(spark)
    return packing.pack_digests(docs, bpe.vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Language ID and packing can't be stated in SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name.replace(" ", "_"))
    return docs
