"""Corpus pipeline: toxic documents go, near copies keep one, benchmark leaks go, sources are mixed, ids are written.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents, whatever further ones there are and however they are named.  Null
and empty texts count as clean, link with nothing, hold no benchmark item, and
leave with the mix, which takes words; null doc_ids are documents like others;
texts of any length are judged whole; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeward.llm import decontamination, jaccardjoin, mixing, tokenfiles, toxicity
from lakeward.llm.cluster import Workspace, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain rejects.

    Repeated rows are judged alike; with too few labels nothing is rejected.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the document of the smallest doc_id of each group of near copies.

    Of repeated rows one stays; a group without any doc_id keeps one of its documents.
    """
    return jaccardjoin.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item.

    Repeated rows are judged alike; an empty benchmark removes nothing.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times.

    Rows with equal doc_id are taken alike; a null source is a source of its own.
    """
    return mixing.take(spark, docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token-id files hold of each document, in ascending doc_id order, nulls first.

    A document that was taken several times is written as often.
    """
    return tokenfiles.token_files(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("source_mix", mix_sources),
    ("token_files", write_tokens),
]

#: The stages run models and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES in order to documents; each stage's rows are written and read again."""
    kept = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
