"""A training corpus from documents: good texts, without copies and near copies, mixed and packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's
result to the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.common import cut, table
from tracewell.llm.exact_dedup import dedup
from tracewell.llm.mixing import mix_documents
from tracewell.llm.ngram_join import keep_representatives
from tracewell.llm.packing import pack
from tracewell.llm.quality import keep_good
from tracewell.llm.tokens import file_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; null texts score as empty ones, ties alike,
    repeated rows stay or go together, an empty table stays empty."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last of each group of equal texts (A-Z folded; null texts are empty); of repeated rows
    one; an empty table stays empty."""
    return dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle similarity of 0.75 or more connects, the one with the
    smallest id; texts without words and rows without an id stay."""
    return keep_representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix to the sources' targets takes it; texts without words stay
    once at least, a null source is one of its own."""
    return mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's token pieces in sequences of 1024; a null text is its end id alone."""
    return pack(docs, file_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", packed)]
#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
