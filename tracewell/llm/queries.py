"""The queries of this folder as (spark, sf_dir) -> DataFrame, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty, equal to each other; of equal texts the largest id stays; a row per document."""
    from .exact_dedup import dedup_report

    return dedup_report(table(spark, sf_dir, "documents"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's files come in waves, each compacted with what is there. Null texts are empty;
    repeated rows stay; an empty table gives no rows."""
    from .sharding import file_waves, shard_report

    return shard_report(*file_waves(spark, f"{sf_dir}/documents.parquet"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty; null ids come first, repeated ones follow each other; empty table, no rows."""
    from .common import shared_dir
    from .records import read_records, write_records
    from .tokens import file_path

    folder = shared_dir(spark, "records")
    write_records(table(spark, sf_dir, "documents"), folder, file_path("word_bpe_49k.json"), end_id=2)
    return read_records(spark, folder)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are one piece, the end id; repeated rows are packed apart; empty table, no rows."""
    from .packing import pack
    from .tokens import file_path

    return pack(table(spark, sf_dir, "documents"), file_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have size 0; a null source is one of its own; empty table, no rows."""
    from .mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts link with nothing; equal ids are one node; empty table, no rows."""
    from .ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts score as empty ones; equal texts score alike; empty table, no rows."""
    from .quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts count 0; repeated rows count alike; empty table, no rows."""
    from .piece_counts import piece_counts
    from .tokens import file_path

    return piece_counts(table(spark, sf_dir, "documents"), file_path("word_bpe_49k.json"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty: one unit of spaces; equal texts give equal media; empty table, no rows."""
    from .media import media_report

    return media_report(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter are `und`; ties go to the first language; empty table, no rows."""
    from .language import language_report

    return language_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_token_records": op2_token_records,
    "op3_piece_counts": op3_piece_counts,
    "op4_media": op4_media,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality": op6_quality,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language": op9_language,
    "op10_source_mix": op10_source_mix,
}
