"""Registered queries of the operators: each applies one to its whole table with production parameters.

`ORACLE_SQL` has the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placerank.llm.chat import chat_report
from placerank.llm.collocations import collocations
from placerank.llm.common import read
from placerank.llm.decontaminate import contaminated
from placerank.llm.language import predict_languages
from placerank.llm.mixing import mix_report
from placerank.llm.near_dedup import near_duplicates
from placerank.llm.oracles import ORACLE_SQL
from placerank.llm.page_text import extract_pages
from placerank.llm.quality import quality_verdicts
from placerank.llm.secrets import scan
from placerank.llm.sharding import shard
from placerank.llm.token_files import token_table
from placerank.llm.url_filters import bad_pages, url_verdicts
from placerank.llm.vector_codes import vector_codes


def tokenizer_file() -> str:
    """The public tokenizer's file; its place is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_report(read(spark, sf_dir, "conversations"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(read(spark, sf_dir, "documents"), tokenizer_file())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all `embeddings`: 8 parts, 16 entries, 6 rounds."""
    return vector_codes(read(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of all `documents`."""
    return collocations(read(spark, sf_dir, "documents"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the url of every page; `labels` of the pages' ids are their outcomes."""
    return url_verdicts(read(spark, sf_dir, "pages"), bad_pages(read(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_quality_rules, op3_decontamination, op4_near_dedup, op5_page_text, op6_token_files, op7_mixing,
        op8_secret_scan, op9_language_id, op10_sharding, op11_vector_codes, op12_collocations, op13_url_filters,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
