"""The queries of this package over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slotframe.llm import exact_dedup, html_text, mixing, quality, sentence_pieces, simhash, token_file, top_k, url_filter, warc
from slotframe.llm.common import table

#: Vocabulary files; any path will do in their place.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), PIECES)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.exact_top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = url_filter.entry_table(spark, (*url_filter.RULES, *url_filter.LISTED))
    return url_filter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), listed)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_digest(table(spark, sf_dir, "documents", "doc_id", "text"), BYTES)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_sentence_pieces, op3_exact_dedup, op4_exact_top_k, op5_quality, op6_html_text, op7_url_filter, op8_warc, op9_token_file, op10_simhash)
}
#: op4 compares all pairs in SQL; at the size of the SQL check that is a few thousand products.
ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_exact_top_k": top_k.ORACLE,
    "op7_url_filter": url_filter.oracle_sql((*url_filter.RULES, *url_filter.LISTED)),
    "op8_warc": warc.ORACLE,
}
