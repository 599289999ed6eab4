"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    chat_format,
    decontaminate,
    fill_middle,
    filter_audit,
    license_scan,
    mixing,
    passage_dedup,
    piece_encode,
    quality_rules,
    secret_scan,
    toxicity,
)
from tidemark.llm.common import read
from tidemark.llm.ngram_join import similar_components
from tidemark.llm.url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Components of texts whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return similar_components(read(spark, sf, "documents"), k=4, percent=85)


@query
def op1_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict, rule and glob of every page's URL."""
    return judge_urls(read(spark, sf, "pages"))


@query
def op2_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Every secret candidate of every document with its forest score."""
    return secret_scan.scan(read(spark, sf, "documents"))


@query
def op3_mixing_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Words that a mix by weights 1, 2, 3 takes from every document."""
    return mixing.mix(read(spark, sf, "documents"))


@query
def op6_license_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Base phrases and license labels of every document."""
    return license_scan.scan(read(spark, sf, "documents")).drop("detections")


@query
def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality_rules.judge(read(spark, sf, "documents")).drop("text_hash")


@query
def op8_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """Every message as canonical JSON with its call link, validity and level."""
    return chat_format.format_conversations(read(spark, sf, "conversations"))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Every region of a document that is a benchmark item within the edit budget."""
    return decontaminate.contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query
def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage of 50 words or more that a document shares with an earlier one."""
    return passage_dedup.repeated_passages(read(spark, sf, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document, learned from labels outside the held-out fold."""
    return toxicity.score_documents(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query
def op11_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    """Form, cuts and hashes of every document's fill-in-middle output and of the text taken back from it."""
    return fill_middle.digests(fill_middle.transform(read(spark, sf, "documents")))


@query
def op12_filter_interaction_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What each of five filters keeps, removes and loses at every step of every order, per source."""
    return filter_audit.audit(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query
def op13_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and spans of every document under a public BPE model, and the text decoded from the ids."""
    import public_tokenizers

    model = piece_encode.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    return piece_encode.digests(piece_encode.encode(read(spark, sf, "documents"), model), model)
