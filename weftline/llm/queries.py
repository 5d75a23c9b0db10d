"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import class_lm, decontaminate, licences, parity_join, piece_codec, token_counts, token_files, toxicity, url_filter
from weftline.llm.common import table
from weftline.llm.quality import quality_report

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and component at a Jaccard similarity of 0.9 or more over three-word shingles."""
    return parity_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), url_filter.default_labelled(), URL_RULES)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest and licence."""
    return licences.licence_matches(table(spark, sf_dir, "documents"), licences.known_licences(spark))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token files."""
    return token_files.token_file_digest(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and whether they decode to its text."""
    return piece_codec.encode_and_check(table(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability by the class model, and by the add-one base."""
    return class_lm.score(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    return quality_report(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def licence_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's operator where there is something to find: documents of which two in three are made known licences, with other spellings, case and copyright lines."""
    return licences.licence_matches(licences.variants(table(spark, sf_dir, "documents")), licences.known_licences(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_url_filters, op3_decontamination, op4_license_scan, op5_toxicity, op6_token_files, op7_sentencepiece, op8_lm_scores, op9_quality_rules, op10_token_counts, licence_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontaminate.oracle(), "op4_license_scan": licences.oracle(), "licence_variants": licences.oracle(f"({licences.variants_sql()})")}
