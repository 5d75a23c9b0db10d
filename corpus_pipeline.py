"""The document pipeline: quality rules, toxicity, near-duplicate join, benchmark decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept with the columns of documents, and works on all of it.
The first four return rows of docs unchanged; the last returns the pieces of each. run() writes each stage's rows as Parquet to the
shared folder of spark.checkpoint.dir and reads them again, so that no stage is computed twice or lost with an executor.

ORACLE_SQL is None: the toxicity model and the encoding aren't SQL. The tests hold each stage against a brute-force version on that stage's
input (toxicity against its model's scores, whose likelihoods have a brute-force version of their own), and the encoding against the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, parity_join, piece_codec, toxicity
from weftline.llm.common import materialize, release, table
from weftline.llm.quality import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filter(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below 0.7, by a model of the labels that aren't held out."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked at a Jaccard similarity of 0.8 or more over five-word shingles."""
    return parity_join.drop_near_copies(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, piece_ids, round_trip of every document left."""
    return piece_codec.encode_and_check(docs)


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
        release(before)  # the table itself isn't a scratch table and stays
    return STAGES[-1][1](spark, docs, sf_dir)
