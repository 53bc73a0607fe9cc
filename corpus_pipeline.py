"""A corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of docs. A stage works on
all rows that the one before kept. Cases are those of the operators: null texts count as empty, repeated
rows are handled row by row, an empty table stays empty, extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veristrata.llm import exact_dedup, jaccard_join, mixing, quality, sentencepiece_bpe
from veristrata.llm.common import materialize, table
from veristrata.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets, the one with the smallest doc_id stays."""
    return jaccard_join.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of the mixture, as digests."""
    return sentencepiece_bpe.sentencepiece_roundtrip(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode),
]
#: SQL can't express the classifier; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
