"""Corpus pipeline: languages, near duplicates, benchmark passages, mixture, token shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewright.llm import contamination, jaccard, langid, mixing, wavelet
from lakewright.llm.queries import tokenizer_path
from lakewright.session import materialize
from lakewright.sources.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language."""
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each class of near copies."""
    return jaccard.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    hits = contamination.phrase_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.where("n_hit = 0").select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins documents so that the domains reach their token shares."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and reads back what they hold of each document."""
    return wavelet.read_shards(spark, wavelet.write_shards(docs, tokenizer_path()))


STAGES = [
    ("language identification", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_sources),
    ("token shards", write_tokens),
]
# Learned models, similarity classes and token ids are beyond SQL; tests/llm compares each stage with a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
