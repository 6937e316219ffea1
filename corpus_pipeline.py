"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's docs.

1. Language ID: documents whose language is rejected go.
2. Exact dedup: of documents of equal text, the one of the smallest doc_id stays.
3. N-gram Jaccard join: of near copies, the document of the smallest doc_id in each component stays.
4. Mixing: each document stays as often as the mix to the sources' target weights takes it.
5. Pieces: encode and decode; the result has the digests of each document's ids and of the text decoded from them.

A null or empty text, or one without a letter, has no language and goes in stage 1, as do texts of a few letters that
all languages' dictionaries compress alike. Null ids stay, in stage 2 one for each text. Texts of any length are taken
whole. Of ties, the smallest doc_id stays, and of repeated rows one, picked by a hash of their other columns. A null
source is mixed as a source of its own. An empty table gives an empty result in every stage. Other columns, whatever
their names and kinds, are carried through stages 1 to 4; the last stage returns its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cloakwork.llm import exact_dedup, language_id, mixing, ngram_join, piece_bpe
from cloakwork.llm.common import discard, scratch, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: Compression sizes, the mix's draw and the pieces can't be put in SQL; tests hold run() against plain computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage has written for itself, and what it has read, goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with scratch(spark):
            made = stage(spark, before, sf_dir)
            docs = written(made, f"pipeline-{name}")
        discard(before)
    return docs
