"""Documents to a training mix: language ID, near-duplicates, source weights, tokens. Each stage is written and reread.

Every stage takes nulls in any column, repeated rows, texts of any length and an empty table. A null or empty text is in
no language and goes in the first stage; rows without a doc_id stay, one of each group; repeated rows are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import bpe, langid, mixing, simhash
from emberwatch.llm.queries import BYTE_BPE, DOMAIN
from emberwatch.session import checkpointed, load_table

MIX = mixing.Mix(weights={"lang": {"en": 4, "de": 2}}, budget_share=0.9, max_epochs=2, seed=7)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text is in one of the languages that the corpus itself teaches."""
    return langid.keep_identified(docs, langid.train_filter(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies."""
    return simhash.one_of_each_group(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the mix; a document in two epochs is two rows."""
    return mixing.draw(docs, F.expr(DOMAIN), MIX)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes each drawn document."""
    return bpe.round_trips(docs, BYTE_BPE)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_round_trip", bpe_round_trip),
]

#: Bloom filters, XXH64 and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return docs
