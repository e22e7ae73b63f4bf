"""A corpus pipeline of five stages, each on all that the stage before it kept.

All but the last stage return the columns of documents, as they are, whatever else is among them; each result is written
as Parquet and read again as the next stage's documents.  Null and empty texts fail the base rules of the first stage,
and in the later ones are documents without words: never toxic, copies of each other, of size 0, without tokens.  Null
ids, languages and sources, repeated ids and empty tables are handled as the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import bpe, mixing, ordinal, rules, simhash
from paperloom.llm.common import materialise, table
from paperloom.llm.queries import VOCABULARY
from paperloom.session import on_workers


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that a base rule or a certified cutoff rejects go."""
    return rules.keep_good(docs, "doc_id", "text", "lang", table(spark, sf_dir, "labels"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that are more likely than not of severity 1 or more go."""
    on_workers(spark)
    model = ordinal.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    return ordinal.keep_civil(docs, "text", model)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each class of similar texts (five-word shingles, similarity 0.8) the smallest id stays."""
    on_workers(spark)
    return simhash.keep_one_of_each(docs, "doc_id", "text", words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as its source's target takes it, which may be never."""
    return mixing.draw_mix(docs, "doc_id", "text", "source")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token ids of every text, their number and digests; columns of these names are replaced."""
    on_workers(spark)
    return bpe.encode_bpe(docs, "text", public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).drop("text")


STAGES = [("quality_rules", keep_good), ("toxicity", keep_civil), ("near_dedup", keep_one_copy), ("mixing", mix_sources), ("byte_bpe", encode)]

#: The toxicity model is fitted by iteration and SimHash uses a 64-bit hash that SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
