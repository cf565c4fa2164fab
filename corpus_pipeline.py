"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept and returns the columns of documents;
the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan.llm import jaccard, language, packing, pii, toxicity
from cuespan.llm.common import crc_mod, read, stage
from cuespan.llm.queries import vocabulary_path

TOXIC_AT = toxicity.THRESHOLD  # what op4 predicts toxic goes
SEQUENCE_TOKENS = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class models score as toxic go. A null or empty text stays."""
    scorer = toxicity.train(docs, read(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return toxicity.without_toxic(docs, scorer, TOXIC_AT)


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; of the others each has a language that fits best."""
    return language.determined(docs, language.train(docs, crc_mod("doc_id", 3) != 1))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 on five-word shingles, the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span is replaced by its kind; n_chars follows the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"), SEQUENCE_TOKENS)


STAGES = [("toxicity", drop_toxic), ("language", drop_undetermined), ("near_duplicates", drop_near_duplicates),
          ("pii", hide_personal_data), ("packing", pack)]

ORACLE_SQL = None  # learned models and packing are not expressible in SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
