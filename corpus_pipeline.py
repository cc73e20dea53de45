"""The corpus pipeline: language ID, exact dedup, near-dedup by five-word Jaccard, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and reads all that its predecessor kept. The first four return the columns of
``documents`` with any others that the table has, under any names, the last one row per packed piece. An empty table
passes as one. No stage drops a clean document: language ID rejects texts without a
letter and those no learned language claims, the dedups keep one of each group, and mixing has a floor of one copy, so
it only repeats documents of scarce domains. Packing places every copy.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strictpast.llm import exact_dedup, langid, mixing, near_dedup, packing
from strictpast.llm.common import table, written

#: Shares of the packed tokens by domain that mixing aims at.
TARGETS = {"high": 0.80, "low": 0.10, "toxic": 0.10}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found. Null, empty and letterless texts go; null ids and repeated rows are judged as any other."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text up to white space, that of the smallest id; a null id stays where no other has the text."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts, that of the smallest id, repeated rows once; rows with a null id all stay."""
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once at least, those of scarce domains repeated; rows with a null id once. Null texts weigh nothing."""
    labels = mixing.labelled_domains(table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, labels, mixing.Settings(targets=TARGETS), floor=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all rows with their places; a null or empty text is its end id alone, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash", near), ("mixing", mix), ("packing", pack)]

#: Learned models, iterated components and tokenization are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
