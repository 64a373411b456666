"""A corpus pipeline: five operators, each on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and gives a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last give the columns of
``docs``. Nulls, ties, repeated rows and empty tables go as in the operators: a row with a null doc_id is
a document, equal rows are near duplicates of which one stays, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm import near_copies
from kinograph.llm.common import drop_rows, materialize
from kinograph.llm.decontaminate import find_contamination
from kinograph.llm.packing import pack_documents
from kinograph.llm.substring_dedup import remove_repeats
from kinograph.llm.token_counts import load_vocabulary
from kinograph.llm.toxicity import drop_toxic as without_toxic
from kinograph.llm.toxicity import fit_labels


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject: those it scores under 0.5, null and empty texts among them.

    Equal rows have equal scores and go or stay together; without labels nothing goes.
    """
    return without_toxic(docs, fit_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles at a similarity of 0.8 or more.

    The one of the smallest doc_id stays (a null doc_id comes last; ties go by the row's key), of equal rows one.
    Texts without words, null or not, are near duplicates of each other.
    """
    return near_copies.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that one of a smaller doc_id has; n_chars counts what is left.

    A null text stays null, a text that is all repeats becomes empty; rows of one doc_id take nothing from each other.
    """
    return remove_repeats(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage stands exactly; null and empty texts stay, equal rows go or stay together."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drop_rows(docs, found.where(F.exists("matches", lambda m: m["exact"])).select("row").distinct())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their bins; a null or empty text is one end token, equal rows are packed each."""
    return pack_documents(docs, load_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL cannot express the stages; the tests hold each against its operator and a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
