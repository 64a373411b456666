"""Query op6: SimHash classes over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm.common import read
from kinograph.llm.simhash import near_duplicates


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: fingerprint and the smallest doc_id of its component."""
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLES: dict = {}
