"""Query op7: the whole documents table packed into bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinograph.llm.common import read
from kinograph.llm.packing import pack_documents
from kinograph.llm.token_counts import load_vocabulary


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its bin and place; a bin takes one document of a source and of a SimHash class."""
    return pack_documents(read(spark, sf_dir, "documents"), load_vocabulary())


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict = {}
