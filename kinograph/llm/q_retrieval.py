"""Query op12: the documents table packed by lexical retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinograph.llm.common import read
from kinograph.llm.retrieval_packing import pack_by_retrieval


def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document: where it begins, its ids' checksum, and its sequence and place."""
    import public_tokenizers

    return pack_by_retrieval(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES = {"op12_retrieval_packing": op12_retrieval_packing}
ORACLES: dict = {}
