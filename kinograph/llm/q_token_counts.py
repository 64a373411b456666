"""Query op5: token counts of the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinograph.llm.common import read
from kinograph.llm.token_counts import count_tokens, load_vocabulary


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its tokens under the best segmentation."""
    return count_tokens(read(spark, sf_dir, "documents"), load_vocabulary())


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict = {}
