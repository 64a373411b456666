"""Query op4: toxicity of the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm.common import read
from kinograph.llm.toxicity import fit_labels, remainder, score


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its score and whether labels of its kind were held out."""
    docs = read(spark, sf_dir, "documents")
    machine = fit_labels(docs, read(spark, sf_dir, "labels"))
    return score(docs, machine).select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict = {}
