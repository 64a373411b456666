"""Query op2: repeated passages of the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm.common import read, row_key
from kinograph.llm.substring_dedup import repeated_spans


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its repeated bytes, the spans that go and who keeps the first copies."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    spans = repeated_spans(docs)
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row"), F.octet_length("text").cast("long").alias("n_bytes"))
    removed = F.aggregate("gone", F.lit(0).cast("long"), lambda a, g: a + g["end"] - g["begin"])
    return rows.join(spans, "row", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("shared", F.lit(0)).alias("shared_bytes"),
        F.coalesce(removed, F.lit(0).cast("long")).alias("removed_bytes"),
        F.coalesce(F.size("gone") > 0, F.lit(False)).alias("has_repeats"),
        F.coalesce("first_ids", F.array().cast("array<long>")).alias("first_ids"),
        F.coalesce("gone", F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("removed_spans"),
    )


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES: dict = {}
