"""Query op1: pages through WARC archives and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm.common import read, scratch_path
from kinograph.llm.warc import read_warc, write_warc


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page, from its record as read back."""
    path = scratch_path(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), path)
    got = read_warc(spark, path)
    header = lambda name: F.element_at("headers", name)
    page = lambda name: F.regexp_extract(header(name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    response = header("warc-type") == "response"
    return got.select(
        page("warc-record-id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(header("x-payload-length").try_cast("long")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_replace(header("warc-payload-digest"), "^sha256:", "")).alias("payload_digest"),
        header("warc-type").alias("record_type"),
        page("warc-refers-to").alias("refers_to"),
    )


QUERIES = {"op1_warc": op1_warc}
ORACLES = {
    "op1_warc": """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
    f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
    SELECT page_id, n AS payload_bytes, d AS payload_digest,
           CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to
    FROM f"""
}
