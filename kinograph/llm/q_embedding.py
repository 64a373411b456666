"""Query op8: near-duplicate vectors of the whole embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinograph.llm.common import read
from kinograph.llm.embedding_dedup import near_duplicates


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: its links, its component's smallest id and whether it is that one."""
    out = near_duplicates(read(spark, sf_dir, "embeddings"))
    return out.selectExpr("vec_id", "n_links", "component_id", "vec_id = component_id AS kept")


QUERIES = {"op8_embedding_dedup": op8_embedding_dedup}
ORACLES = {
    "op8_embedding_dedup": """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) AS n FROM embeddings
      WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true) AND list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.n = b.n AND list_cosine_similarity(a.e, b.e) >= 0.95),
    r AS (SELECT DISTINCT a AS vec_id, a AS seen FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.seen),
    c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id), d AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN d USING (vec_id) LEFT JOIN c USING (vec_id)"""
}
