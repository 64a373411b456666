"""Query op11: the embeddings table as codes of four parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinograph.llm.common import read
from kinograph.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, compress


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: its code, its error, its label's error and the digest of the codebooks."""
    return compress(read(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds written out; inner products of whole numbers are exact in double precision."""
    near = """n{r} AS MATERIALIZED (SELECT rid, p, arg_min(k, (d, k)) AS k, min(d)::BIGINT AS d FROM
      (SELECT rid, part.p, k, xx + yy - 2 * list_inner_product(x, y) AS d FROM part JOIN b{r} ON b{r}.p = part.p) GROUP BY rid, p)"""
    book = """b{s} AS MATERIALIZED (SELECT b{r}.p, b{r}.k, coalesce(y2, y) AS y, list_inner_product(coalesce(y2, y), coalesce(y2, y)) AS yy FROM b{r} LEFT JOIN
      (SELECT p, k, list(m ORDER BY j) AS y2 FROM (SELECT part.p, n{r}.k, j, floor(sum(x[j]) / count(*))::DOUBLE AS m FROM part JOIN n{r} USING (rid, p), range(1, (SELECT size FROM shape) + 1) t(j)
         GROUP BY part.p, n{r}.k, j) GROUP BY p, k) u ON u.p = b{r}.p AND u.k = b{r}.k)"""
    rounds = ", ".join(near.format(r=r) + ", " + book.format(r=r, s=r + 1) for r in range(ROUNDS))
    return f"""
    WITH v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS rid, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
    shape AS (SELECT max(len(e)) // {PARTS} AS size FROM v),
    part AS MATERIALIZED (SELECT rid, p, x, list_inner_product(x, x) AS xx FROM (SELECT rid, p, e[p * size + 1 : p * size + size] AS x FROM v, shape, range({PARTS}) t(p))),
    b0 AS MATERIALIZED (SELECT p, rid - 1 AS k, x AS y, xx AS yy FROM part WHERE rid <= {ENTRIES}), {rounds}, {near.format(r=ROUNDS)},
    s AS (SELECT sha256(string_agg(list_aggregate(list_transform(y, lambda c: c::BIGINT), 'string_agg', ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{ROUNDS}),
    c AS (SELECT rid, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM n{ROUNDS} GROUP BY rid)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (rid), s"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLES = {"op11_vector_codes": _oracle()}
