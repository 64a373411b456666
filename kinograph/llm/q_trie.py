"""Query op13: the prefix trie of the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinograph.llm.common import read
from kinograph.llm.conversation_trie import FAMILY, HEAD, WORD, prefix_trie


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct beginning of a rebuilt conversation."""
    return prefix_trie(read(spark, sf_dir, "conversations"))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
#: CRC-32 of the decimal id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""
#: Every prefix of every conversation as a string of marks, grouped.
ORACLES = {
    "op13_prefix_trie": f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    m AS (SELECT conv_id, sha256(length(r) || ':' || r || x) AS mark, len(regexp_extract_all(x, '{WORD}')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS i FROM t),
    c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {HEAD} AS h FROM (SELECT DISTINCT conv_id FROM t)),
    b AS (SELECT c.conv_id, 0 AS s, i, mark, words FROM c JOIN m ON m.conv_id = c.base AND i <= h UNION ALL SELECT c.conv_id, 1, i, mark, words FROM c JOIN m ON m.conv_id = c.conv_id AND i > h),
    p AS (SELECT conv_id, row_number() OVER w AS d, words, string_agg(mark, '') OVER w AS key FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY s, i) UNION ALL SELECT conv_id, 0, 0, '' FROM c),
    e AS (SELECT conv_id, arg_max(key, d) AS key FROM p GROUP BY conv_id),
    n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words, left(key, greatest(length(key) - 64, 0)) AS up FROM p GROUP BY key, d),
    k AS (SELECT up AS key, count(*) AS children FROM n WHERE d > 0 GROUP BY up),
    s AS (SELECT u.key, sum((n.n - 1) * n.words)::BIGINT AS saved, count(*) FILTER (children IS NULL) AS leaves
          FROM (SELECT DISTINCT a.key, z.key AS below FROM p a JOIN p z ON a.conv_id = z.conv_id AND z.d >= a.d) u JOIN n ON n.key = below LEFT JOIN k ON k.key = below GROUP BY u.key),
    f AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM e GROUP BY key)
    SELECT n.conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN q.conv_id END AS parent_conv_id, n.n AS n_convs, coalesce(children, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens,
           sha256(coalesce(ids, '')) AS ends_sha256
    FROM n JOIN s USING (key) LEFT JOIN k USING (key) LEFT JOIN f USING (key) LEFT JOIN n q ON q.key = n.up"""
}
