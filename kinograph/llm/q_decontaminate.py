"""Query op3: benchmark passages in the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm.common import read
from kinograph.llm.decontaminate import WINDOW, find_contamination, hit_words

#: Words that a term may stand off its place in a proximity match.
SLOP = 2


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its hit words and the items that stand in it; near_items: found by proximity only."""
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), slop=SLOP)
    ids = lambda exact: F.array_distinct(F.transform(F.filter("matches", lambda m: (m["exact"] == exact) & m["item_id"].isNotNull()), lambda m: m["item_id"]))
    out = found.select("doc_id", "n_words", hit_words(F.col("matches")).alias("n_hit"), ids(True).alias("items"), ids(False).alias("near"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size(F.array_except("near", "items")).cast("long").alias("near_items"),
    )


QUERIES = {"op3_decontaminate": op3_decontaminate}
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op3_decontaminate": f"""
    WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
    tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
    it AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    own AS (SELECT DISTINCT item_id, w[s : s + {WINDOW - 1}] AS win FROM it, range(1, 100000) r(s) WHERE len(w) > 0 AND s <= greatest(len(w) - {WINDOW - 1}, 1)),
    win AS (SELECT win, row_number() OVER () AS wid, len(win) AS n FROM (SELECT DISTINCT win FROM own)),
    wt AS (SELECT wid, n, unnest(win) AS word, generate_subscripts(win, 1) - 1 AS place FROM win),
    fq AS (SELECT word, count(*) AS f FROM tok GROUP BY word),
    an AS (SELECT wid, min_by(word, (f, place)) AS word, min_by(place, (f, place)) AS place FROM wt JOIN fq USING (word) GROUP BY wid HAVING count(*) = any_value(n)),
    cand AS (SELECT DISTINCT doc_id, wid, pos - place + k AS c FROM tok JOIN an USING (word), range(-{SLOP}, {SLOP + 1}) r(k)),
    met AS (SELECT cand.doc_id, cand.wid, c, wt.place, bool_or(pos = c + wt.place) AS sure, any_value(n) AS n
            FROM cand JOIN wt USING (wid) JOIN tok ON tok.doc_id = cand.doc_id AND tok.word = wt.word AND pos BETWEEN c + wt.place - {SLOP} AND c + wt.place + {SLOP} GROUP BY ALL),
    found AS (SELECT doc_id, wid, c, any_value(n) AS n, bool_and(sure) AS exact FROM met GROUP BY doc_id, wid, c HAVING count(*) = any_value(n)),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(c, c + n)) AS p FROM found WHERE exact) GROUP BY doc_id),
    pair AS (SELECT doc_id, item_id, bool_or(exact) AS exact FROM found JOIN win USING (wid) JOIN own USING (win) GROUP BY ALL),
    ids AS (SELECT doc_id, count(*) FILTER (exact) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) FILTER (exact) AS items, count(*) FILTER (NOT exact) AS near_items FROM pair GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated, coalesce(near_items, 0) AS near_items
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""
}
