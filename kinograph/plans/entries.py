"""Whole runs and their edges: inputs, fixtures, detection from end to end, signed messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.functions.signing import hmac_sha256, pads
from kinograph.operators.edges import boxes
from kinograph.operators.grid import regions
from kinograph.plans.jobs import _J, _jobs
from kinograph.plans.oracle import GR, PX
from kinograph.plans.overlay import _BOXED, _SHOWN, OPAQUE, SEE_THROUGH, _regions, _shown
from kinograph.sources.tables import frames, pixels, table

KEY = b"dispatch-token"


def collect_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs named one by one count whatever they are; those from a folder only with a wanted suffix; each once, in order of name."""
    keys = table(spark, sf_dir, "pages").select("page_id", "url")
    named = keys.where("page_id % 50 = 0")
    folder = keys.where(F.col("url").rlike(r"/\d+$"))
    return named.union(folder).distinct()


def fixture_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip of a frame for each part, its field as bright as the part's size says, with a mark that stays; sums of each frame inside and outside it."""
    frame = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("t"), F.col("p_size").cast("long").alias("size"))
    px = frame.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(63))))
    x, y = F.col("p") % 8, F.floor(F.col("p") / 8)
    level = F.when(x.between(2, 4) & y.between(2, 4), 200).otherwise(4 * F.col("size") + x + y) % 256
    return px.select("t", level.alias("v"), (x.between(2, 4) & y.between(2, 4)).alias("mark")).groupBy("t").agg(F.sum(F.when(F.col("mark"), F.col("v"))).alias("inside"), F.sum(F.when(~F.col("mark"), F.col("v"))).alias("outside"))


def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job's record, the filter pushed to the scan."""
    return _jobs(spark, sf_dir).where("job = 77").select("job", "state", "outcome")


def job_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that stay when ended jobs of urgent priority are deleted."""
    gone = _jobs(spark, sf_dir).where("priority = '1-URGENT' AND state = 'succeeded'").select("job")
    return _jobs(spark, sf_dir).join(gone, "job", "left_anti").groupBy("state").agg(F.count("*").alias("jobs"))


def webhook_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ended jobs' messages, canonical, and their signatures over version, time and body."""
    j = _jobs(spark, sf_dir).where("state = 'succeeded'")
    body = F.concat(F.lit('{"jobId":'), F.col("job").cast("string"), F.lit(',"state":"'), F.col("state"), F.lit('"}'))
    signed = F.concat(F.lit("v1:"), F.col("finished").cast("string"), F.lit(":"), body)
    return j.select("job", body.alias("body"), hmac_sha256(KEY, signed).alias("signature"))


def detect_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip's mark from end to end: locked edges, regions of 4 pixels, the box around them, plausibility, kind of mark."""
    found = regions(_shown(spark, sf_dir), "clip")
    large = found.groupBy("clip", "region").count().where("count >= 4").select("clip", "region")
    box = boxes(found.join(large, ["clip", "region"], "left_semi"), "clip")
    std = pixels(frames(spark, sf_dir), "px").groupBy("clip", "y", "x").agg(F.stddev_pop("px").alias("s"))
    both = std.withColumnsRenamed({"x": "px_x", "y": "px_y"}).join(box, "clip")
    inside = F.col("px_x").between(F.col("x"), F.col("x") + F.col("w") - 1) & F.col("px_y").between(F.col("y"), F.col("y") + F.col("h") - 1)
    out = both.groupBy("clip", "x", "y", "w", "h", "n").agg(F.avg(F.when(inside, F.col("s"))).alias("i"), F.avg(F.when(~inside, F.col("s"))).alias("o"))
    ratio = F.try_divide("i", "o")
    kind = F.when(ratio.isNull(), "unclear").when(ratio < OPAQUE, "opaque").when(ratio > SEE_THROUGH, "semi").otherwise("unclear")
    return out.select("clip", "x", "y", "w", "h", "n", (F.col("w") * F.col("h") <= 0.5 * 64).alias("plausible"), F.round(ratio, 6).alias("ratio"), kind.alias("kind"))


QUERIES = {f.__name__: f for f in (collect_inputs, fixture_frames, job_lookup, job_delete, webhook_signature, detect_overlay)}

_HEX = [p.hex() for p in pads(KEY)]
_INSIDE = "s.x BETWEEN b.x AND b.x + w - 1 AND s.y BETWEEN b.y AND b.y + h - 1"
ORACLES = {
    "collect_inputs": r"SELECT DISTINCT page_id, url FROM pages WHERE page_id % 50 = 0 OR regexp_matches(url, '/\d+$')",
    "fixture_frames": """WITH p AS (SELECT p_partkey AS t, p_size::BIGINT AS size, p % 8 AS x, p // 8 AS y FROM part, range(64) b(p)), v AS (SELECT t, x BETWEEN 2 AND 4 AND y BETWEEN 2 AND 4 AS m, CASE WHEN x BETWEEN 2 AND 4 AND y BETWEEN 2 AND 4 THEN 200 ELSE (4 * size + x + y) END % 256 AS v FROM p)
      SELECT t, sum(v) FILTER (m)::BIGINT AS inside, sum(v) FILTER (NOT m)::BIGINT AS outside FROM v GROUP BY t""",
    "job_lookup": f"WITH {_J} SELECT job, state, outcome FROM j WHERE job = 77",
    "job_delete": f"WITH {_J} SELECT state, count(*) AS jobs FROM j WHERE NOT coalesce(priority = '1-URGENT' AND state = 'succeeded', false) GROUP BY state",
    "webhook_signature": f"""WITH {_J}, b AS (SELECT job, '{{"jobId":' || job || ',"state":"' || state || '"}}' AS body, finished FROM j WHERE state = 'succeeded')
      SELECT job, body, sha256(unhex('{_HEX[1]}' || sha256(unhex('{_HEX[0]}' || hex(encode('v1:' || finished || ':' || body)))))) AS signature FROM b""",
    "detect_overlay": f"""WITH RECURSIVE {GR}, {_SHOWN}, {_regions('shown')}, large AS (SELECT clip, region FROM region GROUP BY ALL HAVING count(*) >= 4), b AS (SELECT clip, {_BOXED} FROM region SEMI JOIN large USING (clip, region) GROUP BY clip),
      {PX}, s AS (SELECT clip, y, x, stddev_pop(v) AS s FROM px GROUP BY ALL), m AS (SELECT b.clip, b.x, b.y, w, h, n, avg(s) FILTER ({_INSIDE}) AS i, avg(s) FILTER (NOT ({_INSIDE})) AS o FROM s JOIN b ON s.clip = b.clip GROUP BY ALL)
      SELECT clip, x, y, w, h, n, w * h <= 32 AS plausible, round(i / o, 6) AS ratio, CASE WHEN i / o < {OPAQUE} THEN 'opaque' WHEN i / o > {SEE_THROUGH} THEN 'semi' ELSE 'unclear' END AS kind FROM m""",
}
