"""The segment driver and the part container on frames of the tables, with their SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinograph.operators.segments import Settings, drive, repaired
from kinograph.plans.oracle import WHOLE
from kinograph.sources.containers import container_states, read_container, write_container
from kinograph.sources.scratch import scratch, written
from kinograph.sources.tables import frames

CUT_EVERY, PART_FRAMES, STRIDE = 11, 12, 4
SETTINGS = Settings("steady", least=3, segment=8, overlap=3, part_frames=PART_FRAMES)
LOW, HIGH = 1, 3


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, i, t, px): frames by their number in their clip; those without a clip are clip -1."""
    own = frames(spark, sf_dir).withColumn("clip", F.coalesce("clip", F.lit(-1).cast("long")))
    return own.withColumn("i", F.row_number().over(Window.partitionBy("clip").orderBy("t")).cast("long") - 1)


def segment_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a box filled over their segments and context, in parts of 12 that were committed four of a clip at a time: a pixel in the box and one outside."""
    mask = np.zeros((8, 8), bool)
    mask[2:6, 2:6] = True
    own, path = written(_numbered(spark, sf_dir), "frames"), scratch(spark, "driven")
    drive(own, own.where(F.col("t") % CUT_EVERY == 0).select("clip", "i"), mask, path, SETTINGS, STRIDE)
    return repaired(spark, path).select("clip", "part", "i", F.round(F.col("px")[18], 6).alias("inside"), F.round(F.col("px")[0], 6).alias("outside"))


def _contained(spark: SparkSession, sf_dir: str) -> str:
    own = _numbered(spark, sf_dir)
    size = F.count("*").over(Window.partitionBy("clip"))
    part = F.floor(F.col("i") / PART_FRAMES)
    rows = own.select("clip", part.alias("part"), "i", "t", F.array_max("px").alias("most"), F.least(F.lit(PART_FRAMES).cast("long"), size - part * PART_FRAMES).alias("expected"))
    path = scratch(spark, "container")
    write_container(rows, path, PART_FRAMES)
    return path


def container_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of some parts of every clip: no other part is opened."""
    rows = read_container(spark, _contained(spark, sf_dir)).where(f"part >= {LOW} AND part <= {HIGH}")
    return rows.select("clip", "part", "i", "t", "most")


def container_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a container with their frames, as their names tell."""
    return container_states(spark, _contained(spark, sf_dir))


QUERIES = {f.__name__: f for f in (segment_driver, container_parts, container_inventory)}

_NUMBERED = f"""n AS (SELECT coalesce(label::BIGINT, -1) AS clip, vec_id AS t, row_number() OVER (PARTITION BY coalesce(label, -1) ORDER BY vec_id) - 1 AS i, embedding FROM embeddings
  WHERE {WHOLE} AND len([x FOR x IN embedding IF x IS NULL]) = 0)"""
_OUTSIDE = "list_avg([embedding[p]::DOUBLE FOR p IN range(1, 65) IF NOT ((p - 1) % 8 BETWEEN 2 AND 5 AND (p - 1) // 8 BETWEEN 2 AND 5)])"
_PLAN = f"""{_NUMBERED}, tot AS (SELECT clip, count(*) AS total FROM n GROUP BY clip), cuts AS (SELECT clip, i AS c FROM n WHERE t % {CUT_EVERY} = 0),
  acc AS (SELECT clip, 0::BIGINT AS a FROM tot UNION ALL
    SELECT acc.clip, (SELECT min(c) FROM cuts WHERE cuts.clip = acc.clip AND c >= acc.a + {SETTINGS.least}) FROM acc WHERE acc.a IS NOT NULL),
  st AS (SELECT clip, total, a FROM acc JOIN tot USING (clip) WHERE a = 0 OR total - a >= {SETTINGS.least}),
  sh AS (SELECT clip, a, coalesce(lead(a) OVER (PARTITION BY clip ORDER BY a), total) AS z FROM st),
  sg AS (SELECT clip, a, z, s, least(s + {SETTINGS.segment}, z) AS e FROM (SELECT *, unnest(range(a, z, {SETTINGS.segment})) AS s FROM sh)),
  m AS (SELECT clip, i, {_OUTSIDE} AS v FROM n),
  b AS (SELECT sg.clip, s, e, avg(v) AS v FROM sg JOIN m ON m.clip = sg.clip AND i >= greatest(s - {SETTINGS.overlap}, a) AND i < least(e + {SETTINGS.overlap}, z) GROUP BY ALL)"""
ORACLES = {
    "segment_driver": f"""WITH RECURSIVE {_PLAN} SELECT n.clip, i // {PART_FRAMES} AS part, i, round(v, 6) AS inside, round(embedding[1]::DOUBLE, 6) AS outside
      FROM n JOIN b ON n.clip = b.clip AND i >= s AND i < e""",
    "container_parts": f"WITH {_NUMBERED} SELECT clip, i // {PART_FRAMES} AS part, i, t, list_max(embedding)::DOUBLE AS most FROM n WHERE i // {PART_FRAMES} BETWEEN {LOW} AND {HIGH}",
    "container_inventory": f"WITH {_NUMBERED} SELECT clip, i // {PART_FRAMES} AS part, count(*) AS frames FROM n GROUP BY ALL",
}
