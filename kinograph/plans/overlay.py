"""Pixel-locked structure: what stays put while the picture changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.operators.edges import PERSIST_FIND, boxes, locked_edges, sweep, with_gradients
from kinograph.operators.grid import regions
from kinograph.plans.oracle import GR, PX
from kinograph.sources.tables import frames, pixels

EDGE = 0.1
#: Thresholds of the sweep, in thousandths here because pixels are about 0.1.
SWEEP = [t / 1000 for t in (10.0, 7.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.5)]
#: A box is plausible within these shares of the frame, of the searched region's area and of its sides;
#: neighbours in the sweep agree within a tenth.
LEAST_SHARE, MOST_SHARE, MOST_OF_ROI, MOST_SPAN, AGREE = 0.0005, 0.10, 0.35, 0.75, 0.10
#: The tile is the searched region, a quarter of its frame; one clip's mean gradients are larger than all clips'.
ROI, FRAME_AREA = (8, 8), 256
CLIP_SWEEP = [t / 1000 for t in (54.0, 50.0, 46.0, 43.0, 40.0, 37.0, 34.0, 31.0)]
#: A mark is opaque or see-through by its deviation against the background's.
OPAQUE, SEE_THROUGH = 0.15, 0.40
BOX = (2, 2, 4, 4)
COLLAR = 1
SHOW = 0.02


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


def overlay_locked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(locked_edges(with_gradients(frames(spark, sf_dir)), EDGE))


def overlay_locked_edges_by_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(locked_edges(with_gradients(frames(spark, sf_dir)), EDGE, "clip"))


def overlay_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes(sweep(with_gradients(frames(spark, sf_dir)), SWEEP), "i", "threshold")
    return found.withColumn("area", F.col("w") * F.col("h"))


def plausible(area, w, h):
    """Whether a box can be a mark: neither a speck nor too much of the frame or of the region searched, nor as wide or high as that."""
    shares = (area >= LEAST_SHARE * FRAME_AREA) & (area <= MOST_SHARE * FRAME_AREA) & (area <= MOST_OF_ROI * ROI[0] * ROI[1])
    return shares & (w <= MOST_SPAN * ROI[0]) & (h <= MOST_SPAN * ROI[1])


def overlay_stable_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each clip, the largest plausible box that a neighbour in the sweep confirms (of equals the first), else the first plausible one."""
    each = boxes(sweep(with_gradients(frames(spark, sf_dir)), CLIP_SWEEP, "clip"), "clip", "i", "threshold").withColumn("area", F.col("w") * F.col("h"))
    found = each.where(plausible(F.col("area"), F.col("w"), F.col("h")))
    # a clip's boxes are one per threshold, eight at most
    listed = found.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("i", "threshold", "x", "y", "w", "h", "area"))).alias("boxes"))
    agrees = lambda a, b: (F.abs(a["i"] - b["i"]) == 1) & (F.abs(a["area"] - b["area"]) <= AGREE * F.greatest(a["area"], b["area"]))
    stable = F.filter("boxes", lambda a: F.exists("boxes", lambda b: agrees(a, b)))
    best = F.aggregate(stable, stable[0], lambda m, a: F.when(a["area"] > m["area"], a).otherwise(m))
    chosen = listed.select("clip", F.when(F.size(stable) > 0, best).otherwise(F.col("boxes")[0]).alias("b"), (F.size(stable) > 0).alias("is_stable"))
    return chosen.select("clip", "b.*", "is_stable")


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = locked_edges(with_gradients(frames(spark, sf_dir)), SHOW, "clip")
    return found.where((F.greatest("edge_x", "edge_y") > SHOW) & (F.col("persistence") >= PERSIST_FIND)).select("clip", "y", "x")


def overlay_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of marked pixels of each clip, and whether they are large enough to count."""
    found = boxes(regions(_shown(spark, sf_dir), "clip"), "clip", "region")
    return found.withColumn("counts", F.col("n") >= 4)


def overlay_union_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around all regions of at least 4 pixels of each clip."""
    found = regions(_shown(spark, sf_dir), "clip")
    large = found.groupBy("clip", "region").count().where("count >= 4").select("clip", "region")
    return boxes(found.join(large, ["clip", "region"], "left_semi"), "clip")


def overlay_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak regions (over 0.06 of the strongest edge) that touch a strong pixel (over 0.20)."""
    stats = locked_edges(with_gradients(frames(spark, sf_dir)), SHOW, "clip").select("clip", "y", "x", F.greatest("edge_x", "edge_y").alias("e"))
    top = stats.groupBy("clip").agg(F.max("e").alias("top"))
    scaled = stats.join(top, "clip").select("clip", "y", "x", (F.col("e") / F.col("top")).alias("s"))
    weak = regions(scaled.where("s > 0.35"), "clip")
    strong = weak.join(scaled.where("s > 0.8"), ["clip", "y", "x"], "left_semi").select("clip", "region").distinct()
    return boxes(weak.join(strong, ["clip", "region"], "left_semi"), "clip", "region")


def overlay_opacity_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean deviation inside the box against outside it and its collar, and what kind of mark that means."""
    x, y, w, h = BOX
    std = pixels(frames(spark, sf_dir), "px").groupBy("clip", "y", "x").agg(F.stddev_pop("px").alias("std"))
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    around = F.col("x").between(x - COLLAR, x + w - 1 + COLLAR) & F.col("y").between(y - COLLAR, y + h - 1 + COLLAR)
    both = std.groupBy("clip").agg(F.avg(F.when(inside, F.col("std"))).alias("inside_std"), F.avg(F.when(~around, F.col("std"))).alias("outside_std"))
    ratio = F.try_divide("inside_std", "outside_std")
    kind = F.when(ratio < OPAQUE, "opaque").when(ratio > SEE_THROUGH, "semi").otherwise("unclear")
    return _rounded(both.select("*", ratio.alias("ratio"), kind.alias("opacity")))


def fixed_edge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge strength of every pixel, stretched between the median and the 99.8th percentile."""
    stats = locked_edges(with_gradients(frames(spark, sf_dir)), EDGE).select("y", "x", (F.col("edge_x") + F.col("edge_y")).alias("e"))
    span = stats.agg(F.expr("percentile(e, 0.5)").alias("low"), F.expr("percentile(e, 0.998)").alias("high"))
    scaled = F.least(F.greatest((F.col("e") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    return _rounded(stats.crossJoin(F.broadcast(span)).select("y", "x", scaled.alias("strength")))


QUERIES = {f.__name__: f for f in (overlay_locked_edges, overlay_locked_edges_by_clip, overlay_threshold_sweep, overlay_stable_box, overlay_components, overlay_union_box, overlay_hysteresis, overlay_opacity_class, fixed_edge_scan)}

_STATS = "round(abs(avg(dx)), 6) AS edge_x, round(abs(avg(dy)), 6) AS edge_y, round(stddev_pop(v), 6) AS std, round(avg(v), 6) AS mean, round(avg(CASE WHEN abs(dx) > {t} OR abs(dy) > {t} THEN 1 ELSE 0 END), 6) AS persistence, count(*) AS n_frames"
_SWEPT = f"""{GR}, th AS (SELECT * FROM (VALUES {', '.join(f'({i}::BIGINT, {t}::DOUBLE)' for i, t in enumerate(SWEEP))}) v(i, threshold)),
 marked AS (SELECT i, threshold, y, x FROM gr, th GROUP BY ALL HAVING (abs(avg(dx)) > threshold OR abs(avg(dy)) > threshold)
   AND avg(CASE WHEN abs(dx) > threshold OR abs(dy) > threshold THEN 1 ELSE 0 END) >= {PERSIST_FIND}),
 swept AS (SELECT i, threshold, count(*) AS n, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h,
   (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS area FROM marked GROUP BY ALL)"""


def _regions(source: str) -> str:
    """8-connected regions of ``source`` (clip, y, x), by reachability."""
    return f"""reach AS (SELECT clip, y, x, y AS ry, x AS rx FROM {source}
   UNION SELECT m.clip, m.y, m.x, r.ry, r.rx FROM reach r JOIN {source} m ON m.clip = r.clip AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1),
 region AS (SELECT clip, y, x, min(ry * 1048576 + rx) AS region FROM reach GROUP BY ALL)"""


_SHOWN = f"""shown AS (SELECT clip, y, x FROM gr GROUP BY ALL HAVING greatest(abs(avg(dx)), abs(avg(dy))) > {SHOW}
   AND avg(CASE WHEN abs(dx) > {SHOW} OR abs(dy) > {SHOW} THEN 1 ELSE 0 END) >= {PERSIST_FIND})"""
_BOXED = "count(*) AS n, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h"
_IN = f"x BETWEEN {BOX[0]} AND {BOX[0] + BOX[2] - 1} AND y BETWEEN {BOX[1]} AND {BOX[1] + BOX[3] - 1}"
_AROUND = f"x BETWEEN {BOX[0] - COLLAR} AND {BOX[0] + BOX[2] - 1 + COLLAR} AND y BETWEEN {BOX[1] - COLLAR} AND {BOX[1] + BOX[3] - 1 + COLLAR}"

ORACLES = {
    "overlay_locked_edges": f"WITH {GR} SELECT y, x, {_STATS.format(t=EDGE)} FROM gr GROUP BY y, x",
    "overlay_locked_edges_by_clip": f"WITH {GR} SELECT clip, y, x, {_STATS.format(t=EDGE)} FROM gr GROUP BY clip, y, x",
    "overlay_threshold_sweep": f"WITH {_SWEPT} SELECT * FROM swept",
    "overlay_stable_box": f"""WITH {GR}, th AS (SELECT * FROM (VALUES {', '.join(f'({i}::BIGINT, {t}::DOUBLE)' for i, t in enumerate(CLIP_SWEEP))}) v(i, threshold)),
      marked AS (SELECT clip, i, threshold, y, x FROM gr, th GROUP BY ALL HAVING (abs(avg(dx)) > threshold OR abs(avg(dy)) > threshold)
        AND avg(CASE WHEN abs(dx) > threshold OR abs(dy) > threshold THEN 1 ELSE 0 END) >= {PERSIST_FIND}),
      swept AS (SELECT clip, i, threshold, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM marked GROUP BY ALL),
      ok AS (SELECT *, w * h AS area FROM swept WHERE w * h >= {LEAST_SHARE * FRAME_AREA} AND w * h <= {MOST_SHARE * FRAME_AREA} AND w * h <= {MOST_OF_ROI * ROI[0] * ROI[1]}
        AND w <= {MOST_SPAN * ROI[0]} AND h <= {MOST_SPAN * ROI[1]}),
      judged AS (SELECT a.*, EXISTS (SELECT 1 FROM ok b WHERE b.clip = a.clip AND abs(a.i - b.i) = 1 AND abs(a.area - b.area) <= {AGREE} * greatest(a.area, b.area)) AS is_stable FROM ok a),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY is_stable DESC, CASE WHEN is_stable THEN area ELSE 0 END DESC, i) AS n FROM judged)
      SELECT clip, i, threshold, x, y, w, h, area, is_stable FROM ranked WHERE n = 1""",
    "overlay_components": f"WITH RECURSIVE {GR}, {_SHOWN}, {_regions('shown')} SELECT clip, region, {_BOXED}, count(*) >= 4 AS counts FROM region GROUP BY clip, region",
    "overlay_union_box": f"WITH RECURSIVE {GR}, {_SHOWN}, {_regions('shown')}, large AS (SELECT clip, region FROM region GROUP BY ALL HAVING count(*) >= 4) SELECT clip, {_BOXED} FROM region SEMI JOIN large USING (clip, region) GROUP BY clip",
    "overlay_hysteresis": f"""WITH RECURSIVE {GR}, st AS (SELECT clip, y, x, greatest(abs(avg(dx)), abs(avg(dy))) AS e FROM gr GROUP BY ALL),
      sc AS (SELECT clip, y, x, e / max(e) OVER (PARTITION BY clip) AS s FROM st), weak AS (SELECT clip, y, x FROM sc WHERE s > 0.35), {_regions('weak')},
      strong AS (SELECT DISTINCT clip, region FROM region JOIN sc USING (clip, y, x) WHERE s > 0.8)
      SELECT clip, region, {_BOXED} FROM region SEMI JOIN strong USING (clip, region) GROUP BY clip, region""",
    "overlay_opacity_class": f"""WITH {PX}, st AS (SELECT clip, y, x, stddev_pop(v) AS s FROM px GROUP BY ALL),
      b AS (SELECT clip, avg(s) FILTER ({_IN}) AS i, avg(s) FILTER (NOT ({_AROUND})) AS o FROM st GROUP BY clip)
      SELECT clip, round(i, 6) AS inside_std, round(o, 6) AS outside_std, round(i / o, 6) AS ratio,
        CASE WHEN i / o < {OPAQUE} THEN 'opaque' WHEN i / o > {SEE_THROUGH} THEN 'semi' ELSE 'unclear' END AS opacity FROM b""",
    "fixed_edge_scan": f"""WITH {GR}, st AS (SELECT y, x, abs(avg(dx)) + abs(avg(dy)) AS e FROM gr GROUP BY ALL),
      span AS (SELECT quantile_cont(e, 0.5) AS low, quantile_cont(e, 0.998) AS high FROM st)
      SELECT y, x, round(least(greatest((e - low) / greatest(high - low, 1e-9), 0), 1), 6) AS strength FROM st, span""",
}
